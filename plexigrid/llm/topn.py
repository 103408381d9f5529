"""Top N of every group by two-stage salted ranking (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexigrid.operators.skew import salt_of

#: Subgroups into which the rows of a group are hashed; a group of a third of all rows becomes so many tasks.
SALTS = 64


def top_n(df: DataFrame, group: list[str], order: list[Column], ident: str, n: int, salts: int = SALTS) -> DataFrame:
    """The first n rows of every group in the given order, equal ones by ident ascending, with column place from 1.

    Rows equal in everything are one. Stage one hashes ident into subgroups and keeps n of each;
    stage two ranks what is left, at most n * salts rows a group. The order is total because ident
    ends it, so that any run returns the same rows. A null in a group column is a group of its own,
    a null ident comes last; an empty table gives no rows. Other columns are kept (one
    named place or _salt is replaced). n below 1: none.
    """
    by = [*order, F.col(ident).asc_nulls_last()]
    # repeated rows share ident, so that they meet in one subgroup and there have one rank; only what is left is made distinct
    rows = df.withColumn("_salt", F.coalesce(salt_of(F.col(ident), salts), F.lit(0)))
    first = rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*group, "_salt").orderBy(*by))).where(F.col("place") <= n).distinct()
    last = first.drop("place", "_salt").withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*by)))
    return last.where(F.col("place") <= n)
