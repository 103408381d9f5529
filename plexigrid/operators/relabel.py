"""Lookup tables of labels: left join and coalesce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexigrid.operators.skew import hot_keys, skew_join


def without_self(lut: DataFrame) -> DataFrame:
    """Rows that change something (key <> value); rows with a null are dropped."""
    return lut.where(F.col("key") != F.col("value"))


def remap(df: DataFrame, lut: DataFrame, column: str, hot: list | None = None) -> DataFrame:
    """column replaced by the table's value where it has one; labels without an entry and null stay.

    lut: key, value, each key once. Rows of hot labels are joined apart (skew_join), so that one
    label may hold any share of df.
    """
    table = without_self(lut).select(F.col("key").alias(column), F.col("value").alias("_to"))
    return skew_join(df, table, column, "left", hot).withColumn(column, F.coalesce("_to", column)).drop("_to").select(df.columns)


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """The table that does first, then second; labels that first leaves alone go through second."""
    moved = remap(first.select("key", "value"), second, "value")
    rest = second.join(first.select("key"), "key", "left_anti").select("key", "value")
    return moved.unionByName(rest)


def remap_ends(edges: DataFrame, lut: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Both ends of every edge through the same table."""
    return remap(remap(edges, lut, u), lut, v)


def remap_by_neighbours(edges: DataFrame, luts: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Ends of edges (bz, by, bx, u, v) through the tables (bz, by, bx, key, value) of the own and the face-neighbour blocks.

    neighbours: bz, by, bx, nbz, nby, nbx. A key stands in the table of one block only, so that the
    order in which the tables are asked does not matter; an end found in none stays.
    """
    block = ["bz", "by", "bx"]
    own = neighbours.select(*block, *[F.col(f"n{k}") for k in block]).unionByName(luts.select(*block, *[F.col(k).alias(f"n{k}") for k in block]).distinct())
    seen = own.join(luts.select(*[F.col(k).alias(f"n{k}") for k in block], "key", "value"), [f"n{k}" for k in block]).select(*block, "key", "value")
    out = edges
    for end in ("u", "v"):
        t = seen.select(*block, F.col("key").alias(end), F.col("value").alias("_to"))
        out = skew_join(out, t, [*block, end], "left", hot_keys(edges, [*block, end])).withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.select(edges.columns)
