"""Joins and counts that keep hot keys from piling up in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may well hold; a key is hot only beyond that.
TASK_ROWS = 1_000_000

#: A hot key also holds more than one PARTS-th of all rows, so that by counting fewer than PARTS keys are hot.
PARTS = 4096


def _route(keys: list[str]) -> Column:
    """What rows are told hot by: the key itself, of several columns a hash (equal hashes are only joined apart together)."""
    return F.col(keys[0]) if len(keys) == 1 else F.when(~_any_null(keys), F.xxhash64(*keys))


def _any_null(keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def hot_keys(df: DataFrame, key: str | list[str], rows: int = TASK_ROWS, most: int | None = None, parts: int = PARTS) -> list:
    """The keys (of several columns their hashes) with more rows of df than a task should hold: fewer than parts values, whatever the data.

    A key is hot if it has more than rows rows and more than a parts-th of all rows. Counts are
    combined before the shuffle. Null is never hot here (skew_join keeps it apart by itself). No key
    of a table of at most rows rows can be hot; most is an upper bound of its rows, if one is known.
    """
    if most is not None and most <= rows:
        return []
    total = df.count()
    if total <= rows:
        return []
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.select(_route(keys).alias("_r")).where("_r is not null").groupBy("_r").agg(F.count("*").alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") > max(rows, total // parts)).limit(parts).collect()]


def skew_join(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", hot: list | None = None) -> DataFrame:
    """big joined with small on key, where small has each key at most once and big may pile up on a few keys.

    how: inner, left_semi, left_anti or left. Rows of hot keys are joined with a broadcast of small's rows of
    just those keys (fewer than PARTS, proven by counting), and so are rows without a key, which match
    nothing; the rest is an ordinary join, in which no key has more rows than hot_keys() allows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hot = hot_keys(big, keys) if hot is None else hot
    if not hot:
        return big.join(small, keys, how)
    is_hot = F.coalesce(_route(keys).isin(hot), F.lit(False))
    none = _any_null(keys)
    first = big.where(is_hot | none).join(F.broadcast(small.where(is_hot)), keys, how)
    rest = big.where(~is_hot & ~none).join(small.where(~is_hot), keys, how)
    return first.unionByName(rest)


def salt_of(ident: Column, salts: int) -> Column:
    """A subgroup number from 0 to salts - 1, the same for equal identifiers in any run."""
    return F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int")
