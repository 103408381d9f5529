"""Choosing training batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reject(batches: DataFrame, keys: list[str], mask: Column, least: float, inverse: bool = False, second: Column | None = None, points: Column | None = None, probability: float = 1.0, seed: int = 0) -> DataFrame:
    """keys, ratio of the batches whose mean mask is above least (strictly).

    inverse takes 1 - mask; second must hold in some row too; points must be non-zero in some row;
    a batch that fails stays with 1 - probability, by a hash of its keys, so that reruns agree.
    """
    m = (1 - mask) if inverse else mask
    agg = [F.avg(m.cast("double")).alias("ratio")]
    if second is not None:
        agg.append(F.max(second.cast("int")).alias("_second"))
    if points is not None:
        agg.append(F.max((points != 0).cast("int")).alias("_points"))
    out = batches.groupBy(*keys).agg(*agg)
    ok = F.col("ratio") > least
    if second is not None:
        ok = ok & (F.col("_second") == 1)
    if points is not None:
        ok = ok & (F.col("_points") == 1)
    chance = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) / 1_000_000
    return out.where(ok | (chance >= probability)).select(*keys, "ratio")


def skip_empty(blocks: DataFrame, block: str, values: str, kernel: Column) -> DataFrame:
    """block, result: 0 where all values of a block sum to 0 (nothing is computed for it), else kernel."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    return blocks.select(F.col(block), F.when(total == 0, F.lit(0.0)).otherwise(kernel).alias("result"))
