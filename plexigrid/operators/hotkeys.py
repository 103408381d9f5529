"""Exact per-key selection where a few keys hold most rows (problem 5).

Values are never gathered per key. Each round sums up a histogram: counts by (key, bin), combined in
the map tasks, so that what is shuffled of a hot key is at most its bins. Only bins that can still
hold the answer stay open; the next round reads the rows again, keeps those of open bins and splits
these into finer ones, until every answer has a bin of a single value. The first histogram comes
straight from the rows; no table of all (key, value) pairs is made on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plexigrid.operators.skew import skew_join
from plexigrid.session import cut

#: Bits by which a round narrows the bins: 2 ** BITS bins (about) a key or open bin at most.
BITS = 16


def select_mode(df: DataFrame, key: str, value: str, unit: str) -> DataFrame:
    """For every key the integer value with the most distinct units; the smallest such value if equal.

    Returns key, value, n_units. Rows with null in any of the three do not count; repeated rows
    count once; an empty table gives no rows; other columns of df are ignored.

    A bin is a range of values that agree in all but their last bits. Its count of distinct (value,
    unit) bounds from above what any value in it can have. The best value of a key has at least the
    mean of its fullest bin over the bin's width (pigeonhole), or the count of a bin already down to
    one value. Bins below that bound are dropped, the rest refined.
    """
    value_type = df.schema[value].dataType
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("bigint").alias("_v"), F.col(unit).alias("_u")).dropna()
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(value, value_type), T.StructField("n_units", T.LongType())])
    low, high = rows.agg(F.min("_v"), F.max("_v")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], out)
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << BITS:
        shift += 1
    found, open_bins = None, None
    while True:
        alive = rows if open_bins is None else skew_join(rows.withColumn("_b", F.shiftright("_v", before)), open_bins, ["_k", "_b"], "left_semi").drop("_b")
        bins = alive.distinct().groupBy("_k", F.shiftright("_v", shift).alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        if found is not None or shift:
            bins = cut(bins, "mode-bins")
        one = F.col("_lo") == F.col("_hi")
        done = bins.where(one).select("_k", F.col("_lo").alias("_v"), "_n")
        found = done if found is None else found.unionByName(done)
        if shift == 0:
            break
        width = F.col("_hi").cast("double") - F.col("_lo").cast("double") + 1
        bound = bins.groupBy("_k").agg(F.max(F.when(one, F.col("_n")).otherwise(F.ceil(F.col("_n") / width))).alias("_n")).unionByName(found.groupBy("_k").agg(F.max("_n").alias("_n")))
        least = bound.groupBy("_k").agg(F.max("_n").alias("_least"))
        open_bins = cut(bins.where(~one).join(least, "_k").where(F.col("_n") >= F.col("_least")).select("_k", "_b"), "mode-open")
        if open_bins.isEmpty():
            break
        before, shift = shift, max(0, shift - BITS)
    # ~v falls as v grows and cannot overflow: the smallest value of equal ones wins
    winner = found.groupBy("_k").agg(F.max(F.struct(F.col("_n").alias("n"), F.bitwise_not("_v").alias("v"))).alias("w"))
    return winner.select(F.col("_k").alias(key), F.bitwise_not("w.v").cast(value_type).alias(value), F.col("w.n").alias("n_units"))


def _place(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of v in [lo, hi], from 0 to 2 ** BITS - 1 and never falling as v grows; infinite values have bins of their own outside."""
    span, half = hi - lo, hi / 2 - lo / 2
    part = F.when(span < float("inf"), F.try_divide(v - lo, span)).otherwise(F.try_divide(v / 2 - lo / 2, half))
    inside = F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor(F.coalesce(part, F.lit(0.0)) * (1 << BITS)).cast("int")))
    return F.when(v == float("inf"), 1 << BITS).when(v == float("-inf"), -1).otherwise(inside)


def select_quantiles(df: DataFrame, key: str, value: str, probabilities: list[float]) -> DataFrame:
    """Exact per-key quantiles of a numeric column by refined histograms.

    For n values of a key the quantile p is the value of rank max(1, ceil(p n)) in ascending order.
    Values are taken as doubles and come out as they are. Returns key, probability, quantile. Null
    keys and null or NaN values do not count, infinite ones do; a key without values gives no row;
    an empty table none.
    """
    x = F.col(value).cast("double") + 0.0  # -0.0 becomes 0.0
    rows = df.where(F.col(key).isNotNull() & x.isNotNull() & ~F.isnan(x)).select(F.col(key).alias("_k"), x.alias("_v"))
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("probability", T.DoubleType()), T.StructField("quantile", T.DoubleType())])
    finite = F.abs("_v") < float("inf")
    low, high, n = rows.agg(F.min(F.when(finite, F.col("_v"))), F.max(F.when(finite, F.col("_v"))), F.count("*")).first()
    if not n or not probabilities:
        return df.sparkSession.createDataFrame([], out)
    rows = rows.withColumn("_b1", _place(F.col("_v"), F.lit(low or 0.0), F.lit(high or 0.0)))
    counts = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    bins = cut(rows.groupBy("_k", F.lit(0.0).alias("_up"), F.col("_b1").alias("_b")).agg(*counts), "quantile-bins")
    ps = F.explode(F.array(*[F.lit(float(p)) for p in sorted(set(probabilities))]))
    sizes = bins.groupBy("_k").agg(F.sum("_n").alias("_total")).withColumn("_p", ps)
    # a target: the rank that is sought among the rows of one open bin, which is told by its key and lowest value
    targets = sizes.select("_k", F.lit(0.0).alias("_up"), F.lit(None).cast("int").alias("_b1"), "_p", F.greatest(F.lit(1), F.ceil(F.col("_p") * F.col("_total"))).cast("bigint").alias("_rank"))
    found = None
    while True:
        # at most 2 ** BITS + 2 rows a window: the bins of one open bin of one key
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k", "_up").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = targets.join(bins.withColumn("_before", before), ["_k", "_up"]).where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
        hit = cut(hit.select("_k", F.coalesce("_b1", "_b").alias("_b1"), "_p", (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi"), "quantile-hit")
        done = hit.where(F.col("_lo") == F.col("_hi")).select("_k", "_p", F.col("_lo").alias("_v"))
        found = done if found is None else found.unionByName(done)
        rest = hit.where(F.col("_lo") < F.col("_hi"))
        if rest.isEmpty():
            break
        targets = rest.select("_k", F.col("_lo").alias("_up"), "_b1", "_p", "_rank")
        # no more open bins than probabilities lie in one bin of the first histogram
        spans = rest.groupBy("_k", "_b1").agg(F.collect_set(F.struct("_lo", "_hi")).alias("_spans"))
        inside = skew_join(rows, spans, ["_k", "_b1"]).select("_k", "_v", F.explode("_spans").alias("_s")).where((F.col("_v") >= F.col("_s._lo")) & (F.col("_v") <= F.col("_s._hi")))
        bins = cut(inside.groupBy("_k", F.col("_s._lo").alias("_up"), _place(F.col("_v"), F.col("_s._lo"), F.col("_s._hi")).alias("_b")).agg(*counts), "quantile-bins")
    return found.select(F.col("_k").alias(key), F.col("_p").alias("probability"), F.col("_v").alias("quantile"))
