"""The score store: filters, best entries and reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plexigrid.session import cut

PARTS = "struct<rand_split:double,rand_merge:double,nvi_split:double,nvi_merge:double>"
#: The columns of a score row: what an evaluation appends.
SCHEMA = T.StructType([T.StructField("network", T.StringType()), T.StructField("checkpoint", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("scores", T.StringType())])


def score_rows(spark: SparkSession, rows: Iterable[tuple[str, int, float, dict]]) -> DataFrame:
    """Score rows to append, from (network, checkpoint, threshold, scores); types are checked."""
    import json

    out = []
    for network, checkpoint, threshold, scores in rows:
        if not (isinstance(network, str) and isinstance(checkpoint, int) and isinstance(threshold, float) and isinstance(scores, dict)):
            raise TypeError("a score row is (str, int, float, dict)")
        out.append((network, checkpoint, threshold, json.dumps(scores)))
    return spark.createDataFrame(out, SCHEMA)


def append_scores(store: str, network: str, checkpoint: int, threshold: float, scores: DataFrame) -> None:
    """Append one evaluation (a one-row table of scores, as metrics.evaluate() gives) to a store as its JSON text."""
    if not (isinstance(network, str) and isinstance(checkpoint, int) and isinstance(threshold, float)):
        raise TypeError("a score row is of a str, an int and a float")
    row = scores.select(F.lit(network).alias("network"), F.lit(checkpoint).cast("int").alias("checkpoint"), F.lit(threshold).alias("threshold"), F.to_json(F.struct(*scores.columns)).alias("scores"))
    row.coalesce(1).write.mode("append").parquet(store)


def _wanted(column: str, values) -> Column:
    if values is None:
        return F.lit(True)
    if isinstance(values, (str, int, float)):
        return F.col(column) == values
    return F.col(column).isin(list(values))


def select_scores(scores: DataFrame, networks=None, checkpoints=None, thresholds=None) -> DataFrame:
    """Rows that match all of the given filters: None passes all, one value is an equality, several an IN list."""
    return scores.where(_wanted("network", networks) & _wanted("checkpoint", checkpoints) & _wanted("threshold", thresholds))


def _best(rated: DataFrame, metrics: list[str], ident: str) -> DataFrame:
    """Of each (network, checkpoint) the best row by each of the metrics: one grouped minimum for all, combined before the shuffle."""
    order = lambda m: F.when(F.col(m).isNotNull(), F.struct((-F.col(m)).alias("m"), F.col(ident).alias("i"), F.col("threshold").alias("t")))
    return rated.groupBy("network", "checkpoint").agg(*[F.min(order(m)).alias(f"b_{m}") for m in metrics])


def _top(best: DataFrame, metric: str, n: int) -> DataFrame:
    b = f"b_{metric}"
    top = best.where(F.col(b).isNotNull()).orderBy(f"{b}.m", f"{b}.i").limit(n)
    return top.select("network", "checkpoint", F.col(f"{b}.t").alias("threshold"))


def top_entries(rated: DataFrame, metric: str, n: int, ident: str) -> DataFrame:
    """network, checkpoint, threshold of the n best (network, checkpoint) by their best row; ties go to the smaller ident.

    Rows without the metric do not count; an empty table gives no rows.
    """
    return _top(_best(rated, [metric], ident), metric, n)


def union_of_tops(rated: DataFrame, metrics: list[str], n: int, ident: str) -> DataFrame:
    """The entries that are among the n best by any of the metrics, each once; the table is read once."""
    best = cut(_best(rated, metrics, ident), "best")
    out = None
    for m in metrics:
        out = _top(best, m, n) if out is None else out.unionByName(_top(best, m, n))
    return out.distinct()


def numbered(df: DataFrame, by: str, place: str) -> DataFrame:
    """df with a column place: 1, 2 ... in the order of by (equal ones in any order).

    Rows are sorted by ranges of by and numbered inside each; only one count a range goes through a
    window of its own.
    """
    ranged = cut(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.withColumn(place, within).join(counts, "_range").withColumn(place, (F.col(place) + F.col("_before")).cast("int")).drop("_range", "_before")


def csv_report(rated: DataFrame, entries: DataFrame, metrics: list[str], digits: int = 6) -> DataFrame:
    """place, line: a CSV line for every row of the entries (a top-n report), in the order of the text."""
    keys = ["network", "checkpoint", "threshold"]
    rows = rated.join(entries.select(*keys), keys, "left_semi")
    line = F.concat_ws(",", F.col("network"), F.col("checkpoint").cast("string"), F.format_string("%.3f", "threshold"), *[F.format_string(f"%.{digits}f", m) for m in metrics])
    return numbered(rows.select(line.alias("line")), "line", "place")
