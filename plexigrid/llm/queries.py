"""The queries of the problems about training data (2, 3, 4, 6, 7, 8), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexigrid.functions.jsontext import finite_number, strict_object
from plexigrid.llm.components import linked_groups
from plexigrid.llm.leaks import find_leaks
from plexigrid.llm.mixing import Mix, mix_sources
from plexigrid.llm.splitting import split_boxes
from plexigrid.llm.topn import top_n
from plexigrid.llm.truncated import find_truncated, truncation_rates
from plexigrid.operators.skew import hot_keys, skew_join
from plexigrid.session import table

ACCEPTED = 0.5


def accepted_pairs(edges: DataFrame, nodes: DataFrame, threshold: float = ACCEPTED) -> DataFrame:
    """Distinct u < v of edges with a score at or below threshold in any row, both ends among the node ids.

    Null and NaN scores, null ends, self pairs and ends that are no node link nothing.
    """
    pairs = edges.where((F.col("merge_score") <= threshold) & (F.col("u") != F.col("v"))).select("u", "v")
    ids, n = nodes.select("id").where(F.col("id").isNotNull()).distinct(), edges.count()
    for end in ("u", "v"):
        pairs = skew_join(pairs, ids.withColumnRenamed("id", end), end, "left_semi", hot_keys(pairs, end, most=n))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = accepted_pairs(table(spark, sf_dir, "rag_edges"), table(spark, sf_dir, "rag_nodes"))
    return linked_groups(pairs).select("id", "group_id")


def p2_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of every size (groups of two or more)."""
    sizes = p2_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def roi(c: str):
        r = F.struct(*[F.col(c)["begin"].getItem(i).alias(f"b{i}") for i in range(3)], *[F.col(c)["shape"].getItem(i).alias(f"s{i}") for i in range(3)])
        whole = (F.size(F.col(c)["begin"]) == 3) & (F.size(F.col(c)["shape"]) == 3)
        for i in range(3):
            whole = whole & r[f"b{i}"].isNotNull() & (r[f"s{i}"] > 0)
        return F.when(whole, r)

    docs = table(spark, sf_dir, "completion_db_col").select("task", "block_id", roi("read_roi").alias("r"), roi("write_roi").alias("w")).where("r is not null and w is not null")
    blocks = docs.groupBy("task", "block_id").agg(F.min(F.struct("w", "r")).alias("x")).select("task", "block_id", "x.w", "x.r")
    blocks = blocks.join(table(spark, sf_dir, "task_configs").select("task", "max_edge_nm", "chunk_nm", "overlap_nm"), "task")
    axes = [(F.col(f"w.b{i}"), F.col(f"w.b{i}") + F.col(f"w.s{i}"), F.col(f"r.b{i}"), F.col(f"r.b{i}") + F.col(f"r.s{i}")) for i in range(3)]
    cut_up = split_boxes(blocks, axes, F.col("max_edge_nm"), F.col("chunk_nm"), F.col("overlap_nm"), ["z", "y", "x"])
    return cut_up.select("task", "block_id", *[f"{k}{a}{s}" for k in "wr" for s in "01" for a in "zyx"])


def rated_scores(scores: DataFrame, metric: str = "xpress_erl_rand") -> DataFrame:
    """network, checkpoint, threshold, score_id, metric of the rows whose metric is a finite number."""
    j = strict_object(F.col("scores"), f"{metric} string")
    rated = scores.select("network", "checkpoint", "threshold", "score_id", finite_number(j[metric]).alias("metric"))
    return rated.where("network is not null and checkpoint is not null and metric is not null")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    threshold = F.when(~F.isnan("threshold"), F.col("threshold"))
    rated = rated_scores(table(spark, sf_dir, "scores")).withColumn("threshold", threshold)
    return top_n(rated, ["network", "checkpoint"], [F.desc("metric"), F.col("threshold").asc_nulls_last()], "score_id", 3)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("network", "checkpoint", "place", "score_id")


def p4_best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each threshold gives the best evaluation of a (network, checkpoint)."""
    return _best(spark, sf_dir).where("place = 1").groupBy("threshold").agg(F.count("*").alias("wins"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a window of 13 words like one of an item (radius 3, similarity 0.8) of which, by the exact check, all words are equal."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return find_leaks(docs, items, window=13, radius=3).where("similarity = 1.0").select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of messages that leak it (0 too)."""
    items = table(spark, sf_dir, "eval_items").select("item_id").distinct()
    n = p6_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("messages"))


def p6_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a window of 25 words that is much like one of an item (five-word shingles, 0.8), not only equal to it."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return find_leaks(docs, items, window=25, radius=5).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def _mixed(spark: SparkSession, sf_dir: str) -> Mix:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).shares.where("not reached").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).shares


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).chosen


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_truncated(table(spark, sf_dir, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return truncation_rates(docs, find_truncated(docs))


QUERIES = {"p2_found": p2_found, "p2_group_sizes": p2_group_sizes, "p3_found": p3_found, "p4_found": p4_found, "p4_best_thresholds": p4_best_thresholds}
QUERIES |= {"p6_found": p6_found, "p6_items": p6_items, "p6_similar": p6_similar, "p7_found": p7_found, "p7_shares": p7_shares, "p7_mix": p7_mix, "p8_found": p8_found, "p8_rates": p8_rates}

_GROUPS = f"""
WITH RECURSIVE e AS (
  SELECT DISTINCT u, v FROM (
    SELECT u, v FROM rag_edges WHERE merge_score <= {ACCEPTED} AND NOT isnan(merge_score) AND u <> v
    UNION ALL SELECT v, u FROM rag_edges WHERE merge_score <= {ACCEPTED} AND NOT isnan(merge_score) AND u <> v)
  WHERE u IN (SELECT id FROM rag_nodes) AND v IN (SELECT id FROM rag_nodes)
), c(id, g) USING KEY (id) AS (
  SELECT DISTINCT u, u FROM e
  UNION
  SELECT e.v, min(c.g) FROM c JOIN e ON e.u = c.id JOIN recurring.c AS k ON k.id = e.v WHERE c.g < k.g GROUP BY e.v
)
"""

_AXIS = """
{a}(task, block_id, b, e, n, lim, line, i) AS (
  SELECT task, block_id, w.b{i}, NULL::BIGINT, w.b{i} + w.s{i}, max_edge_nm, chunk_nm, 0 FROM blk
  UNION ALL
  SELECT task, block_id, coalesce(e, b), CASE WHEN n - coalesce(e, b) <= lim THEN n
    WHEN CAST(floor((coalesce(e, b) + lim)::DOUBLE / line) AS BIGINT) * line > coalesce(e, b) THEN CAST(floor((coalesce(e, b) + lim)::DOUBLE / line) AS BIGINT) * line
    ELSE coalesce(e, b) + lim END, n, lim, line, i + 1 FROM {a} WHERE coalesce(e, b) < n
)"""

_RATED = r"""
WITH t AS (SELECT *, regexp_replace(scores, '([:,\[]\s*)-?(NaN|Infinity)', '\1null', 'g') AS s FROM scores),
v AS (SELECT *, CASE WHEN json_valid(s) THEN s::JSON END AS j FROM t),
m AS (SELECT DISTINCT network, checkpoint, threshold, score_id, CASE WHEN isfinite(TRY_CAST(j->>'$.xpress_erl_rand' AS DOUBLE)) THEN TRY_CAST(j->>'$.xpress_erl_rand' AS DOUBLE) END AS metric
      FROM v WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'),
r AS (SELECT *, row_number() OVER (PARTITION BY network, checkpoint ORDER BY metric DESC, threshold NULLS LAST, score_id) AS place
      FROM m WHERE metric IS NOT NULL AND network IS NOT NULL AND checkpoint IS NOT NULL)
"""

SQL = {
    "p2_found": _GROUPS + "SELECT id, g AS group_id FROM c",
    "p2_group_sizes": _GROUPS + ", s AS (SELECT g, count(*) AS size FROM c GROUP BY g) SELECT size, count(*) AS groups FROM s GROUP BY size",
    "p3_found": """
WITH RECURSIVE d AS (
  SELECT task, block_id,
    {'b0': read_roi.begin[1], 'b1': read_roi.begin[2], 'b2': read_roi.begin[3], 's0': read_roi.shape[1], 's1': read_roi.shape[2], 's2': read_roi.shape[3]} AS r,
    {'b0': write_roi.begin[1], 'b1': write_roi.begin[2], 'b2': write_roi.begin[3], 's0': write_roi.shape[1], 's1': write_roi.shape[2], 's2': write_roi.shape[3]} AS w
  FROM completion_db_col
  WHERE len(read_roi.begin) = 3 AND len(read_roi.shape) = 3 AND len(write_roi.begin) = 3 AND len(write_roi.shape) = 3
    AND list_min(read_roi.shape) > 0 AND list_min(write_roi.shape) > 0
), blk AS (
  SELECT DISTINCT task, block_id, r, w, max_edge_nm, chunk_nm, overlap_nm FROM d JOIN task_configs USING (task)
  WHERE w.s0 > max_edge_nm OR w.s1 > max_edge_nm OR w.s2 > max_edge_nm
),"""
    + ",".join(_AXIS.format(a=a, i=i) for i, a in enumerate("zyx"))
    + """
SELECT blk.task, blk.block_id, z.b AS wz0, y.b AS wy0, x.b AS wx0, z.e AS wz1, y.e AS wy1, x.e AS wx1,
  greatest(z.b - overlap_nm, r.b0) AS rz0, greatest(y.b - overlap_nm, r.b1) AS ry0, greatest(x.b - overlap_nm, r.b2) AS rx0,
  least(z.e + overlap_nm, r.b0 + r.s0) AS rz1, least(y.e + overlap_nm, r.b1 + r.s1) AS ry1, least(x.e + overlap_nm, r.b2 + r.s2) AS rx1
FROM blk JOIN z ON z.task = blk.task AND z.block_id = blk.block_id AND z.e IS NOT NULL
JOIN y ON y.task = blk.task AND y.block_id = blk.block_id AND y.e IS NOT NULL
JOIN x ON x.task = blk.task AND x.block_id = blk.block_id AND x.e IS NOT NULL""",
    "p4_found": _RATED + "SELECT network, checkpoint, place, score_id FROM r WHERE place <= 3",
    "p4_best_thresholds": _RATED + "SELECT threshold, count(*) AS wins FROM r WHERE place = 1 GROUP BY threshold",
    # sizes in characters instead of tokens: every case is clear enough that the measure does not matter
    "p7_found": """
WITH d AS (SELECT lower(trim(source)) AS s, sum(length(text)) AS own FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT source, target_share, max_repeats, coalesce(own, 0) AS own FROM source_targets LEFT JOIN d ON d.s = lower(trim(source)))
SELECT source FROM t WHERE max_repeats * own < target_share * (SELECT sum(own) FROM t) OR own = 0""",
}
