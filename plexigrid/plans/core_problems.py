"""The queries of the general problems (1 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexigrid.operators.hotkeys import select_mode, select_quantiles
from plexigrid.session import fresh_path, table
from plexigrid.streaming.compact import compact, completion_records


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "compact")
    return compact(spark, f"{sf_dir}/block_files.parquet", f"{root}/table", f"{root}/checkpoint", completion_records, ["task", "block_id", "start_ms"], "record")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compacted(spark, sf_dir).select("task", "block_id", "start_ms")


def p1_block_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compacted table is for: one pass over whole records instead of over tiny files."""
    t = _compacted(spark, sf_dir)
    d = F.get_json_object("record", "$.duration").try_cast("double")
    return t.groupBy("task").agg(F.count("*").alias("records"), F.countDistinct("block_id").alias("blocks"), F.round(F.sum(d), 3).alias("total_s"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "skeleton_nodes").where(F.col("seg_label") != 0)
    return select_mode(nodes, "seg_label", "skeleton_id", "node").select("seg_label", "skeleton_id")


def p5_depth_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of node depth in every segment label (repeated nodes count as they stand)."""
    nodes = table(spark, sf_dir, "skeleton_nodes").where(F.col("seg_label") != 0)
    return select_quantiles(nodes, "seg_label", "pz", [0.25, 0.5, 0.75])


QUERIES = {"p1_found": p1_found, "p1_block_durations": p1_block_durations, "p5_found": p5_found, "p5_depth_quantiles": p5_depth_quantiles}

_RECORDS = r"""
WITH l AS (
  SELECT task, trim(unnest(string_split(replace(body, chr(13), chr(10)), chr(10))), ' ' || chr(9)) AS line FROM block_files WHERE body IS NOT NULL
), r AS (
  SELECT task, line, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM l WHERE line <> ''
), k AS (
  SELECT task, line,
    CASE WHEN json_type(j, '$.block_id') = 'ARRAY' THEN array_to_string(CAST(j->'$.block_id' AS VARCHAR[]), '_') ELSE j->>'$.block_id' END AS block_id,
    CAST(round(CAST(j->>'$.start' AS DOUBLE) * 1000) AS BIGINT) AS start_ms,
    CAST(j->>'$.duration' AS DOUBLE) AS duration
  FROM r WHERE j IS NOT NULL AND json_type(j) = 'OBJECT'
)
"""

SQL = {
    "p1_found": _RECORDS + "SELECT DISTINCT task, block_id, start_ms FROM k",
    "p1_block_durations": _RECORDS
    + """, u AS (SELECT task, block_id, start_ms, min(duration) AS duration FROM k GROUP BY ALL)
SELECT task, count(*) AS records, count(DISTINCT block_id) AS blocks, round(sum(duration), 3) AS total_s FROM u GROUP BY task""",
    "p5_found": """
WITH n AS (SELECT seg_label, skeleton_id, count(DISTINCT node) AS n FROM skeleton_nodes
           WHERE seg_label IS NOT NULL AND seg_label <> 0 AND skeleton_id IS NOT NULL AND node IS NOT NULL GROUP BY ALL)
SELECT seg_label, skeleton_id FROM (SELECT *, row_number() OVER (PARTITION BY seg_label ORDER BY n DESC, skeleton_id) AS r FROM n) WHERE r = 1""",
    "p5_depth_quantiles": """
WITH v AS (SELECT seg_label, pz, row_number() OVER (PARTITION BY seg_label ORDER BY pz) AS r, count(*) OVER (PARTITION BY seg_label) AS n
           FROM skeleton_nodes WHERE seg_label <> 0 AND pz IS NOT NULL AND NOT isnan(pz)),
p AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS probability)
SELECT seg_label, probability, pz AS quantile FROM v, p WHERE r = greatest(1, ceil(probability * n))""",
}
