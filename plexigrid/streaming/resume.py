"""Blocks that are done: a file stream of completion rows kept once each, and what remains to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexigrid.streaming.compact import compact


def completed_blocks(spark: SparkSession, source: str, target: str, checkpoint: str) -> DataFrame:
    """task, block_id of every completion row under source, each once, kept up by a checkpointed stream."""
    return compact(spark, source, target, checkpoint, lambda rows: rows.selectExpr("task", "block_id", "cast(start as string) as start"), ["task", "block_id"], "start").select("task", "block_id")


def remaining(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """Blocks (task, block_id) that are not in done."""
    return blocks.join(done, ["task", "block_id"], "left_anti")
