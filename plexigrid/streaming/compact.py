"""Checkpointed streaming compaction of very many small files (problem 1).

A file stream discovers every input file once (its log lives in the checkpoint), takes what is
there in batches of bounded size, keeps each record once by a state store in the same checkpoint,
and writes every batch into the folder of its batch number with overwrite. A batch that is run
again, after a lost executor or a new start from the checkpoint, sees the same files and the same
state and replaces its own folder, so that no record is lost or written twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexigrid.functions.jsontext import strict_object

#: Bytes of a good output file, and of input that one batch takes.
TARGET_FILE_BYTES = 256 * 2**20
BATCH_BYTES = 64 * 2**30

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def lines_of(body: Column) -> Column:
    """The non-blank lines of a file body, without outer white space; both line ends."""
    return F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")


def completion_records(files: DataFrame) -> DataFrame:
    """One row per completion record of small files (task, body): task, block_id, start_ms, record.

    A record is a line that is one complete JSON object. block_id is its text, or its list joined
    by "_"; start_ms is round(start * 1000). The whole line stays in record, so that further keys
    survive. Null and empty bodies, torn lines and other JSON values are no records; a field that
    an object lacks is null.
    """
    lines = files.select("task", F.explode(lines_of(F.col("body"))).alias("record"))
    j = strict_object(F.col("record"), "block_id string, start string")
    got = lines.select("task", "record", j.alias("_j")).where(F.col("_j").isNotNull())
    block = F.regexp_replace(F.regexp_replace(F.col("_j.block_id"), r"^\[|\]$|[\s\"]", ""), ",", "_")
    return got.select("task", block.alias("block_id"), F.round(F.col("_j.start").try_cast("double") * 1000).cast("bigint").alias("start_ms"), "record")


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    parse,
    key: list[str],
    payload: str,
    batch_bytes: int = BATCH_BYTES,
    file_bytes: int = TARGET_FILE_BYTES,
    fmt: str = "parquet",
) -> DataFrame:
    """Consolidate what lies at source into few files under target and return the compacted table.

    parse: DataFrame of the source's rows -> DataFrame with the columns key + [payload], one row
    per record. A record is told by its key (null equals null); of equal ones the first met stays.
    Call it again with the same checkpoint and only new files are read. A source without files, or
    with files of no rows, gives an empty table of the right columns.
    """
    schema = spark.read.format(fmt).load(source).schema
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(root):
        source = f"{source[:-1]}[{source[-1]}]"  # a file stream takes a folder or a pattern, not the path of one file
    stream = spark.readStream.format(fmt).schema(schema).option("maxBytesPerTrigger", batch_bytes).option("maxFileAge", "36500d").load(source)
    unique = parse(stream).select(*key, payload).dropDuplicates(key)

    def write(batch: DataFrame, number: int) -> None:
        # the sizes measured in a shuffle decide how many files there are; nothing is kept or counted before.
        # A stream turns adaptive plans off for its state's sake; this write alone has one.
        conf = batch.sparkSession.conf
        wanted = {"enabled": "true", "advisoryPartitionSizeInBytes": str(file_bytes), "coalescePartitions.parallelismFirst": "false"}
        held = {f"spark.sql.adaptive.{k}": conf.get(f"spark.sql.adaptive.{k}") for k in wanted}
        for k, v in zip(held, wanted.values()):
            conf.set(k, v)
        try:
            batch.hint("rebalance").write.mode("overwrite").parquet(f"{target}/batch={number}")
        finally:
            for k, v in held.items():
                conf.set(k, v)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    out = T.StructType([*unique.schema.fields, T.StructField("batch", T.IntegerType())])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(target)
