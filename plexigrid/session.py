"""Session helpers: the shared folder, tables that cut lineage, reading the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that setting is absent (tests, a single machine) is a folder of our own made;
    on a cluster master its absence is an error, since a machine-local folder would lose data
    with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="plexigrid-")
    return _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str, rows_a_file: int = 0) -> DataFrame:
    """Write df as a table in the shared folder and read it back; in files of at most rows_a_file rows, if given.

    The result has no lineage, survives the loss of any executor, and carries file sizes, so
    that Catalyst may choose a broadcast from a size it knows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by cut(); only once nothing reads it any more."""
    made = {p.rpartition("/")[2]: p for p in _MADE}
    for folder in {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}:
        if folder in made:
            delete_folder(df.sparkSession, made[folder])
            _MADE.remove(made[folder])


def discard_all(spark: SparkSession) -> None:
    """Delete all tables that cut() has made in this process; only once all results have been used or written."""
    while _MADE:
        delete_folder(spark, _MADE.pop())
