"""Stored volumes, lookup tables and completed blocks as partitioned Parquet (or ORC, CSV, JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexigrid.operators import volume as V
from plexigrid.operators.geometry import Roi
from plexigrid.session import delete_folder

#: Formats by the ending of a container's name.
FORMATS = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json"}


def format_of(container: str) -> str:
    for ending, fmt in FORMATS.items():
        if container.rstrip("/").endswith(ending):
            return fmt
    raise ValueError(f"unknown kind of container: {container}")


def parse_dataset(name: str) -> tuple[str, dict[str, int]]:
    """Name and fixed coordinates of a dataset name such as labels[3,,7] (z, y, x; an empty place is free)."""
    base, bracket, rest = name.partition("[")
    if not bracket:
        return name, {}
    if not rest.endswith("]"):
        raise ValueError(f"not a dataset name: {name}")
    fixed = {}
    for axis, at in zip("zyx", rest[:-1].split(",")):
        if ":" in at:
            raise NotImplementedError("ranges in dataset names")
        if at.strip():
            fixed[axis] = int(at)
    return base, fixed


def open_volume(spark: SparkSession, container: str, dataset: str = "") -> DataFrame:
    """The voxels of a stored volume; fixed coordinates of the name become pushed-down filters."""
    name, fixed = parse_dataset(dataset)
    df = spark.read.format(format_of(container)).load(f"{container}/{name}" if name else container)
    for axis, at in fixed.items():
        df = df.where(F.col(axis) == at).drop(axis)
    return df


def write_volume(df: DataFrame, container: str, dataset: str = "", by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Write a volume; partitioned by columns, only the partitions present in df are replaced."""
    writer = df.write.format(format_of(container)).mode(mode)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.save(f"{container}/{dataset}" if dataset else container)


INFO = "offset array<bigint>, shape array<bigint>, resolution array<bigint>, dtype string"


def prepare_volume(spark: SparkSession, container: str, dataset: str, roi: Roi, resolution: tuple[int, int, int], dtype: str, delete: bool = False) -> None:
    """Record the region (nm), voxel size (nm) and value type of a dataset beside it, before blocks are written.

    The region must lie on the voxel grid. A dataset that is already recorded must agree, unless
    delete is set: then its record is replaced and its values are dropped.
    """
    if any(b % r or n % r for b, n, r in zip(roi.begin, roi.shape, resolution)):
        raise ValueError(f"{roi} does not lie on the grid of {resolution}")
    new = (list(roi.begin), list(roi.shape), list(resolution), dtype)
    if delete:
        delete_folder(spark, f"{container}/{dataset}")
    elif table_exists(spark, f"{container}/{dataset}.info"):
        if tuple(volume_info(spark, container, dataset)) != new:
            raise ValueError(f"{dataset} is there with another region, voxel size or type")
        return
    spark.createDataFrame([new], INFO).coalesce(1).write.mode("overwrite").json(f"{container}/{dataset}.info")


def volume_info(spark: SparkSession, container: str, dataset: str):
    """offset, shape, resolution, dtype of a dataset (one row); fails if it was not prepared."""
    return spark.read.schema(INFO).json(f"{container}/{parse_dataset(dataset)[0]}.info").first()


def convert_volume(spark: SparkSession, source: str, dataset: str, target: str, factor: int = 1, transpose: bool = False, keep: list[int] | None = None, shift: tuple[int, int, int] = (0, 0, 0)) -> None:
    """Copy a prepared dataset to another container: every factor-th voxel, axes reversed, labels not kept as 0.

    The record goes along: the resolution grows by factor, the region shrinks to whole voxels of it,
    reversed axes reverse both; shift moves the region. The kinds of the containers may differ.
    """
    name = parse_dataset(dataset)[0]
    info, df = volume_info(spark, source, dataset), open_volume(spark, source, name)
    if factor > 1:
        df = V.downsample(df, factor)
    if keep is not None:
        df = df.withColumn("value", V.keep_labels(F.col("value"), keep))
    resolution = [r * factor for r in info["resolution"]]
    offset = [o + s for o, s in zip(info["offset"], shift)]
    shape = [-(-n // r) * r for n, r in zip(info["shape"], resolution)]
    if transpose:
        df, resolution, offset, shape = V.transpose(df), resolution[::-1], offset[::-1], shape[::-1]
    if any(o % r for o, r in zip(offset, resolution)):
        offset = [o // r * r for o, r in zip(offset, resolution)]
    prepare_volume(spark, target, name, Roi(tuple(offset), tuple(shape)), tuple(resolution), info["dtype"], delete=True)
    write_volume(df, target, name)


def submission_errors(spark: SparkSession, container: str, dataset: str, resolution: tuple[int, int, int] = (99, 99, 99), roi: Roi = Roi((3267,) * 3, (33066,) * 3)) -> list[str]:
    """What is wrong with a submitted segmentation: kind of container, whether it can be read, type, voxel size, region."""
    try:
        format_of(container)
    except ValueError as e:
        return [str(e)]
    if not table_exists(spark, f"{container}/{dataset}.info"):
        return [f"no {dataset} in {container}"]
    info, out = volume_info(spark, container, dataset), []
    if not table_exists(spark, f"{container}/{dataset}"):
        out.append("no values")
    if info["dtype"] not in ("uint64", "int64", "bigint"):
        out.append(f"type {info['dtype']}")
    if tuple(info["resolution"]) != resolution:
        out.append(f"voxel size {info['resolution']}")
    if (tuple(info["offset"]), tuple(info["shape"])) != (roi.begin, roi.shape):
        out.append(f"region {info['offset']}, {info['shape']}")
    return out


def scales_of(spark: SparkSession, container: str, dataset: str) -> list[str]:
    """The names of the scales of a dataset (s0, s1 ... beside each other), or the dataset itself if it has none."""
    found = [(int(f.rsplit("/s", 1)[1]), f) for f in _listing(spark, f"{container}/{dataset}/s[0-9]*") if f.rsplit("/s", 1)[1].isdigit()]
    return [f"{dataset}/s{k}" for k, _ in sorted(found)] or [dataset]


#: Tables that a task writes at once; only what goes beyond them is sorted first.
OPEN_TABLES = 32


def write_lut(lut: DataFrame, path: str) -> None:
    """Add threshold and stage partitions of lookup tables (threshold, stage, ..., key, value) to a table.

    Rows go to the files of their tables as they come, unsorted.
    """
    conf, name = lut.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, OPEN_TABLES)
    try:
        lut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "threshold").parquet(path)
    finally:
        conf.set(name, before)


def read_lut(spark: SparkSession, path: str, stage: str, threshold: float) -> DataFrame:
    """One lookup table; partition pruning reads its files alone. Fails if the table is not there."""
    return spark.read.parquet(path).where((F.col("stage") == stage) & (F.col("threshold") == threshold))


def read_luts(spark: SparkSession, path: str) -> DataFrame:
    """All lookup tables under path: stage, threshold and the columns written."""
    return spark.read.parquet(path)


def stored_luts(spark: SparkSession, path: str) -> DataFrame:
    """stage, threshold of the lookup tables that are there; told by the names of their folders, no file is read."""
    found = _listing(spark, f"{path}/stage=*/threshold=*")
    named = [dict(part.split("=", 1) for part in f.rsplit("/", 2)[1:]) for f in found]
    return spark.createDataFrame([(x["stage"], float(x["threshold"])) for x in named], "stage string, threshold double")


def lut_exists(spark: SparkSession, path: str, stage: str, threshold: float) -> bool:
    return bool(_listing(spark, f"{path}/stage={stage}/threshold={threshold}"))


def _listing(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a stored table or volume is there (a probe of its folder; nothing is read)."""
    return bool(_listing(spark, path))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, by: str = "bz") -> None:
    """Store a region graph (both tables have bz, by, bx): a folder a layer of blocks, sorted by block inside, so that a region reads few files.

    Only the layers present are replaced.
    """
    for name, df in (("nodes", nodes), ("edges", edges)):
        one = df.repartition(*[c for c in ("bz", "by", "bx")]).sortWithinPartitions("bz", "by", "bx")
        one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, begin: tuple[int, int, int], end: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Nodes with a position, and edges, of the blocks from begin to end (exclusive): layers are pruned, the rest is pushed down."""
    blocks = Roi(begin, tuple(e - b for b, e in zip(begin, end))).where("bz", "by", "bx")
    nodes, edges = (spark.read.parquet(f"{path}/{name}").where(blocks) for name in ("nodes", "edges"))
    return nodes.where("center_z is not null and center_y is not null and center_x is not null"), edges
