"""Dense volumes as rows: block form (block, array of values) and voxel form (block, z, y, x, value).

Blocks are cubes of side n, values in z, y, x order; coordinates count within the block. All
operators are per voxel or per block, so that they need no shuffle unless they look at neighbours,
and those join within a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def explode_blocks(blocks: DataFrame, block: str, values: str, side: int) -> DataFrame:
    """Voxel form: block, z, y, x, value. Null blocks of values give no voxels; null values stay null."""
    v = blocks.select(F.col(block).alias("block"), F.posexplode(values).alias("i", "value"))
    i = F.col("i").cast("bigint")
    return v.select("block", F.floor(i / (side * side)).alias("z"), (F.floor(i / side) % side).alias("y"), (i % side).alias("x"), F.col("value").cast("double").alias("value"))


def pack_blocks(voxels: DataFrame) -> DataFrame:
    """Block form: block, values in z, y, x order (a block is of bounded size)."""
    packed = voxels.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("z", "y", "x", "value"))).alias("v"))
    return packed.select("block", F.col("v.value").alias("values"))


def downsample(voxels: DataFrame, factor: int, begin: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Every factor-th voxel from begin on each axis; a side of n gives ceil(n / factor)."""
    keep = reduce(lambda a, b: a & b, [(F.col(c) >= b) & ((F.col(c) - b) % factor == 0) for c, b in zip("zyx", begin)])
    return voxels.where(keep).withColumns({c: F.floor((F.col(c) - b) / factor).cast("bigint") for c, b in zip("zyx", begin)})


def mean_pool(voxels: DataFrame, factor: int) -> DataFrame:
    """Mean of the values in each cube of factor voxels a side; nulls do not count."""
    return voxels.groupBy("block", *[F.floor(F.col(c) / factor).cast("bigint").alias(c) for c in "zyx"]).agg(F.avg("value").alias("value"))


def transpose(voxels: DataFrame) -> DataFrame:
    """All axes reversed: z and x change places."""
    return voxels.select(*[F.col({"z": "x", "x": "z"}.get(c, c)).alias(c) for c in voxels.columns])


def project(voxels: DataFrame, axis: str, at: int) -> DataFrame:
    """The plane of voxels at a coordinate of an axis, without that axis."""
    if axis not in ("z", "y", "x"):
        raise ValueError(f"no such axis: {axis}")
    return voxels.where(F.col(axis) == at).drop(axis)


def scale_shift(value: Column, scale: float, shift: float) -> Column:
    return value * scale + shift


def zero_sections(voxels: DataFrame, sections: list[int]) -> DataFrame:
    """Values in the listed z sections become 0."""
    return voxels.withColumn("value", F.when(F.col("z").isin(sections), F.lit(0.0)).otherwise(F.col("value")))


def replace_sections(voxels: DataFrame, by: dict[int, int]) -> DataFrame:
    """Section z takes the values of section by[z] where the block has both; one after another in the given order.

    As later replacements see earlier ones, the source of each section is traced back first.
    """
    source = {z: z for z in {*by, *by.values()}}
    for z, s in by.items():
        source[z] = source[s]
    moved = {z: s for z, s in source.items() if z != s}
    if not moved:
        return voxels
    pairs = F.create_map(*[F.lit(k) for p in moved.items() for k in p])
    wanted = voxels.withColumn("_from", F.coalesce(pairs[F.col("z").cast("int")].cast("bigint"), F.col("z")))
    there = voxels.select("block", F.col("z").alias("_from"), "y", "x", F.col("value").alias("_new"), F.lit(True).alias("_there"))
    out = wanted.join(there, ["block", "_from", "y", "x"], "left")
    return out.select("block", "z", "y", "x", F.when(F.col("_there"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def pad(voxels: DataFrame, side: int, margin: int) -> DataFrame:
    """Each block with margin zero voxels on all sides (coordinates from -margin to side + margin - 1)."""
    axis = F.sequence(F.lit(-margin).cast("bigint"), F.lit(side + margin - 1).cast("bigint"))
    grid = voxels.select("block").distinct()
    for c in "zyx":
        grid = grid.withColumn(c, F.explode(axis))
    return grid.join(voxels, ["block", "z", "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def unlabelled_mask(label: Column, exclude: list[int], include_zero: bool = False) -> Column:
    """0 for labels to be excluded (0 too, unless include_zero), else 1; null is excluded."""
    out = sorted({*exclude} | (set() if include_zero else {0}))
    return F.when(label.isNull() | label.isin(out), 0).otherwise(1)


def keep_labels(label: Column, keep: list[int]) -> Column:
    return F.when(label.isin(keep), label).otherwise(0)


#: The columns that tell a block: one number, or a place in the grid of blocks.
BLOCK = ["bz", "by", "bx"]
BLOCKS = ("block", *BLOCK)


def blocks_of(voxels: DataFrame) -> list[str]:
    return [c for c in BLOCKS if c in voxels.columns]


def on_grid(voxels: DataFrame, side: int, rows: int, columns: int) -> DataFrame:
    """Numbered blocks as parts of one volume: z, y, x count over the whole grid, the block column is gone.

    Block b lies at (b div (rows * columns), b div columns mod rows, b mod columns). Blocks must be
    numbered from 0; their number is not limited (the volume grows along z).
    """
    b = F.col("block").cast("bigint")
    at = {"z": F.floor(b / (rows * columns)), "y": F.floor(b / columns) % rows, "x": b % columns}
    return voxels.withColumns({c: (at[c] * side + F.col(c)).cast("bigint") for c in "zyx"}).drop("block")


def halo(voxels: DataFrame, size: int, context: int) -> DataFrame:
    """Voxels of a grid by blocks of size voxels a side, each block with a margin of context: bz, by, bx, core.

    A voxel goes to every block whose grown region holds it; core marks its own block. This is the
    only shuffle: what follows may join or group by block (and anything else) within the partitions.
    """
    out = voxels
    for c, k in zip("zyx", BLOCK):
        lo, hi = F.floor((F.col(c) - context) / size), F.floor((F.col(c) + context) / size)
        out = out.withColumn(k, F.explode(F.sequence(lo, hi)))
    core = reduce(lambda a, b: a & b, [F.floor(F.col(c) / size) == F.col(k) for c, k in zip("zyx", BLOCK)])
    return out.withColumn("core", core).repartition(*BLOCK)


def shifted(voxels: DataFrame, offsets: list[tuple[int, int, int]], value: str) -> DataFrame:
    """Each voxel with the voxels at the given offsets: columns oz, oy, ox and other.

    Neighbours are sought in the voxel's block (block, or bz, by, bx), or in the whole grid if there
    is no block column. The few offsets are exploded on one side, so that the search is one equi-join.
    """
    keys = blocks_of(voxels)
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("oz"), F.lit(b).alias("oy"), F.lit(c).alias("ox")) for a, b, c in offsets]))
    left = voxels.withColumn("_o", o).select("*", "_o.*").drop("_o").withColumns({f"_{c}": F.col(c) + F.col(f"o{c}") for c in "zyx"})
    right = voxels.select(*keys, *[F.col(c).alias(f"_{c}") for c in "zyx"], F.col(value).alias("other"))
    return left.join(right, [*keys, "_z", "_y", "_x"]).drop("_z", "_y", "_x")


def offsets_along_axes(distances: list[int]) -> list[tuple[int, int, int]]:
    return [tuple(d if i == a else 0 for i in range(3)) for d in distances for a in range(3)]


def affinities(labels: DataFrame, distances: list[int]) -> DataFrame:
    """For every voxel and offset within the block (or the grid) whether both ends have the same label, not 0."""
    near = shifted(labels, offsets_along_axes([-d for d in distances]), "label")
    same = (F.col("label") == F.col("other")) & (F.col("label") != 0)
    return near.select(*blocks_of(labels), "z", "y", "x", "oz", "oy", "ox", F.coalesce(same, F.lit(False)).cast("int").alias("affinity"))


FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def grow_boundary(labels: DataFrame, steps: int = 1) -> DataFrame:
    """Voxels with a face neighbour of another label become 0, as many times as steps (a margin must have as many voxels)."""
    keys = [*blocks_of(labels), "z", "y", "x"]
    for _ in range(steps):
        near = shifted(labels, FACES, "label").groupBy(*keys).agg(F.max((F.col("label") != F.col("other")).cast("int")).alias("_edge"))
        labels = labels.join(near, keys, "left").withColumn("label", F.when(F.coalesce("_edge", F.lit(0)) == 1, 0).otherwise(F.col("label"))).drop("_edge")
    return labels


def dilate_sections(labels: DataFrame, steps: int = 1) -> DataFrame:
    """Zero voxels take the greatest label of their 3 x 3 neighbourhood in the section, as many times as steps (a margin must have as many voxels)."""
    keys = [*blocks_of(labels), "z", "y", "x"]
    square = [(0, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    for _ in range(steps):
        most = shifted(labels, square, "label").groupBy(*keys).agg(F.max("other").alias("_most"))
        labels = labels.join(most, keys, "left").withColumn("label", F.when(F.col("label") == 0, F.coalesce("_most", F.lit(0))).otherwise(F.col("label"))).drop("_most")
    return labels


def balance_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight: inverse frequency, so that every class weighs the same; weights average 1 over rows."""
    n = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    return n.withColumn("weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")))
