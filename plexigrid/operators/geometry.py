"""World coordinates, regions and block grids as Column expressions.

Axis order is z, y, x. Division floors as the coordinates may be negative; all sizes are positive.
A null in any coordinate gives null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def floor_div(a: Column, b: Column) -> Column:
    """floor(a / b) in exact integers (Spark's div truncates towards 0)."""
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def align_down(a: Column, step: Column) -> Column:
    """The greatest multiple of step that is not above a."""
    return a - F.pmod(a, step)


def voxel_of(nm: Column, voxel: int) -> Column:
    """Voxel index of a world coordinate (double), floored."""
    return F.floor(nm / voxel).cast("bigint")


@dataclass(frozen=True)
class Roi:
    """A half-open box: begin and shape of each axis."""

    begin: tuple[int, int, int]
    shape: tuple[int, int, int]

    @property
    def end(self) -> tuple[int, int, int]:
        return tuple(b + s for b, s in zip(self.begin, self.shape))

    @property
    def empty(self) -> bool:
        return any(s <= 0 for s in self.shape)

    def contains(self, other: Roi) -> bool:
        return all(a <= b and c >= d for a, b, c, d in zip(self.begin, other.begin, self.end, other.end))

    def intersect(self, other: Roi) -> Roi:
        b = tuple(map(max, self.begin, other.begin))
        e = tuple(map(min, self.end, other.end))
        return Roi(b, tuple(max(0, y - x) for x, y in zip(b, e)))

    def grow(self, by: tuple[int, int, int]) -> Roi:
        return Roi(tuple(b - g for b, g in zip(self.begin, by)), tuple(s + 2 * g for s, g in zip(self.shape, by)))

    def snap(self, step: tuple[int, int, int]) -> Roi:
        """Grown to the grid of step."""
        b = tuple(x // s * s for x, s in zip(self.begin, step))
        e = tuple(-(-x // s) * s for x, s in zip(self.end, step))
        return Roi(b, tuple(y - x for x, y in zip(b, e)))

    def where(self, z: str = "z", y: str = "y", x: str = "x") -> Column:
        """Rows inside: plain range predicates, which reach the Parquet scan."""
        parts = [(F.col(c) >= b) & (F.col(c) < e) for c, b, e in zip((z, y, x), self.begin, self.end)]
        return reduce(lambda p, q: p & q, parts)


def whole_roi(roi: str) -> Column:
    """Whether a struct<begin array, shape array> has three begins and three positive shapes."""
    b, s = F.col(roi)["begin"], F.col(roi)["shape"]
    ok = (F.size(b) == 3) & (F.size(s) == 3)
    for i in range(3):
        ok = ok & b.getItem(i).isNotNull() & (s.getItem(i) > 0)
    return F.coalesce(ok, F.lit(False))


def flat_roi(df: DataFrame, roi: str, prefix: str) -> DataFrame:
    """Begin and end of each axis of a roi struct as columns <prefix><axis>0 and <prefix><axis>1."""
    cols = {}
    for i, a in enumerate(AXES):
        b, s = F.col(roi)["begin"].getItem(i), F.col(roi)["shape"].getItem(i)
        cols |= {f"{prefix}{a}0": b, f"{prefix}{a}1": b + s}
    return df.withColumns(cols)


def tile(df: DataFrame, begin: dict[str, Column], end: dict[str, Column], step: Column, fit: str = "shrink") -> DataFrame:
    """One row per block of a grid of step from begin to end on every axis: columns <axis>0, <axis>1.

    fit: shrink clips the last block to the end, overhang keeps its full size, valid leaves a block
    that does not fit out. Rows with a null bound, an end not above its begin or a step below 1 give
    no blocks.
    """
    if fit not in ("shrink", "overhang", "valid"):
        raise ValueError(f"no such fit: {fit}")
    ok = reduce(lambda p, q: p & q, [(end[a] > begin[a]) for a in AXES]) & (step >= 1)
    out = df.where(ok)
    for a in AXES:
        out = out.withColumn(f"{a}0", F.explode(F.sequence(begin[a], end[a] - 1, step)))
    for a in AXES:
        stop = F.col(f"{a}0") + step
        if fit == "valid":
            out = out.where(stop <= end[a])
        out = out.withColumn(f"{a}1", F.least(stop, end[a]) if fit == "shrink" else stop)
    return out


def face_neighbours(blocks: DataFrame, keys: tuple[str, str, str] = ("bz", "by", "bx")) -> DataFrame:
    """Every block with each of the up to six blocks of the table that share a face: columns n<key>."""
    steps = [(d if i == a else 0) for a in range(3) for d in (-1, 1) for i in range(3)]
    offsets = F.array(*[F.struct(*[F.lit(steps[k * 3 + i]).alias(f"d{i}") for i in range(3)]) for k in range(6)])
    ids = blocks.select(*keys).distinct()
    near = ids.withColumn("_o", F.explode(offsets)).select(*keys, *[(F.col(k) + F.col(f"_o.d{i}")).alias(f"n{k}") for i, k in enumerate(keys)])
    return near.join(ids.select(*[F.col(k).alias(f"n{k}") for k in keys]), [f"n{k}" for k in keys], "left_semi")


def halo_blocks(points: DataFrame, size: int, context: int, coords: tuple[str, str, str]) -> DataFrame:
    """Each point with every block (bz, by, bx of a grid of size) whose region grown by context holds it.

    The range join of points with grown blocks as an explode: at most (2 * ceil(context / size) + 1)
    blocks an axis, so that what follows is an equi-join or a grouping by block. Points with a null
    coordinate are left out.
    """
    out = points.where(reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in coords]))
    for c, k in zip(coords, ("bz", "by", "bx")):
        lo = F.floor((F.col(c) - context) / size).cast("bigint")
        hi = F.floor((F.col(c) + context) / size).cast("bigint")
        out = out.withColumn(k, F.explode(F.sequence(lo, hi)))
        out = out.where((F.col(c) >= F.col(k) * size - context) & (F.col(c) < (F.col(k) + 1) * size + context))
    return out


#: Regions of an evaluation by its mode (fixed values, nm).
MODES = {"validation": Roi((8316,) * 3, (23067,) * 3), "test": Roi((3267,) * 3, (33066,) * 3)}


def blocks_with_points(boxes: DataFrame, keys: list[str], points: DataFrame, cell: int) -> DataFrame:
    """The keys of the boxes (columns <axis>0, <axis>1) that hold at least one point (z, y, x).

    Boxes and points meet in cubes of cell a side. A cube that a box holds whole needs only to have
    a point at all, so that points are compared one by one in cubes at the box's faces alone, and
    equal places count once. Both joins are semi-joins, which may broadcast points but never cubes:
    Catalyst takes boxes for as many rows before their cubes are listed as after.
    """
    at = points.where(reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in AXES])).select(*AXES).distinct()
    at = at.withColumns({f"c{a}": F.floor(F.col(a) / cell).cast("bigint") for a in AXES})
    cubes = boxes.where(reduce(lambda p, q: p & q, [F.col(f"{a}1") > F.col(f"{a}0") for a in AXES]))
    for a in AXES:
        lo, hi = floor_div(F.col(f"{a}0"), F.lit(cell)), floor_div(F.col(f"{a}1") - 1, F.lit(cell))
        cubes = cubes.withColumn(f"c{a}", F.explode(F.sequence(lo, hi)))
    cube = [f"c{a}" for a in AXES]
    whole = reduce(lambda p, q: p & q, [(F.col(f"{a}0") <= F.col(f"c{a}") * cell) & (F.col(f"{a}1") >= (F.col(f"c{a}") + 1) * cell) for a in AXES])
    full = cubes.where(whole).join(at.select(*cube).distinct(), cube, "left_semi").select(*keys)
    inside = reduce(lambda p, q: p & q, [(F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")) for a in AXES])
    near, own = cubes.where(~whole), at.withColumnsRenamed({c: f"_{c}" for c in cube})
    part = near.join(own, reduce(lambda p, q: p & q, [F.col(c) == F.col(f"_{c}") for c in cube]) & inside, "left_semi").select(*keys)
    return full.unionByName(part).distinct()


def compatible_rois(source: dict[str, Column], chunk: Column, voxel: Column, net: Column, roi: Roi | None = None, sub_roi: Roi | None = None, shrink: Column | None = None) -> dict[str, Column]:
    """What a task schedules and writes (s<axis>0, s<axis>1, d<axis>0, d<axis>1) of a source region (<axis>0, <axis>1).

    An explicit region is written as it is and scheduled with the network's context around it. Of a
    sub-region the whole source is the dataset and the sub-region, with the context, is scheduled.
    With neither, the whole source is both; shrink takes that context off the source first. All is
    grown to the voxel grid. ok tells whether the rules hold: an explicit region lies in the source,
    a sub-region too and begins on the chunk grid of the source.
    """
    out, ok = {}, F.lit(True)
    for i, a in enumerate(AXES):
        b, e = source[f"{a}0"], source[f"{a}1"]
        if roi is not None:
            d = F.lit(roi.begin[i]), F.lit(roi.end[i])
            ok = ok & (d[0] >= b) & (d[1] <= e)
            s = d
        elif sub_roi is not None:
            d, s = (b, e), (F.lit(sub_roi.begin[i]), F.lit(sub_roi.end[i]))
            ok = ok & (s[0] >= b) & (s[1] <= e) & (F.pmod(b - s[0], chunk) == 0)
        else:
            c = F.lit(0) if shrink is None else shrink
            d = s = (b + c, e - c)
        s = s[0] - net, s[1] + net
        for k, (lo, hi) in (("s", s), ("d", d)):
            out[f"{k}{a}0"], out[f"{k}{a}1"] = align_down(lo, voxel).cast("bigint"), (-align_down(-hi, voxel)).cast("bigint")
    return out | {"ok": ok}
