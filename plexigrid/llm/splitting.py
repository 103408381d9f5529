"""Cutting oversized intervals at natural boundaries by recursive bisection (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cut_near_middle(b: Column, e: Column, limit: Column, line: Column) -> Column:
    """The admissible cut of [b, e) at or next below its midpoint, by the rule of split_interval.

    Cuts of an interval that starts at b, if each piece is to end on the furthest line it can reach:
    with lines no further apart than the limit they are one series of equal steps after the first;
    with wider gaps every line is a cut, and between lines the steps are of the full limit.
    A half that starts or ends at such a cut has the same cuts as the whole, so bisection is exact.
    """
    mid = b + F.floor((e - b) / 2).cast("bigint")
    step = limit - F.pmod(limit, line)
    first = b + limit - F.pmod(b + limit, line)
    dense = F.when(mid < first, first).otherwise(mid - F.pmod(mid - first, step))
    line_above = b - F.pmod(b, line) + line
    between = F.when(b + limit >= line_above, line_above).when(mid < b + limit, b + limit).otherwise(mid - F.pmod(mid - b, limit))
    sparse = F.when(mid >= line_above, mid - F.pmod(mid, line)).otherwise(between)
    no_lines = F.when(mid < b + limit, b + limit).otherwise(mid - F.pmod(mid - b, limit))
    return F.when(line.isNull() | (line <= 0), no_lines).when(limit >= line, dense).otherwise(sparse)


def split_interval(begin: Column, end: Column, limit: Column, line: Column) -> Column:
    """The pieces of [begin, end) as an array of structs b, e, ascending; none longer than limit.

    Natural boundaries are the multiples of line (absolute, also below 0). An interval longer than
    limit is cut at the strongest admissible boundary near its midpoint (a line where the piece
    before can end on one, else a full limit from where that piece begins), and halves still longer
    than limit are cut again; each row needs as many rounds as the logarithm of its number of pieces.
    The admissible boundaries are those by which every piece ends on the furthest line within limit.
    Null in begin, end or limit, a limit below 1 or an empty interval give null. A null line or one
    below 1 means that there are no natural boundaries.
    """
    b, e, m = begin.cast("bigint"), end.cast("bigint"), limit.cast("bigint")
    ln = line.cast("bigint")
    piece = lambda x, y: F.struct(x.alias("b"), y.alias("e"))

    def halves(p: Column) -> Column:
        c = _cut_near_middle(p["b"], p["e"], m, ln)
        return F.when(p["e"] - p["b"] > m, F.array(piece(p["b"], c), piece(c, p["e"]))).otherwise(F.array(piece(p["b"], p["e"])))

    rounds = (F.ceil(F.log2((e - b) / m + 2)) + 5).cast("int")
    shortest = F.when(ln.isNull() | (ln <= 0) | (ln > m), m).otherwise(m - F.pmod(m, ln))
    rounds = (rounds + F.ceil(F.log2(m / shortest + 1))).cast("int")
    start = F.array(piece(b, e))
    cut = F.aggregate(F.sequence(F.lit(1), rounds), start, lambda acc, _: F.flatten(F.transform(acc, halves)))
    return F.when((m >= 1) & (e > b), F.when(e - b > m, cut).otherwise(start))


def split_boxes(df: DataFrame, axes: list[tuple[Column, Column, Column, Column]], limit: Column, line: Column, overlap: Column, names: list[str]) -> DataFrame:
    """One row per piece of every box that is longer than limit on some axis.

    axes: for each axis begin and end of the core, and begin and end of the space that overlaps may
    use. The pieces tile the core as a grid (split_interval on each axis). A piece's outer interval
    is its core grown by overlap on both sides and clipped to the given space. Adds, for each name
    of an axis, the columns w<name>0, w<name>1, r<name>0, r<name>1. Boxes with a null bound or an
    empty axis, and boxes within the limit, give no rows; a null overlap counts as 0.
    """
    too_long = F.lit(False)
    for b, e, _, _ in axes:
        too_long = too_long | (e - b > limit)
    out = df.withColumns({f"_c{n}": split_interval(b, e, limit, line) for n, (b, e, _, _) in zip(names, axes)} | {f"_o{n}": F.struct(ob.alias("b"), oe.alias("e")) for n, (_, _, ob, oe) in zip(names, axes)} | {"_long": too_long, "_grow": F.coalesce(overlap.cast("bigint"), F.lit(0))})
    out = out.where("_long")
    for n in names:
        out = out.withColumn(f"_p{n}", F.explode(f"_c{n}")).drop(f"_c{n}")
    add = {}
    for n in names:
        add |= {f"w{n}0": F.col(f"_p{n}.b"), f"w{n}1": F.col(f"_p{n}.e")}
        add |= {f"r{n}0": F.greatest(F.col(f"_p{n}.b") - F.col("_grow"), F.col(f"_o{n}.b")), f"r{n}1": F.least(F.col(f"_p{n}.e") + F.col("_grow"), F.col(f"_o{n}.e"))}
    return out.withColumns(add).drop("_long", "_grow", *[f"_p{n}" for n in names], *[f"_o{n}" for n in names])
