"""Scores of a segmentation against reference skeletons.

Two of the definitions (expected run length, Rand and variation of information) follow published
formulas, as the reference computes them in a package whose code is not at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexigrid.operators.skew import skew_join
from plexigrid.session import cut

#: Node ids that one window takes.
RANGE = 65536


def beside(*ones: DataFrame) -> DataFrame:
    """One-row tables of numbers with different columns as one row."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ones)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def contingency(df: DataFrame, truth: str, test: str) -> DataFrame:
    """t, g, n: how often each pair of labels occurs; rows with a null label or truth 0 do not count."""
    ok = F.col(truth).isNotNull() & F.col(test).isNotNull()
    return df.where(ok & (F.col(truth).cast("string") != "0")).groupBy(F.col(truth).alias("t"), F.col(test).alias("g")).agg(F.count("*").alias("n"))


def rand_voi(pairs: DataFrame) -> DataFrame:
    """One row with rand_split, rand_merge, nvi_split, nvi_merge of a contingency table; all null if it is empty.

    rand_split = sum n_tg^2 / sum n_t^2, rand_merge likewise by g; voi_split = H(g|t), voi_merge =
    H(t|g), both divided by the joint entropy (0 if that is 0).
    """
    n = F.col("n").cast("double")
    sums = [F.sum(n * n).alias("sq"), F.sum(n * F.log(n)).alias("nl"), F.sum(n).alias("all")]
    both = pairs.agg(*sums)
    by_t = pairs.groupBy("t").agg(F.sum("n").alias("n")).agg(*sums[:2]).toDF("sq_t", "nl_t")
    by_g = pairs.groupBy("g").agg(F.sum("n").alias("n")).agg(*sums[:2]).toDF("sq_g", "nl_g")
    one = beside(both, by_t, by_g)
    joint = F.log("all") - F.col("nl") / F.col("all")
    h_t, h_g = F.log("all") - F.col("nl_t") / F.col("all"), F.log("all") - F.col("nl_g") / F.col("all")
    part = lambda h: F.when(joint > 1e-12, (joint - h) / joint).otherwise(F.when(F.col("all").isNotNull(), 0.0))
    return one.select((F.col("sq") / F.col("sq_t")).alias("rand_split"), (F.col("sq") / F.col("sq_g")).alias("rand_merge"), part(h_t).alias("nvi_split"), part(h_g).alias("nvi_merge"))


def blend(nvi_split: Column, nvi_merge: Column, rand_split: Column, rand_merge: Column, erl_norm: Column) -> dict[str, Column]:
    """The blended scores; score_erl_rand is the one that ranks."""
    voi, rand = 1 - (nvi_split + nvi_merge) / 2, (rand_split + rand_merge) / 2
    return {"score_voi": voi, "score_rand": rand, "score_erl_voi": (voi + erl_norm) / 2, "score_erl_rand": (rand + erl_norm) / 2}


def path_edges(nodes: DataFrame) -> DataFrame:
    """skeleton_id, u, v, gu, gv, length: each node with the next of its skeleton in node order.

    nodes: node, skeleton_id, seg_label, z, y, x, each node once; nodes without position or skeleton
    are left out. A hot skeleton is cut into ranges of node ids: within a range a window finds the
    next node, across ranges the last and first nodes are linked (one row a range, so that even a
    skeleton of 10^11 nodes leaves under two million rows to that window).
    """
    ok = nodes.where("skeleton_id is not null and z is not null and y is not null and x is not null")
    part = F.floor(F.col("node") / RANGE).alias("_part")
    rows = ok.select("skeleton_id", part, F.struct("node", "seg_label", "z", "y", "x").alias("a"))
    within = rows.withColumn("b", F.lead("a").over(Window.partitionBy("skeleton_id", "_part").orderBy("a.node"))).where("b is not null").select("skeleton_id", "a", "b")
    seams = rows.groupBy("skeleton_id", "_part").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    w = Window.partitionBy("skeleton_id").orderBy("_part")
    across = seams.withColumn("b", F.lead("lo").over(w)).where("b is not null").select("skeleton_id", F.col("hi").alias("a"), "b")
    e = within.unionByName(across)
    d = [F.col(f"a.{c}") - F.col(f"b.{c}") for c in "zyx"]
    return e.select("skeleton_id", F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.seg_label").alias("gu"), F.col("b.seg_label").alias("gv"), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("length"))


def skeleton_lengths(edges: DataFrame) -> DataFrame:
    return edges.groupBy("skeleton_id").agg(F.sum("length").alias("length"))


def merging_segments(nodes: DataFrame) -> DataFrame:
    """seg_label, skeletons of the segments (not null, not 0) that touch more than one skeleton."""
    pairs = nodes.where("seg_label <> 0 and skeleton_id is not null").select("seg_label", "skeleton_id").distinct()
    return pairs.groupBy("seg_label").agg(F.count("*").alias("skeletons")).where("skeletons > 1")


def expected_run_length(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: erl, avg_length, erl_norm.

    An edge is right if both ends have the same label (not 0) and that segment does not merge
    skeletons; erl = sum over (skeleton, label) of (sum of right lengths)^2 / sum of all lengths.
    avg_length is the mean length of skeletons longer than 0. Null where there is no length.
    """
    total = skeleton_lengths(edges).where("length > 0").agg(F.sum("length").alias("all"), F.avg("length").alias("avg_length"))
    right = edges.where((F.col("gu") == F.col("gv")) & (F.col("gu") != 0)).groupBy("skeleton_id", F.col("gu").alias("seg_label")).agg(F.sum("length").alias("l"))
    right = right.join(merging_segments(nodes).select("seg_label"), "seg_label", "left_anti")
    one = beside(right.agg(F.coalesce(F.sum(F.col("l") * F.col("l")), F.lit(0.0)).alias("sq")), total)
    return one.select((F.col("sq") / F.col("all")).alias("erl"), "avg_length", (F.col("sq") / F.col("all") / F.col("avg_length")).alias("erl_norm"))


def split_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends lie in different segments (0 differs from every label, also from another 0)."""
    return edges.where((F.col("gu") != F.col("gv")) | ((F.col("gu") == 0) & (F.col("gv") == 0)))


def split_histogram(skeletons: DataFrame, splits: DataFrame) -> DataFrame:
    """splits, skeletons: how many skeletons have how many splits, those without any included."""
    n = splits.groupBy("skeleton_id").agg(F.count("*").alias("n"))
    every = skeletons.select("skeleton_id").distinct().join(n, "skeleton_id", "left")
    return every.groupBy(F.coalesce("n", F.lit(0)).alias("splits")).agg(F.count("*").alias("skeletons"))


def merge_counts(nodes: DataFrame) -> DataFrame:
    """seg_label, skeletons, sites: k skeletons in a segment make k (k - 1) / 2 merge sites."""
    return merging_segments(nodes).withColumn("sites", (F.col("skeletons") * (F.col("skeletons") - 1) / 2).cast("bigint"))


def merge_sites(nodes: DataFrame, radius: float) -> DataFrame:
    """seg_label, s1 < s2, u, v, distance: the nearest nodes of two skeletons in one segment, if within radius.

    Space is cut into cubes of the radius, so that a node meets only those of its own and the next
    cubes: an equi-join on (segment, cube), never all pairs of a segment. Ties go to the smaller u,
    then v. all_merge_sites() has the pairs at any distance, merge_counts() their number.
    """
    ok = nodes.where("seg_label <> 0 and skeleton_id is not null and z is not null and y is not null and x is not null")
    cell = ok.withColumns({f"c{c}": F.floor(F.col(c) / radius).cast("bigint") for c in "zyx"})
    cell = cell.select("seg_label", "skeleton_id", "node", "z", "y", "x", "cz", "cy", "cx")
    busy = cell.select("seg_label", "skeleton_id").distinct().groupBy("seg_label").agg(F.count("*").alias("k")).where("k > 1").select("seg_label")
    cell = skew_join(cell, busy, "seg_label", "left_semi")
    near = cell
    for c in "zyx":
        near = near.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + d for d in (-1, 0, 1)])))
    a = near.select("seg_label", "cz", "cy", "cx", *[F.col(c).alias(f"a{c}") for c in "zyx"], F.col("skeleton_id").alias("s1"), F.col("node").alias("u"))
    b = cell.select("seg_label", "cz", "cy", "cx", *[F.col(c).alias(f"b{c}") for c in "zyx"], F.col("skeleton_id").alias("s2"), F.col("node").alias("v"))
    d = [F.col(f"a{c}") - F.col(f"b{c}") for c in "zyx"]
    met = a.join(b, ["seg_label", "cz", "cy", "cx"]).where("s1 < s2").withColumn("distance", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("distance") <= radius)
    best = met.groupBy("seg_label", "s1", "s2").agg(F.min(F.struct("distance", "u", "v")).alias("m"))
    return best.select("seg_label", "s1", "s2", "m.u", "m.v", "m.distance")


#: Numbers in one matrix of distances.
MATRIX = 1 << 20
#: Rows that a task returns at once.
RETURNED = 1 << 16
#: Nodes from which on a skeleton is searched by a tree of boxes, not by a matrix of all distances, and the least in a box.
LONG, LEAF = 2048, 16
#: Squared distances up to so many times the least can have the same root.
SAME = 1 + 16 * np.finfo(float).eps


def _products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows of a to all of b (NaN as infinite), and by how much they may be wrong."""
    if np.isfinite(a).all() and np.isfinite(b).all() and max(np.abs(a).max(), np.abs(b).max()) < 1e100:
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        left = np.column_stack([a * -2, aa, np.ones(len(a))])
        return left @ np.column_stack([b, np.ones(len(b)), bb]).T, 64 * np.finfo(float).eps * (aa.max() + bb.max())
    with np.errstate(all="ignore"):
        out = ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)
    return np.where(np.isnan(out), np.inf, out), 0.0


def _begins(s: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.nonzero(s[1:] != s[:-1])[0] + 1])


def _tile(a: tuple, b: tuple, later: bool) -> tuple:
    """s1, s2, u, v, distance of every two skeletons, one of a and one of b (s, node, place; sorted by both); with later only where b's is the greater."""
    g, wrong = _products(a[2], b[2])
    ra, rb = _begins(a[0]), _begins(b[0])
    na, nb = np.diff(ra, append=len(a[0])), np.diff(rb, append=len(b[0]))
    low = np.minimum.reduceat(g, ra, axis=0)  # along the rows first, of all columns at once
    least = np.minimum.reduceat(low, rb, axis=1)
    one, other = a[0][ra][:, None], b[0][rb][None, :]
    bound = np.where(other > one if later else other != one, least * SAME + wrong, -np.inf)
    bound = np.repeat(bound, nb, axis=1)
    of, col = np.divmod(np.flatnonzero(low <= bound), len(b[0]))
    n = na[of]
    row = np.arange(n.sum()) + np.repeat(ra[of] - np.cumsum(n) + n, n)  # all rows of a's skeleton in these columns
    of, col = np.repeat(of, n), np.repeat(col, n)
    good = g[row, col] <= bound[of, col]
    of, row, col = of[good], row[good], col[good]
    with np.errstate(all="ignore"):
        d = np.sqrt(_squares(a[2][row] - b[2][col]))
    rows = _turned(a[0][row], b[0][col], a[1][row], b[1][col], d)
    pair = of * len(rb) + np.repeat(np.arange(len(rb)), nb)[col]
    tied = np.bincount(pair, minlength=1)[pair] > 1
    if not tied.any():
        return rows
    return tuple(np.concatenate(c) for c in zip([c[~tied] for c in rows], _nearest(*(c[tied] for c in rows))))


def _squares(d: np.ndarray) -> np.ndarray:
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]


def _turned(s1, s2, u, v, d) -> tuple:
    """The rows with the lesser skeleton first."""
    turned = s1 > s2
    return np.where(turned, s2, s1), np.where(turned, s1, s2), np.where(turned, v, u), np.where(turned, u, v), d


def _nearest(s1, s2, u, v, d) -> tuple:
    """Of each two skeletons the row of the least distance, then u, then v."""
    order = np.lexsort((v, u, d, s2, s1))
    first = np.ones(len(order), bool)
    p, q = s1[order], s2[order]
    first[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    order = order[first]
    return s1[order], s2[order], u[order], v[order], d[order]


def _tree(p: np.ndarray) -> tuple:
    """Nodes by leaves, each split at the median of its longest side, and the corners of boxes, of all levels from the root on.

    All leaves have as many nodes; for that some are there twice.
    """
    depth = max(0, int(np.log2(len(p) / LEAF))) if len(p) > LEAF else 0
    total = -(-len(p) // (1 << depth)) << depth
    order = np.arange(total) * len(p) // total
    for level in range(depth):
        q, order = p[order].reshape(1 << level, -1, 3), order.reshape(1 << level, -1)
        longest = (q.max(1) - q.min(1)).argmax(1)
        key = np.take_along_axis(q, longest[:, None, None], 2)[:, :, 0]
        order = np.take_along_axis(order, key.argsort(1), 1).ravel()
    q = p[order].reshape(1 << depth, -1, 3)
    lo, hi = [q.min(1)], [q.max(1)]
    for _ in range(depth):
        lo.insert(0, np.minimum(lo[0][::2], lo[0][1::2]))
        hi.insert(0, np.maximum(hi[0][::2], hi[0][1::2]))
    return order.reshape(1 << depth, -1), lo, hi


def _searched(a: tuple, b: tuple) -> tuple:
    """Rows of one skeleton with every skeleton of b (rows of each together, places finite), by the tree of a's boxes.

    A box is opened as long as it may be as near as what is known of b's skeleton. Differences,
    squares and sums are rounded in the same order for boxes as for nodes, so that a box is never told farther than
    a node in it. At most MATRIX numbers are compared at once.
    """
    order, lo, hi = _tree(a[2])
    depth, leaves, place = len(lo) - 1, a[2][order], b[2]
    begins = _begins(b[0])
    which = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(b[0])))
    most = max(1, MATRIX // order.shape[1] // 4)

    def apart(of: np.ndarray, level: int, box: np.ndarray) -> np.ndarray:
        p = place[of]
        return _squares(np.maximum(np.maximum(lo[level][box] - p, p - hi[level][box]), 0))

    least, stack, found = np.full(len(begins), np.inf), [], []
    for first in range(0, len(place), most):
        of = np.arange(first, min(first + most, len(place)))
        box = np.zeros(len(of), int)
        stack.append((0, of, box))
        for level in range(1, depth + 1):
            box = box * 2
            box += apart(of, level, box + 1) < apart(of, level, box)
        np.minimum.at(least, which[of], _squares(place[of][:, None] - leaves[box]).min(1))
    while stack:
        level, of, box = stack.pop()
        near = apart(of, level, box) <= least[which[of]] * SAME
        of, box = of[near], box[near]
        if level < depth:
            of, box = np.repeat(of, 2), np.repeat(box * 2, 2)
            box[1::2] += 1
            stack += [(level + 1, of[k : k + most], box[k : k + most]) for k in range(0, len(of), most)]
        elif len(of):
            g = _squares(place[of][:, None] - leaves[box])
            np.minimum.at(least, which[of], g.min(1))
            row, col = np.nonzero(g <= (least[which[of]] * SAME)[:, None])
            found.append(_turned(np.full(len(row), a[0][0]), b[0][of[row]], a[1][order[box[row], col]], b[1][of[row]], np.sqrt(g[row, col])))
            if sum(len(f[0]) for f in found) > MATRIX:
                found = [_nearest(*(np.concatenate(c) for c in zip(*found)))]
    return _nearest(*(np.concatenate(c) for c in zip(*found)))


def _parted(a: tuple) -> tuple[list[tuple], tuple]:
    """Each long skeleton of a, and the rows of the others."""
    begins = _begins(a[0])
    ends = np.append(begins[1:], len(a[0]))
    long = np.flatnonzero(ends - begins >= LONG)
    rest = np.repeat(ends - begins < LONG, ends - begins)
    return [tuple(c[begins[k] : ends[k]] for c in a) for k in long], tuple(c[rest] for c in a)


def _pairs(a: tuple, b: tuple | None) -> Iterator[tuple]:
    """The rows of all pairs of skeletons inside a (without b), or between a and b; of one skeleton of a at a time if it is long."""
    if np.isfinite(a[2]).all() and (b is None or np.isfinite(b[2]).all()):
        with np.errstate(all="ignore"):
            long, a = _parted(a)
            meets = [(one, tuple(np.concatenate(c) for c in zip(a, *long[k + 1 :])) if b is None else b) for k, one in enumerate(long)]
            if b is not None:
                long, b = _parted(b)
                meets += [(one, a) for one in long]
            for one, to in meets:
                other = to[0] != one[0][0]
                if other.any():
                    yield _searched(one, to if other.all() else tuple(c[other] for c in to))
    if not len(a[0]):
        return
    begins = _begins(a[0])
    ends = np.append(begins[1:], len(a[0]))
    k = 0
    while k < len(begins):
        lo = begins[k]
        to = tuple(c[ends[k] :] for c in a) if b is None else b
        if not len(to[0]):
            return
        most = max(1, MATRIX // len(to[0]))
        last = max(k + 1, int(np.searchsorted(ends, lo + most, "right")))  # whole skeletons that fit together
        hi = ends[last - 1]
        parts = [_tile(tuple(c[r : min(r + most, hi)] for c in a), to, b is None) for r in range(lo, hi, most)]
        yield parts[0] if len(parts) == 1 else _nearest(*(np.concatenate(c) for c in zip(*parts)))
        k = last


#: What all_merge_sites() adds to a pair if asked to: both places, and the tag of u.
CARRIED = ["z_u", "y_u", "x_u", "z_v", "y_v", "x_v", "tag"]


def _sites(batches: Iterator[pd.DataFrame], carried: bool = False) -> Iterator[pd.DataFrame]:
    """Nearest nodes of the skeletons of each group (seg_label, i, j), whose rows come together: sides 0 and 1, or 0 alone."""
    held: list[tuple] = []
    names = ["seg_label", "s1", "s2", "u", "v", "distance", *(CARRIED if carried else [])]

    def full(least: int) -> Iterator[pd.DataFrame]:
        if sum(len(h[0]) for h in held) >= least and held:
            yield pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*held)))))
            held.clear()

    def groups() -> Iterator[pd.DataFrame]:
        keys, open_ = ["seg_label", "i", "j"], []
        for batch in batches:
            if not len(batch):
                continue
            k = batch[keys].to_numpy()
            cuts = np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1
            if open_ and (open_[0][keys].to_numpy()[0] != k[0]).any():
                yield pd.concat(open_)
                open_ = []
            for lo, hi in zip([0, *cuts], [*cuts, len(k)]):
                open_.append(batch.iloc[lo:hi])
                if hi < len(k):
                    yield pd.concat(open_) if len(open_) > 1 else open_[0]
                    open_ = []
        if open_:
            yield pd.concat(open_)

    for g in groups():
        side, s, node, place = g["side"].to_numpy(), g["s"].to_numpy(), g["node"].to_numpy(), g[["z", "y", "x"]].to_numpy()
        at = int((side == 0).sum())  # rows are in the order of sides
        if not at or (at == len(side) and (s[0] == s[-1] or g["whole"].iloc[0] == 0)):
            continue
        a = (s[:at], node[:at], place[:at])
        order = np.argsort(node) if carried else None
        for rows in _pairs(a, (s[at:], node[at:], place[at:]) if at < len(side) else None):
            if carried:
                u, v = (order[np.searchsorted(node, end, sorter=order)] for end in rows[2:4])
                rows = (*rows, *place[u].T, *place[v].T, g["tag"].to_numpy()[u])
            if len(rows[0]):
                held.append((np.full(len(rows[0]), g["seg_label"].iloc[0]), *rows))
            yield from full(RETURNED)
    yield from full(1)


def all_merge_sites(nodes: DataFrame, side: float, leaf: int = 256, part: int = 1 << 16, carried: bool = False) -> DataFrame:
    """seg_label, s1 < s2, u, v, distance: the nearest nodes of every two skeletons in one segment, at any distance.

    The skeletons of a segment lie in parts of about part nodes. Every two parts, and every part with
    itself, meet in one group of rows, where matrix products tell which nodes can be nearest and
    distances of these decide: what is shuffled are nodes, once a part of their segment (once if it
    has up to part nodes), never pairs, and the rows of pairs go straight to the result. Skeletons of more than part
    nodes are cut by nodes; the rows of their pieces alone are grouped. Ties go to the smaller u, then
    v. The result does not depend on side, leaf and part. With carried nodes have a
    tag (bigint, the same all along a skeleton), and the result CARRIED as well: no join of pairs is needed for those.
    """
    ok = nodes.where("seg_label <> 0 and skeleton_id is not null and z is not null and y is not null and x is not null")
    tag = ["tag"] if carried else []
    per = ok.groupBy("seg_label", F.col("skeleton_id").alias("s")).agg(F.count("*").alias("n"))
    per = cut(per, "lengths")
    wide = per.where(F.col("n") > part).withColumn("wide", F.lit(1))
    size = per.groupBy("seg_label").agg(F.count("*").alias("k"), F.ceil(F.sum("n") / part).cast("int").alias("parts"), F.ceil(F.sum(F.when(F.col("n") > part, F.col("n"))) / part).cast("int").alias("wide_parts")).where("k > 1").drop("k")
    own = skew_join(ok, size, "seg_label").select("seg_label", F.col("skeleton_id").alias("s"), "node", *[F.col(c).cast("double").alias(c) for c in "zyx"], *tag, "parts", "wide_parts")
    own = cut(skew_join(own, wide.select("seg_label", "s", "wide"), ["seg_label", "s"], "left"), "merging")
    columns = ["seg_label", "i", "j", "side", "whole", "s", "node", "z", "y", "x", *tag]
    more = CARRIED if carried else []
    schema = "seg_label bigint, s1 bigint, s2 bigint, u bigint, v bigint, distance double" + "".join(f", {c} {'bigint' if c == 'tag' else 'double'}" for c in more)

    def met(df: DataFrame) -> DataFrame:
        tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, own.count() // 20_000))
        rows = df.select(*columns).repartition(tasks, "seg_label", "i", "j").sortWithinPartitions("seg_label", "i", "j", "side", "s", "node")
        return rows.mapInPandas(partial(_sites, carried=carried), schema)

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    by_s, by_node = (F.pmod(F.xxhash64(c), F.col("parts")).cast("int") for c in ("s", "node"))
    narrow = own.where("wide is null").withColumn("p", by_s).withColumn("q", every("parts"))
    narrow = narrow.withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q"), "side": (F.col("p") > F.col("q")).cast("int"), "whole": (F.col("p") == F.col("q")).cast("int")})
    short = met(narrow)
    if wide.isEmpty():
        return short
    piece = F.pmod(F.xxhash64("node"), F.col("wide_parts")).cast("int")
    long = own.where("wide = 1").withColumn("i", piece).withColumn("j", every("parts")).withColumn("side", F.lit(0))
    rest = own.where("wide_parts > 0").withColumn("j", F.when(F.col("wide") == 1, by_node).otherwise(by_s)).withColumn("i", every("wide_parts")).withColumn("side", F.lit(1))
    pieces = met(long.unionByName(rest).withColumn("whole", F.lit(0)))
    best = pieces.groupBy("seg_label", "s1", "s2").agg(F.min(F.struct("distance", "u", "v", *more)).alias("m"))
    return short.unionByName(best.select("seg_label", "s1", "s2", *[f"m.{c}" for c in ("u", "v", "distance", *more)]))


def fresh_labels(nodes: DataFrame, voxel: float) -> DataFrame:
    """node, seg_label with a new label for each voxel that has nodes of label 0: max + 1, + 2 ... by first node.

    Later nodes of the voxel take the same new label. Nulls stay. The voxels of label 0 are numbered
    over ranges of their first node (offsets by a running sum over the ranges), not in one task.
    """
    at = nodes.withColumn("_vox", F.struct(*[F.floor(F.col(c) / voxel).alias(c) for c in "zyx"]))
    zero = at.where("seg_label = 0").groupBy("_vox").agg(F.min("node").alias("_first"))
    span = F.floor(F.col("_first") / RANGE)
    ranked = zero.withColumn("_span", span).withColumn("_in", F.row_number().over(Window.partitionBy("_span").orderBy("_first")))
    offsets = ranked.groupBy("_span").agg(F.count("*").alias("_n"))
    # one row per 65,536 node ids
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = nodes.agg(F.max("seg_label")).first()[0] or 0
    new = ranked.join(offsets, "_span").select("_vox", (F.lit(top) + F.col("_before") + F.col("_in")).alias("_new"))
    out = at.join(new, "_vox", "left")
    return out.select("node", F.when(F.col("seg_label") == 0, F.col("_new")).otherwise(F.col("seg_label")).alias("seg_label"))


def rasterise(nodes: DataFrame, voxel: float) -> DataFrame:
    """z, y, x, value: the voxels that nodes fall into; of several skeletons the greatest id stays."""
    ok = nodes.where("skeleton_id is not null and z is not null and y is not null and x is not null")
    return ok.groupBy(*[F.floor(F.col(c) / voxel).cast("bigint").alias(c) for c in "zyx"]).agg(F.max("skeleton_id").alias("value"))


def label_at(points: DataFrame, volume: DataFrame, voxel: int) -> DataFrame:
    """points (z, y, x in nm and other columns) with the label of the voxel of volume (z, y, x, label) that each falls into.

    Points outside of the volume, or with a null coordinate, are left out. A voxel is in the volume
    once, so that voxels in which very many points crowd are joined apart.
    """
    at = points.withColumns({f"_{c}": F.floor(F.col(c) / voxel).cast("bigint") for c in "zyx"})
    cells = volume.select(*[F.col(c).cast("bigint").alias(f"_{c}") for c in "zyx"], "label")
    return skew_join(at, cells, ["_z", "_y", "_x"]).drop("_z", "_y", "_x")


def evaluate(nodes: DataFrame) -> DataFrame:
    """One row of all scores of a segmentation, from nodes: node, skeleton_id, seg_label, z, y, x (each node once).

    Scores that nothing is left to tell (no nodes, no lengths) are null, counts 0.
    """
    n = cut(nodes, "nodes")
    e = cut(path_edges(n), "paths")
    rv = rand_voi(contingency(n.where("seg_label <> 0"), "skeleton_id", "seg_label"))
    splits = split_edges(e).agg(F.count("*").cast("double").alias("splits"))
    merges = merge_counts(n).agg(F.coalesce(F.sum("sites"), F.lit(0)).cast("double").alias("merges"))
    neurons = n.where("skeleton_id is not null").agg(F.countDistinct("skeleton_id").cast("double").alias("n_neurons"))
    one = beside(rv, expected_run_length(e, n), splits, merges, neurons)
    one = one.withColumns(blend(F.col("nvi_split"), F.col("nvi_merge"), F.col("rand_split"), F.col("rand_merge"), F.col("erl_norm")))
    return one.withColumns({f"{c}_per_neuron": F.try_divide(c, "n_neurons") for c in ("splits", "merges")})


def as_report(one: DataFrame) -> DataFrame:
    """metric, value of a one-row table of doubles."""
    return one.unpivot([], one.columns, "metric", "value")
