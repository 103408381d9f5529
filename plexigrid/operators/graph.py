"""Region graphs: scores of contacts, thresholds, connected components and fragments."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexigrid.operators.relabel import remap
from plexigrid.operators.skew import hot_keys, skew_join
from plexigrid.operators.volume import BLOCK, BLOCKS, blocks_of, halo, shifted
from plexigrid.session import cut, discard


def scored(edges: DataFrame, score: str = "merge_score") -> DataFrame:
    """Edges with a missing score (null or NaN) as 1.0: below that they never merge."""
    return edges.withColumn(score, F.coalesce(F.when(~F.isnan(score), F.col(score)), F.lit(1.0)))


def under(edges: DataFrame, threshold: float, score: str = "merge_score") -> DataFrame:
    """Edges with a score at or below threshold (NaN is above all)."""
    return edges.where(F.col(score) <= threshold)


def boundary_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is not among the nodes of the edge's block (both tables have bz, by, bx)."""
    block = ["bz", "by", "bx"]
    ids = nodes.select(*block, F.col("id")).where("id is not null").distinct()
    out = edges
    for end in ("u", "v"):
        out = skew_join(out, ids.withColumnRenamed("id", end).withColumn(f"_{end}", F.lit(True)), [*block, end], "left", hot_keys(edges, [*block, end]))
    return out.where(F.col("_u").isNull() | F.col("_v").isNull()).select(edges.columns)


def canonical(edges: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """u < v, each pair once (in each group of by); self pairs and null ends dropped."""
    return edges.where(F.col("u") != F.col("v")).select(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame, by: Iterable[str] = (), max_rounds: int = 64) -> DataFrame:
    """key, value: every id that has an edge with the smallest id of its connected component.

    Alternating stars: every vertex links its larger neighbours to its smallest one, then its smaller
    ones to the smallest, until each component is one star. Each round is two grouped minima and two
    joins; hot vertices are joined apart. An empty table gives no rows. by names columns whose values
    are graphs of their own (thresholds), all solved in the same rounds; they come first in the result.
    """
    by = list(by)
    e = cut(canonical(edges, by), "stars")
    n = e.count()  # no round makes more edges than this
    if n == 0:
        return e.select(*by, F.col("u").alias("key"), F.col("v").alias("value"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*by, "u").agg(F.min("v").alias("_m")).select(*by, "u", F.least("u", "_m").alias("_m"))
        large = skew_join(both, low, [*by, "u"], hot=hot_keys(both, [*by, "u"], most=2 * n)).where(F.col("v") > F.col("u")).select(*by, F.col("_m").alias("u"), "v")
        large = cut(canonical(large, by), "stars")
        # small star: of each larger end, its smaller ends and itself to the smallest
        least = large.groupBy(*by, "v").agg(F.min("u").alias("_m"))
        small = skew_join(large, least, [*by, "v"], hot=hot_keys(large, [*by, "v"], most=2 * n))
        small = small.select(*by, F.col("_m").alias("u"), F.col("u").alias("v")).unionByName(least.select(*by, F.col("_m").alias("u"), "v"))
        new = cut(canonical(small, by), "stars")
        # done when every vertex is either a center or a tip of one center
        ends = new.select(*by, F.col("u").alias("x"), F.lit(0).alias("tip")).unionByName(new.select(*by, F.col("v").alias("x"), F.lit(1).alias("tip")))
        starred = ends.groupBy(*by, "x").agg(F.sum("tip").alias("as_tip"), F.min("tip").alias("low")).where("as_tip > 1 or (as_tip = 1 and low = 0)").isEmpty()
        discard(e)
        discard(large)
        e = new
        if starred:
            return e.select(*by, F.col("v").alias("key"), F.col("u").alias("value")).unionByName(e.select(*by, F.col("u").alias("key"), F.col("u").alias("value")).distinct())
    raise RuntimeError(f"not connected after {max_rounds} rounds")


def label_nodes(nodes: DataFrame, lut: DataFrame) -> DataFrame:
    """id, component for all node ids; a node without edges is its own component."""
    ids = nodes.select("id").where("id is not null").distinct()
    return remap(ids.withColumn("component", F.col("id")), lut, "component", hot=[])


def _forest(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each id's component; u and v are positions in the sorted ids."""
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if np.array_equal(new, root):
            return ids[root]
        root = new


#: Edges that a map task contracts at once (about 50 bytes each).
CHUNK_EDGES = 1 << 20


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined to chunks of about CHUNK_EDGES rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK_EDGES:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def _stars(levels: int):
    """Of each chunk of (u, v, _level) the components at every level, as stars: level, center, tip."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches):
            ids, at = np.unique(chunk[["u", "v"]].to_numpy(), return_inverse=True)
            at, level = at.reshape(-1, 2), chunk["_level"].to_numpy()
            place = np.arange(len(ids))
            root = place
            for k in range(levels):
                new = level == k
                if new.any():
                    root = _forest(place, root[at[new, 0]], root[at[new, 1]])[root]
                tip = np.nonzero(root != place)[0]
                if len(tip):
                    yield pd.DataFrame({"_level": np.full(len(tip), k, np.int32), "u": ids[root[tip]], "v": ids[tip]})

    return run


def _merges(u: np.ndarray, v: np.ndarray, level: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merges of edges: ids (sorted), the position of what each id is merged into, and at which level.

    An id leads its component, as the smallest in it, until its level, when its component meets one
    with a smaller id: that is what it is merged into, and that leads on beyond the level. Ids that
    still lead at the end point to themselves, at level levels.
    """
    ids = np.unique(np.concatenate([u, v]))
    a, b = np.searchsorted(ids, u).astype(np.int32), np.searchsorted(ids, v).astype(np.int32)
    root = np.arange(len(ids), dtype=np.int32)
    into, at = root.copy(), np.full(len(ids), levels, np.int8)
    for k in range(levels):
        new = np.nonzero(level == k)[0]
        x, y = root[a[new]], root[b[new]]
        apart = x != y
        x, y = x[apart], y[apart]
        if not len(x):
            continue
        met = np.unique(np.concatenate([x, y]))  # those who led before
        low = _forest(met, np.searchsorted(met, x), np.searchsorted(met, y))
        moved = low != met
        into[met[moved]], at[met[moved]] = low[moved], k
        root[met[moved]] = low[moved]
        root = root[root]
    return ids, into, at


def _links(levels: int):
    """Of each chunk of (_level, u, v) its merges as edges: an id less one of each component, and the same components at every level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches):
            ids, into, at = _merges(*(chunk[c].to_numpy() for c in ("u", "v", "_level")), levels)
            tip = np.nonzero(at < levels)[0]
            yield pd.DataFrame({"_level": at[tip].astype(np.int32), "u": ids[into[tip]], "v": ids[tip]})

    return run


def _runs(levels: int):
    """Of all edges (_level, u, v) of one task: key, value and the levels lo to hi at which key has that value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(b["u"].to_numpy(), b["v"].to_numpy(), b["_level"].to_numpy().astype(np.int8)) for b in batches]
        if not held:
            return
        u, v, level = (np.concatenate(c) for c in zip(*held))
        del held
        ids, into, at = _merges(u, v, level, levels)
        del u, v, level
        tip = np.nonzero(at < levels)[0]
        born = np.full(len(ids), levels, np.int8)  # when an id first leads another
        np.minimum.at(born, into[tip], at[tip])

        def rows(key: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pd.DataFrame]:
            for k in range(0, len(key), CHUNK_EDGES):
                of = slice(k, k + CHUNK_EDGES)
                yield pd.DataFrame({"key": ids[key[of]], "value": ids[value[of]], "lo": lo[of].astype(np.int32), "hi": hi[of].astype(np.int32)})

        lead = np.nonzero(born < at)[0]
        yield from rows(lead, lead, born[lead], at[lead] - 1)
        key, last = tip, tip
        while len(key):  # at most once a level: what an id is merged into leads longer
            value = into[last]
            yield from rows(key, value, at[last], at[value] - 1)
            on = at[value] < levels
            key, last = key[on], value[on]

    return run


#: Links that one task joins (about 70 bytes each); of more, all tasks join them in rounds.
JOINED_LINKS = 8_000_000


def threshold_sweep(edges: DataFrame, thresholds: list[float], score: str = "merge_score") -> DataFrame:
    """threshold, key, value: the components at every threshold.

    All thresholds are solved at once. Map tasks contract bounded chunks of edges to their merges, at
    most a link an id whatever the number of thresholds; one task joins up to JOINED_LINKS of them to
    runs of thresholds with the same value, which all tasks spread out. More links go through
    components(), all thresholds in the same rounds. No thresholds or no edges give no rows.
    """
    steps = sorted({float(t) for t in thresholds})
    if not steps:
        return edges.select(F.lit(0.0).alias("threshold"), F.col("u").cast("bigint").alias("key"), F.col("v").cast("bigint").alias("value")).limit(0)
    array = F.array(*[F.lit(t) for t in steps])
    level = F.size(F.filter(array, lambda t: t < F.col(score))).cast("int")  # the first threshold that takes the edge
    rows = edges.where((F.col("u") != F.col("v")) & F.col(score).isNotNull() & ~F.isnan(score)).select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), level.alias("_level")).where(F.col("_level") < len(steps))
    links = cut(rows.select("_level", "u", "v").mapInPandas(_links(len(steps)), "_level int, u bigint, v bigint"), "links")
    if links.count() > JOINED_LINKS:
        stars = links.mapInPandas(_stars(len(steps)), "_level int, u bigint, v bigint")
        return components(stars, ["_level"]).select(F.get(array, F.col("_level")).alias("threshold"), "key", "value")
    runs = links.coalesce(1).mapInPandas(_runs(len(steps)), "key bigint, value bigint, lo int, hi int")
    runs = cut(runs, "runs", rows_a_file=CHUNK_EDGES // 4)
    discard(links)
    return runs.select(F.explode(F.slice(array, F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)).alias("threshold"), "key", "value")


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for chunk in _chunks(batches):
        ids, at = np.unique(chunk[["u", "v"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        yield pd.DataFrame({"key": ids, "value": _forest(ids, at[:, 0], at[:, 1])})


def two_phase_components(edges: DataFrame) -> DataFrame:
    """key, value as by components(): first inside what a task reads, then across.

    Chunks of edges are contracted on their own by the map tasks, before the first shuffle; as
    the edges of a block lie together in the files, that is where most of them meet. However many
    edges a block holds, no task takes more than a chunk at a time. Every contracted chunk links the
    same ids as its edges, so that the result equals the one-phase one. Self pairs and null ends add
    nothing.
    """
    good = edges.where(F.col("u") != F.col("v")).select(F.col("u").cast("bigint"), F.col("v").cast("bigint"))
    local = good.mapInPandas(_local, "key bigint, value bigint").where("key <> value")
    return components(local.select(F.col("key").alias("u"), F.col("value").alias("v")))


def block_tables(edges: DataFrame, nodes: DataFrame, by: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The tables of all blocks and the edges between them, from edges (bz, by, bx, u, v) and nodes (bz, by, bx, id).

    A block's table (by, bz, by, bx, key, value) has the components of the edges whose ends are both
    among the nodes of the edge's block; the other edges cross its boundary. All blocks, and all
    graphs of by, are solved in the same rounds; no block is gathered.
    """
    by, block = list(by), ["bz", "by", "bx"]
    crossing = boundary_edges(edges, nodes).select(*by, *block, "u", "v").distinct()
    inside = edges.select(*by, *block, "u", "v").distinct().join(crossing, [*by, *block, "u", "v"], "left_anti")
    return components(inside, [*by, *block]), crossing


def joined_tables(local: DataFrame, crossing: DataFrame, by: Iterable[str] = (), span: int | None = None) -> DataFrame:
    """by, key, value: one table of all blocks, from those of block_tables().

    Links the values of the blocks by the edges that cross their boundaries; an id that several
    blocks know links theirs. With span, cubes of span blocks a side are joined first, then these:
    the result is the same, the last step has fewer ids.
    """
    by, block = list(by), ["bz", "by", "bx"]
    links = local.select(*by, *block, F.col("value").alias("u"), F.col("key").alias("v")).unionByName(crossing.select(*by, *block, "u", "v"))
    if span is not None:
        cube = [F.floor(F.col(c) / span).alias(c) for c in block]
        links = components(links.select(*by, *cube, "u", "v"), [*by, *block]).select(*by, F.col("value").alias("u"), F.col("key").alias("v"))
    return components(links.select(*by, "u", "v"), by)


def boundary_scores(affinity: DataFrame) -> DataFrame:
    """1 - mean affinity of every contact (u, v of affinity rows), with the number of voxels that touch."""
    return affinity.groupBy("u", "v").agg((1 - F.avg("affinity")).alias("merge_score"), F.count("*").alias("contacts"))


def _bin_of(bins: int) -> Column:
    return F.least(F.greatest(F.floor(F.col("affinity") * (bins - 1)), F.lit(0)), F.lit(bins - 1)).cast("int")


def _histogram(affinity: DataFrame, bins: int) -> DataFrame:
    return affinity.where(F.col("affinity").isNotNull() & ~F.isnan("affinity")).groupBy("u", "v", _bin_of(bins).alias("bin")).agg(F.count("*").alias("n"))


def all_quantile_scores(affinity: DataFrame, quantiles: Iterable[int], bins: int = 256) -> DataFrame:
    """q, u, v, merge_score: 1 - each quantile of the affinities of every contact, from one histogram over [0, 1].

    The first bin at which the cumulated count reaches q percent; its value is bin / (bins - 1).
    Null and NaN affinities do not count; an empty table or no quantiles give no rows.
    """
    pair = Window.partitionBy("u", "v")  # at most bins rows
    upto = F.sum("n").over(pair.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    h = _histogram(affinity, bins).withColumn("upto", upto).withColumn("all", F.sum("n").over(pair))
    before = F.col("upto") - F.col("n")
    reached = [F.when((F.col("upto") * 100 >= F.col("all") * q) & ((before * 100 < F.col("all") * q) | (before == 0)), F.lit(q)) for q in quantiles]
    at = h.withColumn("q", F.explode(F.array_compact(F.array(*reached))) if reached else F.lit(0)).where(F.lit(bool(reached)))
    return at.select("q", "u", "v", (1 - F.col("bin") / (bins - 1)).alias("merge_score"))


def quantile_scores(affinity: DataFrame, quantile: int, bins: int = 256, init_max: bool = False) -> DataFrame:
    """u, v, merge_score for one quantile, as by all_quantile_scores().

    init_max takes the greatest bin instead, as scores are when no later merge has changed them.
    """
    if init_max:
        return _histogram(affinity, bins).groupBy("u", "v").agg((1 - F.max("bin") / (bins - 1)).alias("merge_score"))
    return all_quantile_scores(affinity, [quantile], bins).drop("q")


#: Merge functions by name (fixed values): how the affinities of a contact give its score.
QUANTILES = (10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90)
MERGE_FUNCTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {"mean": lambda a: boundary_scores(a).drop("contacts")}
MERGE_FUNCTIONS |= {f"hist_quant_{q}": (lambda a, q=q: quantile_scores(a, q)) for q in QUANTILES}
MERGE_FUNCTIONS |= {f"hist_quant_{q}_initmax": (lambda a, q=q: quantile_scores(a, q, init_max=True)) for q in (10, 25, 50, 75, 90)}


def contacts(fragments: DataFrame, affinity: str | None = None) -> DataFrame:
    """u < v for each pair of face neighbours with different labels, none 0; with the smaller affinity of both, if given.

    Neighbours are sought in the block of a voxel, or in the whole grid if there is no block column.
    With a margin (halo()) each pair counts once, at the voxel that comes first.
    """
    keys, faces = blocks_of(fragments), [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
    both = fragments.withColumn("_l", F.struct(F.col("label").alias("l"), F.col(affinity).alias("a")) if affinity else F.struct(F.col("label").alias("l")))
    near = shifted(both, faces, "_l")
    if "core" in fragments.columns:
        near = near.where("core")
    other = F.col("other.l")
    touch = near.where((F.col("label") != other) & (F.col("label") != 0) & (other != 0))
    return touch.select(*keys, F.least("label", other).alias("u"), F.greatest("label", other).alias("v"), *([F.least(affinity, "other.a").alias("affinity")] if affinity else []))


def centers(fragments: DataFrame) -> DataFrame:
    """id, center_z, center_y, center_x, voxels of every label but 0."""
    return fragments.where("label <> 0").groupBy(F.col("label").alias("id")).agg(*[F.avg(c).alias(f"center_{c}") for c in "zyx"], F.count("*").alias("voxels"))


def agglomerate(affinity: DataFrame, threshold: float, merge: str = "mean") -> DataFrame:
    """key, value: fragments merged by single linkage over contacts with a score at or below threshold."""
    return components(under(MERGE_FUNCTIONS[merge](affinity), threshold))


def _hierarchy(threshold: float, quantile: int | None, init_max: bool, bins: int):
    """Agglomeration of one block: the contact of lowest score merges first, and its neighbours' contacts become one.

    A contact is its histogram of affinities (counts and sums by bin). Its score is 1 - mean, or 1 -
    the quantile; with init_max 1 - the greatest bin until a merge has changed the contact.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hist: dict[tuple[int, int], dict[int, int]] = {}
        total: dict[tuple[int, int], list[float]] = {}
        near: dict[int, set[int]] = {}
        changed: set[tuple[int, int]] = set()
        for u, v, k, n, s in zip(*(pdf[c].tolist() for c in ("u", "v", "bin", "n", "total"))):
            h = hist.setdefault((u, v), {})
            h[k] = h.get(k, 0) + n
            t = total.setdefault((u, v), [0.0, 0])
            t[0] += s
            t[1] += n
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)

        def score(pair: tuple[int, int]) -> float:
            if quantile is None:
                return 1 - total[pair][0] / total[pair][1]
            h = hist[pair]
            if init_max and pair not in changed:
                return 1 - max(h) / (bins - 1)
            upto = 0
            for k in sorted(h):
                upto += h[k]
                if upto * 100 >= total[pair][1] * quantile:
                    return 1 - k / (bins - 1)

        heap = [(round(score(p), 12), p) for p in hist]
        heapify(heap)
        out = []
        while heap:
            rank, (u, v) = heappop(heap)
            if (u, v) not in hist or rank != round(score((u, v)), 12):
                continue  # merged away, or scored anew since
            if score((u, v)) > threshold:
                break
            out.append((u, v, score((u, v))))
            del hist[u, v], total[u, v]
            near[u].discard(v)
            for w in near.pop(v) - {u}:
                old, pair = (min(v, w), max(v, w)), (min(u, w), max(u, w))
                h, t = hist.pop(old), total.pop(old)
                if pair in hist:
                    for k, n in h.items():
                        hist[pair][k] = hist[pair].get(k, 0) + n
                    total[pair] = [total[pair][0] + t[0], total[pair][1] + t[1]]
                    changed.add(pair)
                else:
                    hist[pair], total[pair] = h, t
                    changed.add(pair) if old in changed else changed.discard(pair)
                near[w].discard(v)
                near[w].add(u)
                near[u].add(w)
                heappush(heap, (round(score(pair), 12), pair))
        keys = {c: pdf[c].iloc[0] for c in pdf.columns if c in BLOCKS}
        return pd.DataFrame(out, columns=["u", "v", "merge_score"]).assign(**keys)[[*keys, "u", "v", "merge_score"]]

    return run


def agglomerate_blocks(affinity: DataFrame, threshold: float, quantile: int | None = None, init_max: bool = False, bins: int = 256) -> DataFrame:
    """block, u, v, merge_score: the merges inside each block in hierarchical order (v is merged into u < v).

    Contacts are summed up as histograms before the shuffle, so that a task takes at most bins rows a
    contact of its block, however many voxels touch. quantile and init_max: see _hierarchy(); without
    a quantile the mean decides. Null and NaN affinities do not count.
    """
    keys = blocks_of(affinity)
    bin_of = _bin_of(bins) if quantile is not None else F.lit(0)
    h = affinity.where(F.col("affinity").isNotNull() & ~F.isnan("affinity")).groupBy(*keys, "u", "v", bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum("affinity").alias("total"))
    schema = ", ".join(f"{k} bigint" for k in keys) + ", u bigint, v bigint, merge_score double"
    return h.groupBy(*keys).applyInPandas(_hierarchy(threshold, quantile, init_max, bins), schema)


def _watershed(side: int, low: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.full((side, side, side), -np.inf)
        g[pdf["z"], pdf["y"], pdf["x"]] = pdf["value"].to_numpy()
        flat = g.ravel()
        n = flat.size
        # each voxel points to its greatest face neighbour or itself; ties go to the smaller index
        best, to = flat.copy(), np.arange(n)
        index = np.arange(n).reshape(g.shape)
        for axis in range(3):
            for step in (1, -1):
                a, b = [slice(None)] * 3, [slice(None)] * 3
                a[axis], b[axis] = (slice(0, -1), slice(1, None)) if step == 1 else (slice(1, None), slice(0, -1))
                here, there = index[tuple(a)].ravel(), index[tuple(b)].ravel()
                up = (flat[there] > best[here]) | ((flat[there] == best[here]) & (there < to[here]))
                best[here[up]], to[here[up]] = flat[there[up]], there[up]
        while not np.array_equal(to, to[to]):
            to = to[to]
        block = int(pdf["block"].iloc[0])
        label = np.where(flat > low, block * n + to + 1, 0)
        z, y, x = pdf["z"].to_numpy(), pdf["y"].to_numpy(), pdf["x"].to_numpy()
        return pd.DataFrame({"block": block, "z": z, "y": y, "x": x, "label": label[index[z, y, x]]})

    return run


def watershed(voxels: DataFrame, side: int, low: float) -> DataFrame:
    """block, z, y, x, label: voxels above low joined uphill to a local maximum of their block, others 0.

    A plain steepest-ascent watershed in one block at a time; labels are unique over all blocks.
    """
    return voxels.where("value is not null").groupBy("block").applyInPandas(_watershed(side, low), "block bigint, z bigint, y bigint, x bigint, label bigint")


#: Bits of each coordinate in a voxel's number; coordinates are from 0 to 2 ** AXIS_BITS - 1.
AXIS_BITS = 21


def voxel_number() -> Column:
    return F.shiftleft(F.shiftleft(F.col("z"), AXIS_BITS) + F.col("y"), AXIS_BITS) + F.col("x")


def _uphill(size: int):
    """Where the ascent from each voxel of a block ends inside it: at a peak, or at the first voxel of another block."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = size + 2  # a margin of one
        base = np.array(key) * size - 1
        at = pdf[["z", "y", "x"]].to_numpy() - base
        flat_at = (at[:, 0] * n + at[:, 1]) * n + at[:, 2]
        flat, number = np.full(n**3, -np.inf), np.zeros(n**3, np.int64)
        flat[flat_at] = pdf["value"].to_numpy()
        number[flat_at] = (((pdf["z"].to_numpy() << AXIS_BITS) + pdf["y"].to_numpy()) << AXIS_BITS) + pdf["x"].to_numpy()
        core = flat_at[pdf["core"].to_numpy()]
        to = np.arange(n**3)
        best = flat[core].copy()
        for step in (-n * n, -n, -1, 1, n, n * n):  # ties go to the smaller number: itself or an earlier neighbour first
            there = core + step
            up = (flat[there] > best) | ((flat[there] == best) & (there < to[core]))
            to[core[up]], best[up] = there[up], flat[there[up]]
        while not np.array_equal(to, to[to]):
            to = to[to]
        end = to[core]
        inside = np.zeros(n**3, bool)
        inside[core] = True
        c = number[core]
        return pd.DataFrame({"id": c, "high": flat[core], "at": number[end], "peak": inside[end]})

    return run


def watershed_grid(voxels: DataFrame, size: int, low: float) -> DataFrame:
    """z, y, x, label: the voxels of a grid above low joined uphill to a local maximum, others 0.

    Steepest ascent over face neighbours, ties to the voxel that comes first; the label is the
    number of the maximum + 1. Blocks of size voxels a side see a margin of one voxel, so that the
    result does not depend on the blocks: an ascent that leaves its block is followed by the ends
    of others, halving its length in each round; only voxels at which some ascent enters a block
    take part in that. Voxels without a value are not there.
    """
    blocks = halo(voxels.where(F.col("value").isNotNull() & ~F.isnan("value")), size, 1).where(F.col("bz").isNotNull())
    local = cut(blocks.groupBy(*BLOCK).applyInPandas(_uphill(size), "id bigint, high double, at bigint, peak boolean"), "ascents")
    ways = local.select("id", "at", "peak").join(local.where("not peak").select(F.col("at").alias("id")).distinct(), "id", "left_semi")
    ways = cut(ways, "ways")
    while not ways.where("not peak").isEmpty():
        on = ways.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("peak").alias("_peak"))
        longer = cut(ways.join(on, "at", "left").select("id", F.when(F.col("peak"), F.col("at")).otherwise(F.col("_at")).alias("at"), (F.col("peak") | F.col("_peak")).alias("peak")), "ways")
        discard(ways)
        ways = longer
    # only what leaves its block is looked up, at most a block's voxels at each end, however large a basin is
    left = local.where("not peak").join(ways.select(F.col("id").alias("at"), F.col("at").alias("_end")), "at").select("id", "high", "_end")
    end = local.where("peak").select("id", "high", F.col("at").alias("_end")).unionByName(left)
    end = end.select("id", F.when(F.col("high") > low, F.col("_end") + 1).otherwise(0).alias("label"))
    mask = (1 << AXIS_BITS) - 1
    number = F.col("id")
    place = [F.shiftright(number, 2 * AXIS_BITS).alias("z"), F.shiftright(number, AXIS_BITS).bitwiseAND(mask).alias("y"), number.bitwiseAND(mask).alias("x")]
    return end.select(*place, "label")


def _seeded(size: int, context: int, seed_distance: int, low: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = size + 2 * context
        at = pdf[["z", "y", "x"]].to_numpy() - (np.array(key) * size - context)
        inside = np.zeros((n, n, n), bool)
        inside[tuple(at.T)] = (pdf["value"].to_numpy() > low) & pdf["free"].to_numpy()
        near = [(a, s) for a in range(3) for s in (1, -1)]

        def moved(grid: np.ndarray, axis: int, step: int, fill) -> np.ndarray:
            out = np.roll(grid, step, axis)
            edge = [slice(None)] * 3
            edge[axis] = slice(0, step) if step > 0 else slice(step, None)
            out[tuple(edge)] = fill
            return out

        # steps to the next voxel that is not inside; what lies beyond the margin counts as inside
        depth, left = np.zeros((n, n, n), np.int32), inside.copy()
        while left.any() and depth.max() < n:
            depth[left] += 1
            for axis, step in near:
                left = left & moved(depth >= depth.max(), axis, step, True)
        # seeds: no deeper voxel, nor an equal one that comes first, within the distance on every axis
        rank = depth.astype(np.int64) * n**3 + (n**3 - 1 - np.arange(n**3).reshape(n, n, n))
        top = rank
        for axis in range(3):
            wide = top
            for d in range(1, seed_distance + 1):
                wide = np.maximum(wide, np.maximum(moved(top, axis, d, -1), moved(top, axis, -d, -1)))
            top = wide
        label = np.where((top == rank) & inside, np.arange(n**3).reshape(n, n, n) + 1, 0)
        # floods from the deepest level down; a voxel takes the smallest label beside it
        for level in range(int(depth.max()), 0, -1):
            while True:
                free, best = inside & (label == 0) & (depth >= level), np.full((n, n, n), n**3 + 1)
                for axis, step in near:
                    side = moved(label, axis, step, 0)
                    best = np.where(side > 0, np.minimum(best, side), best)
                take = free & (best <= n**3)
                if not take.any():
                    break
                label[take] = best[take]
        number = np.zeros(n**3, np.int64)
        flat_at = np.ravel_multi_index(tuple(at.T), (n, n, n))
        number[flat_at] = (((pdf["z"].to_numpy() << AXIS_BITS) + pdf["y"].to_numpy()) << AXIS_BITS) + pdf["x"].to_numpy() + 1
        got = label.ravel()[flat_at]
        full = np.where(got > 0, number[got - 1], 0)
        return pdf[["z", "y", "x"]].assign(label=full)[pdf["core"].to_numpy()]

    return run


def seeded_watershed(voxels: DataFrame, size: int, context: int, seed_distance: int, low: float = 0.5, mask: Column | None = None) -> DataFrame:
    """z, y, x, label: fragments of a grid, grown from seeds in blocks of size voxels with a margin of context.

    voxels: z, y, x, value (a mean affinity). A voxel is inside if its value is above low and mask
    (a condition on voxels' columns) holds. Seeds are the voxels furthest from the outside (steps
    over faces) within seed_distance voxels on each axis, the first of equal ones; the inside is
    flooded from them, deepest first. Parts of the inside that no seed reaches stay 0. The label is
    the seed's number + 1, so that blocks which see the same seed agree; later stages join fragments
    across faces.
    """
    free = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    rows = voxels.where(F.col("value").isNotNull()).select("z", "y", "x", "value", free.alias("free"))
    return halo(rows, size, context).groupBy(*BLOCK).applyInPandas(_seeded(size, context, seed_distance, low), "z bigint, y bigint, x bigint, label bigint")


def drop_weak_fragments(fragments: DataFrame, affinity: Column, least: float) -> DataFrame:
    """Fragments of a mean affinity below least become 0."""
    mean = fragments.where("label <> 0").groupBy("label").agg(F.avg(affinity).alias("_mean")).where(F.col("_mean") < least)
    weak = skew_join(fragments, mean.select("label", F.lit(True).alias("_weak")), "label", "left", hot=hot_keys(fragments, "label"))
    return weak.withColumn("label", F.when(F.col("_weak"), 0).otherwise(F.col("label"))).drop("_weak")


#: Distance of seeds by voxel size in nm (fixed values); other sizes take the default.
SEED_DISTANCE = {8: 8, 16: 5, 50: 5}
SEED_DISTANCE_DEFAULT = 10


def seed_distance(voxel: Column) -> Column:
    out = F.lit(SEED_DISTANCE_DEFAULT)
    for size, d in SEED_DISTANCE.items():
        out = F.when(voxel == size, d).otherwise(out)
    return out
