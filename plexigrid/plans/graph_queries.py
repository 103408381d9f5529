"""Queries over the region graph (rag_nodes, rag_edges) and over skeletons (skeleton_nodes)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexigrid.operators import graph as G
from plexigrid.operators import metrics as M
from plexigrid.operators import relabel as L
from plexigrid.operators import scores as S
from plexigrid.operators.geometry import MODES, face_neighbours, halo_blocks, voxel_of
from plexigrid.operators.skew import skew_join
from plexigrid.session import cut, fresh_path, table
from plexigrid.sources.volumes import read_graph, read_lut, read_luts, stored_luts, write_graph, write_lut

T = 0.2
#: The thresholds of a sweep (fixed values: 0.05 to 0.95 by 0.05).
SWEEP = [round(k * 0.05, 2) for k in range(1, 20)]
BLOCK = ["bz", "by", "bx"]
ROI = MODES["validation"]


def edges(s, d) -> DataFrame:
    return table(s, d, "rag_edges")


def nodes(s, d) -> DataFrame:
    return table(s, d, "rag_nodes")


def clean_edges(s, d) -> DataFrame:
    """Edges with two ends and a score (a missing one is 1.0), each row once."""
    return G.scored(edges(s, d)).where("u is not null and v is not null").distinct()


def edge_threshold(s, d):
    return G.under(G.scored(edges(s, d)), T).groupBy(*BLOCK).agg(F.count("*").alias("edges"))


def boundary_edges(s, d):
    return G.boundary_edges(G.under(clean_edges(s, d), T), nodes(s, d)).select(*BLOCK, "u", "v").distinct()


def distinct_edges(s, d):
    return clean_edges(s, d).groupBy("u", "v").agg(F.min("merge_score").alias("merge_score"), F.count("*").alias("scores"))


def positioned_nodes(s, d):
    return nodes(s, d).where("center_z is not null and center_y is not null and center_x is not null").groupBy(*BLOCK).agg(F.countDistinct("id").alias("nodes"))


def block_centers(s, d):
    unique = nodes(s, d).distinct()
    return unique.groupBy(*BLOCK).agg(*[F.round(F.avg(f"center_{c}"), 4).alias(f"center_{c}") for c in "zyx"])


def nodes_in_roi(s, d):
    return nodes(s, d).where(ROI.where("center_z", "center_y", "center_x")).select("id").distinct()


def edges_in_roi(s, d):
    ids = nodes_in_roi(s, d)
    e = clean_edges(s, d).select("u", "v").distinct()
    for end in ("u", "v"):
        e = skew_join(e, ids.withColumnRenamed("id", end), end, "left_semi")
    return e.select("u", "v")


def cc_threshold(s, d):
    lut = G.components(G.under(clean_edges(s, d), T))
    return G.label_nodes(nodes(s, d), lut)


def cc_sweep(s, d):
    """The components at every threshold of a sweep; repeated rows add nothing, and edges stay with those of their block."""
    return G.threshold_sweep(G.scored(edges(s, d)), SWEEP)


def cc_distinct(s, d):
    """How many components (of two ids or more) and ids in them every threshold of a sweep leaves."""
    return cc_sweep(s, d).groupBy("threshold").agg(F.countDistinct("value").alias("components"), F.count("*").alias("ids"))


def degenerate_blocks(s, d):
    """Blocks of the node table whose graph has no edge at or below the threshold: nothing is to be merged in them."""
    some = G.under(clean_edges(s, d), T).where("u <> v").select(*BLOCK).distinct()
    return nodes(s, d).select(*BLOCK).distinct().join(some, BLOCK, "left_anti")


def cc_two_phase(s, d):
    return G.two_phase_components(G.under(clean_edges(s, d), T))


def _leveled(s, d) -> DataFrame:
    """The edges that every threshold of a sweep takes."""
    e = clean_edges(s, d).where("u <> v")
    return e.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in SWEEP]))).where("merge_score <= threshold").select("threshold", *BLOCK, "u", "v")


def block_luts(s, d):
    """The tables of every block at every threshold of a sweep."""
    return G.block_tables(_leveled(s, d), nodes(s, d), ["threshold"])[0]


def block_boundaries(s, d):
    """How many edges cross the boundary of each block at every threshold."""
    return G.block_tables(_leveled(s, d), nodes(s, d), ["threshold"])[1].groupBy("threshold", *BLOCK).agg(F.count("*").alias("edges"))


def joined_block_luts(s, d):
    """One table of all blocks, joined in cubes of 2 blocks a side first."""
    local, crossing = G.block_tables(G.under(clean_edges(s, d), T), nodes(s, d))
    return G.joined_tables(cut(local, "local"), cut(crossing, "crossing"), span=2)


def graph_store(s, d):
    """The region graph stored by layers of blocks, and the edges of some blocks read back with the positions of their ends."""
    path = fresh_path(s, "graph")
    write_graph(nodes(s, d).distinct(), clean_edges(s, d), path)
    n, e = read_graph(s, path, (1, 2, 0), (4, 6, 5))
    least = n.groupBy("id").agg(F.min("center_z").alias("z"))
    for end in ("u", "v"):
        e = skew_join(e, least.select(F.col("id").alias(end), F.col("z").alias(f"z_{end}")), end)
    return e.select("bz", "by", "bx", "u", "v", "merge_score", "z_u", "z_v")


def _lut(s, d) -> DataFrame:
    return cut(G.components(G.under(clean_edges(s, d), 0.1)), "lut")


def lut_self_ref_filter(s, d):
    return L.without_self(_lut(s, d))


def lut_remap(s, d):
    return L.remap(nodes(s, d).select("id", *BLOCK).where("id is not null").distinct(), _lut(s, d), "id").distinct()


def lut_chain(s, d):
    first = _lut(s, d)
    between = G.under(clean_edges(s, d), T).where("merge_score > 0.1").select("u", "v")
    second = G.components(L.remap_ends(between, first))
    return L.compose(first, second)


STAGE = "local_to_global"


def _stored_luts(s, d) -> str:
    path = fresh_path(s, "luts")
    write_lut(cc_sweep(s, d).withColumn("stage", F.lit(STAGE)), path)
    return path


def lut_store(s, d):
    """The tables of a sweep stored by stage and threshold, and the one of 0.1 read back from its partition alone."""
    return read_lut(s, _stored_luts(s, d), STAGE, 0.1).select("key", "value")


def lut_store_scan(s, d):
    """All stored tables of a sweep read back at once: how many keys each has."""
    return read_luts(s, _stored_luts(s, d)).groupBy("stage", "threshold").agg(F.count("*").alias("keys"), F.countDistinct("value").alias("values"))


def lut_missing(s, d):
    """The thresholds (hundredths up to 1) of which no table is stored."""
    path = _stored_luts(s, d)
    wanted = s.range(1, 101).select(F.lit(STAGE).alias("stage"), F.round(F.col("id") * 0.01, 2).alias("threshold"))
    return wanted.join(stored_luts(s, path), ["stage", "threshold"], "left_anti")


def edge_endpoint_remap(s, d):
    return G.canonical(L.remap_ends(clean_edges(s, d).select("u", "v"), _lut(s, d)))


def face_neighbour_blocks(s, d):
    return face_neighbours(nodes(s, d).select(*BLOCK))


def face_neighbour_remap(s, d):
    """Each block's table takes its ids to the smallest id of the block; edges use the tables around."""
    ids = nodes(s, d).where("id is not null").groupBy("id").agg(F.min(F.struct(*BLOCK)).alias("b")).select("id", "b.*")
    least = ids.groupBy(*BLOCK).agg(F.min("id").alias("value"))
    luts = ids.join(least, BLOCK).select(*BLOCK, F.col("id").alias("key"), "value")
    e = clean_edges(s, d).select(*BLOCK, "u", "v").distinct()
    return L.remap_by_neighbours(e, luts, face_neighbours(ids.select(*BLOCK))).distinct()


def halo_join(s, d):
    """Nodes of every block of 3840 nm and its margin of 480 nm."""
    points = nodes(s, d).select("id", "center_z", "center_y", "center_x").distinct()
    return halo_blocks(points, 3840, 480, ("center_z", "center_y", "center_x")).groupBy(*BLOCK).agg(F.count("*").alias("nodes"), F.min("id").alias("least"))


def skeletons(s, d) -> DataFrame:
    """node, skeleton_id, seg_label, z, y, x of skeleton_nodes, each node once."""
    t = table(s, d, "skeleton_nodes").where("node is not null")
    return t.select("node", "skeleton_id", "seg_label", F.col("pz").alias("z"), F.col("py").alias("y"), F.col("px").alias("x")).groupBy("node").agg(F.min(F.struct("skeleton_id", "seg_label", "z", "y", "x")).alias("a")).select("node", "a.*")


def axis_swap(s, d):
    return skeletons(s, d)


def world_to_voxel_floor(s, d):
    n = skeletons(s, d)
    return n.select("node", *[voxel_of(F.col(c), 33).alias(c) for c in "zyx"], *[(voxel_of(F.col(c), 33) * 33).alias(f"{c}_nm") for c in "zyx"])


def point_label_lookup(s, d):
    """Each placed skeleton node with the label that most nodes of its 990 nm cube have (the cube as the volume's voxel)."""
    n = skeletons(s, d).where("z is not null and y is not null and x is not null and seg_label is not null")
    at = n.withColumns({f"v{c}": voxel_of(F.col(c), 990) for c in "zyx"})
    cells = at.groupBy("vz", "vy", "vx", "seg_label").agg(F.count("*").alias("n")).groupBy("vz", "vy", "vx").agg(F.min(F.struct((-F.col("n")).alias("n"), "seg_label")).alias("m"))
    return skew_join(at, cells, ["vz", "vy", "vx"]).select("node", F.col("m.seg_label").alias("label"))


def skeleton_components(s, d):
    e = M.path_edges(skeletons(s, d))
    return G.components(e.where("gu = gv and gu <> 0").select("u", "v"))


def skeleton_lengths(s, d):
    return M.skeleton_lengths(M.path_edges(skeletons(s, d))).select("skeleton_id", F.round("length", 4).alias("length"))


def erl(s, d):
    n = skeletons(s, d)
    one = M.expected_run_length(M.path_edges(n), n)
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


def split_edges(s, d):
    return M.split_edges(M.path_edges(skeletons(s, d))).select("skeleton_id", "u", "v")


def split_histogram(s, d):
    n = skeletons(s, d)
    return M.split_histogram(n.where("skeleton_id is not null"), M.split_edges(M.path_edges(n)))


def merge_counts(s, d):
    return M.merge_counts(skeletons(s, d))


def merge_sites(s, d):
    out = M.merge_sites(skeletons(s, d), 100.0)
    return out.withColumn("distance", F.round("distance", 6))


def all_merge_sites(s, d):
    """The nearest nodes of every two skeletons of a segment, also further apart than the radius of merge_sites."""
    return M.all_merge_sites(cut(skeletons(s, d), "nodes"), 100.0).withColumn("distance", F.round("distance", 6))


def fresh_labels(s, d):
    return M.fresh_labels(skeletons(s, d).where("z is not null and y is not null and x is not null"), 33.0)


def rasterise(s, d):
    return M.rasterise(skeletons(s, d), 99.0)


def rand_voi_skeletons(s, d):
    one = M.rand_voi(M.contingency(skeletons(s, d).where("seg_label <> 0"), "skeleton_id", "seg_label"))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


def rand_voi_lang_source(s, d):
    one = M.rand_voi(M.contingency(table(s, d, "documents"), "lang", "source"))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


def rand_voi_flag_status(s, d):
    one = M.rand_voi(M.contingency(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"))
    return one.select(*[F.round(c, 6).alias(c) for c in one.columns])


def eval_report(s, d):
    one = M.evaluate(skeletons(s, d))
    return M.as_report(one.select(*[F.round(c, 6).alias(c) for c in one.columns]))


def eval_store(s, d):
    """Skeletons inside the region of each mode evaluated and appended to a copy of the score store; what the store then has of them."""
    store = fresh_path(s, "scores")
    table(s, d, "scores").select("network", "checkpoint", "threshold", "scores").write.parquet(store)
    n = cut(skeletons(s, d), "nodes")
    names = []
    for k, (mode, roi) in enumerate(MODES.items()):
        one = cut(M.evaluate(n.where(roi.where())), "scores-of")
        names = one.columns
        S.append_scores(store, f"evaluated {mode}", k, 0.5, one)
    back = S.select_scores(s.read.parquet(store), [f"evaluated {m}" for m in MODES], None, 0.5)
    j = F.from_json("scores", ", ".join(f"{c} double" for c in names))
    flat = back.select("network", "checkpoint", j.alias("j")).select("network", "checkpoint", *[F.round(f"j.{c}", 6).alias(c) for c in names])
    return flat.unpivot(["network", "checkpoint"], names, "metric", "value").where("value is not null")


def error_listing(s, d):
    """Every split and merge with the voxels of both ends (33 nm) and the number of errors of its kind at its skeleton.

    kind split: an edge of the skeleton between two segments; kind merge: the nearest nodes of two
    skeletons of one segment (listed at the smaller skeleton).
    """
    n = cut(skeletons(s, d), "nodes")
    splits = cut(M.split_edges(M.path_edges(n)).select(F.lit("split").alias("kind"), "skeleton_id", "u", "v"), "splits")
    per = splits.groupBy("kind", "skeleton_id").agg(F.count("*").alias("errors"))
    for end in ("u", "v"):
        at = n.select(F.col("node").alias(end), *[voxel_of(F.col(c), 33).alias(f"{c}_{end}") for c in "zyx"])
        splits = skew_join(splits, at, end)
    splits = skew_join(splits, per, ["kind", "skeleton_id"])
    # a skeleton has a merge with each later one of its segments, so they are counted before there are pairs
    in_segments = n.where("seg_label <> 0 and skeleton_id is not null and z is not null and y is not null and x is not null").select("seg_label", "skeleton_id").distinct()
    later = in_segments.withColumn("later", F.row_number().over(Window.partitionBy("seg_label").orderBy(F.desc("skeleton_id"))) - 1)
    tags = later.groupBy("skeleton_id").agg(F.sum("later").alias("tag"))
    merges = M.all_merge_sites(skew_join(n, tags, "skeleton_id", "left"), 100.0, carried=True)
    voxels = [voxel_of(F.col(f"{c}_{end}"), 33).alias(f"{c}_{end}") for end in "uv" for c in "zyx"]
    return splits.unionByName(merges.select(F.lit("merge").alias("kind"), F.col("s1").alias("skeleton_id"), "u", "v", *voxels, F.col("tag").alias("errors")))


_NAMES = """block_luts block_boundaries joined_block_luts graph_store eval_store cc_distinct degenerate_blocks lut_store_scan lut_missing error_listing edge_threshold boundary_edges distinct_edges positioned_nodes block_centers nodes_in_roi edges_in_roi cc_threshold cc_sweep
cc_two_phase lut_self_ref_filter lut_remap lut_chain lut_store edge_endpoint_remap face_neighbour_blocks face_neighbour_remap halo_join
axis_swap world_to_voxel_floor point_label_lookup skeleton_components skeleton_lengths erl split_edges split_histogram merge_counts
merge_sites all_merge_sites fresh_labels rasterise rand_voi_skeletons rand_voi_lang_source rand_voi_flag_status eval_report"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_E = """WITH RECURSIVE ce AS (SELECT DISTINCT u, v, coalesce(CASE WHEN NOT isnan(merge_score) THEN merge_score END, 1.0) AS s, bz, by, bx FROM rag_edges WHERE u IS NOT NULL AND v IS NOT NULL),
blk AS (SELECT DISTINCT bz, by, bx FROM rag_nodes),
roi AS (SELECT DISTINCT id FROM rag_nodes WHERE center_z >= 8316 AND center_z < 31383 AND center_y >= 8316 AND center_y < 31383 AND center_x >= 8316 AND center_x < 31383)
"""


def _cc(name: str, t: float) -> str:
    """Components of the edges at or below t as a keyed recursion: name(key, value)."""
    return f""", e{name} AS (SELECT u, v FROM ce WHERE s <= {t} AND NOT isnan(s) AND u <> v UNION SELECT v, u FROM ce WHERE s <= {t} AND NOT isnan(s) AND u <> v),
{name}(key, value) USING KEY (key) AS (SELECT DISTINCT u, u FROM e{name} UNION
  SELECT e.v, min(c.value) FROM {name} c JOIN e{name} e ON e.u = c.key JOIN recurring.{name} AS k ON k.key = e.v WHERE c.value < k.value GROUP BY e.v)
"""


_S = """WITH RECURSIVE nd AS (SELECT node, min({'s': skeleton_id, 'g': seg_label, 'z': pz, 'y': py, 'x': px}) AS a FROM skeleton_nodes WHERE node IS NOT NULL GROUP BY node),
n AS (SELECT node, a.s AS skeleton_id, a.g AS seg_label, a.z AS z, a.y AS y, a.x AS x FROM nd),
p AS (SELECT * FROM n WHERE skeleton_id IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL),
q AS (SELECT skeleton_id, node AS u, seg_label AS gu, z, y, x, lead(node) OVER w AS v, lead(seg_label) OVER w AS gv, lead(z) OVER w AS z2, lead(y) OVER w AS y2, lead(x) OVER w AS x2
  FROM p WINDOW w AS (PARTITION BY skeleton_id ORDER BY node)),
e AS (SELECT skeleton_id, u, v, gu, gv, sqrt((z - z2) * (z - z2) + (y - y2) * (y - y2) + (x - x2) * (x - x2)) AS length FROM q WHERE v IS NOT NULL),
mg AS (SELECT seg_label, count(DISTINCT skeleton_id) AS skeletons FROM n WHERE seg_label <> 0 AND skeleton_id IS NOT NULL GROUP BY seg_label HAVING count(DISTINCT skeleton_id) > 1),
sp AS (SELECT * FROM e WHERE gu <> gv OR (gu = 0 AND gv = 0)),
len AS (SELECT skeleton_id, sum(length) AS l FROM e GROUP BY skeleton_id),
run AS (SELECT skeleton_id, gu, sum(length) AS l FROM e WHERE gu = gv AND gu <> 0 AND gu NOT IN (SELECT seg_label FROM mg) GROUP BY ALL),
er AS (SELECT (SELECT coalesce(sum(l * l), 0) FROM run) / sum(l) AS erl, avg(l) AS avg_length FROM len WHERE l > 0)
"""


_SWEEP = "".join(_cc(f"c{k}", t) for k, t in enumerate(SWEEP)) + ", swept AS (" + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, key, value FROM c{k}" for k, t in enumerate(SWEEP)) + ") "
_SITES = """, w AS (SELECT a.seg_label, a.skeleton_id AS s1, b.skeleton_id AS s2, min({'d': sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), 'u': a.node, 'v': b.node}) AS m
  FROM p a JOIN p b ON a.seg_label = b.seg_label AND a.skeleton_id < b.skeleton_id WHERE a.seg_label <> 0 GROUP BY ALL)
"""


def _rand_voi(source: str) -> str:
    return f""", c AS ({source}), ct AS (SELECT t, sum(n) AS n FROM c GROUP BY t), cg AS (SELECT g, sum(n) AS n FROM c GROUP BY g),
m AS (SELECT (SELECT sum(n::DOUBLE * n) FROM c) AS sq, (SELECT sum(n::DOUBLE * n) FROM ct) AS st, (SELECT sum(n::DOUBLE * n) FROM cg) AS sg,
  (SELECT sum(n)::DOUBLE FROM c) AS tot, (SELECT sum(n * ln(n)) FROM c) AS nl, (SELECT sum(n * ln(n)) FROM ct) AS nt, (SELECT sum(n * ln(n)) FROM cg) AS ng),
h AS (SELECT sq / st AS rand_split, sq / sg AS rand_merge, ln(tot) - nl / tot AS hj, ln(tot) - nt / tot AS ht, ln(tot) - ng / tot AS hg FROM m),
rv AS (SELECT rand_split, rand_merge, (hj - ht) / hj AS nvi_split, (hj - hg) / hj AS nvi_merge FROM h)
"""


_RV = "SELECT round(rand_split, 6) AS rand_split, round(rand_merge, 6) AS rand_merge, round(nvi_split, 6) AS nvi_split, round(nvi_merge, 6) AS nvi_merge FROM rv"
_RVS = _rand_voi("SELECT skeleton_id AS t, seg_label AS g, count(*) AS n FROM n WHERE seg_label <> 0 AND skeleton_id <> 0 GROUP BY ALL")
_REPORT = """, r AS (SELECT rand_split, rand_merge, nvi_split, nvi_merge, erl, avg_length, erl / avg_length AS erl_norm,
  (SELECT count(*) FROM sp)::DOUBLE AS splits, (SELECT coalesce(sum(skeletons * (skeletons - 1) // 2), 0) FROM mg)::DOUBLE AS merges, (SELECT count(DISTINCT skeleton_id) FROM n)::DOUBLE AS n_neurons FROM rv, er),
x AS (SELECT *, 1 - (nvi_split + nvi_merge) / 2 AS score_voi, (rand_split + rand_merge) / 2 AS score_rand, (1 - (nvi_split + nvi_merge) / 2 + erl_norm) / 2 AS score_erl_voi,
  ((rand_split + rand_merge) / 2 + erl_norm) / 2 AS score_erl_rand, splits / nullif(n_neurons, 0) AS splits_per_neuron, merges / nullif(n_neurons, 0) AS merges_per_neuron FROM r)
"""


def _in_roi(roi) -> str:
    inside = " AND ".join(f"a.{c} >= {b} AND a.{c} < {e}" for c, b, e in zip("zyx", roi.begin, roi.end))
    return _S.replace("FROM nd),", f"FROM nd WHERE {inside}),")



def _block_cc(name: str, t: float) -> str:
    """Components of each block's inner edges at or below t: name(bz, by, bx, key, value)."""
    same = " AND ".join(f"{{a}}.{c} = {{b}}.{c}" for c in BLOCK)
    return f""", i{name} AS (SELECT DISTINCT bz, by, bx, u, v FROM ce WHERE s <= {t} AND u <> v AND EXISTS (SELECT 1 FROM rag_nodes n WHERE n.id = u AND {same.format(a="n", b="ce")}) AND EXISTS (SELECT 1 FROM rag_nodes n WHERE n.id = v AND {same.format(a="n", b="ce")})),
e{name} AS (SELECT * FROM i{name} UNION SELECT bz, by, bx, v, u FROM i{name}),
{name}(bz, by, bx, key, value) USING KEY (bz, by, bx, key) AS (SELECT DISTINCT bz, by, bx, u, u FROM e{name} UNION
  SELECT e.bz, e.by, e.bx, e.v, min(c.value) FROM {name} c JOIN e{name} e ON e.u = c.key AND {same.format(a="e", b="c")} JOIN recurring.{name} AS k ON k.key = e.v AND {same.format(a="k", b="e")} WHERE c.value < k.value GROUP BY e.bz, e.by, e.bx, e.v)
"""


SQL = {
    "block_luts": _E + "".join(_block_cc(f"b{k}", t) for k, t in enumerate(SWEEP)) + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, * FROM b{k}" for k, t in enumerate(SWEEP)),
    "block_boundaries": _E + ", lv AS (SELECT unnest([" + ", ".join(map(str, SWEEP)) + "])::DOUBLE AS threshold), x AS (SELECT DISTINCT threshold, bz, by, bx, u, v FROM ce, lv WHERE s <= threshold AND u <> v AND NOT (EXISTS (SELECT 1 FROM rag_nodes n WHERE n.id = u AND n.bz = ce.bz AND n.by = ce.by AND n.bx = ce.bx) AND EXISTS (SELECT 1 FROM rag_nodes n WHERE n.id = v AND n.bz = ce.bz AND n.by = ce.by AND n.bx = ce.bx))) SELECT threshold, bz, by, bx, count(*) AS edges FROM x GROUP BY ALL",
    "joined_block_luts": _E + _cc("c", T) + "SELECT * FROM c",
    "graph_store": _E + """, p AS (SELECT id, min(center_z) AS z FROM rag_nodes WHERE center_z IS NOT NULL AND center_y IS NOT NULL AND center_x IS NOT NULL AND bz BETWEEN 1 AND 3 AND by BETWEEN 2 AND 5 AND bx BETWEEN 0 AND 4 GROUP BY id)
SELECT bz, by, bx, u, v, s AS merge_score, a.z AS z_u, b.z AS z_v FROM ce JOIN p a ON a.id = u JOIN p b ON b.id = v WHERE bz BETWEEN 1 AND 3 AND by BETWEEN 2 AND 5 AND bx BETWEEN 0 AND 4""",
    "edge_threshold": f"SELECT bz, by, bx, count(*) AS edges FROM rag_edges WHERE coalesce(merge_score, 1.0) <= {T} AND NOT isnan(coalesce(merge_score, 1.0)) GROUP BY ALL",
    "boundary_edges": _E + f"SELECT DISTINCT bz, by, bx, u, v FROM ce WHERE s <= {T} AND NOT isnan(s) AND NOT (EXISTS (SELECT 1 FROM rag_nodes n WHERE n.id = u AND n.bz = ce.bz AND n.by = ce.by AND n.bx = ce.bx) AND EXISTS (SELECT 1 FROM rag_nodes n WHERE n.id = v AND n.bz = ce.bz AND n.by = ce.by AND n.bx = ce.bx))",
    "distinct_edges": _E + "SELECT u, v, min(s) AS merge_score, count(*) AS scores FROM ce GROUP BY u, v",
    "positioned_nodes": "SELECT bz, by, bx, count(DISTINCT id) AS nodes FROM rag_nodes WHERE center_z IS NOT NULL AND center_y IS NOT NULL AND center_x IS NOT NULL GROUP BY ALL",
    "block_centers": "SELECT bz, by, bx, round(avg(center_z), 4) AS center_z, round(avg(center_y), 4) AS center_y, round(avg(center_x), 4) AS center_x FROM (SELECT DISTINCT * FROM rag_nodes) GROUP BY ALL",
    "nodes_in_roi": _E + "SELECT id FROM roi",
    "edges_in_roi": _E + "SELECT DISTINCT u, v FROM ce WHERE u IN (SELECT id FROM roi) AND v IN (SELECT id FROM roi)",
    "cc_threshold": _E + _cc("c", T) + "SELECT id, coalesce(value, id) AS component FROM (SELECT DISTINCT id FROM rag_nodes WHERE id IS NOT NULL) LEFT JOIN c ON c.key = id",
    "cc_sweep": _E + _SWEEP + "SELECT * FROM swept",
    "cc_distinct": _E + _SWEEP + "SELECT threshold, count(DISTINCT value) AS components, count(*) AS ids FROM swept GROUP BY threshold",
    "lut_store_scan": _E + _SWEEP + "SELECT 'local_to_global' AS stage, threshold, count(*) AS keys, count(DISTINCT value) AS values FROM swept GROUP BY threshold",
    "lut_missing": "SELECT 'local_to_global' AS stage, round(i * 0.01::DOUBLE, 2) AS threshold FROM (SELECT unnest(range(1, 101)) AS i) WHERE NOT (i % 5 = 0 AND i < 100)",
    "degenerate_blocks": _E + f"SELECT bz, by, bx FROM blk WHERE (bz, by, bx) NOT IN (SELECT (bz, by, bx) FROM ce WHERE s <= {T} AND u <> v)",
    "cc_two_phase": _E + _cc("c", T) + "SELECT * FROM c",
    "lut_self_ref_filter": _E + _cc("c", 0.1) + "SELECT * FROM c WHERE key <> value",
    "lut_remap": _E + _cc("c", 0.1) + "SELECT DISTINCT coalesce(value, id) AS id, bz, by, bx FROM rag_nodes LEFT JOIN c ON c.key = id WHERE id IS NOT NULL",
    "lut_chain": _E + _cc("c", 0.1) + _cc("k", T) + ", r AS (SELECT k.key, k.value FROM k) SELECT key, value FROM r WHERE key IN (SELECT key FROM c) OR key IN (SELECT coalesce(c.value, w) FROM (SELECT u AS w FROM ce WHERE s > 0.1 AND s <= 0.2 UNION SELECT v FROM ce WHERE s > 0.1 AND s <= 0.2) LEFT JOIN c ON c.key = w)",
    "lut_store": _E + _cc("c", 0.1) + "SELECT * FROM c",
    "edge_endpoint_remap": _E + _cc("c", 0.1) + "SELECT DISTINCT least(coalesce(a.value, u), coalesce(b.value, v)) AS u, greatest(coalesce(a.value, u), coalesce(b.value, v)) AS v FROM ce LEFT JOIN c a ON a.key = u LEFT JOIN c b ON b.key = v WHERE coalesce(a.value, u) <> coalesce(b.value, v)",
    "face_neighbour_blocks": _E + "SELECT a.bz, a.by, a.bx, b.bz AS nbz, b.by AS nby, b.bx AS nbx FROM blk a JOIN blk b ON abs(a.bz - b.bz) + abs(a.by - b.by) + abs(a.bx - b.bx) = 1",
    "face_neighbour_remap": _E + """, ids AS (SELECT id, min({'z': bz, 'y': by, 'x': bx}) AS b FROM rag_nodes WHERE id IS NOT NULL GROUP BY id),
lut AS (SELECT b.z AS z, b.y AS y, b.x AS x, id AS key, min(id) OVER (PARTITION BY b) AS value FROM ids)
SELECT DISTINCT bz, by, bx, coalesce(p.value, u) AS u, coalesce(q.value, v) AS v FROM ce
LEFT JOIN lut p ON p.key = u AND abs(p.z - bz) + abs(p.y - by) + abs(p.x - bx) <= 1 AND (bz, by, bx) IN (SELECT (z, y, x) FROM lut)
LEFT JOIN lut q ON q.key = v AND abs(q.z - bz) + abs(q.y - by) + abs(q.x - bx) <= 1 AND (bz, by, bx) IN (SELECT (z, y, x) FROM lut)""",
    "halo_join": """WITH p AS (SELECT DISTINCT id, center_z AS z, center_y AS y, center_x AS x FROM rag_nodes WHERE center_z IS NOT NULL AND center_y IS NOT NULL AND center_x IS NOT NULL),
s AS (SELECT unnest([-1, 0, 1]) AS o), g AS (SELECT id, z, y, x, CAST(floor(z / 3840) AS BIGINT) + a.o AS bz, CAST(floor(y / 3840) AS BIGINT) + b.o AS by, CAST(floor(x / 3840) AS BIGINT) + c.o AS bx FROM p, s a, s b, s c)
SELECT bz, by, bx, count(*) AS nodes, min(id) AS least FROM g WHERE z >= bz * 3840 - 480 AND z < (bz + 1) * 3840 + 480 AND y >= by * 3840 - 480 AND y < (by + 1) * 3840 + 480 AND x >= bx * 3840 - 480 AND x < (bx + 1) * 3840 + 480 GROUP BY ALL""",
    "axis_swap": _S + "SELECT node, skeleton_id, seg_label, z, y, x FROM n",
    "world_to_voxel_floor": _S + "SELECT node, CAST(floor(z / 33) AS BIGINT) AS z, CAST(floor(y / 33) AS BIGINT) AS y, CAST(floor(x / 33) AS BIGINT) AS x, CAST(floor(z / 33) AS BIGINT) * 33 AS z_nm, CAST(floor(y / 33) AS BIGINT) * 33 AS y_nm, CAST(floor(x / 33) AS BIGINT) * 33 AS x_nm FROM n",
    "point_label_lookup": _S + """, v AS (SELECT node, seg_label, floor(z / 990) AS a, floor(y / 990) AS b, floor(x / 990) AS c FROM n WHERE z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL AND seg_label IS NOT NULL),
k AS (SELECT a, b, c, seg_label, row_number() OVER (PARTITION BY a, b, c ORDER BY count(*) DESC, seg_label) AS r FROM v GROUP BY a, b, c, seg_label)
SELECT node, k.seg_label AS label FROM v JOIN k USING (a, b, c) WHERE r = 1""",
    "skeleton_components": _S + """, f AS (SELECT u, v FROM e WHERE gu = gv AND gu <> 0 UNION SELECT v, u FROM e WHERE gu = gv AND gu <> 0),
c(key, value) USING KEY (key) AS (SELECT DISTINCT u, u FROM f UNION SELECT f.v, min(c.value) FROM c JOIN f ON f.u = c.key JOIN recurring.c AS k ON k.key = f.v WHERE c.value < k.value GROUP BY f.v)
SELECT * FROM c""",
    "skeleton_lengths": _S + "SELECT skeleton_id, round(l, 4) AS length FROM len",
    "erl": _S + "SELECT round(erl, 6) AS erl, round(avg_length, 6) AS avg_length, round(erl / avg_length, 6) AS erl_norm FROM er",
    "split_edges": _S + "SELECT skeleton_id, u, v FROM sp",
    "error_listing": _S + _SITES + """, l AS (SELECT 'split' AS kind, skeleton_id, u, v FROM sp UNION ALL SELECT 'merge', s1, m.u, m.v FROM w)
SELECT kind, l.skeleton_id, u, v, CAST(floor(a.z / 33) AS BIGINT) AS z_u, CAST(floor(a.y / 33) AS BIGINT) AS y_u, CAST(floor(a.x / 33) AS BIGINT) AS x_u,
  CAST(floor(b.z / 33) AS BIGINT) AS z_v, CAST(floor(b.y / 33) AS BIGINT) AS y_v, CAST(floor(b.x / 33) AS BIGINT) AS x_v, count(*) OVER (PARTITION BY kind, l.skeleton_id) AS errors
FROM l JOIN n a ON a.node = u JOIN n b ON b.node = v""",
    "split_histogram": _S + "SELECT coalesce(k, 0) AS splits, count(*) AS skeletons FROM (SELECT DISTINCT skeleton_id FROM n WHERE skeleton_id IS NOT NULL) LEFT JOIN (SELECT skeleton_id, count(*) AS k FROM sp GROUP BY skeleton_id) USING (skeleton_id) GROUP BY 1",
    "merge_counts": _S + "SELECT seg_label, skeletons, skeletons * (skeletons - 1) // 2 AS sites FROM mg",
    "merge_sites": _S + """, pr AS (SELECT a.seg_label, a.skeleton_id AS s1, b.skeleton_id AS s2, a.node AS u, b.node AS v, sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d
  FROM p a JOIN p b ON a.seg_label = b.seg_label AND a.skeleton_id < b.skeleton_id AND b.z BETWEEN a.z - 100 AND a.z + 100 AND b.y BETWEEN a.y - 100 AND a.y + 100 AND b.x BETWEEN a.x - 100 AND a.x + 100 WHERE a.seg_label <> 0),
w AS (SELECT *, row_number() OVER (PARTITION BY seg_label, s1, s2 ORDER BY d, u, v) AS r FROM pr WHERE d <= 100)
SELECT seg_label, s1, s2, u, v, round(d, 6) AS distance FROM w WHERE r = 1""",
    "all_merge_sites": _S + _SITES + "SELECT seg_label, s1, s2, m.u AS u, m.v AS v, round(m.d, 6) AS distance FROM w",
    "fresh_labels": _S + """, k AS (SELECT *, floor(z / 33) AS a, floor(y / 33) AS b, floor(x / 33) AS c FROM n WHERE z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL),
f AS (SELECT a, b, c, row_number() OVER (ORDER BY min(node)) AS r FROM k WHERE seg_label = 0 GROUP BY a, b, c)
SELECT node, CASE WHEN seg_label = 0 THEN (SELECT max(seg_label) FROM k) + r ELSE seg_label END AS seg_label FROM k LEFT JOIN f USING (a, b, c)""",
    "rasterise": _S + "SELECT CAST(floor(z / 99) AS BIGINT) AS z, CAST(floor(y / 99) AS BIGINT) AS y, CAST(floor(x / 99) AS BIGINT) AS x, max(skeleton_id) AS value FROM p GROUP BY 1, 2, 3",
    "rand_voi_skeletons": _S + _RVS + _RV,
    "rand_voi_lang_source": "WITH one AS (SELECT 1)" + _rand_voi("SELECT lang AS t, source AS g, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL") + _RV,
    "rand_voi_flag_status": "WITH one AS (SELECT 1)" + _rand_voi("SELECT l_returnflag AS t, l_linestatus AS g, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL") + _RV,
    "eval_report": _S + _RVS + _REPORT + "SELECT metric, round(value, 6) AS value FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE value)",
    "eval_store": " UNION ALL ".join(
        f"SELECT 'evaluated {m}' AS network, {k} AS checkpoint, * FROM ({_in_roi(r)}{_RVS}{_REPORT} SELECT metric, round(value, 6) AS value FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE value))" for k, (m, r) in enumerate(MODES.items())
    ),
}

#: The column by is a keyword there.
SQL = {k: re.sub(r'(?<![\w"])by(?![\w"])', '"by"', v) for k, v in SQL.items()}
