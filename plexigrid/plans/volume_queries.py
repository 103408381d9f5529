"""Queries over volumes: each row of embeddings is a 4 x 4 x 4 block of values.

The voxel_ and other plain queries take each block as a volume of its own; the grid_ and chain_ ones
take all blocks as parts of one volume, 8 blocks wide and high, and look across their faces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexigrid.operators import graph as G
from plexigrid.operators import metrics as M
from plexigrid.operators import scores as S
from plexigrid.operators import volume as V
from plexigrid.operators.geometry import Roi
from plexigrid.operators.skew import skew_join
from plexigrid.operators.training import skip_empty
from plexigrid.plans.graph_queries import _REPORT as REPORT_SQL
from plexigrid.plans.graph_queries import _RVS as VOI_SQL
from plexigrid.plans.graph_queries import _S as NODES_SQL
from plexigrid.session import cut, fresh_path, table
from plexigrid.sources.volumes import convert_volume, open_volume, prepare_volume, scales_of, volume_info, write_volume

SIDE = 4
KEY = ["block", "z", "y", "x"]


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.explode_blocks(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIDE)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels 0 to 4 or so by tenths of the value, 0 below 0.1."""
    v = voxels(spark, sf_dir)
    return v.select(*KEY, F.greatest(F.lit(0), F.floor(F.col("value") * 10)).cast("bigint").alias("label"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.watershed(voxels(spark, sf_dir), SIDE, 0.0)


def r6(c: str):
    return F.round(c, 6).alias(c)


def voxel_explode(s, d):
    return voxels(s, d).select(*KEY, r6("value"))


def voxel_pack(s, d):
    packed = V.pack_blocks(voxels(s, d).where("value > 0"))
    return packed.select("block", F.size("values").alias("n"), F.round(F.element_at("values", 1), 6).alias("first"), F.round(F.element_at("values", -1), 6).alias("last"))


def voxel_slice(s, d):
    return voxels(s, d).where(Roi((1, 0, 2), (2, 3, 2)).where()).select(*KEY, r6("value"))


def voxel_project(s, d):
    return V.project(voxels(s, d), "z", 2).select("block", "y", "x", r6("value"))


def voxel_downsample2(s, d):
    return V.downsample(voxels(s, d), 2).select(*KEY, r6("value"))


def voxel_downsample3(s, d):
    return V.downsample(voxels(s, d), 3, (0, 1, 0)).select(*KEY, r6("value"))


def voxel_transpose(s, d):
    return V.transpose(voxels(s, d)).select(*KEY, r6("value"))


def voxel_meanpool(s, d):
    return V.mean_pool(voxels(s, d), 2).select(*KEY, r6("value"))


def intensity_scale(s, d):
    return voxels(s, d).select(*KEY, F.round(V.scale_shift(F.col("value"), 2, -1), 6).alias("value"))


def normalize_uint8(s, d):
    byte = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("value") + 1) * 127.5)))
    return voxels(s, d).select(*KEY, F.round(byte / 255.0, 6).alias("value"))


def section_delete(s, d):
    return V.zero_sections(voxels(s, d), [1, 3]).select(*KEY, r6("value"))


def section_replace(s, d):
    return V.replace_sections(voxels(s, d), {1: 0, 2: 1, 3: 9}).select(*KEY, r6("value"))


def pad_grid(s, d):
    return V.pad(voxels(s, d), SIDE, 1).select(*KEY, r6("value"))


def constant_mask(s, d):
    return voxels(s, d).select(*KEY, F.lit(1).alias("mask"))


def unlabelled_mask(s, d):
    m = V.unlabelled_mask(F.col("label"), [2])
    return labels(s, d).select(*KEY, (m * F.when(F.col("z") > 0, 1).otherwise(0)).alias("mask"))


def keep_labels(s, d):
    return labels(s, d).select(*KEY, V.keep_labels(F.col("label"), [1, 3]).alias("label"))


def distinct_labels(s, d):
    return labels(s, d).where(~F.col("label").isin(1, 3)).select("label").distinct()


def affinity_offsets(s, d):
    return V.affinities(labels(s, d), [1, 3])


def grow_boundary(s, d):
    return V.grow_boundary(labels(s, d)).select(*KEY, "label")


def dilate_sections(s, d):
    return V.dilate_sections(labels(s, d)).select(*KEY, "label")


def label_balance(s, d):
    return V.balance_weights(labels(s, d)).select("label", "n", F.round("weight", 6).alias("weight"))


def block_sums(s, d):
    return voxels(s, d).groupBy("block").agg(F.round(F.sum("value"), 5).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"))


def skip_empty_blocks(s, d):
    """Values up to 0.3 are background; a block of nothing else is empty and left out of the work."""
    blocks = table(s, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x > 0.3, x).otherwise(0.0)).alias("v"))
    return skip_empty(blocks, "vec_id", "v", F.round(F.array_max("v") * 255, 3))


def stack_channels(s, d):
    """The volume and its mask as two channels of one table (c), as networks take them."""
    v = voxels(s, d)
    channels = F.array(F.struct(F.lit(0).alias("c"), F.round("value", 6).alias("value")), F.struct(F.lit(1).alias("c"), F.when(F.col("value") > 0, 1.0).otherwise(0.0).alias("value")))
    return v.select(*KEY, F.explode(channels).alias("s")).select("s.c", *KEY, "s.value")


def rag_contacts(s, d):
    return G.contacts(labels(s, d)).groupBy("block", "u", "v").agg(F.count("*").alias("contacts"))


def _contact_affinities(s, d) -> DataFrame:
    v = voxels(s, d).select(*KEY, (F.floor((F.col("value") + 1) * 128) / 256).alias("aff"), F.greatest(F.lit(0), F.floor(F.col("value") * 10)).cast("bigint").alias("label"))
    return G.contacts(v, "aff")


def rag_mean_score(s, d):
    return G.boundary_scores(_contact_affinities(s, d)).select("u", "v", F.round("merge_score", 6).alias("merge_score"), "contacts")


def rag_hist_quantiles(s, d):
    return G.all_quantile_scores(_contact_affinities(s, d), G.QUANTILES).select("q", "u", "v", F.round("merge_score", 6).alias("merge_score"))


def rag_hist_initmax(s, d):
    return G.quantile_scores(_contact_affinities(s, d), 50, init_max=True).select("u", "v", F.round("merge_score", 6).alias("merge_score"))


def fragment_centers(s, d):
    return G.centers(labels(s, d)).select("id", *[F.round(f"center_{c}", 6).alias(f"center_{c}") for c in "zyx"], "voxels")


def cc_voxels(s, d):
    v = labels(s, d).where("label > 0").withColumn("label", F.col("block") * 64 + F.col("z") * 16 + F.col("y") * 4 + F.col("x"))
    lut = G.components(G.contacts(v).select("u", "v"))
    return G.label_nodes(v.select(F.col("label").alias("id")), lut)


def agglomerate_single_linkage(s, d):
    a = _contact_affinities(s, d)
    a = a.select((F.col("block") * 16 + F.col("u")).alias("u"), (F.col("block") * 16 + F.col("v")).alias("v"), "affinity")
    return G.agglomerate(a, 0.42)


def watershed_fragments(s, d):
    return fragments(s, d)


def agglomerate_hierarchical(s, d):
    v = voxels(s, d).select(*KEY, ((F.col("value") + 1) / 2).alias("aff"))
    f = fragments(s, d).join(v, KEY)
    return G.agglomerate_blocks(G.contacts(f, "aff"), 0.45).select("block", "u", "v", F.round("merge_score", 6).alias("merge_score"))


def weak_fragments(s, d):
    v = voxels(s, d)
    f = fragments(s, d).join(v, KEY)
    return G.drop_weak_fragments(f, F.col("value"), 0.1).select(*KEY, "label")


def scale_pyramid(s, d):
    """The volume at strides 1, 2 and 4 (scale 0 to 2), as a partition column of one table."""
    v = voxels(s, d).select(*KEY, r6("value"))
    out = None
    for scale in range(3):
        one = V.downsample(v, 2**scale).withColumn("scale", F.lit(scale))
        out = one if out is None else out.unionByName(one)
    return out


def sample_point_check(s, d):
    """Whether a block seems written: the sum of its values at a quarter, half and three quarters of each side is not 0."""
    at = voxels(s, d).where("z = y and y = x and z > 0")
    return at.groupBy("block").agg((F.round(F.sum("value"), 5) != 0).alias("written"))


def _chance(*parts) -> Column:
    """A number from 0 to 999,999 that looks random, by two steps of a multiplicative generator (plain integers, the same in SQL)."""
    seed = reduce(lambda a, c: a * 64 + c, [F.col(p) if isinstance(p, str) else F.lit(p) for p in parts])
    for _ in range(3):
        seed = (seed * 48271 + 11) % 2147483647
    return seed % 1_000_000


def intensity_noise(s, d):
    """Values with a reproducible jitter of up to 0.05 by voxel, clipped to [-1, 1]."""
    jitter = (_chance("block", "z", "y", "x") / 1_000_000 - 0.5) * 0.1
    return voxels(s, d).select(*KEY, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(F.col("value") + jitter, 6))).alias("value"))


def simple_augment(s, d):
    """Each block mirrored along axes and with y and x changed over, by a reproducible choice of the block."""
    v = voxels(s, d)
    for k, c in enumerate("zyx"):
        v = v.withColumn(c, F.when(_chance("block", k) < 500_000, SIDE - 1 - F.col(c)).otherwise(F.col(c)))
    swap = _chance("block", 3) < 500_000
    return v.select("block", "z", F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), r6("value"))


GRID = 8  # blocks along y and x
TILE = 16  # voxels a side of the blocks in which the grid is worked on


def grid(s, d) -> DataFrame:
    """z, y, x, value of all blocks as one volume."""
    return V.on_grid(voxels(s, d), SIDE, GRID, GRID)


def grid_labels(s, d) -> DataFrame:
    value = F.col("value")
    return grid(s, d).select("z", "y", "x", F.greatest(F.lit(0), F.floor(value * 10)).cast("bigint").alias("label"), (F.floor((value + 1) * 128) / 256).alias("aff"))


def grid_affinities(s, d):
    """Affinities to 12 offsets: 1, 3, 9 and 27 voxels back on each axis, across blocks."""
    return V.affinities(grid_labels(s, d).drop("aff"), [1, 3, 9, 27])


def grid_grow_boundary(s, d):
    return V.grow_boundary(V.halo(grid_labels(s, d).drop("aff"), TILE, 1)).where("core").select("z", "y", "x", "label")


def grid_dilate_sections(s, d):
    return V.dilate_sections(V.halo(grid_labels(s, d).drop("aff"), TILE, 2), 2).where("core").select("z", "y", "x", "label")


def grid_contacts(s, d):
    return G.boundary_scores(G.contacts(V.halo(grid_labels(s, d), TILE, 1), "aff")).select("u", "v", F.round("merge_score", 6).alias("merge_score"), "contacts")


def grid_watershed(s, d):
    return G.watershed_grid(grid(s, d), TILE, 0.0)


def grid_seeded_fragments(s, d):
    """Fragments from seeds at least 3 voxels apart, in blocks with a margin of 4; the lowest section is masked out."""
    v = grid(s, d).withColumn("value", (F.col("value") + 1) / 2)
    return G.seeded_watershed(v, TILE, 4, 2, mask=F.col("z") > 0)


def grid_point_labels(s, d):
    """Skeleton nodes inside the volume with the label of the voxel (1320 nm) they fall into."""
    n = table(s, d, "skeleton_nodes").where("node is not null").select("node", F.col("pz").alias("z"), F.col("py").alias("y"), F.col("px").alias("x")).distinct()
    return M.label_at(n, grid_labels(s, d).drop("aff"), 1320).select("node", "z", "y", "x", "label")


#: Thresholds at which the chain writes a segmentation.
CHAIN = [0.4, 0.43, 0.44, 0.45, 0.46]


def _chain(s, d) -> dict[str, DataFrame]:
    """Affinities to fragments, nodes and scored edges of their graph, and the tables of all thresholds."""
    v = cut(grid(s, d).withColumn("aff", F.floor((F.col("value") + 1) * 128) / 256), "chain-volume")
    f = cut(G.watershed_grid(v, TILE, 0.0).join(v.select("z", "y", "x", "aff"), ["z", "y", "x"]), "chain-fragments")
    e = cut(G.boundary_scores(G.contacts(V.halo(f, TILE, 1), "aff")), "chain-edges")
    return {"fragments": f, "nodes": G.centers(f), "edges": e, "luts": cut(G.threshold_sweep(e, CHAIN), "chain-luts")}


def chain_nodes(s, d):
    return _chain(s, d)["nodes"].select("id", *[F.round(f"center_{c}", 6).alias(f"center_{c}") for c in "zyx"], "voxels")


def chain_edges(s, d):
    return _chain(s, d)["edges"].select("u", "v", F.round("merge_score", 6).alias("merge_score"), "contacts")


def chain_segmentation(s, d):
    """The volume relabelled at every threshold, written as one dataset a threshold and read back."""
    made, root = _chain(s, d), f"{fresh_path(s, 'chain')}.parquet"
    f = made["fragments"].select(F.explode(F.array(*[F.lit(t) for t in CHAIN])).alias("threshold"), "z", "y", "x", "label")
    lut = made["luts"].select("threshold", F.col("key").alias("label"), F.col("value").alias("_to"))
    whole = skew_join(f, lut, ["threshold", "label"], "left").select(F.format_string("%.3f", "threshold").alias("at"), "z", "y", "x", F.coalesce("_to", "label").alias("label"))
    write_volume(whole, root, "segmentation", by=("at",))
    return open_volume(s, root, "segmentation").select(F.col("at").cast("double").alias("threshold"), "z", "y", "x", "label")


def chain_segment_sizes(s, d):
    """Voxels of every segment at every threshold."""
    return chain_segmentation(s, d).where("label <> 0").groupBy("threshold", "label").agg(F.count("*").alias("voxels"))


def chain_scores(s, d):
    """The segmentation of every threshold scored against the skeletons (labels at their nodes, voxels of 1320 nm), appended to a score store and read back."""
    seg, store, names = cut(chain_segmentation(s, d), "segmentations"), fresh_path(s, "scores"), []
    t = table(s, d, "skeleton_nodes").where("node is not null").select("node", "skeleton_id", F.col("pz").alias("z"), F.col("py").alias("y"), F.col("px").alias("x"))
    n = cut(t.groupBy("node").agg(F.min(F.struct("skeleton_id", "z", "y", "x")).alias("a")).select("node", "a.*"), "skeletons")
    for k, at in enumerate(CHAIN):
        labelled = M.label_at(n, seg.where(F.col("threshold") == at), 1320).withColumnRenamed("label", "seg_label")
        one = cut(M.evaluate(labelled), "scores-of")
        names = one.columns
        S.append_scores(store, "chain", k, at, one)
    back = S.select_scores(s.read.parquet(store), "chain", None, CHAIN).select("threshold", F.from_json("scores", ", ".join(f"{c} double" for c in names)).alias("j"))
    flat = back.select("threshold", *[F.round(f"j.{c}", 6).alias(c) for c in names])
    return flat.unpivot(["threshold"], names, "metric", "value").where("value is not null")


def grid_hierarchical(s, d):
    """Merges in hierarchical order inside blocks of the grid, by the median of the affinities of each contact."""
    made = _chain(s, d)["fragments"]
    inside = made.withColumns({f"b{c}": F.floor(F.col(c) / TILE) for c in "zyx"})
    return G.agglomerate_blocks(G.contacts(inside, "aff"), 0.45, quantile=50).withColumn("merge_score", F.round("merge_score", 6))


def stored_conversion(s, d):
    """The labels stored with their region and voxel size, converted to every second voxel with reversed axes and two labels kept, and opened at a section."""
    root = fresh_path(s, "convert")
    prepare_volume(s, f"{root}/a.parquet", "labels", Roi((0, 0, 0), (1024 * 33,) * 3), (33, 33, 33), "uint64")
    write_volume(grid_labels(s, d).select("z", "y", "x", F.col("label").alias("value")), f"{root}/a.parquet", "labels")
    convert_volume(s, f"{root}/a.parquet", "labels", f"{root}/b.orc", factor=2, transpose=True, keep=[1, 2])
    info = volume_info(s, f"{root}/b.orc", "labels")
    return open_volume(s, f"{root}/b.orc", "labels[3]").withColumn("nm_y", F.col("y") * info["resolution"][1] + info["offset"][1])


def stored_scales(s, d):
    """The volume stored at strides 1, 2 and 4 as s0 to s2; the scales that are found there, each with its voxels and sum."""
    root, v = f"{fresh_path(s, 'scales')}.parquet", grid_labels(s, d).select("z", "y", "x", F.col("label").alias("value"))
    for k in range(3):
        write_volume(V.downsample(v, 2**k), root, f"labels/s{k}")
    found = [open_volume(s, root, name).agg(F.lit(name).alias("name"), F.count("*").alias("voxels"), F.sum("value").alias("total")) for name in scales_of(s, root, "labels")]
    return reduce(DataFrame.unionByName, found)


_NAMES = """simple_augment grid_affinities grid_grow_boundary grid_dilate_sections grid_contacts grid_watershed grid_seeded_fragments grid_point_labels
chain_nodes chain_edges chain_segmentation chain_segment_sizes chain_scores grid_hierarchical stored_conversion stored_scales scale_pyramid sample_point_check intensity_noise voxel_explode voxel_pack voxel_slice voxel_project voxel_downsample2 voxel_downsample3 voxel_transpose voxel_meanpool
intensity_scale normalize_uint8 section_delete section_replace pad_grid constant_mask unlabelled_mask keep_labels distinct_labels
affinity_offsets grow_boundary dilate_sections label_balance stack_channels block_sums skip_empty_blocks rag_contacts rag_mean_score
rag_hist_quantiles rag_hist_initmax fragment_centers cc_voxels agglomerate_single_linkage watershed_fragments
agglomerate_hierarchical weak_fragments"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_V = """WITH RECURSIVE vox AS (SELECT vec_id AS block, i // 16 AS z, (i // 4) % 4 AS y, i % 4 AS x, CAST(embedding[CAST(i + 1 AS BIGINT)] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(64)) AS i)),
lab AS (SELECT block, z, y, x, value, CAST(greatest(0, floor(value * 10)) AS BIGINT) AS label, floor((value + 1) * 128) / 256 AS aff FROM vox),
unit AS (SELECT * FROM (VALUES (0, 0, 1), (0, 1, 0), (1, 0, 0)) AS t(oz, oy, ox)),
con AS (SELECT a.block, least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, least(a.aff, b.aff) AS affinity
  FROM lab a, unit, lab b WHERE b.block = a.block AND b.z = a.z + oz AND b.y = a.y + oy AND b.x = a.x + ox AND a.label <> b.label AND a.label <> 0 AND b.label <> 0)
"""
#: The blocks as one volume, and its steepest ascents.
_GV = _V + """, g AS (SELECT (block // 64) * 4 + z AS z, (block // 8 % 8) * 4 + y AS y, (block % 8) * 4 + x AS x, value, label, aff FROM lab)
"""
_FACES = "(VALUES (0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 0, -1), (0, -1, 0), (-1, 0, 0)) AS t(oz, oy, ox)"


def _ascents(name: str, source: str, key: str, number: str, low: str) -> str:
    """name: the columns of source and label, the number of the maximum that the ascent from each voxel reaches + 1 (0 for low values)."""
    on = " AND ".join(f"b.{c} = a.{c} + o{c}" for c in "zyx") + "".join(f" AND b.{c} = a.{c}" for c in key.split())
    return f""", {name}i AS (SELECT *, {number} AS id FROM {source}),
{name}p AS (SELECT a.id, -max({{'v': b.value, 'k': -b.id}}).k AS up FROM {name}i a, {_FACES}, {name}i b WHERE {on} GROUP BY a.id),
{name}r(id, pos) AS (SELECT id, up FROM {name}p UNION SELECT r.id, p.up FROM {name}r r JOIN {name}p p ON p.id = r.pos WHERE p.up <> r.pos),
{name}e AS (SELECT r.id, r.pos FROM {name}r r JOIN {name}p p ON p.id = r.pos AND p.up = r.pos),
{name} AS (SELECT i.*, CASE WHEN {low} THEN e.pos + 1 ELSE 0 END AS fragment FROM {name}i i JOIN {name}e e ON e.id = i.id)
"""


_BLOCKWISE = _ascents("f", "vox", "block", "block * 64 + z * 16 + y * 4 + x", "value > 0")
_GRIDWISE = _ascents("f", "g", "", "z * 4398046511104 + y * 2097152 + x", "value > 0")
_EDGES = _GRIDWISE + """, ge AS (SELECT least(a.fragment, b.fragment) AS u, greatest(a.fragment, b.fragment) AS v, 1 - avg(least(a.aff, b.aff)) AS s, count(*) AS contacts
  FROM f a, unit, f b WHERE b.z = a.z + oz AND b.y = a.y + oy AND b.x = a.x + ox AND a.fragment <> b.fragment AND a.fragment <> 0 AND b.fragment <> 0 GROUP BY ALL)
"""


def _segments(t: float) -> str:
    k = f"k{round(t * 1000)}"
    return f""", e{k} AS (SELECT u, v FROM ge WHERE s <= {t} UNION SELECT v, u FROM ge WHERE s <= {t}),
{k}(key, value) USING KEY (key) AS (SELECT DISTINCT u, u FROM e{k} UNION
  SELECT e.v, min(c.value) FROM {k} c JOIN e{k} e ON e.u = c.key JOIN recurring.{k} AS q ON q.key = e.v WHERE c.value < q.value GROUP BY e.v),
s{k} AS (SELECT {t}::DOUBLE AS threshold, z, y, x, coalesce({k}.value, fragment) AS label FROM f LEFT JOIN {k} ON key = fragment)
"""


_CHAIN = _GV + _EDGES + "".join(_segments(t) for t in CHAIN) + ", seg AS (" + " UNION ALL ".join(f"SELECT * FROM sk{round(t * 1000)}" for t in CHAIN) + ") "


def _scored(t: float) -> str:
    """The scores of the segmentation at t, with nodes labelled by it in place of those of the table."""
    nodes = f"""nd AS (SELECT node, min({{'s': skeleton_id, 'z': pz, 'y': py, 'x': px}}) AS a FROM skeleton_nodes WHERE node IS NOT NULL GROUP BY node),
n AS (SELECT node, a.s AS skeleton_id, q.label AS seg_label, a.z AS z, a.y AS y, a.x AS x FROM nd JOIN sk{round(t * 1000)} q ON floor(a.z / 1320) = q.z AND floor(a.y / 1320) = q.y AND floor(a.x / 1320) = q.x),
p AS ("""
    scores = nodes + NODES_SQL.partition("\np AS (")[2].replace("q AS (SELECT skeleton_id", "pq AS (SELECT skeleton_id").replace("FROM q WHERE", "FROM pq WHERE")
    return f"{_GV}{_EDGES}{_segments(t)}, {scores}{VOI_SQL}{REPORT_SQL} SELECT metric, round(value, 6) AS value FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE value)"


def _dice(seed: str) -> str:
    """As _chance()."""
    for _ in range(3):
        seed = f"(({seed}) * 48271 + 11) % 2147483647"
    return f"({seed}) % 1000000"


_R = "block, z, y, x, round(value, 6) AS value"
_H = ", h AS (SELECT u, v, CAST(floor(affinity * 255) AS INT) AS bin, count(*) AS n FROM con GROUP BY ALL)"

SQL = {
    "scale_pyramid": _V + "SELECT k AS scale, block, z // (1 << k) AS z, y // (1 << k) AS y, x // (1 << k) AS x, round(value, 6) AS value FROM vox, (VALUES (0), (1), (2)) AS t(k) WHERE z % (1 << k) = 0 AND y % (1 << k) = 0 AND x % (1 << k) = 0",
    "sample_point_check": _V + "SELECT block, round(sum(value), 5) <> 0 AS written FROM vox WHERE z = y AND y = x AND z > 0 GROUP BY block",
    "voxel_explode": _V + f"SELECT {_R} FROM vox",
    "voxel_pack": _V + "SELECT block, count(*) AS n, round(arg_min(value, z * 16 + y * 4 + x), 6) AS first, round(arg_max(value, z * 16 + y * 4 + x), 6) AS last FROM vox WHERE value > 0 GROUP BY block",
    "voxel_slice": _V + f"SELECT {_R} FROM vox WHERE z BETWEEN 1 AND 2 AND y BETWEEN 0 AND 2 AND x BETWEEN 2 AND 3",
    "voxel_project": _V + "SELECT block, y, x, round(value, 6) AS value FROM vox WHERE z = 2",
    "voxel_downsample2": _V + "SELECT block, z // 2 AS z, y // 2 AS y, x // 2 AS x, round(value, 6) AS value FROM vox WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0",
    "voxel_downsample3": _V + "SELECT block, z // 3 AS z, (y - 1) // 3 AS y, x // 3 AS x, round(value, 6) AS value FROM vox WHERE z % 3 = 0 AND y >= 1 AND (y - 1) % 3 = 0 AND x % 3 = 0",
    "voxel_transpose": _V + "SELECT block, x AS z, y, z AS x, round(value, 6) AS value FROM vox",
    "voxel_meanpool": _V + "SELECT block, z // 2 AS z, y // 2 AS y, x // 2 AS x, round(avg(value), 6) AS value FROM vox GROUP BY 1, 2, 3, 4",
    "intensity_scale": _V + "SELECT block, z, y, x, round(value * 2 - 1, 6) AS value FROM vox",
    "normalize_uint8": _V + "SELECT block, z, y, x, round(greatest(0, least(255, floor((value + 1) * 127.5::DOUBLE))) / 255.0::DOUBLE, 6) AS value FROM vox",
    "section_delete": _V + "SELECT block, z, y, x, round(CASE WHEN z IN (1, 3) THEN 0.0 ELSE value END, 6) AS value FROM vox",
    "section_replace": _V + "SELECT a.block, a.z, a.y, a.x, round(coalesce(b.value, a.value), 6) AS value FROM vox a LEFT JOIN vox b ON b.block = a.block AND b.y = a.y AND b.x = a.x AND b.z = 0 AND a.z IN (1, 2)",
    "pad_grid": _V + ", g AS (SELECT unnest(range(-1, 5)) AS i) SELECT k.block, gz.i AS z, gy.i AS y, gx.i AS x, round(coalesce(value, 0.0), 6) AS value FROM (SELECT DISTINCT block FROM vox) k, g gz, g gy, g gx LEFT JOIN vox ON vox.block = k.block AND vox.z = gz.i AND vox.y = gy.i AND vox.x = gx.i",
    "constant_mask": _V + "SELECT block, z, y, x, 1 AS mask FROM vox",
    "unlabelled_mask": _V + "SELECT block, z, y, x, CASE WHEN label IN (0, 2) OR z = 0 THEN 0 ELSE 1 END AS mask FROM lab",
    "keep_labels": _V + "SELECT block, z, y, x, CASE WHEN label IN (1, 3) THEN label ELSE 0 END AS label FROM lab",
    "distinct_labels": _V + "SELECT DISTINCT label FROM lab WHERE label NOT IN (1, 3)",
    "affinity_offsets": _V + """SELECT a.block, a.z, a.y, a.x, oz, oy, ox, CAST(a.label = b.label AND a.label <> 0 AS INT) AS affinity
FROM lab a, (SELECT -k * oz AS oz, -k * oy AS oy, -k * ox AS ox FROM unit, (VALUES (1), (3)) AS m(k)) o, lab b
WHERE b.block = a.block AND b.z = a.z + oz AND b.y = a.y + oy AND b.x = a.x + ox""",
    "grow_boundary": _V + "SELECT block, z, y, x, CASE WHEN EXISTS (SELECT 1 FROM lab b WHERE b.block = a.block AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) = 1 AND b.label <> a.label) THEN 0 ELSE label END AS label FROM lab a",
    "dilate_sections": _V + "SELECT a.block, a.z, a.y, a.x, CASE WHEN a.label = 0 THEN max(b.label) ELSE a.label END AS label FROM lab a JOIN lab b ON b.block = a.block AND b.z = a.z AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY a.block, a.z, a.y, a.x, a.label",
    "label_balance": _V + "SELECT label, count(*) AS n, round((SELECT count(*) FROM lab) / ((SELECT count(DISTINCT label) FROM lab) * count(*))::DOUBLE, 6) AS weight FROM lab GROUP BY label",
    "stack_channels": _V + "SELECT 0 AS c, block, z, y, x, round(value, 6) AS value FROM vox UNION ALL SELECT 1, block, z, y, x, CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END FROM vox",
    "block_sums": _V + "SELECT block, round(sum(value), 5) AS total, round(avg(value), 6) AS mean, max(value) AS high FROM vox GROUP BY block",
    "skip_empty_blocks": "SELECT vec_id, CASE WHEN list_max(embedding)::DOUBLE > 0.3 THEN round(list_max(embedding)::DOUBLE * 255, 3) ELSE 0.0 END AS result FROM embeddings",
    "intensity_noise": _V + f"SELECT block, z, y, x, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, round(value + (({_dice('((block * 64 + z) * 64 + y) * 64 + x')}) / 1000000::DOUBLE - 0.5) * 0.1, 6))) AS value FROM vox",
    "simple_augment": _V + ", m AS (SELECT block, " + ", ".join(f"CASE WHEN {_dice(f'block * 64 + {k}')} < 500000 THEN 3 - {c} ELSE {c} END AS {c}" for k, c in enumerate("zyx")) + f", value, {_dice('block * 64 + 3')} < 500000 AS swap FROM vox) SELECT block, z, CASE WHEN swap THEN x ELSE y END AS y, CASE WHEN swap THEN y ELSE x END AS x, round(value, 6) AS value FROM m",
    "watershed_fragments": _V + _BLOCKWISE + "SELECT block, z, y, x, fragment AS label FROM f",
    "weak_fragments": _V + _BLOCKWISE + ", w AS (SELECT fragment FROM f WHERE fragment <> 0 GROUP BY fragment HAVING avg(value) < 0.1) SELECT block, z, y, x, CASE WHEN fragment IN (SELECT fragment FROM w) THEN 0 ELSE fragment END AS label FROM f",
    "grid_affinities": _GV + """SELECT a.z, a.y, a.x, oz, oy, ox, CAST(a.label = b.label AND a.label <> 0 AS INT) AS affinity
FROM g a, (SELECT -k * oz AS oz, -k * oy AS oy, -k * ox AS ox FROM unit, (VALUES (1), (3), (9), (27)) AS m(k)) o, g b WHERE b.z = a.z + oz AND b.y = a.y + oy AND b.x = a.x + ox""",
    "grid_grow_boundary": _GV + f"SELECT a.z, a.y, a.x, CASE WHEN max(CAST(b.label <> a.label AS INT)) = 1 THEN 0 ELSE a.label END AS label FROM g a, {_FACES}, g b WHERE b.z = a.z + oz AND b.y = a.y + oy AND b.x = a.x + ox GROUP BY a.z, a.y, a.x, a.label",
    "grid_dilate_sections": _GV + """, sq AS (SELECT p.o AS oy, q.o AS ox FROM (VALUES (-1), (0), (1)) AS p(o), (VALUES (-1), (0), (1)) AS q(o)),
d1 AS (SELECT a.z, a.y, a.x, CASE WHEN a.label = 0 THEN max(b.label) ELSE a.label END AS label FROM g a, sq, g b WHERE b.z = a.z AND b.y = a.y + oy AND b.x = a.x + ox GROUP BY a.z, a.y, a.x, a.label)
SELECT a.z, a.y, a.x, CASE WHEN a.label = 0 THEN max(b.label) ELSE a.label END AS label FROM d1 a, sq, d1 b WHERE b.z = a.z AND b.y = a.y + oy AND b.x = a.x + ox GROUP BY a.z, a.y, a.x, a.label""",
    "grid_contacts": _GV + "SELECT least(a.label, b.label) AS u, greatest(a.label, b.label) AS v, round(1 - avg(least(a.aff, b.aff)), 6) AS merge_score, count(*) AS contacts FROM g a, unit, g b WHERE b.z = a.z + oz AND b.y = a.y + oy AND b.x = a.x + ox AND a.label <> b.label AND a.label <> 0 AND b.label <> 0 GROUP BY 1, 2",
    "grid_watershed": _GV + _GRIDWISE + "SELECT z, y, x, fragment AS label FROM f",
    "grid_point_labels": _GV + "SELECT DISTINCT node, pz AS z, py AS y, px AS x, label FROM skeleton_nodes JOIN g ON floor(pz / 1320) = g.z AND floor(py / 1320) = g.y AND floor(px / 1320) = g.x WHERE node IS NOT NULL",
    "chain_nodes": _GV + _GRIDWISE + "SELECT fragment AS id, round(avg(z), 6) AS center_z, round(avg(y), 6) AS center_y, round(avg(x), 6) AS center_x, count(*) AS voxels FROM f WHERE fragment <> 0 GROUP BY fragment",
    "chain_edges": _GV + _EDGES + "SELECT u, v, round(s, 6) AS merge_score, contacts FROM ge",
    "chain_segmentation": _CHAIN + "SELECT * FROM seg",
    "chain_segment_sizes": _CHAIN + "SELECT threshold, label, count(*) AS voxels FROM seg WHERE label <> 0 GROUP BY threshold, label",
    "chain_scores": " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, * FROM ({_scored(t)})" for t in CHAIN),
    "stored_conversion": _GV + "SELECT y // 2 AS y, z // 2 AS x, CASE WHEN label IN (1, 2) THEN label ELSE 0 END AS value, y // 2 * 66 AS nm_y FROM g WHERE x = 6 AND y % 2 = 0 AND z % 2 = 0",
    "stored_scales": _GV + "SELECT 'labels/s' || k AS name, count(*) AS voxels, CAST(sum(label) AS BIGINT) AS total FROM g, (VALUES (0), (1), (2)) AS t(k) WHERE z % (1 << k) = 0 AND y % (1 << k) = 0 AND x % (1 << k) = 0 GROUP BY k",
    "rag_contacts": _V + "SELECT block, u, v, count(*) AS contacts FROM con GROUP BY ALL",
    "rag_mean_score": _V + "SELECT u, v, round(1 - avg(affinity), 6) AS merge_score, count(*) AS contacts FROM con GROUP BY u, v",
    "rag_hist_quantiles": _V + _H + """, c AS (SELECT *, sum(n) OVER (PARTITION BY u, v ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY u, v) AS total FROM h)
SELECT q, u, v, round(1 - min(bin) / 255::DOUBLE, 6) AS merge_score FROM c, (VALUES (10), (20), (25), (30), (40), (50), (60), (70), (75), (80), (90)) AS t(q) WHERE upto * 100 >= total * q GROUP BY q, u, v""",
    "rag_hist_initmax": _V + _H + "SELECT u, v, round(1 - max(bin) / 255::DOUBLE, 6) AS merge_score FROM h GROUP BY u, v",
    "fragment_centers": _V + "SELECT label AS id, round(avg(z), 6) AS center_z, round(avg(y), 6) AS center_y, round(avg(x), 6) AS center_x, count(*) AS voxels FROM lab WHERE label <> 0 GROUP BY label",
    "cc_voxels": _V + """, p AS (SELECT block * 64 + z * 16 + y * 4 + x AS id, * FROM lab WHERE label > 0),
e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON b.block = a.block AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) = 1),
r(id, c) AS (SELECT id, id FROM p UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id WHERE r.c < e.v)
SELECT id, min(c) AS component FROM r GROUP BY id""",
    "agglomerate_single_linkage": _V + """, s AS (SELECT block * 16 + u AS u, block * 16 + v AS v FROM con GROUP BY block, u, v HAVING 1 - avg(affinity) <= 0.42),
e AS (SELECT u, v FROM s UNION SELECT v, u FROM s), r(id, c) AS (SELECT u, u FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id)
SELECT id AS key, min(c) AS value FROM r GROUP BY id""",
}
