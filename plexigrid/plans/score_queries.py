"""Queries over the score store (scores), block records (completion_db_col) and event batches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexigrid.functions.jsontext import finite_number, strict_object
from plexigrid.operators import geometry as geo
from plexigrid.operators import metrics as M
from plexigrid.operators import scores as S
from plexigrid.operators.graph import seed_distance
from plexigrid.operators.training import reject
from plexigrid.plans.volume_queries import _GV, grid_labels
from plexigrid.session import cut, fresh_path, table
from plexigrid.streaming.compact import lines_of
from plexigrid.streaming.resume import completed_blocks, remaining

METRICS = ["erl_norm", "voi", "rand", "erl_voi", "erl_rand"]
_FIELDS = {"erl_norm": "erl_norm", "voi": "xpress_voi", "rand": "xpress_rand", "erl_voi": "xpress_erl_voi", "erl_rand": "xpress_erl_rand"}


def rated(s, d) -> DataFrame:
    """score_id, network, checkpoint, threshold and the metrics of the score texts (null where they are no numbers), each score once."""
    t = table(s, d, "scores").where("network is not null and checkpoint is not null and threshold is not null")
    j = strict_object(F.col("scores"), ", ".join(f"{f} string" for f in _FIELDS.values()))
    r = t.select("score_id", "network", "checkpoint", "threshold", j.alias("j"))
    return r.select("score_id", "network", "checkpoint", "threshold", *[finite_number(F.col(f"j.{f}")).alias(m) for m, f in _FIELDS.items()]).distinct()


def score_filter_in(s, d):
    t = S.select_scores(table(s, d, "scores"), None, [500, 1000, 21000], [0.2, 0.5, 0.55])
    return t.select("score_id", "network", "checkpoint", "threshold").distinct()


def topn_best_threshold(s, d):
    return S.top_entries(rated(s, d), "erl_norm", 5, "score_id")


def union_top_metrics(s, d):
    return S.union_of_tops(rated(s, d), METRICS, 16, "score_id")


def score_csv(s, d):
    r = rated(s, d).where(" and ".join(f"{m} is not null" for m in METRICS))
    return S.csv_report(r, S.union_of_tops(r, METRICS, 16, "score_id"), METRICS)


def best_per_checkpoint(s, d):
    order = F.struct((-F.col("erl_rand")).alias("m"), F.col("score_id").alias("i"), F.col("threshold").alias("t"), F.col("erl_rand").alias("v"))
    best = rated(s, d).where("erl_rand is not null").groupBy("network", "checkpoint").agg(F.min(order).alias("b"))
    return best.select("network", "checkpoint", F.col("b.t").alias("threshold"), F.col("b.v").alias("erl_rand"))


def json_scores(s, d):
    t = table(s, d, "scores")
    j = strict_object(F.col("scores"), f"n_neurons string, erl string, rand_voi {S.PARTS}")
    r = t.select("score_id", j.alias("j")).where("j is not null").select("score_id", F.col("j.n_neurons").try_cast("bigint").alias("n_neurons"), finite_number(F.col("j.erl")).alias("erl"), "j.rand_voi.*")
    return r.distinct()


def blend_check(s, d):
    """The blended scores of the parts, beside those that stand in the text."""
    j = strict_object(F.col("scores"), f"erl_norm string, rand_voi {S.PARTS}")
    r = table(s, d, "scores").select("score_id", j.alias("j")).select("score_id", "j.rand_voi.*", finite_number(F.col("j.erl_norm")).alias("erl_norm")).distinct()
    b = M.blend(F.col("nvi_split"), F.col("nvi_merge"), F.col("rand_split"), F.col("rand_merge"), F.col("erl_norm"))
    return r.select("score_id", *[F.round(c, 9).alias(n) for n, c in b.items()]).where("score_erl_rand is not null and score_erl_voi is not null")


def score_to_json(s, d):
    """Every score as one JSON text: its keys and all its metrics with nine places (those that are no numbers are left out)."""
    fixed = [F.col(c).cast("decimal(18,9)").alias(c) for c in ["threshold", *METRICS]]
    return rated(s, d).select("score_id", F.to_json(F.struct("network", "checkpoint", *fixed)).alias("entry"))


def sweep_grid(s, d):
    """The (network, checkpoint, threshold of the 19 of a sweep) that have no evaluation yet, counted by threshold."""
    t = table(s, d, "scores").where("network is not null and checkpoint is not null")
    runs = t.select("network", "checkpoint").distinct()
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.round(i * 0.05, 2))).alias("threshold")
    done = t.select("network", "checkpoint", F.round("threshold", 2).alias("threshold")).distinct()
    return runs.select("network", "checkpoint", steps).join(done, ["network", "checkpoint", "threshold"], "left_anti").groupBy("threshold").agg(F.count("*").alias("missing"))


def threshold_names(s, d):
    t = table(s, d, "scores").where("threshold is not null").select("threshold").distinct()
    return t.select("threshold", F.format_string("segmentation_%.3f", "threshold").alias("dataset"), F.floor(F.col("threshold") * 100).cast("int").alias("percent"))


def score_text_hash(s, d):
    return table(s, d, "scores").where("scores is not null").select("score_id", F.md5("scores").alias("hash")).distinct()


def blocks(s, d) -> DataFrame:
    """task, block_id, begin and end of write and read region, of blocks with two whole regions, each once."""
    t = table(s, d, "completion_db_col").where(geo.whole_roi("read_roi") & geo.whole_roi("write_roi"))
    t = geo.flat_roi(geo.flat_roi(t, "write_roi", "w"), "read_roi", "r")
    return t.select("task", "block_id", *[f"{k}{a}{e}" for k in "wr" for a in "zyx" for e in "01"]).distinct()


def roi_containment(s, d):
    inside = None
    for a in "zyx":
        c = (F.col(f"r{a}0") <= F.col(f"w{a}0")) & (F.col(f"r{a}1") >= F.col(f"w{a}1"))
        inside = c if inside is None else inside & c
    return blocks(s, d).withColumn("inside", inside).groupBy("task", "inside").agg(F.count("*").alias("blocks"))


def roi_intersection(s, d):
    total = geo.Roi((8316, 8316, 8316), (23067, 23067, 23067))
    b = blocks(s, d)
    for a, lo, hi in zip("zyx", total.begin, total.end):
        b = b.withColumn(f"{a}0", F.greatest(F.col(f"w{a}0"), F.lit(lo))).withColumn(f"{a}1", F.least(F.col(f"w{a}1"), F.lit(hi))).where(F.col(f"{a}0") < F.col(f"{a}1"))
    return b.select("task", "block_id", *[f"{a}{e}" for a in "zyx" for e in "01"])


def block_context(s, d):
    """Half of what a block reads beyond what it writes."""
    return blocks(s, d).select("task", "block_id", *[F.floor((F.col(f"r{a}1") - F.col(f"r{a}0") - F.col(f"w{a}1") + F.col(f"w{a}0")) / 2).cast("bigint").alias(a) for a in "zyx"])


def _with_config(s, d) -> DataFrame:
    return blocks(s, d).join(table(s, d, "task_configs"), "task")


def _tiles(s, d, fit: str) -> DataFrame:
    b = _with_config(s, d)
    t = geo.tile(b, {a: F.col(f"w{a}0") for a in "zyx"}, {a: F.col(f"w{a}1") for a in "zyx"}, F.col("chunk_nm"), fit)
    return t.select("task", "block_id", *[f"{a}{e}" for a in "zyx" for e in "01"])


def block_tiling_shrink(s, d):
    return _tiles(s, d, "shrink")


def block_tiling_overhang(s, d):
    return _tiles(s, d, "overhang")


def block_tiling_valid(s, d):
    return _tiles(s, d, "valid")


def chunk_blocks_in_roi(s, d):
    """Tiles of the blocks that meet the total region, counted by task."""
    t = _tiles(s, d, "overhang").where("z0 < 31383 and z1 > 8316 and y0 < 31383 and y1 > 8316 and x0 < 31383 and x1 > 8316")
    return t.groupBy("task").agg(F.count("*").alias("tiles"))


def grid_offset(s, d):
    return _with_config(s, d).select("task", "block_id", *[F.pmod(F.col(f"w{a}0"), F.col("chunk_nm")).alias(a) for a in "zyx"])


def compatible_roi(s, d):
    """What a task may write of its total read region: shrunk by the context and snapped inward to the voxel grid."""
    c = _with_config(s, d).groupBy("task").agg(*[F.min(f"r{a}0").alias(f"{a}0") for a in "zyx"], *[F.max(f"r{a}1").alias(f"{a}1") for a in "zyx"], F.max("overlap_nm").alias("o"), F.max("voxel_nm").alias("v"))
    lo = {f"{a}0": -geo.align_down(-(F.col(f"{a}0") + F.col("o")), F.col("v")) for a in "zyx"}
    hi = {f"{a}1": geo.align_down(F.col(f"{a}1") - F.col("o"), F.col("v")) for a in "zyx"}
    return c.withColumns(lo | hi).select("task", *lo, *hi)


def divisible(s, d):
    b = _with_config(s, d)
    ok = None
    for a in "zyx":
        c = (F.col(f"w{a}1") - F.col(f"w{a}0")) % F.col("voxel_nm") == 0
        ok = c if ok is None else ok & c
    return b.withColumn("whole", ok).groupBy("task", "whole").agg(F.count("*").alias("blocks"))


def seed_distances(s, d):
    return _with_config(s, d).select("task", "block_id", seed_distance(F.col("voxel_nm")).alias("distance"))


def _node_blocks(s, d) -> DataFrame:
    n = table(s, d, "rag_nodes")
    return n.groupBy(F.concat_ws("_", "bz", "by", "bx").alias("block_id")).agg(F.countDistinct("id").alias("nodes"))


def anti_completed(s, d):
    done = table(s, d, "completion_db_col").where("task = '03_agglomerate'").select("task", "block_id").distinct()
    todo = _node_blocks(s, d).select(F.lit("03_agglomerate").alias("task"), "block_id", "nodes")
    return remaining(todo, done)


def block_precheck(s, d):
    """State of every block of the agglomerate task: outside the region, to be redone, done, or open.

    Blocks that start at a multiple of 40 nm in an overwritten section are redone in any case; else
    a block is done if it is recorded or if its graph has nodes.
    """
    b = blocks(s, d).where("task = '03_agglomerate'")
    n = _node_blocks(s, d)
    outside = (F.col("wz1") <= 8316) | (F.col("wz0") >= 31383)
    redo = (F.col("wz0") <= 20000) & (F.col("wz1") > 20000)
    state = F.when(outside, "outside").when(redo, "redo").when(F.col("nodes") >= 1, "done").otherwise("open")
    return b.join(n, "block_id", "left").select("block_id", "wz0", state.alias("state")).distinct()


def block_states(s, d):
    """State of every block of every task, in the order in which a worker asks.

    outside the written region (nothing to do); redo_section: its write region meets the overwritten
    section (numbers of 40 nm); redo_mask: its read region holds a node of segment 0; recorded: a
    whole completion document (with its duration) is there; written: of the volume (voxels of 1320
    nm) the labels at a quarter, half and three quarters of the written part are not all 0; else open.
    """
    whole = geo.MODES["test"]
    b = cut(blocks(s, d), "blocks")
    mask = table(s, d, "skeleton_nodes").where("seg_label = 0").select(F.col("pz").alias("z"), F.col("py").alias("y"), F.col("px").alias("x"))
    boxes = b.select("task", "block_id", *[F.col(f"r{a}{e}").alias(f"{a}{e}") for a in "zyx" for e in "01"])
    masked = geo.blocks_with_points(boxes, ["task", "block_id"], mask, 3840).withColumn("_masked", F.lit(True))
    done = table(s, d, "completion_db_col").where("duration is not null").select("task", "block_id", F.lit(True).alias("_done")).distinct()
    for a, lo, hi in zip("zyx", whole.begin, whole.end):
        b = b.withColumns({f"{a}0": F.greatest(F.col(f"w{a}0"), F.lit(lo)), f"{a}1": F.least(F.col(f"w{a}1"), F.lit(hi))})
    points = F.explode(F.array(*[F.struct(*[geo.floor_div(F.col(f"{a}0") * 4 + (F.col(f"{a}1") - F.col(f"{a}0")) * k, F.lit(4 * 1320)).alias(a) for a in "zyx"]) for k in (1, 2, 3)]))
    # a left join, as that never broadcasts points of blocks; those outside of the volume have no label, which no sum counts
    sampled = b.select("task", "block_id", points.alias("p")).select("task", "block_id", "p.*").join(grid_labels(s, d).select("z", "y", "x", "label"), ["z", "y", "x"], "left")
    written = sampled.groupBy("task", "block_id").agg((F.sum("label") != 0).alias("_written")).where("_written")
    outside = F.lit(False)
    for a in "zyx":
        outside = outside | (F.col(f"{a}0") >= F.col(f"{a}1"))
    state = F.when(outside, "outside").when((F.col("wz0") < 501 * 40) & (F.col("wz1") > 500 * 40), "redo_section").when(F.col("_masked"), "redo_mask")
    state = state.when(F.col("_done"), "recorded").when(F.col("_written"), "written").otherwise("open")
    for t in (masked, done, written):  # each has up to a row a block, too many for a broadcast though their files are small
        b = b.join(t.hint("merge"), ["task", "block_id"], "left")
    return b.select("task", "block_id", state.alias("state"))


def roi_rules(s, d):
    """What every task schedules and writes by each of the rules: an explicit region, a sub-region, the whole source, the source less its margin."""
    c = _with_config(s, d).groupBy("task").agg(*[F.min(f"r{a}0").alias(f"{a}0") for a in "zyx"], *[F.max(f"r{a}1").alias(f"{a}1") for a in "zyx"], F.max("overlap_nm").alias("o"), F.max("voxel_nm").alias("v"), F.max("chunk_nm").alias("c"))
    inner = geo.Roi((8316,) * 3, (23067,) * 3)
    rules = {"explicit": {"roi": inner}, "sub": {"sub_roi": inner}, "source": {}, "shrunk": {"shrink": F.col("o") * 2}}
    out = None
    for name, rule in rules.items():
        cols = geo.compatible_rois({f"{a}{e}": F.col(f"{a}{e}") for a in "zyx" for e in "01"}, F.col("c"), F.col("v"), F.col("o"), **rule)
        one = c.select("task", F.lit(name).alias("rule"), *[v.alias(k) for k, v in cols.items()])
        out = one if out is None else out.unionByName(one)
    return out


def submission_check(s, d):
    """Whether a block's write region has the size of a full block of its task and the voxel grid."""
    b = _with_config(s, d)
    ok = None
    for a in "zyx":
        c = (F.col(f"w{a}1") - F.col(f"w{a}0") == F.col("max_edge_nm")) & (F.pmod(F.col(f"w{a}0"), F.col("voxel_nm")) == 0)
        ok = c if ok is None else ok & c
    return b.select("task", "block_id", ok.alias("full"))


def overwrite_sections(s, d):
    """Blocks to be done again as sections of 40 nm (numbers 300 to 303 and 500) are overwritten, with those they meet."""
    sections = F.array(*[F.lit(n) for n in (300, 301, 302, 303, 500)])
    met = F.filter(sections, lambda n: (n * 40 < F.col("wz1")) & ((n + 1) * 40 > F.col("wz0")))
    b = blocks(s, d).withColumn("met", met).where(F.size("met") > 0)
    return b.select("task", "block_id", "wz0", F.array_min("met").alias("first"), F.array_max("met").alias("last"))


def section_context(s, d):
    """Read region of a block whose fragments are made section by section: the context along z is 0."""
    b = blocks(s, d)
    return b.select("task", "block_id", F.col("wz0").alias("z0"), F.col("wz1").alias("z1"), *[F.col(f"r{a}{e}").alias(f"{a}{e}") for a in "yx" for e in "01"])


def chunk_offsets(s, d):
    """Where the lines of each file start in the list of all lines of its task, in order of file_id, and how many there are.

    Lines are counted per file; the running sum goes over ranges of 4096 file ids first, so that no
    window holds a task's files at once.
    """
    f = table(s, d, "block_files").select("task", "file_id", F.coalesce(F.size(lines_of(F.col("body"))), F.lit(0)).cast("bigint").alias("lines"))
    f = f.withColumn("lines", F.greatest("lines", F.lit(0))).withColumn("_part", F.floor(F.col("file_id") / 4096))
    within = Window.partitionBy("task", "_part").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("task").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = f.groupBy("task", "_part").agg(F.sum("lines").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(across), F.lit(0)))
    placed = f.withColumn("_in", F.coalesce(F.sum("lines").over(within), F.lit(0))).join(parts.drop("n"), ["task", "_part"])
    return placed.select("task", "file_id", "lines", (F.col("_before") + F.col("_in")).alias("begin"))


def completion_stats(s, d):
    t = table(s, d, "completion_db_col").select("task", "block_id", "start", "duration").distinct()
    return t.groupBy("task").agg(F.countDistinct("block_id").alias("blocks"), F.round(F.avg("duration"), 4).alias("mean_s"), F.max("duration").alias("longest_s"))


def stream_resume(s, d):
    root = fresh_path(s, "resume")
    return completed_blocks(s, f"{d}/completion_db_col.parquet", f"{root}/table", f"{root}/checkpoint")


def reject_batches(s, d):
    e = table(s, d, "events").withColumn("day", F.to_date("ts"))
    out = reject(e, ["user_id", "day"], F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0), 0.5, second=F.col("event_type") == "purchase")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("ratio", 6).alias("ratio"))


_NAMES = """score_filter_in topn_best_threshold union_top_metrics score_csv best_per_checkpoint json_scores blend_check score_to_json
sweep_grid threshold_names score_text_hash roi_containment roi_intersection block_context block_tiling_shrink block_tiling_overhang
block_tiling_valid chunk_blocks_in_roi grid_offset compatible_roi divisible seed_distances anti_completed block_precheck
block_states roi_rules submission_check overwrite_sections section_context chunk_offsets completion_stats stream_resume reject_batches"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_T = r"""WITH t AS (SELECT *, regexp_replace(scores, '([:,\[]\s*)-?(NaN|Infinity)', '\1null', 'g') AS s FROM scores),
v AS (SELECT *, CASE WHEN json_valid(s) THEN s::JSON END AS j0 FROM t), o AS (SELECT *, CASE WHEN json_type(j0) = 'OBJECT' THEN j0 END AS j FROM v)
"""


def _num(f: str) -> str:
    return f"CASE WHEN isfinite(TRY_CAST(j->>'$.{f}' AS DOUBLE)) THEN TRY_CAST(j->>'$.{f}' AS DOUBLE) END"


_RATED = _T + ", r AS (SELECT DISTINCT score_id, network, checkpoint, threshold, " + ", ".join(f"{_num(f)} AS {m}" for m, f in _FIELDS.items()) + " FROM o WHERE network IS NOT NULL AND checkpoint IS NOT NULL AND threshold IS NOT NULL)"


def _top(source: str, metric: str, n: int) -> str:
    return f"""SELECT network, checkpoint, threshold FROM (SELECT *, row_number() OVER (PARTITION BY network, checkpoint ORDER BY {metric} DESC, score_id) AS k FROM {source} WHERE {metric} IS NOT NULL)
WHERE k = 1 ORDER BY {metric} DESC, score_id LIMIT {n}"""


def _tops(source: str) -> str:
    return " UNION ".join(f"SELECT * FROM ({_top(source, m, 16)})" for m in METRICS)


_B = """WITH RECURSIVE c AS (SELECT * FROM completion_db_col WHERE len(read_roi.begin) = 3 AND len(read_roi.shape) = 3 AND len(write_roi.begin) = 3 AND len(write_roi.shape) = 3 AND list_min(read_roi.shape) > 0 AND list_min(write_roi.shape) > 0),
b AS (SELECT DISTINCT task, block_id, """ + ", ".join(f"{k}_roi.begin[{i + 1}] AS {k[0]}{a}0, {k}_roi.begin[{i + 1}] + {k}_roi.shape[{i + 1}] AS {k[0]}{a}1" for k in ("write", "read") for i, a in enumerate("zyx")) + """ FROM c),
g AS (SELECT * FROM b JOIN task_configs USING (task))
"""


def _rules() -> str:
    """The four rules of roi_rules: what is scheduled (s) and written (d), before it grows to the voxel grid."""
    rules = {"explicit": ("8316", "31383", "8316", "31383", "8316 >= {a}0 AND 31383 <= {a}1"), "sub": ("8316", "31383", "{a}0", "{a}1", "8316 >= {a}0 AND 31383 <= {a}1 AND ({a}0 - 8316) % c = 0")}
    rules |= {"source": ("{a}0", "{a}1", "{a}0", "{a}1", "TRUE"), "shrunk": ("{a}0 + 2 * o", "{a}1 - 2 * o", "{a}0 + 2 * o", "{a}1 - 2 * o", "TRUE")}
    down, up = "CAST(floor(({x})::DOUBLE / v) AS BIGINT) * v", "CAST(ceil(({x})::DOUBLE / v) AS BIGINT) * v"
    parts = []
    for name, (s0, s1, d0, d1, ok) in rules.items():
        axes = ", ".join(f"{down.format(x=f'{s0} - o')} AS s{a}0, {up.format(x=f'{s1} + o')} AS s{a}1, {down.format(x=d0)} AS d{a}0, {up.format(x=d1)} AS d{a}1".format(a=a) for a in "zyx")
        parts.append(f"SELECT task, '{name}' AS rule, {axes}, " + " AND ".join(f"({ok.format(a=a)})" for a in "zyx") + " AS ok FROM q")
    return "rl AS (" + " UNION ALL ".join(parts) + ") "


def _tile(fit: str) -> str:
    stop = {"shrink": "least(w{a}1, {a}0 + chunk_nm)"}.get(fit, "{a}0 + chunk_nm")
    axes = "".join(f", q{a} AS (SELECT g.*, unnest(range(w{a}0, w{a}1, chunk_nm)) AS {a}0 FROM g)" for a in "z") + ", qy AS (SELECT qz.*, unnest(range(wy0, wy1, chunk_nm)) AS y0 FROM qz), qx AS (SELECT qy.*, unnest(range(wx0, wx1, chunk_nm)) AS x0 FROM qy)"
    where = " WHERE z0 + chunk_nm <= wz1 AND y0 + chunk_nm <= wy1 AND x0 + chunk_nm <= wx1" if fit == "valid" else ""
    return axes + ", tl AS (SELECT task, block_id, " + ", ".join(f"{a}0, {stop.format(a=a)} AS {a}1" for a in "zyx") + f" FROM qx{where}) "


SQL = {
    "score_filter_in": "SELECT DISTINCT score_id, network, checkpoint, threshold FROM scores WHERE checkpoint IN (500, 1000, 21000) AND threshold IN (0.2, 0.5, 0.55)",
    "topn_best_threshold": _RATED + " " + _top("r", "erl_norm", 5),
    "union_top_metrics": _RATED + " " + _tops("r"),
    "score_csv": _RATED + ", f AS (SELECT * FROM r WHERE " + " AND ".join(f"{m} IS NOT NULL" for m in METRICS) + f"), u AS ({_tops('f')}), l AS (SELECT concat_ws(',', network, checkpoint, printf('%.3f', threshold), " + ", ".join(f"printf('%.6f', {m})" for m in METRICS) + ") AS line FROM f SEMI JOIN u USING (network, checkpoint, threshold)) SELECT row_number() OVER (ORDER BY line) AS place, line FROM l",
    "best_per_checkpoint": _RATED + " SELECT network, checkpoint, threshold, erl_rand FROM (SELECT *, row_number() OVER (PARTITION BY network, checkpoint ORDER BY erl_rand DESC, score_id) AS k FROM r WHERE erl_rand IS NOT NULL) WHERE k = 1",
    "json_scores": _T + "SELECT DISTINCT score_id, TRY_CAST(j->>'$.n_neurons' AS BIGINT) AS n_neurons, " + _num("erl") + " AS erl, " + ", ".join(f"TRY_CAST(j->>'$.rand_voi.{p}' AS DOUBLE) AS {p}" for p in ("rand_split", "rand_merge", "nvi_split", "nvi_merge")) + " FROM o WHERE j IS NOT NULL",
    "blend_check": _T + ", p AS (SELECT DISTINCT score_id, " + _num("erl_norm") + " AS e, " + ", ".join(f"TRY_CAST(j->>'$.rand_voi.{p}' AS DOUBLE) AS {p}" for p in ("rand_split", "rand_merge", "nvi_split", "nvi_merge")) + """ FROM o)
SELECT score_id, round(1 - (nvi_split + nvi_merge) / 2, 9) AS score_voi, round((rand_split + rand_merge) / 2, 9) AS score_rand, round((1 - (nvi_split + nvi_merge) / 2 + e) / 2, 9) AS score_erl_voi, round(((rand_split + rand_merge) / 2 + e) / 2, 9) AS score_erl_rand
FROM p WHERE e IS NOT NULL AND rand_split IS NOT NULL AND rand_merge IS NOT NULL AND nvi_split IS NOT NULL AND nvi_merge IS NOT NULL""",
    "score_to_json": _RATED + " SELECT score_id, '{' || concat_ws(',', '\"network\":\"' || network || '\"', '\"checkpoint\":' || checkpoint, " + ", ".join(f"'\"{m}\":' || CAST({m} AS DECIMAL(18, 9))" for m in ["threshold", *METRICS]) + ") || '}' AS entry FROM r",
    "sweep_grid": """WITH t AS (SELECT * FROM scores WHERE network IS NOT NULL AND checkpoint IS NOT NULL), g AS (SELECT unnest(range(1, 20)) AS i)
SELECT round(i * 0.05::DOUBLE, 2) AS threshold, count(*) AS missing FROM (SELECT DISTINCT network, checkpoint FROM t) r, g
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.network = r.network AND t.checkpoint = r.checkpoint AND round(t.threshold, 2) = round(i * 0.05::DOUBLE, 2)) GROUP BY i""",
    "threshold_names": "SELECT DISTINCT threshold, printf('segmentation_%.3f', threshold) AS dataset, CAST(floor(threshold * 100) AS INT) AS percent FROM scores WHERE threshold IS NOT NULL",
    "score_text_hash": "SELECT DISTINCT score_id, md5(scores) AS hash FROM scores WHERE scores IS NOT NULL",
    "roi_containment": _B + "SELECT task, rz0 <= wz0 AND rz1 >= wz1 AND ry0 <= wy0 AND ry1 >= wy1 AND rx0 <= wx0 AND rx1 >= wx1 AS inside, count(*) AS blocks FROM b GROUP BY ALL",
    "roi_intersection": _B + "SELECT task, block_id, " + ", ".join(f"greatest(w{a}0, 8316) AS {a}0, least(w{a}1, 31383) AS {a}1" for a in "zyx") + " FROM b WHERE " + " AND ".join(f"w{a}0 < 31383 AND w{a}1 > 8316" for a in "zyx"),
    "block_context": _B + "SELECT task, block_id, " + ", ".join(f"CAST(floor((r{a}1 - r{a}0 - w{a}1 + w{a}0) / 2) AS BIGINT) AS {a}" for a in "zyx") + " FROM b",
    "block_tiling_shrink": _B + _tile("shrink") + "SELECT * FROM tl",
    "block_tiling_overhang": _B + _tile("overhang") + "SELECT * FROM tl",
    "block_tiling_valid": _B + _tile("valid") + "SELECT * FROM tl",
    "chunk_blocks_in_roi": _B + _tile("overhang") + "SELECT task, count(*) AS tiles FROM tl WHERE " + " AND ".join(f"{a}0 < 31383 AND {a}1 > 8316" for a in "zyx") + " GROUP BY task",
    "grid_offset": _B + "SELECT task, block_id, " + ", ".join(f"((w{a}0 % chunk_nm) + chunk_nm) % chunk_nm AS {a}" for a in "zyx") + " FROM g",
    "compatible_roi": _B + "SELECT task, " + ", ".join(f"CAST(ceil((min(r{a}0) + max(overlap_nm))::DOUBLE / max(voxel_nm)) AS BIGINT) * max(voxel_nm) AS {a}0, CAST(floor((max(r{a}1) - max(overlap_nm))::DOUBLE / max(voxel_nm)) AS BIGINT) * max(voxel_nm) AS {a}1" for a in "zyx") + " FROM g GROUP BY task",
    "divisible": _B + "SELECT task, " + " AND ".join(f"(w{a}1 - w{a}0) % voxel_nm = 0" for a in "zyx") + " AS whole, count(*) AS blocks FROM g GROUP BY ALL",
    "seed_distances": _B + "SELECT task, block_id, CASE voxel_nm WHEN 8 THEN 8 WHEN 16 THEN 5 WHEN 50 THEN 5 ELSE 10 END AS distance FROM g",
    "anti_completed": "WITH n AS (SELECT concat_ws('_', bz, by, bx) AS block_id, count(DISTINCT id) AS nodes FROM rag_nodes GROUP BY 1) SELECT '03_agglomerate' AS task, block_id, nodes FROM n WHERE block_id NOT IN (SELECT block_id FROM completion_db_col WHERE task = '03_agglomerate' AND block_id IS NOT NULL)",
    "block_precheck": _B + ", n AS (SELECT concat_ws('_', bz, by, bx) AS block_id, count(DISTINCT id) AS nodes FROM rag_nodes GROUP BY 1) SELECT DISTINCT block_id, wz0, CASE WHEN wz1 <= 8316 OR wz0 >= 31383 THEN 'outside' WHEN wz0 <= 20000 AND wz1 > 20000 THEN 'redo' WHEN nodes >= 1 THEN 'done' ELSE 'open' END AS state FROM b LEFT JOIN n USING (block_id) WHERE task = '03_agglomerate'",
    "block_states": _GV.replace("vox AS", "one AS (SELECT 1), vox AS", 1) + "," + _B.removeprefix("WITH RECURSIVE ").replace("), g AS (", "), cfg AS (").replace("\ng AS (", "\ncfg AS (") + """, o AS (SELECT *, """ + ", ".join(f"greatest(w{a}0, 3267) AS {a}0, least(w{a}1, 36333) AS {a}1" for a in "zyx") + """ FROM b),
dn AS (SELECT DISTINCT task, block_id FROM completion_db_col WHERE duration IS NOT NULL),
sm AS (SELECT task, block_id, sum(label) AS t FROM o, (VALUES (1), (2), (3)) AS q(k), g WHERE """ + " AND ".join(f"g.{a} = floor(({a}0 * 4 + ({a}1 - {a}0) * k)::DOUBLE / 5280)".replace(f"({a}0 * 4 + ({a}1 - {a}0)", f"(o.{a}0 * 4 + (o.{a}1 - o.{a}0)") for a in "zyx") + """ GROUP BY task, block_id)
SELECT o.task, o.block_id, CASE WHEN z0 >= z1 OR y0 >= y1 OR x0 >= x1 THEN 'outside' WHEN wz0 < 20040 AND wz1 > 20000 THEN 'redo_section'
  WHEN EXISTS (SELECT 1 FROM skeleton_nodes s WHERE s.seg_label = 0 AND s.pz >= rz0 AND s.pz < rz1 AND s.py >= ry0 AND s.py < ry1 AND s.px >= rx0 AND s.px < rx1) THEN 'redo_mask'
  WHEN dn.task IS NOT NULL THEN 'recorded' WHEN t <> 0 THEN 'written' ELSE 'open' END AS state
FROM o LEFT JOIN dn ON dn.task = o.task AND dn.block_id = o.block_id LEFT JOIN sm ON sm.task = o.task AND sm.block_id = o.block_id""",
    "roi_rules": _B + ", q AS (SELECT task, max(overlap_nm) AS o, max(voxel_nm) AS v, max(chunk_nm) AS c, " + ", ".join(f"min(r{a}0) AS {a}0, max(r{a}1) AS {a}1" for a in "zyx") + " FROM g GROUP BY task), " + _rules() + "SELECT * FROM rl",
    "submission_check": _B + "SELECT task, block_id, " + " AND ".join(f"w{a}1 - w{a}0 = max_edge_nm AND w{a}0 % voxel_nm = 0" for a in "zyx") + ' AS "full" FROM g',
    "overwrite_sections": _B + ", n AS (SELECT unnest([300, 301, 302, 303, 500]) AS k) SELECT task, block_id, wz0, min(k) AS first, max(k) AS last FROM b JOIN n ON k * 40 < wz1 AND (k + 1) * 40 > wz0 GROUP BY ALL",
    "section_context": _B + "SELECT task, block_id, wz0 AS z0, wz1 AS z1, ry0 AS y0, ry1 AS y1, rx0 AS x0, rx1 AS x1 FROM b",
    "chunk_offsets": """WITH f AS (SELECT task, file_id, len(list_filter(string_split(replace(coalesce(body, ''), chr(13), chr(10)), chr(10)), lambda x: trim(x) <> '')) AS lines FROM block_files)
SELECT task, file_id, lines, coalesce(sum(lines) OVER (PARTITION BY task ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM f""",
    "completion_stats": "SELECT task, count(DISTINCT block_id) AS blocks, round(avg(duration), 4) AS mean_s, max(duration) AS longest_s FROM (SELECT DISTINCT task, block_id, start, duration FROM completion_db_col) GROUP BY task",
    "stream_resume": "SELECT DISTINCT task, block_id FROM completion_db_col",
    "reject_batches": "SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0::DOUBLE ELSE 0 END), 6) AS ratio FROM events GROUP BY 1, 2 HAVING avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0::DOUBLE ELSE 0 END) > 0.5 AND max(CAST(event_type = 'purchase' AS INT)) = 1",
}

#: The column by is a keyword there.
SQL = {k: re.sub(r'(?<![\w"])by(?![\w"])', '"by"', v) for k, v in SQL.items()}
