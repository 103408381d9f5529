"""Volumes that go on across blocks, stored volumes, block checks and hot keys."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plexigrid.operators import geometry as geo
from plexigrid.operators import graph as G
from plexigrid.operators import metrics as M
from plexigrid.operators import scores as S
from plexigrid.operators import volume as V
from plexigrid.operators.skew import hot_keys, skew_join
from plexigrid.sources import volumes as src

FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def noise(seed, n=7, values=6):
    rnd = random.Random(seed)
    return {p: float(rnd.randrange(values)) for p in itertools.product(range(n), repeat=3) if rnd.random() > 0.05}


def volume(spark, grid, name="value", kind="double"):
    return spark.createDataFrame([(*p, v if kind == "double" else int(v)) for p, v in grid.items()], f"z bigint, y bigint, x bigint, {name} {kind}")


def number(p):
    return (p[0] << 42) + (p[1] << 21) + p[2]


def test_blocks_as_one_volume(spark):
    v = spark.createDataFrame([(b, 1, 0, 2, float(b)) for b in range(20)], "block bigint, z bigint, y bigint, x bigint, value double")
    got = {r.value: (r.z, r.y, r.x) for r in V.on_grid(v, 4, 2, 3).collect()}
    assert got[0] == (1, 0, 2) and got[5] == (1, 4, 10) and got[6] == (5, 0, 2) and got[19] == (13, 0, 6)


@pytest.mark.parametrize("size, context", [(3, 1), (4, 2), (2, 3)])
def test_margins_hold_all_neighbours(spark, size, context):
    grid = noise(1)
    got = defaultdict(set)
    core = defaultdict(list)
    for r in V.halo(volume(spark, grid), size, context).collect():
        got[r.bz, r.by, r.bx].add((r.z, r.y, r.x))
        if r.core:
            core[r.bz, r.by, r.bx].append((r.z, r.y, r.x))
    assert sorted(itertools.chain(*core.values())) == sorted(grid)
    for b in core:
        assert got[b] == {p for p in grid if all(k * size - context <= c < (k + 1) * size + context for c, k in zip(p, b))}


@pytest.mark.parametrize("size", [2, 3, 7])
def test_neighbours_do_not_end_at_blocks(spark, size):
    grid = noise(2, values=3)
    whole = volume(spark, grid, "label", "bigint")
    parts = V.halo(whole, size, 1)
    want = sorted((min(a, b), max(a, b)) for p, a in grid.items() for d in FACES[::2] if (b := grid.get(tuple(map(sum, zip(p, d))), a)) != a and a and b)
    assert rows(G.contacts(parts).select("u", "v")) == want == rows(G.contacts(whole))
    grown = {p: 0 if any(grid.get(tuple(map(sum, zip(p, d))), a) != a for d in FACES) else a for p, a in grid.items()}
    assert {(r.z, r.y, r.x): r.label for r in V.grow_boundary(parts).where("core").collect()} == grown
    twice = V.dilate_sections(V.halo(whole, size, 2), 2).where("core").select("z", "y", "x", "label")
    assert rows(twice) == rows(V.dilate_sections(whole, 2))
    assert rows(V.affinities(whole, [1, 4])) == sorted(
        (*p, *(-d * f for f in face), int(a == b and a != 0)) for p, a in grid.items() for d in (1, 4) for face in FACES[::2] if (b := grid.get(tuple(c - d * f for c, f in zip(p, face)))) is not None
    )


@pytest.mark.parametrize("size", [1, 2, 3, 8])
def test_watershed_does_not_depend_on_blocks(spark, size):
    grid = noise(3)

    def top(p):
        near = [q for q in [p, *[tuple(map(sum, zip(p, d))) for d in FACES]] if q in grid]
        up = min(near, key=lambda q: (-grid[q], number(q)))
        return p if up == p else top(up)

    want = sorted((*p, number(top(p)) + 1 if v > 1 else 0) for p, v in grid.items())
    assert rows(G.watershed_grid(volume(spark, grid), size, 1.0)) == want
    assert G.watershed_grid(volume(spark, grid).limit(0), size, 1.0).count() == 0


def brute_seeds(grid, low, distance):
    """One block of the whole grid: steps to the outside, seeds, floods."""
    inside = {p for p, v in grid.items() if v > low}
    span = [range(min(p[a] for p in grid), max(p[a] for p in grid) + 1) for a in range(3)]
    outside = {p for p in itertools.product(*span)} - inside
    depth, front, d = {}, outside, 0
    while front:
        d += 1
        front = {q for p in front for f in FACES if (q := tuple(map(sum, zip(p, f)))) in inside and q not in depth}
        depth |= dict.fromkeys(front, d)
    best = lambda p: (depth[p], [-c for c in p])
    seeds = [p for p in inside if all(best(q) <= best(p) for q in inside if max(abs(a - b) for a, b in zip(p, q)) <= distance)]
    label = {p: p for p in seeds}
    for level in range(max(depth.values()), 0, -1):
        while True:
            take = {}
            for p in inside - label.keys():
                near = [label[q] for f in FACES if (q := tuple(map(sum, zip(p, f)))) in label]
                if near and depth[p] >= level:
                    take[p] = min(near)
            if not take:
                break
            label |= take
    return {p: number(label[p]) + 1 if p in label else 0 for p in grid}


def test_seeded_fragments_against_brute_force(spark):
    rnd = random.Random(4)
    centers = [(2, 2, 2), (2, 6, 6), (6, 3, 7)]
    grid = {p: 1.0 if min(sum(abs(a - b) for a, b in zip(p, c)) for c in centers) + rnd.random() < 3.5 else 0.0 for p in itertools.product(range(9), repeat=3)}
    got = {(r.z, r.y, r.x): r.label for r in G.seeded_watershed(volume(spark, grid), 9, 0, 2).collect()}
    # beyond the block counts as inside there, as outside here: a hull of outside makes both the same
    hull = {p: grid.get(p, 0.0) for p in itertools.product(range(-1, 10), repeat=3)}
    framed = {tuple(c + 1 for c in p): v for p, v in hull.items()}
    full = {(r.z, r.y, r.x): r.label for r in G.seeded_watershed(volume(spark, framed), 11, 0, 2).collect()}
    assert full == brute_seeds(framed, 0.5, 2) and len(set(full.values())) == 4
    assert got.keys() == grid.keys() and all((got[p] > 0) <= (grid[p] > 0.5) for p in grid)
    masked = {(r.z, r.y, r.x): r.label for r in G.seeded_watershed(volume(spark, framed), 11, 0, 2, mask=F.col("z") > 5).collect()}
    assert not any(v for p, v in masked.items() if p[0] <= 5) and any(masked.values())
    # every block with a margin as wide as the volume sees all of it
    parts = {(r.z, r.y, r.x): r.label for r in G.seeded_watershed(volume(spark, framed), 4, 12, 2).collect()}
    assert parts == full


@pytest.mark.parametrize("quantile, init_max", [(None, False), (50, False), (25, True)])
def test_merging_order_against_brute_force(spark, quantile, init_max):
    rnd = random.Random(5)
    data = [(b, u, v, rnd.randrange(256) / 255) for b in (1, 2) for u, v in itertools.combinations(range(1, 8), 2) if rnd.random() < 0.7 for _ in range(rnd.randrange(1, 6))]
    want = []
    for b in (1, 2):
        contact, changed = defaultdict(list), set()
        for k, u, v, a in data:
            if k == b:
                contact[u, v].append(a)

        def score(pair):
            bins = sorted(int(a * 255) for a in contact[pair])
            if quantile is None:
                return 1 - sum(contact[pair]) / len(bins)
            if init_max and pair not in changed:
                return 1 - bins[-1] / 255
            return 1 - bins[max(0, -(-len(bins) * quantile // 100) - 1)] / 255

        while contact:
            u, v = min(contact, key=lambda p: (round(score(p), 12), p))
            if score((u, v)) > 0.6:
                break
            want.append((b, u, v, round(score((u, v)), 9)))
            del contact[u, v]
            for p in [p for p in contact if v in p]:
                w = p[0] if p[1] == v else p[1]
                new = (min(u, w), max(u, w))
                if new in contact or p in changed:
                    changed.add(new)
                contact[new] += contact.pop(p)
    df = spark.createDataFrame([*data, (1, 1, 2, None), (1, 1, 2, float("nan"))], "block bigint, u bigint, v bigint, affinity double")
    got = G.agglomerate_blocks(df, 0.6, quantile, init_max).withColumn("merge_score", F.round("merge_score", 9))
    assert rows(got) == sorted(want)


def test_components_of_many_graphs_at_once(spark):
    pairs = [(t, u, v) for t in (1, 2) for u, v in [(1, 2), (2, 3), (8, 9)]] + [(2, 3, 8), (3, None, 1), (3, 4, 4)]
    got = rows(G.components(spark.createDataFrame(pairs, "t int, u bigint, v bigint"), ["t"]))
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 8, 8), (1, 9, 8), *[(2, k, 1) for k in (1, 2, 3, 8, 9)]]


def test_sweep_of_chunks(spark, monkeypatch):
    rnd = random.Random(7)
    data = [(rnd.randrange(80), rnd.randrange(80), rnd.choice([rnd.random(), 0.25, 0.5, None, float("nan")])) for _ in range(300)]
    df = spark.createDataFrame(data, "u bigint, v bigint, merge_score double").repartition(3)
    steps = [0.25, 0.5, 0.1, 0.9]
    got = defaultdict(dict)
    for r in G.threshold_sweep(df, steps).collect():
        got[r.threshold][r.key] = r.value
    for t in steps:
        assert got[t] == {r.key: r.value for r in G.components(G.under(df, t)).collect()}
    assert G.threshold_sweep(df, []).count() == 0 and G.threshold_sweep(df.limit(0), steps).count() == 0
    # chunks of two edges
    import pandas as pd

    monkeypatch.setattr(G, "CHUNK_EDGES", 2)
    batch = pd.DataFrame([(1, 2, 0), (2, 3, 1), (3, 1, 0), (4, 5, 1), (5, 6, 1)], columns=["u", "v", "_level"])
    out = [tuple(r) for c in G._stars(2)(iter([batch[:2], batch[2:4], batch[4:]])) for r in c.itertuples(index=False)]
    assert out == [(0, 1, 2), (1, 1, 2), (1, 1, 3), (0, 1, 3), (1, 1, 3), (1, 4, 5), (1, 5, 6)]


def test_sweep_links_each_id_once_whatever_the_thresholds(spark, monkeypatch):
    import pandas as pd

    rnd = random.Random(11)
    data = [(rnd.randrange(90), rnd.randrange(90), rnd.choice([rnd.random(), 0.25, None, float("nan")])) for _ in range(250)]
    df = spark.createDataFrame(data, "u bigint, v bigint, merge_score double").repartition(3)
    steps = [k / 20 for k in range(1, 20)]
    want = rows(G.threshold_sweep(df, steps))
    for t in steps:
        assert [r[1:] for r in want if r[0] == t] == rows(G.components(G.under(df, t)))
    monkeypatch.setattr(G, "JOINED_LINKS", 0)  # all tasks, in rounds
    assert rows(G.threshold_sweep(df, steps)) == want
    monkeypatch.undo()
    batch = pd.DataFrame([(5, 6, 0), (6, 7, 1), (5, 7, 1), (2, 7, 3), (1, 9, 2), (9, 2, 4)], columns=["u", "v", "_level"])
    assert [tuple(r) for c in G._links(19)(iter([batch])) for r in c.itertuples(index=False)] == [(4, 1, 2), (3, 2, 5), (0, 5, 6), (1, 5, 7), (2, 1, 9)]
    runs = sorted(tuple(r) for c in G._runs(19)(iter([batch])) for r in c.itertuples(index=False))
    assert runs == [(1, 1, 2, 18), (2, 1, 4, 18), (2, 2, 3, 3), (5, 1, 4, 18), (5, 2, 3, 3), (5, 5, 0, 2), (6, 1, 4, 18), (6, 2, 3, 3), (6, 5, 0, 2), (7, 1, 4, 18), (7, 2, 3, 3), (7, 5, 1, 2), (9, 1, 2, 18)]


def test_a_key_of_one_percent_is_hot(spark):
    big = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, -1).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("j"), F.col("id").alias("n"))
    big = big.unionByName(spark.createDataFrame([(None, 1, -1), (5, None, -2)], "k bigint, j bigint, n bigint"))
    assert hot_keys(big, "k", rows=150) == [-1]
    assert hot_keys(big, "k", rows=200) == [] and hot_keys(big, "k", rows=150, most=100) == []
    assert hot_keys(big, "k", rows=0, parts=100) == []  # not more than a hundredth of all
    hot = hot_keys(big, ["k", "j"], rows=25)
    assert len(hot) == 7
    small = spark.range(-1, 9_000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("j"), F.lit("x").alias("s"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        for keys, h in (("k", [-1]), (["k", "j"], hot)):
            s = small.drop("j") if keys == "k" else small
            assert sorted(map(str, skew_join(big, s, keys, how, h).collect())) == sorted(map(str, big.join(s, keys, how).collect()))


def test_boundary_edges_with_hot_vertices(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 0, 2), (0, 0, 1, 2), (0, 0, 1, None)], "bz bigint, by bigint, bx bigint, id bigint")
    edges = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 0, 0, 2, 3), (0, 0, 1, 1, 2), (0, 0, 1, 2, 2)], "bz bigint, by bigint, bx bigint, u bigint, v bigint")
    assert rows(G.boundary_edges(edges, nodes)) == [(0, 0, 0, 2, 3), (0, 0, 1, 1, 2)]


def test_labels_at_points(spark):
    v = spark.createDataFrame([(0, 0, 0, 7), (0, 0, 1, 8)], "z int, y int, x int, label bigint")
    p = spark.createDataFrame([(1, 5.0, 9.9, 0.0), (2, 0.0, 0.0, 19.9), (3, 0.0, 0.0, 20.0), (4, -0.1, 0.0, 0.0), (5, None, 0.0, 0.0)], "node int, z double, y double, x double")
    assert rows(M.label_at(p, v, 10).select("node", "label")) == [(1, 7), (2, 8)]


def test_blocks_with_points_against_brute_force(spark):
    rnd = random.Random(8)
    boxes = [(k, *[x for _ in range(3) for x in sorted((rnd.randrange(-40, 40), rnd.randrange(-40, 40)))]) for k in range(60)]
    points = [tuple(float(rnd.randrange(-45, 45)) for _ in range(3)) for _ in range(12)] + [(None, 0.0, 0.0)]
    b = spark.createDataFrame(boxes, "k int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    got = geo.blocks_with_points(b, ["k"], spark.createDataFrame(points * 2, "z double, y double, x double"), 10)
    assert [r[0] for r in rows(got)] == [x[0] for x in boxes if any(p[0] is not None and all(x[1 + 2 * a] <= p[a] < x[2 + 2 * a] for a in range(3)) for p in points)]


def test_cubes_of_boxes_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(k, *[0, 100 + k] * 3) for k in range(20)], "k int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int").coalesce(1).write.parquet(f"{tmp_path}/boxes")
    spark.range(20_000).select(*[(F.rand(i) - 1 + F.when(F.col("id") == 7, 110).otherwise(0)).alias(a) for i, a in enumerate("zyx")]).write.parquet(f"{tmp_path}/points")
    got = geo.blocks_with_points(spark.read.parquet(f"{tmp_path}/boxes"), ["k"], spark.read.parquet(f"{tmp_path}/points"), 10)
    assert "BuildLeft" not in got._jdf.queryExecution().sparkPlan().toString()  # cubes are on the left of both joins
    assert [r[0] for r in rows(got)] == list(range(10, 20))


def test_prepared_and_converted_volumes(spark, tmp_path):
    a, b = f"{tmp_path}/a.parquet", f"{tmp_path}/b.orc"
    roi = geo.Roi((0, 33, 66), (132, 132, 132))
    src.prepare_volume(spark, a, "seg", roi, (33, 33, 33), "uint64")
    src.prepare_volume(spark, a, "seg", roi, (33, 33, 33), "uint64")
    with pytest.raises(ValueError):
        src.prepare_volume(spark, a, "seg", roi, (66, 66, 66), "uint64", delete=True)
    with pytest.raises(ValueError):
        src.prepare_volume(spark, a, "seg", roi, (33, 33, 33), "uint8")
    assert src.submission_errors(spark, a, "seg") == ["no values", "voxel size [33, 33, 33]", "region [0, 33, 66], [132, 132, 132]"]
    assert src.submission_errors(spark, a, "other") and src.submission_errors(spark, "a.tif", "seg")
    v = spark.createDataFrame([(*p, sum(p)) for p in itertools.product(range(4), repeat=3)], "z bigint, y bigint, x bigint, value bigint")
    src.write_volume(v, a, "seg")
    assert src.submission_errors(spark, a, "seg", (33, 33, 33), roi) == []
    src.convert_volume(spark, a, "seg", b, factor=2, transpose=True, keep=[2, 4])
    info = src.volume_info(spark, b, "seg")
    assert (info["offset"], info["shape"], info["resolution"]) == ([66, 0, 0], [132] * 3, [66] * 3)
    assert rows(src.open_volume(spark, b, "seg[1]").select("y", "x", "value")) == [(y, x, w if (w := 2 + 2 * y + 2 * x) in (2, 4) else 0) for y in (0, 1) for x in (0, 1)]
    assert src.scales_of(spark, a, "seg") == ["seg"] and src.table_exists(spark, f"{a}/seg") and not src.table_exists(spark, f"{a}/no")


def test_tables_that_are_stored(spark, tmp_path):
    lut = spark.createDataFrame([("local", 0.1, 1, 2), ("local", 0.25, 1, 3)], "stage string, threshold double, key bigint, value bigint")
    src.write_lut(lut, f"{tmp_path}/lut")
    assert rows(src.stored_luts(spark, f"{tmp_path}/lut")) == [("local", 0.1), ("local", 0.25)]
    assert src.lut_exists(spark, f"{tmp_path}/lut", "local", 0.25) and not src.lut_exists(spark, f"{tmp_path}/lut", "local", 0.2)
    assert src.read_luts(spark, f"{tmp_path}/lut").count() == 2 and src.stored_luts(spark, f"{tmp_path}/none").count() == 0


def test_evaluations_are_appended(spark, tmp_path):
    nodes = spark.createDataFrame([(k, k % 2, 1 + (k % 4) // 2, float(k), 0.0, 0.0) for k in range(12)], "node bigint, skeleton_id bigint, seg_label bigint, z double, y double, x double")
    one = M.evaluate(nodes)
    for k, df in enumerate((one, M.evaluate(nodes.limit(0)))):
        S.append_scores(f"{tmp_path}/s", "net", k, 0.5, df)
    got = spark.read.parquet(f"{tmp_path}/s").orderBy("checkpoint").collect()
    assert [r.checkpoint for r in got] == [0, 1] and '"n_neurons":2.0' in got[0].scores and '"n_neurons":0.0' in got[1].scores and "erl" not in got[1].scores
    with pytest.raises(TypeError):
        S.append_scores(f"{tmp_path}/s", "net", 1, 1, one)


@pytest.mark.parametrize("rule, want", [({"roi": geo.Roi((9,) * 3, (30,) * 3)}, (0, 50, 0, 40, True)), ({"sub_roi": geo.Roi((20,) * 3, (20,) * 3)}, (10, 50, 0, 100, True)), ({}, (-10, 110, 0, 100, True)), ({"sub_roi": geo.Roi((25,) * 3, (20,) * 3)}, (20, 50, 0, 100, False))])
def test_regions_by_rule(spark, rule, want):
    source = {f"{a}{k}": F.lit(v) for a in "zyx" for k, v in ((0, 0), (1, 100))}
    got = spark.range(1).select(*[c.alias(k) for k, c in geo.compatible_rois(source, F.lit(20), F.lit(10), F.lit(5), **rule).items()]).first()
    # 9 - 5 = 4 and 39 + 5 = 44 grow to 0 and 50; 20 - 5 to 10, 40 + 5 to 50
    assert tuple(got[k] for k in ("sz0", "sz1", "dx0", "dx1", "ok")) == want


@pytest.mark.parametrize("span", [None, 2])
def test_block_tables_join_to_the_components_of_all(spark, span):
    rnd = random.Random(11)
    home = {i: (rnd.randrange(4), rnd.randrange(2), rnd.randrange(3)) for i in range(120)}
    nodes = spark.createDataFrame([(*b, i) for i, b in home.items()] + [(3, 1, 2, 5), (0, 0, 0, None)], "bz bigint, by bigint, bx bigint, id bigint")
    data = []
    for t in (1, 2):
        for _ in range(90 * t):
            u, v = rnd.choice(list(home.items())), rnd.randrange(120)
            data.append((t, *u[1], u[0], v))
    edges = spark.createDataFrame(data + [(1, 0, 0, 0, None, 3), (1, 0, 0, 0, 4, 4)], "t int, bz bigint, by bigint, bx bigint, u bigint, v bigint")
    local, crossing = G.block_tables(edges.where("u <> v"), nodes, ["t"])
    for r in local.collect():
        assert home[r.key] == (r.bz, r.by, r.bx) == home[r.value] or r.key == 5 or r.value == 5
    assert rows(G.joined_tables(local, crossing, ["t"], span)) == rows(G.components(edges, ["t"]))


def test_graph_store_reads_layers(spark, tmp_path):
    nodes = spark.createDataFrame([(z, y, 0, 10 * z + y, 1.0, 1.0, None if y == 3 else 1.0) for z in range(4) for y in range(4)], "bz bigint, by bigint, bx bigint, id bigint, center_z double, center_y double, center_x double")
    edges = spark.createDataFrame([(z, y, 0, 1, 2) for z in range(4) for y in range(4)], "bz bigint, by bigint, bx bigint, u bigint, v bigint")
    src.write_graph(nodes, edges, f"{tmp_path}/g")
    src.write_graph(nodes.where("bz = 2").withColumn("id", F.col("id") + 100), edges.where("bz = 2"), f"{tmp_path}/g")
    n, e = src.read_graph(spark, f"{tmp_path}/g", (1, 1, 0), (3, 4, 1))
    assert [r.id for r in n.orderBy("id").collect()] == [11, 12, 121, 122] and e.count() == 6
    assert "PartitionFilters: [isnotnull(bz" in e._jdf.queryExecution().explainString(e.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_numbers_across_ranges(spark):
    lines = [f"{k % 37:03d}" for k in range(200)]
    got = S.numbered(spark.createDataFrame([(x,) for x in lines], "line string").repartition(4), "line", "place")
    assert sorted((r.place, r.line) for r in got.collect()) == list(enumerate(sorted(lines), 1))
    assert S.numbered(got.drop("place").limit(0), "line", "place").count() == 0


def test_tables_are_written_unsorted(spark):
    from types import SimpleNamespace

    from plexigrid.sources import volumes

    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []

    class Writer:
        def __getattr__(self, _):
            return lambda *a: self

        def parquet(self, path):
            seen.append(int(spark.conf.get(name)))

    before = spark.conf.get(name)
    volumes.write_lut(SimpleNamespace(sparkSession=spark, write=Writer()), "nowhere")
    assert seen == [volumes.OPEN_TABLES] and spark.conf.get(name) == before
