import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plexigrid.operators import geometry as geo
from plexigrid.operators import graph as G
from plexigrid.operators import metrics as M
from plexigrid.operators import relabel as L
from plexigrid.operators import scores as S
from plexigrid.operators import volume as V
from plexigrid.operators.training import reject, skip_empty
from plexigrid.plans import config
from plexigrid.sources import volumes as src


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return {x: find(x) for x in list(root)}


def random_pairs(seed, n=60, m=70):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    pairs += [(1000 + i, 1001 + i) for i in range(25)] + [(5000, 5001 + i) for i in range(30)]
    return pairs + [(v, u) for u, v in pairs[:10]] + [(7, 7), (None, 3), (3, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_two_phases(spark, seed):
    pairs = random_pairs(seed)
    want = brute_components(pairs)
    e = spark.createDataFrame([(u, v, (u or 0) % 3, 0, 0) for u, v in pairs], "u bigint, v bigint, bz bigint, by bigint, bx bigint")
    assert dict(rows(G.components(e))) == want
    assert dict(rows(G.two_phase_components(e.where("u is not null and v is not null")))) == want


def test_two_phases_of_one_hot_block(spark):
    pairs = [(i, i + 1) for i in range(0, 300, 2)] + [(i, i + 2) for i in range(0, 298, 2)] + [(None, 5), (5, None), (9, 9)]
    e = spark.createDataFrame([(u, v, 0, 0, 0) for u, v in pairs], "u bigint, v bigint, bz bigint, by bigint, bx bigint").repartition(3)
    assert dict(rows(G.two_phase_components(e))) == brute_components(pairs)
    assert rows(G.two_phase_components(e.limit(0))) == []


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([(1, 1), (None, 2)], "u bigint, v bigint")).count() == 0


def test_threshold_sweep_is_monotone_and_inclusive(spark):
    e = spark.createDataFrame([(1, 2, 0.2), (2, 3, 0.3), (3, 4, 0.3000001), (5, 6, 0.1), (6, 1, 0.9), (8, 9, float("nan"))], "u bigint, v bigint, merge_score double")
    got = {}
    for r in G.threshold_sweep(e, [0.3, 0.2, 0.95]).collect():
        got.setdefault(r.threshold, {})[r.key] = r.value
    assert got == {0.2: {1: 1, 2: 1, 5: 5, 6: 5}, 0.3: {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}, 0.95: {k: 1 for k in (1, 2, 3, 4, 5, 6)}}


def test_lookup_tables(spark):
    lut = spark.createDataFrame([(5, 50), (1, 1), (2, 1)], "key bigint, value bigint")
    df = spark.createDataFrame([(5, "a"), (6, "b"), (None, "c"), (2, "d")], "id bigint, key string")
    assert sorted(map(str, L.remap(df, lut, "id").collect())) == sorted(map(str, spark.createDataFrame([(50, "a"), (6, "b"), (None, "c"), (1, "d")], df.schema).collect()))
    assert rows(L.without_self(lut)) == [(2, 1), (5, 50)]
    second = spark.createDataFrame([(50, 7), (99, 98)], "key bigint, value bigint")
    assert dict(rows(L.compose(lut, second))) == {5: 7, 1: 1, 2: 1, 50: 7, 99: 98}
    ends = spark.createDataFrame([(5, 2), (6, 6)], "u bigint, v bigint")
    assert rows(L.remap_ends(ends, lut)) == [(6, 6), (50, 1)]


def paths(spark, data):
    return spark.createDataFrame(data, "node bigint, skeleton_id bigint, seg_label bigint, z double, y double, x double")


def test_run_length_and_splits(spark):
    one = paths(spark, [(i, 1, g, 10.0 * i, 0.0, 0.0) for i, g in enumerate([101, 101, 102, 102])])
    e = M.path_edges(one)
    r = M.expected_run_length(e, one).first()
    assert (round(r.erl, 3), r.avg_length, round(r.erl_norm, 4)) == (6.667, 30.0, 0.2222)
    assert M.split_edges(e).count() == 1
    both = paths(spark, [(i, s, g + (0 if g == 101 else s), 10.0 * i, 0.0, 0.0) for s in (1, 2) for i, g in ((s * 10 + k, g) for k, g in enumerate([101, 101, 102, 102]))])
    r = M.expected_run_length(M.path_edges(both), both).first()
    assert round(r.erl, 3) == 3.333
    assert rows(M.merge_counts(both)) == [(101, 2, 1)]
    three = paths(spark, [(i, i, 9, float(i), 0.0, 0.0) for i in range(3)])
    assert rows(M.merge_counts(three)) == [(9, 3, 3)]
    assert rows(M.merge_sites(three, 1.5)) == [(9, 0, 1, 0, 1, 1.0), (9, 1, 2, 1, 2, 1.0)]
    assert M.expected_run_length(M.path_edges(one.limit(0)), one.limit(0)).first().erl is None


@pytest.mark.parametrize("leaf", [2, 256])
def test_merge_sites_at_any_distance(spark, leaf):
    rnd = random.Random(3)
    data = [(i, rnd.choice([1, 2, 3, 4, None]), rnd.choice([7, 7, 7, 8, 0, None]), *(float(rnd.randrange(-900, 900)) for _ in range(3))) for i in range(240)]
    data += [(1000 + i, 5 + i % 2, 9, 5.0 * (i // 2), 0.0, 30.0 * (i % 2)) for i in range(40)]  # ties all along
    data += [(2000 + i, 7 + i % 2, 10, 1.0, 2.0, 3.0) for i in range(20)] + [(3000, 1, 11, 0.0, 0.0, 0.0), (3001, 2, 11, 9e5, 0.0, -9e5), (3002, 3, 11, None, 0.0, 0.0)]
    want = {}
    for u, s1, g, *a in data:
        for v, s2, h, *b in data:
            if g and g == h and s1 and s2 and s1 < s2 and None not in a + b:
                d = sum((p - q) ** 2 for p, q in zip(a, b)) ** 0.5
                want[g, s1, s2] = min(want.get((g, s1, s2), (d, u, v)), (d, u, v))
    got = rows(M.all_merge_sites(paths(spark, data), 10.0, leaf))
    assert [r[:5] for r in got] == sorted((*k, u, v) for k, (_, u, v) in want.items())
    assert [r[5] for r in got] == pytest.approx([want[r[:3]][0] for r in got])
    assert M.all_merge_sites(paths(spark, data).limit(0), 10.0).count() == 0


def test_merge_sites_of_parts_and_pieces(spark, monkeypatch):
    rnd = random.Random(5)
    data = [(i, rnd.choice([1, 1, 1, 1, 2, 2, 3, 4, 5]), rnd.choice([7, 7, 8]), *(float(rnd.randrange(-6, 6)) for _ in range(3))) for i in range(160)]  # many ties
    data += [(1000 + i, i % 3, 9, 0.1 * i, 1e7 / 3 + i % 2, -0.7 * i) for i in range(30)] + [(2000, 1, 10, float("nan"), 0.0, 0.0), (2001, 2, 10, 1.0, 0.0, 0.0), (2002, 1, 10, 4.0, 0.0, 0.0)]
    want = {}
    for u, s1, g, *a in data:
        for v, s2, h, *b in data:
            if g == h and s1 < s2 and a == a and b == b and not any(x != x for x in a + b):
                d = [p - q for p, q in zip(a, b)]
                d = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) ** 0.5
                want[g, s1, s2] = min(want.get((g, s1, s2), (d, u, v)), (d, u, v))
    want = sorted((*k, u, v, d) for k, (d, u, v) in want.items())
    n = paths(spark, data).repartition(3)
    monkeypatch.setattr(M, "MATRIX", 64)
    assert rows(M.all_merge_sites(n, 10.0, part=20)) == want  # parts, and skeletons longer than one
    tagged = M.all_merge_sites(n.withColumn("tag", F.col("skeleton_id") * 10), 10.0, part=20, carried=True)
    place = {r[0]: tuple(r[3:]) for r in data}
    assert sorted(tuple(r) for r in tagged.collect()) == [(*w, *place[w[3]], *place[w[4]], w[1] * 10) for w in want]
    batches = [pd.DataFrame([(7, 0, 0, 0, 1, s, k, float(k), 0.0, 0.0)], columns=["seg_label", "i", "j", "side", "whole", "s", "node", "z", "y", "x"]) for k, s in enumerate([1, 1, 2])]
    assert [tuple(r) for b in M._sites(iter(batches)) for r in b.itertuples(index=False)] == [(7, 1, 2, 1, 2, 1.0)]


def _skeletons(rnd, sizes, first, grid):
    """s, node, place as all_merge_sites() sorts them."""
    s = np.repeat(list(sizes), list(sizes.values()))
    node = rnd.permutation(len(s)) + first
    order = np.lexsort((node, s))
    return s[order], node[order], rnd.integers(0, grid, (len(s), 3)) * 1.1


@pytest.mark.parametrize("long, leaf, matrix", [(1, 1, 50), (5, 2, 300), (20, 4, 1 << 20), (1 << 20, 16, 1000)])
def test_long_skeletons_against_brute_force(monkeypatch, long, leaf, matrix):
    for name, value in (("LONG", long), ("LEAF", leaf), ("MATRIX", matrix)):
        monkeypatch.setattr(M, name, value)
    rnd = np.random.default_rng(4)
    for grid in (1, 3, 1000):  # all in one place, many ties, hardly any
        a, b = _skeletons(rnd, {1: 3, 4: 40, 5: 22, 6: 1, 9: 6}, 0, grid), _skeletons(rnd, {2: 25, 3: 2, 4: 9, 7: 8}, 1000, grid)
        for other in (None, b):
            want, got = {}, {}
            for s, n, p in zip(*a):
                for t, m, q in zip(*(a if other is None else other)):
                    d = p - q
                    row = (np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), *((n, m) if s < t else (m, n)))
                    if s != t:
                        want[min(s, t), max(s, t)] = min(want.get((min(s, t), max(s, t)), row), row)
            for rows_of in M._pairs(a, other):
                for s, t, u, v, d in zip(*rows_of):
                    assert other is not None or (s, t) not in got
                    got[s, t] = min(got.get((s, t), (d, u, v)), (d, u, v))
            assert got == want


def test_long_skeletons_need_no_matrix_of_all_distances(monkeypatch):
    rnd = np.random.default_rng(6)
    a = _skeletons(rnd, {1: 4000, 2: 3000} | dict.fromkeys(range(3, 300), 3), 0, 10_000)
    compared = {}
    for name, numbers in (("_products", lambda p, q: len(p) * len(q)), ("_squares", lambda d: d.size // 3)):
        if hasattr(M, name):
            of = getattr(M, name)
            monkeypatch.setattr(M, name, lambda *x, of=of, name=name, numbers=numbers: compared.update({name: compared.get(name, 0) + numbers(*x)}) or of(*x))
    assert sum(len(r[0]) for r in M._pairs(a, None)) == 299 * 298 // 2
    assert sum(compared.values()) < 6_000_000, compared  # all pairs of nodes are 31 million


def test_long_skeletons_carry_places_and_tags_without_a_matrix(monkeypatch):
    s, node, place = _skeletons(np.random.default_rng(8), {1: 2100, 2: 2200}, 0, 10_000)
    monkeypatch.setattr(M, "_products", lambda p, q: pytest.fail(f"{len(p)} x {len(q)} distances"))
    group = pd.DataFrame({"seg_label": 7, "i": 0, "j": 0, "side": 0, "whole": 1, "s": s, "node": node, "z": place[:, 0], "y": place[:, 1], "x": place[:, 2], "tag": s * 10})
    (row,) = [tuple(r) for b in M._sites(iter([group]), carried=True) for r in b.itertuples(index=False)]
    d = np.sqrt(((place[s == 1][:, None] - place[s == 2][None]) ** 2).sum(2))
    u, v = np.unravel_index(d.argmin(), d.shape)
    assert row[:5] == (7, 1, 2, node[s == 1][u], node[s == 2][v]) and row[5] == pytest.approx(d.min())
    assert row[6:] == (*place[s == 1][u], *place[s == 2][v], 10)


def test_histogram_has_zero_bin(spark):
    sk = spark.createDataFrame([(1,), (2,), (3,), (3,)], "skeleton_id bigint")
    sp = spark.createDataFrame([(2,), (2,), (3,), (3,)], "skeleton_id bigint")
    assert rows(M.split_histogram(sk, sp)) == [(0, 1), (2, 2)]


@pytest.mark.parametrize("pairs, want", [([(1, 1), (1, 1), (2, 2), (2, 2)], (1, 1, 0, 0)), ([(1, 1), (1, 2)], (0.5, 1, 1, 0)), ([(1, 1), (2, 1)], (1, 0.5, 0, 1))])
def test_rand_voi(spark, pairs, want):
    df = spark.createDataFrame([*pairs, (None, 1), (1, None), (0, 1)], "t bigint, g bigint").withColumn("n", F.lit("clash"))
    assert [round(x, 9) for x in M.rand_voi(M.contingency(df, "t", "g")).first()] == list(want)


def test_blend_golden():
    voi = 1 - (0.09069016147388803 + 0.009372640868915904) / 2
    rand = (0.7121796364338487 + 0.9542967590725423) / 2
    assert abs(voi - 0.9499685988285981) < 1e-12 and abs(rand - 0.8332381977531955) < 1e-12
    assert abs((rand + 0.6666742989110856) / 2 - 0.7499562483321406) < 1e-12


def test_fresh_labels(spark):
    n = paths(spark, [(1, 1, 0, 5.0, 5.0, 5.0), (2, 1, 0, 6.0, 6.0, 6.0), (3, 1, 0, 90.0, 5.0, 5.0), (4, 1, 7, 1.0, 1.0, 1.0)])
    assert rows(M.fresh_labels(n, 33.0)) == [(1, 8), (2, 8), (3, 9), (4, 7)]


def test_roi_and_tiles(spark):
    a, b = geo.Roi((0, 0, 0), (10, 10, 10)), geo.Roi((5, -5, 20), (10, 10, 10))
    assert a.intersect(b).empty and a.contains(geo.Roi((1, 1, 1), (9, 9, 9)))
    assert geo.Roi((-1, 2, 3), (5, 5, 5)).snap((4, 4, 4)) == geo.Roi((-4, 0, 0), (8, 8, 8))
    df = spark.createDataFrame([(-3, 4)], "b bigint, e bigint")
    args = ({c: F.col("b") for c in "zyx"}, {c: F.col("e") for c in "zyx"}, F.lit(4))
    assert sorted({(r.x0, r.x1) for r in geo.tile(df, *args).collect()}) == [(-3, 1), (1, 4)]
    assert sorted({(r.x0, r.x1) for r in geo.tile(df, *args, fit="overhang").collect()}) == [(-3, 1), (1, 5)]
    assert sorted({(r.x0, r.x1) for r in geo.tile(df, *args, fit="valid").collect()}) == [(-3, 1)]
    assert geo.tile(spark.createDataFrame([(None, 4), (4, 4)], "b bigint, e bigint"), *args).count() == 0
    grid = spark.createDataFrame([(z, y, x) for z in (0, 1) for y in (0, 1) for x in (0, 1)], "bz bigint, by bigint, bx bigint")
    assert geo.face_neighbours(grid).where("bz = 0 and by = 0 and bx = 0").count() == 3
    assert [r[0] for r in spark.createDataFrame([(-7,), (7,), (6,)], "a bigint").select(geo.floor_div(F.col("a"), F.lit(3))).collect()] == [-3, 2, 2]


def test_halo_is_the_range_join(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.choice([0.0, 4.0, -2.0, 6.0])) for i in range(40)] + [(99, None, 0.0, 0.0)]
    got = {(r.id, r.bz, r.by, r.bx) for r in geo.halo_blocks(spark.createDataFrame(pts, "id bigint, z double, y double, x double"), 4, 2, ("z", "y", "x")).collect()}
    near = lambda c: [b for b in range(-6, 6) if b * 4 - 2 <= c < b * 4 + 6]
    assert got == {(i, a, b, c) for i, z, y, x in pts[:-1] for a in near(z) for b in near(y) for c in near(x)}


def cube(spark, values, side=3):
    return spark.createDataFrame([(1, i // side**2, i // side % side, i % side, float(v)) for i, v in enumerate(values)], "block bigint, z bigint, y bigint, x bigint, value double")


def test_volume_operators(spark):
    line = spark.createDataFrame([(1, i, 0, 0, float(i)) for i in range(7)], "block bigint, z bigint, y bigint, x bigint, value double")
    assert [r[1] for r in rows(V.downsample(line, 3))] == [0, 1, 2]
    assert {r.z: r.value for r in V.replace_sections(line, {1: 0, 2: 1, 3: 77}).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}
    assert V.pad(line.limit(1), 1, 1).count() == 27
    lab = cube(spark, [1] * 13 + [0] + [2] * 13).withColumn("label", F.col("value").cast("bigint"))
    assert V.dilate_sections(lab).where("label = 0").count() == 0
    assert V.grow_boundary(lab).where("label = 0").count() > 1
    assert V.affinities(lab, [1]).count() == 54
    assert V.pack_blocks(lab.select("block", "z", "y", "x", "value")).first()["values"] == [1.0] * 13 + [0.0] + [2.0] * 13
    assert V.balance_weights(lab).agg(F.sum(F.col("n") * F.col("weight"))).first()[0] == pytest.approx(27)
    blocks = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, None])], "b bigint, v array<double>")
    assert rows(skip_empty(blocks, "b", "v", F.array_max("v") * 10)) == [(1, 0.0), (2, 10.0)]


def test_watershed_climbs_to_maxima(spark):
    v = cube(spark, [5, 1, 6] + [0] * 24)
    got = {(r.z, r.y, r.x): r.label for r in G.watershed(v, 3, 0.5).collect()}
    assert got[0, 0, 1] == got[0, 0, 2] != got[0, 0, 0] and got[2, 2, 2] == 0


def test_hierarchical_agglomeration_updates_scores(spark):
    a = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 3, 0.8), (1, 1, 3, 0.0), (1, 1, 3, 0.0)], "block bigint, u bigint, v bigint, affinity double")
    assert [tuple(round(x, 3) for x in r) for r in rows(G.agglomerate_blocks(a, 0.5))] == [(1, 1, 2, 0.1)]
    assert G.agglomerate_blocks(a, 0.8).count() == 2
    assert dict(rows(G.agglomerate(a, 0.5))) == {1: 1, 2: 1, 3: 1}  # single linkage keeps the fixed scores


def test_quantile_scores(spark):
    a = spark.createDataFrame([(1, 2, v / 255) for v in (0, 10, 20, 30, 255)] + [(1, 2, None)], "u bigint, v bigint, affinity double")
    assert G.quantile_scores(a, 50).first().merge_score == pytest.approx(1 - 20 / 255)
    assert G.quantile_scores(a, 50, init_max=True).first().merge_score == 0.0
    assert len(G.MERGE_FUNCTIONS) == 17


def test_all_quantiles_are_the_single_ones(spark):
    rnd = random.Random(3)
    data = [(u, u + 1, rnd.choice([0.0, 0.25, 0.5, 1.0, 1.5, rnd.random()])) for u in range(4) for _ in range(60)] + [(1, 2, None), (1, 2, float("nan"))]
    a = spark.createDataFrame(data, "u bigint, v bigint, affinity double")
    want = set()
    for q in G.QUANTILES:
        for u in range(4):
            bins = sorted(min(max(int(x * 255), 0), 255) for w, _, x in data if w == u and x is not None and x == x)
            want.add((q, u, u + 1, round(1 - bins[max(0, -(-len(bins) * q // 100) - 1)] / 255, 9)))
    got = [(r.q, r.u, r.v, round(r.merge_score, 9)) for r in G.all_quantile_scores(a, G.QUANTILES).collect()]
    assert len(got) == len(want) and set(got) == want
    assert rows(G.all_quantile_scores(a, [])) == [] and rows(G.all_quantile_scores(a.limit(0), [50])) == []


def test_paths_across_ranges_of_nodes(spark):
    ids = [1, 2, M.RANGE - 1, M.RANGE, M.RANGE + 5, 9 * M.RANGE]
    n = spark.createDataFrame([(i, s, 1, float(k), 0.0, 0.0) for s in (7, 8) for k, i in enumerate(x + s - 7 for x in ids)], "node bigint, skeleton_id bigint, seg_label bigint, z double, y double, x double")
    got = rows(M.path_edges(n).select("skeleton_id", "u", "v", "length"))
    assert got == sorted((s, a + s - 7, b + s - 7, 1.0) for s in (7, 8) for a, b in zip(ids, ids[1:]))


def test_scores_and_reports(spark):
    r = spark.createDataFrame([(1, "a", 1, 0.1, 3.0), (2, "a", 1, 0.2, 5.0), (3, "a", 2, 0.1, 4.0), (4, "b", 9, 0.1, None)], "score_id bigint, network string, checkpoint int, threshold double, m double")
    assert rows(S.top_entries(r, "m", 2, "score_id")) == [("a", 1, 0.2), ("a", 2, 0.1)]
    assert rows(S.select_scores(r, "a", [2, 9], None).select("score_id")) == [(3,)]
    lines = S.csv_report(spark.createDataFrame([("n", 10, 0.5, 1.0), ("n", 9, 0.5, 1.0)], "network string, checkpoint int, threshold double, m double"), spark.createDataFrame([("n", 10, 0.5), ("n", 9, 0.5)], "network string, checkpoint int, threshold double"), ["m"], 1)
    assert [x[1] for x in sorted((p, t) for t, p in rows(lines))] == ["n,10,0.500,1.0", "n,9,0.500,1.0"]
    assert S.score_rows(spark, [("a", 1, 0.5, {"m": 1})]).count() == 1
    with pytest.raises(TypeError):
        S.score_rows(spark, [("a", "1", 0.5, {})])


def test_reject(spark):
    b = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, 0)], "k bigint, m int")
    assert rows(reject(b, ["k"], F.col("m"), 0.5)) == [(1, 1.0)]
    assert rows(reject(b, ["k"], F.col("m"), 0.4, inverse=True).select("k")) == [(2,), (3,)]
    assert reject(b, ["k"], F.col("m"), 0.5, probability=0.0).count() == 3


def test_stored_volumes(spark, tmp_path):
    v = cube(spark, range(27))
    src.write_volume(v, f"{tmp_path}/a.parquet", "raw")
    assert src.open_volume(spark, f"{tmp_path}/a.parquet", "raw[1,,2]").count() == 3
    with pytest.raises(ValueError):
        src.format_of("a.tif")
    lut = spark.createDataFrame([("local", 0.1, 1, 2), ("local", 0.2, 1, 3)], "stage string, threshold double, key bigint, value bigint")
    src.write_lut(lut, f"{tmp_path}/lut")
    src.write_lut(lut.where("threshold = 0.2").withColumn("value", F.lit(9).cast("bigint")), f"{tmp_path}/lut")
    assert src.read_lut(spark, f"{tmp_path}/lut", "local", 0.1).select("value").first()[0] == 2
    assert src.read_lut(spark, f"{tmp_path}/lut", "local", 0.2).select("value").first()[0] == 9


def test_config():
    from dataclasses import dataclass

    @dataclass
    class Task:
        size: int
        name: str = "x"

    base = config.loads('{"T": {"size": 4, "url": "a//b"} /* c */ } // end')
    assert base == {"T": {"size": 4, "url": "a//b"}}
    both = config.override(config.merge(base, {"T": {"size": 5}, "U": {}}), "T.size=6", "U.rate=0.5", "U.kind=abc")
    assert both == {"T": {"size": 6, "url": "a//b"}, "U": {"rate": 0.5, "kind": "abc"}} and base["T"]["size"] == 4
    with pytest.raises(ValueError):
        config.override(base, "size=3")
    assert config.build(Task, {"size": 1}, {"name": "y"}) == Task(1, "y")
    with pytest.raises(KeyError):
        config.build(Task, {"size": 1, "other": 2})
    with pytest.raises(ValueError):
        config.build(Task, {})
    assert config.fingerprint({"a": 1, "b": 2}, ("b",)) == config.fingerprint({"b": 3, "a": 1}, ("b",))
