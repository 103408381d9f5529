import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plexigrid.functions.jsontext import finite_number, strict_object
from plexigrid.operators.hotkeys import select_mode, select_quantiles
from plexigrid.operators.skew import hot_keys, skew_join
from plexigrid.streaming.compact import compact, completion_records

KEY = ["task", "block_id", "start_ms"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_strict_json(spark):
    good = ['{"m":1.5}', ' {"m":1,"b":NaN} ', '{"a":{"m":3},"m":"4"}', '{"m":1,"m":2}', '{"m":null}', '{"x":1}']
    bad = ['{"m":1.5', '{"m":1} x', '{"m":1}{"m":2}', '{"m":1},{"m":2}', "{'m':1}", "[1]", "null", "", None, '{"m":1,}', '{"m":1}]', '{"']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(good + bad)], "i int, s string").select("i", strict_object(F.col("s"), "m string").alias("j"))
    got = {r.i: r.j for r in df.collect()}
    assert [got[i].m for i in range(len(good))] == ["1.5", "1", "4", "2", None, None]
    assert all(got[i] is None for i in range(len(good), len(good + bad)))


def test_finite_number(spark):
    cases = {"1.5": 1.5, " 2 ": 2.0, "-1e-3": -0.001, "NaN": None, '"NaN"': None, "1d": None, "Infinity": None, "1e999": None, "": None, None: None, "true": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", finite_number(F.col("s")).alias("x"))
    assert {r.s: r.x for r in df.collect()} == cases


def record(block, start, **more):
    return json.dumps({"block_id": block, "start": start, "duration": 1.0, **more})


def files(spark, bodies):
    return spark.createDataFrame([(i, "t", b, "clash") for i, b in enumerate(bodies)], "file_id bigint, task string, body string, record string")


def test_records_of_files(spark):
    bodies = [record("1_2_3", 5.0004) + "\r\n\n  " + record([1, 2, 3], 5.0), record("4", 1)[:-3], "", None, "null\n[1]\n7", record("4", 1) + "\n" + record("4", 1)]
    got = rows(completion_records(files(spark, bodies)).select(KEY))
    assert got == [("t", "1_2_3", 5000), ("t", "1_2_3", 5000), ("t", "4", 1000), ("t", "4", 1000)]


def test_compaction_takes_each_file_once_and_each_record_once(spark, tmp_path):
    source, target, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda **kw: compact(spark, source, target, check, completion_records, KEY, "record", **kw)
    files(spark, [record("a", 1), record("b", 2) + "\n" + record("a", 1)]).coalesce(1).write.parquet(source)
    assert rows(run().select("block_id")) == [("a",), ("b",)]
    assert rows(run().select("block_id")) == [("a",), ("b",)]
    files(spark, [record("b", 2), record("c", 3, host="h")]).coalesce(1).write.mode("append").parquet(source)
    out = run()
    assert rows(out.select("block_id", "batch")) == [("a", 0), ("b", 0), ("c", 1)]
    assert "host" in out.where("block_id = 'c'").first()["record"]


def test_a_batch_that_failed_is_replaced(spark, tmp_path):
    source, target, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    files(spark, [record("a", 1), record("b", 2)]).write.parquet(source)
    # what a lost run of the same batch left behind
    spark.createDataFrame([("t", "a", 1000, "torn")], "task string, block_id string, start_ms bigint, record string").write.parquet(f"{target}/batch=0")
    out = compact(spark, source, target, check, completion_records, KEY, "record")
    assert rows(out.select("block_id")) == [("a",), ("b",)]
    assert not out.where("record = 'torn'").count()


def test_files_are_few_and_of_the_size_asked_for(spark, tmp_path):
    from uuid import uuid4

    files(spark, [record(str(uuid4()), i, note="".join(str(uuid4()) for _ in range(60))) for i in range(3000)]).repartition(6).write.parquet(str(tmp_path / "in"))
    sizes = {}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    for size in (2**28, 300_000):
        compact(spark, str(tmp_path / "in"), str(tmp_path / f"out{size}"), str(tmp_path / f"ck{size}"), completion_records, KEY, "record", file_bytes=size)
        sizes[size] = [p.stat().st_size for p in (tmp_path / f"out{size}").rglob("*.parquet")]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes[2**28]) == 1 and 1 < len(sizes[300_000]) < 24  # Spark joins what is under a megabyte in any case


def test_compaction_in_many_batches_and_of_nothing(spark, tmp_path):
    bodies = [record(str(i % 30), i % 30) for i in range(90)]
    files(spark, bodies).repartition(6).write.parquet(str(tmp_path / "in"))
    out = compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), completion_records, KEY, "record", batch_bytes=1)
    assert out.count() == 30 and out.select("batch").distinct().count() > 1
    files(spark, []).write.parquet(str(tmp_path / "none"))
    none = compact(spark, str(tmp_path / "none"), str(tmp_path / "out2"), str(tmp_path / "ck2"), completion_records, KEY, "record")
    assert none.count() == 0 and none.columns == [*KEY, "record", "batch"]


def test_mode_against_brute_force(spark):
    rnd = random.Random(1)
    data = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([rnd.randrange(10), rnd.randrange(10**12), -5, None]), rnd.randrange(400)) for _ in range(3000)]
    df = spark.createDataFrame(data + data[:50], "seg bigint, sk bigint, node bigint").withColumn("_k", F.lit("clash"))
    units = defaultdict(set)
    for k, v, u in data:
        if k is not None and v is not None:
            units[k, v].add(u)
    want = {}
    for (k, v), u in units.items():
        want[k] = max(want.get(k, (0, 0)), (len(u), -v))
    got = {r.seg: (r.n_units, -r.sk) for r in select_mode(df, "seg", "sk", "node").collect()}
    assert got == want


def test_mode_of_nothing_and_ties(spark):
    empty = spark.createDataFrame([], "seg bigint, sk bigint, node bigint")
    assert select_mode(empty, "seg", "sk", "node").count() == 0
    tie = spark.createDataFrame([(1, 9, 1), (1, 4, 2), (1, 4, 2)], "seg bigint, sk bigint, node bigint")
    assert rows(select_mode(tie, "seg", "sk", "node")) == [(1, 4, 1)]


@pytest.mark.parametrize("spread", [50, 10**7])
def test_quantiles_against_brute_force(spark, spread):
    rnd = random.Random(spread)
    data = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice([rnd.uniform(-spread, spread), None, float("nan"), 1.25])) for _ in range(1500)]
    df = spark.createDataFrame(data, "k string, v double")
    by = defaultdict(list)
    for k, v in data:
        if k is not None and v is not None and v == v:
            by[k].append(v)
    want = {}
    for k, vs in by.items():
        vs.sort()
        for p in (0.0, 0.1, 0.5, 1.0):
            want[k, p] = vs[max(1, -(-int(p * len(vs) * 1000) // 1000)) - 1]
    got = {(r.k, r.probability): r.quantile for r in select_quantiles(df, "k", "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    assert got == want
    assert select_quantiles(df.limit(0), "k", "v", [0.5]).count() == 0


def test_skew_join_with_hot_keys(spark):
    big = spark.createDataFrame([("h" if i % 3 else str(i), i) for i in range(300)] + [(None, -1)], "k string, i int")
    small = spark.createDataFrame([("h", "hot"), ("3", "three"), ("x", "none")], "k string, s string")
    hot = hot_keys(big, "k", rows=10)
    assert hot == ["h"]
    for how in ("inner", "left", "left_semi"):
        assert sorted(map(str, skew_join(big, small, "k", how, hot).collect())) == sorted(map(str, big.join(small, "k", how).collect()))




def test_tables_that_cut_lineage(spark):
    import os

    from plexigrid.session import cut, discard, discard_all, shared_dir

    a, b = cut(spark.range(3).toDF("x"), "t"), cut(spark.range(0).toDF("x"), "t")
    assert a.count() == 3 and b.count() == 0 and b.columns == ["x"]
    folder = a.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert folder.startswith(shared_dir(spark).removeprefix("file:"))
    discard(a)
    assert not os.path.exists(folder)
    discard_all(spark)


def test_extreme_values(spark):
    edge = 2**63
    mode = spark.createDataFrame([(1, v, u) for v, us in ((-edge, 2), (edge - 1, 2), (0, 1), (7, 1)) for u in range(us)], "k bigint, v bigint, u bigint")
    assert rows(select_mode(mode, "k", "v", "u")) == [(1, -edge, 2)]
    inf = float("inf")
    values = [-inf, -1.7e308, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0000000000000002, 1.7e308, inf, inf]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", inf), ("c", float("nan")), ("d", None), (None, 1.0)], "k string, v double")
    ps = [(i + 1) / len(values) for i in range(len(values))]
    got = {(r.k, r.probability): r.quantile for r in select_quantiles(df, "k", "v", ps).collect()}
    assert [got["a", p] for p in ps] == sorted(values) and {got["b", p] for p in ps} == {inf} and {k for k, _ in got} == {"a", "b"}
    whole = spark.createDataFrame([(1, i) for i in range(100)], "k int, v int")
    assert rows(select_quantiles(whole, "k", "v", [0.5])) == [(1, 0.5, 49.0)]


def test_selection_in_many_rounds(spark, monkeypatch):
    from plexigrid.operators import hotkeys

    monkeypatch.setattr(hotkeys, "BITS", 2)
    rnd = random.Random(2)
    data = [(rnd.choice([1, 1, 2]), rnd.choice([rnd.randrange(300), 17, 5 * 10**9, -4]), rnd.randrange(60)) for _ in range(600)]
    units, values = defaultdict(set), defaultdict(list)
    for k, v, u in data:
        units[k, v].add(u)
        values[k].append(v)
    df = spark.createDataFrame(data, "k int, v bigint, u int")
    best = {}
    for (k, v), u in units.items():
        best[k] = max(best.get(k, (0, 0)), (len(u), -v))
    assert rows(select_mode(df, "k", "v", "u")) == [(k, -v, n) for k, (n, v) in sorted(best.items())]
    assert rows(select_quantiles(df, "k", "v", [0.25, 0.5])) == [(k, p, float(sorted(vs)[max(1, -(-len(vs) * i // 4)) - 1])) for k, vs in sorted(values.items()) for i, p in ((1, 0.25), (2, 0.5))]
