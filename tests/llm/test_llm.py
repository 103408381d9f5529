import base64
import math
import quopri
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexigrid.llm.components import linked_groups
from plexigrid.llm.leaks import Items, Signs, find_leaks, fingerprints
from plexigrid.llm.mail import leaves, readable, words
from plexigrid.llm.mixing import PATTERN, TOKENIZER, _encoding, mix_sources
from plexigrid.llm.queries import accepted_pairs
from plexigrid.llm.splitting import split_boxes, split_interval
from plexigrid.llm.topn import top_n
from plexigrid.llm.truncated import cut_copies, ending, find_truncated, truncation_rates


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 2: groups


def brute_groups(pairs):
    near = defaultdict(set)
    for u, v in pairs:
        if u is not None and v is not None and u != v:
            near[u].add(v)
            near[v].add(u)
    seen, out = {}, {}
    for x in sorted(near):
        if x not in seen:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in seen:
                    seen[y] = x
                    todo += near[y]
    out.update(seen)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(70)]
    chain = list(range(1000, 1040))
    rnd.shuffle(chain)
    pairs += list(zip(chain, chain[1:]))  # a long chain in any order
    pairs += [(500, 600 + i) for i in range(60)] + [(v, u) for u, v in pairs[:20]] + [(1, 1), (None, 2), (3, None)]
    df = spark.createDataFrame(pairs, "u bigint, v bigint").withColumn("id", F.lit(7)).withColumn("group_id", F.lit(8))
    assert dict(rows(linked_groups(df))) == brute_groups(pairs)


def test_groups_of_nothing(spark):
    assert linked_groups(spark.createDataFrame([(None, 1), (2, 2)], "u bigint, v bigint")).count() == 0
    assert linked_groups(spark.createDataFrame([], "u bigint, v bigint")).columns == ["id", "group_id"]


def test_accepted_pairs(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.9), (2, 3, 0.51), (3, 4, None), (4, 5, float("nan")), (5, 9, 0.1), (None, 1, 0.1), (6, 6, 0.0)], "u bigint, v bigint, merge_score double")
    n = spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, 5, 6, None)], "id bigint")
    assert rows(accepted_pairs(e, n)) == [(1, 2)]


# 3: splitting


def greedy(b, e, limit, line):
    out = []
    while e - b > limit:
        c = (b + limit) // line * line if line and line > 0 else b
        c = c if c > b else b + limit
        out.append((b, c))
        b = c
    return [*out, (b, e)]


def test_bisection_makes_the_pieces_of_the_rule(spark):
    rnd = random.Random(4)
    cases = [(b, b + rnd.randrange(1, 4000), rnd.choice([7, 64, 90, 100, 350]), rnd.choice([1, 10, 64, 100, 333, None, 0])) for b in (rnd.randrange(-2000, 2000) for _ in range(800))]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, b bigint, e bigint, m bigint, c bigint")
    got = df.select("i", split_interval(F.col("b"), F.col("e"), F.col("m"), F.col("c")).alias("p")).collect()
    for r in got:
        assert [(x.b, x.e) for x in r.p] == greedy(*cases[r.i]), cases[r.i]


def test_boxes(spark):
    df = spark.createDataFrame([(1, 0, 10, -1, 12), (2, 0, 4, 0, 4), (3, None, 9, 0, 9), (4, 5, 5, 0, 9)], "k int, b bigint, e bigint, rb bigint, re bigint").withColumn("limit", F.lit("clash"))
    axis = (F.col("b"), F.col("e"), F.col("rb"), F.col("re"))
    out = split_boxes(df, [axis], F.lit(4), F.lit(3), F.lit(2), ["x"])
    assert rows(out.select("k", "wx0", "wx1", "rx0", "rx1")) == [(1, 0, 3, -1, 5), (1, 3, 6, 1, 8), (1, 6, 10, 4, 12)]


# 4: top n


@pytest.mark.parametrize("salts", [1, 7])
def test_top_n_against_brute_force(spark, salts):
    rnd = random.Random(5)
    data = [(rnd.choice(["hot", "hot", "a", None]), rnd.randrange(4) / 2, rnd.choice([None, 0.1, 0.2]), i) for i in range(300)]
    df = spark.createDataFrame(data + data[:40], "g string, m double, t double, i bigint")
    by = defaultdict(list)
    for g, m, t, i in data:
        by[g].append(((-m, t is None, t or 0, i), i))
    want = {(g, k + 1, i) for g, v in by.items() for k, (_, i) in enumerate(sorted(v)[:3])}
    got = top_n(df, ["g"], [F.desc("m"), F.col("t").asc_nulls_last()], "i", 3, salts)
    assert {(r.g, r.place, r.i) for r in got.collect()} == want
    assert top_n(df.limit(0), ["g"], [F.desc("m")], "i", 3).count() == 0


# 6: leaks

PASSAGE = "During the long eclipse the ash potters of Côte Merlune weighed 948 glass mirrors because the granary roof leaked badly that night"
FILL = "We counted the yearly invoice and sent it back to the office with the other papers of the month."


def mail(body, kind="text/plain", encoding="", extra=""):
    head = f"From: Ann Bee <a@b.example>\nContent-Type: {kind}; charset=utf-8\n"
    return head + (f"Content-Transfer-Encoding: {encoding}\n" if encoding else "") + extra + "\n" + body


def shapes():
    part = " ".join(PASSAGE.split()[2:16])
    text = f"{FILL} {part}. {FILL}"
    lines = "\n".join(f"> > {' '.join(text.split()[i : i + 6])}" for i in range(0, len(text.split()), 6))
    html = f"<html><body><p>{FILL}<br>{part.replace('ô', '&ocirc;').replace('glass', '<b>gl</b>ass').replace(' ', '&nbsp;')}</p></body></html>"
    multi = f'From: x\nContent-Type: multipart/mixed; boundary="=_b"\n\n--=_b\nContent-Type: text/plain\n\n{FILL}\n--=_b\nContent-Type: text/plain; name="n.txt"\nContent-Transfer-Encoding: base64\n\n{base64.encodebytes(text.encode()).decode()}--=_b--\n'
    return {
        1: mail(text),
        2: mail(lines),
        3: mail(html, "text/html"),
        4: mail(base64.encodebytes(text.encode()).decode(), encoding="base64").replace("\n", "\r\n"),
        5: mail(quopri.encodestring(text.encode()).decode(), encoding="quoted-printable"),
        6: multi,
        7: mail(text.upper()),
        8: mail(f"{FILL} {' '.join(PASSAGE.split()[2:14])}. {FILL}"),  # twelve words: too few
        9: mail(FILL),
        10: "",
        11: None,
    }


def test_leaks_in_every_shape_of_mail(spark):
    docs = spark.createDataFrame([*shapes().items(), (1, shapes()[1])], "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(100, PASSAGE), (101, "too short"), (102, None), (103, PASSAGE + " again")], "item_id bigint, text string")
    for chunk in (20, 1000):  # one item a pass, or all
        got = find_leaks(docs, items, window=13, radius=1, min_similarity=1.0, chunk_words=chunk)
        assert rows(got.select("doc_id", "item_id")) == [(d, i) for d in range(1, 8) for i in (100, 103)]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_very_long_texts(spark):
    from plexigrid.llm.leaks import BLOCK_WORDS

    filler = [f"w{i % 977}" for i in range(BLOCK_WORDS * 2 + 100)]
    for at in (BLOCK_WORDS - 6, BLOCK_WORDS, 2 * BLOCK_WORDS + 50):  # across and beside the seams of blocks
        text = " ".join([*filler[:at], *words(PASSAGE)[:13], *filler[at:]])
        docs = spark.createDataFrame([(1, mail(text))], "doc_id bigint, text string")
        items = spark.createDataFrame([(5, PASSAGE)], "item_id bigint, text string")
        assert rows(find_leaks(docs, items, window=13, min_similarity=1.0).select("doc_id", "item_id")) == [(1, 5)]
    long = mail("word " * 400_000 + "and then")
    assert ending(long)[1].startswith("tail ") and ending(long + ".") == (None, None)


def test_similar_passages_by_radius(spark):
    changed = PASSAGE.replace("glass", "brass")
    docs = spark.createDataFrame([(1, f"{FILL} {changed}. {FILL}")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, PASSAGE)], "item_id bigint, text string")
    n = len(words(PASSAGE))
    got = find_leaks(docs, items, window=n, radius=15, min_similarity=0.5).collect()
    assert len(got) == 1 and 0.5 <= got[0].similarity < 1
    assert find_leaks(docs, items, window=n, radius=15, min_similarity=0.95).count() == 0


def indexed(items, window, radius, shingle):
    """Items of (id, words) as an index, with the weights by brute force."""
    signs, having = Signs(), {}
    for i, w in items:
        for x in {tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)}:
            having.setdefault(x, set()).add(i)
    packed = []
    for i, w in items:
        at = signs.index(w)
        weights = [1 / len(having[tuple(w[j : j + shingle])]) for j in range(len(w) - shingle + 1)]
        packed.append((i, fingerprints(signs.rows[at], window, shingle), np.arange(len(w) - window + 1), signs.codes[at], np.pad(np.array(weights), (0, len(w) - len(weights)))))
    return Items(packed, window, radius, shingle), having


def prints_of(ws, window, shingle):
    signs = Signs()
    at = signs.index(ws)
    return fingerprints(signs.rows[at], window, shingle)


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_blocks_find_all_within_radius(radius):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, [rnd.choice(vocabulary) for _ in range(20)]) for i in range(12)]
    doc = [w for _, ws in items for w in ws[:9]]
    it, _ = indexed(items, 5, radius, 2)
    prints = prints_of(doc, 5, 2)
    got = set(zip(*map(list, it.candidates(prints))))
    want = {(p, k) for p in range(len(prints)) for k in range(len(it.prints)) if bin(int(prints[p]) ^ int(it.prints[k])).count("1") <= radius}
    assert got == want and want


def similar(a, b, having, shingle=5):
    """By definition: the weights of b's window; what b lacks weighs 1."""
    if a == b:
        return 1.0
    x, y = ({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} for w in (a, b))
    return sum(1 / len(having[g]) for g in x & y) / (sum(1 / len(having[g]) for g in y) + len(x - y))


def passages():
    """Items, texts with passages like them, and by brute force the similarity of each pair above 0.8."""
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, [rnd.choice(vocabulary) for _ in range(rnd.choice([24, 25, 26, 40]))]) for i in range(12)]
    items += [(20, ["ha"] * 30), (21, (["tick", "tock"] * 20)[:33]), (22, items[3][1][:30] + ["end"])]  # few distinct shingles; shared ones
    items = [(i, w) for i, w in items if len(w) >= 25]
    texts = []
    for i, w in items:
        for at in (0, 1, 12, 23, 24, None):  # one word changed, or a passage of 24 equal words at any place
            v = list(w)
            if at is not None and at < len(v):
                v[at] = "changed"
            lead = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))]
            texts.append([*lead, *v, *[rnd.choice(vocabulary) for _ in range(rnd.randrange(30))]])
            texts.append([*lead, *w[rnd.randrange(2) :][:24], "new", *lead])
            texts.append([*lead, *w[1:24], "two", "new", *lead])
    _, having = indexed(items, 25, 0, 5)
    want = {}
    for d, w in enumerate(texts):
        for i, x in items:
            sim = max((similar(w[p : p + 25], x[q : q + 25], having) for p in range(len(w) - 24) for q in range(len(x) - 24)), default=0.0)
            if sim >= 0.8:
                want[d, i] = sim
    return items, texts, want


def test_similar_windows_against_brute_force(spark):
    items, texts, want = passages()
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id bigint, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    first = None
    for chunk in (60, 10**6):  # the result does not depend on the chunks
        got = {(r.doc_id, r.item_id): r.similarity for r in find_leaks(docs, table, window=25, read=lambda t: [t], chunk_words=chunk).collect()}
        assert first is None or got == first
        first = got
    assert got.keys() <= want.keys() and all(got[k] <= want[k] + 1e-9 for k in got)
    near = [k for k, v in want.items() if v < 1]
    assert len(near) > 80 and sum(k in got for k in near) >= 0.95 * len(near)
    assert all(got.get(k) == 1 for k, v in want.items() if v == 1)


@pytest.mark.parametrize("changed, least", [((24,), 0.97), ((23, 24), 0.9), ((0, 24), 0.97), ((23,), 0.95)])
def test_recall_of_single_windows(changed, least):
    """Windows of 25 words at the lowest similarities above 0.8, by the radius of the query."""
    rnd = random.Random(3)
    hits = 0
    for k in range(600):
        w = [f"{rnd.random()}" for _ in range(25)]
        v = [f"new{k}{i}" if i in changed else x for i, x in enumerate(w)]
        hits += bin(int(prints_of(w, 25, 5)[0]) ^ int(prints_of(v, 25, 5)[0])).count("1") <= 5
    assert hits >= least * 600


def test_leaves_of_nested_parts():
    inner = 'Content-Type: multipart/alternative; boundary="=_b1"\n\n--=_b1\nContent-Type: text/plain\n\none\n--=_b1\nContent-Type: text/html\n\n<p>two</p>\n--=_b1--\n'
    text = f'From: x\nContent-Type: multipart/mixed; boundary="=_b"\n\npreamble\n--=_b\n{inner}--=_b\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA\n--=_b--\nend'
    assert [x.kind for x in leaves(text)] == ["text/plain", "text/html", "image/png"]
    assert [words(t) for t in readable(text)] == [["one"], ["two"]]
    assert readable(None) == [] and readable("") == []
    assert words("Café _x_ 3.5") == ["café", "x", "3", "5"]


# 7: mixing


def test_mix(spark):
    rnd = random.Random(7)
    docs = [(i, "word " * rnd.randrange(1, 40), rnd.choice(["A", " a", "A", "A", "b", "B ", "other", None])) for i in range(400)] + [(900, None, "a"), (901, "", "b")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 3), ("c", 0.1, 9)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, targets)
    shares = {r.source: r for r in mix.shares.collect()}
    total = sum(r.own_tokens for r in shares.values())
    encode = _encoding(TOKENIZER).encode_ordinary
    own = sum(len(encode(r.text)) for r in docs.where("lower(trim(source)) = 'a' and text is not null").collect())
    assert shares["a"].own_tokens == own and shares["c"].own_tokens == 0 and not shares["c"].reached
    used = defaultdict(int)
    for r in mix.chosen.collect():
        assert 1 <= r.copies <= {"a": 1, "b": 3}[r.source]
        used[r.source] += r.copies * r.tokens
    for s, share, repeats in (("a", 0.3, 1), ("b", 0.6, 3)):
        budget = math.floor(share * total)
        r = shares[s]
        assert r.budget == budget and r.used_tokens == used[s] <= budget and r.reached == (repeats * r.own_tokens >= share * total)
        if r.reached:
            assert budget - used[s] < 60  # the next document in hash order does not fit
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    smaller = {r.doc_id for r in mix_sources(docs, targets, total=total // 3).chosen.collect() if r.source == "a"}
    assert smaller < {r.doc_id for r in mix.chosen.collect() if r.source == "a"}
    assert mix_sources(docs.limit(0), targets).shares.where("reached").count() == 0
    assert PATTERN.startswith("'s|")


# 8: truncation

BODY = "Dear Bob,\n\nThe courier opened the last box of the month. We never saw the second delivery note"
WHOLE = mail(BODY + " again.\n\nKind regards\nAnn\n\n-- \nAnn Bee\nFoo GmbH | Tel +1 555 0163\n")


@pytest.mark.parametrize(
    "text, reason",
    [
        (WHOLE, None),
        (mail(BODY), "tail"),
        (mail(BODY + "\n\n"), "tail"),
        (mail(BODY + "..."), "ellipsis"),
        (mail("Hello,\n\n+1"), "line"),
        (mail(BODY + " �"), "character"),
        (mail(BODY + ".\n\nTo leave write to x-leave@list"), "word"),
        (mail(BODY + ".\n\nTo leave write to x-leave@list.exam"), "host"),
        (mail(BODY + ".\n\nTo leave write to x-leave@list.example"), "host"),
        (mail(BODY + ".\n\nSee https://list.example/a"), None),
        (mail("<html><body><p>Hi", "text/html"), "markup"),
        (mail("<html><body><p>Hi</p></body></html>", "text/html"), None),
        (mail("<p>Hi &eac", "text/html"), "markup"),
        (mail("Q2Fm", encoding="base64"), "line"),
        (mail("Q2FmZ", encoding="base64"), "encoding"),
        (mail("caf=C3", encoding="quoted-printable"), "encoding"),
        (mail("a caf=C3=A9.", encoding="quoted-printable"), None),
        ('From: x\nContent-Type: multipart/mixed; boundary="=_b"\n\n--=_b\n\nHi.\n', "part"),
        ('From: x\nContent-Type: multipart/mixed; boundary="=_b"\n\n--=_b\n\nHi.\n--=_b--\n', None),
        ("From: x\nSubject: y", "part"),
        ("From: x\n\n", None),
        ("", None),
    ],
)
def test_endings(text, reason):
    said, ask = ending(text)
    assert (said or (ask or "").partition(" ")[0] or None) == reason


def test_copies_are_found_across_partitions(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh \n") for _ in range(400)) + "z" for _ in range(6)]
    data = [(i, b) for i, b in enumerate(base)] + [(10 + i, b[: 150 + 40 * i] + "  ...") for i, b in enumerate(base)] + [(30, base[0]), (31, base[1][:63]), (32, "x"), (33, None)]
    data += [(40, "base"), (41, "base of another message")]
    df = spark.createDataFrame([(i, t if t is None else "H: v\n\n" + t) for i, t in data], "doc_id bigint, text string").withColumn("_k", F.lit("clash"))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.doc_id for r in cut_copies(df.repartition(5)).collect()}
        assert got == set(range(10, 16))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_truncation_of_tables(spark):
    data = [(1, WHOLE, "S"), (2, mail(BODY), " s"), (2, mail(BODY), " s"), (3, None, "s"), (4, "", None), (5, mail("Hi,\n\nsee attached"), None), (6, mail("Hi,\n\nsee attached"), "t"), (7, mail("Ok,\n\nsee attached"), "t"), (8, mail("Hi,\n\nsee att"), "t")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string").withColumn("reason", F.lit("clash"))
    found = find_truncated(docs)
    assert rows(found.select("doc_id", "source", "reason")) == [(2, "s", "copy"), (8, "t", "sentence")]
    assert {r.source: (r.documents, r.truncated) for r in truncation_rates(docs, found).collect()} == {"s": (3, 1), "t": (3, 1), None: (2, 0)}
    assert find_truncated(docs.limit(0)).count() == 0


def test_copies_of_a_cut_text_are_no_evidence_of_a_natural_ending(spark):
    head = "From: Cid <c@d.example>\nX-Kept: again\n\n"
    data = [(1, mail(BODY)), (2, head + BODY.replace("\n", "\r\n") + " "), (3, mail("Hi,\n\n+1")), (4, mail("Hi,\n\n+1") + "\n"), (5, mail("Hi,\n\n+1"))]
    data += [(10 + i, mail(f"Note {i}.\n\nThis list is run by the volunteers of the north harbour")) for i in range(2)]  # distinct bodies end so
    for extra in (0, 300):  # short lines are judged by the same share of few and of many texts
        docs = spark.createDataFrame([*data, *[(100 + i, mail(f"All is well on day {i}.")) for i in range(extra)]], "doc_id bigint, text string").withColumn("source", F.lit("s"))
        assert {r.doc_id: r.reason for r in find_truncated(docs).collect()} == dict.fromkeys(range(1, 6), "sentence")


def test_short_bodies_are_compared_within_their_message(spark):
    head = "From: a@b.example\nMessage-ID: <{}@x>\nSubject: s\n\n"
    data = [(1, head.format(1) + "See you."), (2, head.format(2) + "See you. Bring the keys."), (3, head.format(1) + "See you. At noon."), (4, head.format(3).replace("ID", "Id") + "Hi"), (5, head.format(3) + "Hi there")]
    data += [(6, head.format(4) + "See you."), (7, head.format(4) + "See you.\n "), (8, head.format(5)), (9, head.format(5) + "x"), (10, head.format(1) + "See you all.")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert rows(cut_copies(docs)) == [(1,), (4,)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_hosts_are_those_of_senders(spark):
    data = [(i, mail(f"Note {i}. {BODY} again.\n\nTo leave write to x-leave@list.{end}")) for i, end in enumerate(["example", "exam", "ru", "EXAMPLE"])]
    docs = spark.createDataFrame([*data, (9, "From: Ivan <i@post.ru>\n\nYes.")], "doc_id bigint, text string").withColumn("source", F.lit("s"))
    assert {r.doc_id: r.reason for r in find_truncated(docs).collect()} == {1: "word"}


def test_piles_are_seen_across_ranges_of_sizes(spark):
    limit = 4096
    cut = [mail(f"{i} " + "word and " * 900)[: limit - 3] + "..." for i in range(6)]
    near = [mail("y" * (limit + d - len(mail(""))) + ".") for d in (-2, 3, 9, 20)]
    docs = spark.createDataFrame(list(enumerate([*cut, *near])), "doc_id bigint, text string").withColumn("source", F.lit("s"))
    assert {r.doc_id for r in find_truncated(docs).where("reason = 'ellipsis'").collect()} == set(range(6))


def test_parts_at_any_depth():
    text = "Content-Type: text/plain\n\nthe innermost words"
    for k in range(60):
        text = f'Content-Type: multipart/mixed; boundary="b{k}="\n\n--b{k}=\n{text}\n--b{k}=--\n'
    assert [x.raw.strip() for x in leaves(text)] == ["the innermost words"] and leaves(text)[0].closed
    assert [x.strip() for x in readable(text)] == ["the innermost words"]
    assert not leaves(text.replace("--b30=--", ""))[0].closed


def test_top_n_of_a_group_of_repeated_rows(spark):
    df = spark.createDataFrame([("g", 1.0, 1)] * 500 + [("g", 1.0, 2), ("g", 0.5, 3), (None, 1.0, 4)], "g string, m double, i bigint")
    got = top_n(df, ["g"], [F.desc("m")], "i", 2, salts=3)
    assert rows(got.where("g is not null").select("place", "i")) == [(1, 1), (2, 2)] and got.where("g is null").count() == 1
