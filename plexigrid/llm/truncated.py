"""Texts that were cut by a field limit or in transfer (problem 8).

Two kinds of evidence. Copies: after hashing fixed-length prefixes of the bodies, the bodies that
share one are sorted, and a value that is a strict prefix of its successor was cut. Endings: a map
over whole messages finds parts, markup, encodings, words and sentences that never end; endings
that may be natural are decided by counts over all messages (lines that many messages end with,
and the length at which a source's texts pile up).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plexigrid.llm.mail import leaves, split_head, unix, unmark
from plexigrid.llm.mail import decode as decode_leaf
from plexigrid.operators.skew import skew_join
from plexigrid.session import cut

#: Prefix lengths that are hashed; a shorter body is compared with copies of its own message alone.
LADDER = (64, 128, 256, 512, 1024)
#: Share of all distinct bodies; if so many others end in the same way, that is a usual ending
#: (of 98,109 bodies, each natural line ended 2.4e-4 or more, each cut one 0.5e-4 or less).
USUAL = 1.5e-4
#: Bytes of bodies that one task sorts.
SORT_BYTES = 64 * 2**20

_SPACE = " \t\n\v\f\r�"
_MARK = re.compile(r"\s*(?:\.\.\.|…|\[(?:\.\.\.|…)\])$")
_QUOTED = re.compile(r"^[ \t]*((?:[>|][ \t]?)*)(.*)$")
_ENDED = re.compile(r"[.!?;:)\]][\"'”»’)\]*_]*$")
_NAME = re.compile(r"^[^\W\d_a-z][^\W\d_]+(?: [^\W\d_a-z][^\W\d_]+){0,2}$")
#: What introduces a quoted text: a line that ends in a colon or in a time of day with or without a zone.
_INTRO = re.compile(r":$|\d{1,2}:\d{2}(?::\d{2})?(?: ?[A-Z]{3,4}| ?[+-]\d{4})?$")
#: The last of several answer options, which carry no full stop.
_OPTION = re.compile(r"\([A-E]\) [^().?!]{1,60}$")


_FROM = re.compile(r"@[\w.-]*\.([\w-]+)")
_MESSAGE_ID = re.compile(r"^message-id:[ \t]*(\S+)", re.I | re.M)


def _host_at_end(token: str) -> str | None:
    """The last label of the host that an address or URL ends with ("" if the host has no point); None if token is neither, or the URL goes on after its host."""
    if "@" in token:
        host = token.rpartition("@")[2]
    elif "://" in token:
        host, slash, _ = token.partition("://")[2].partition("/")
        if slash:
            return None
    else:
        return None
    return host.rpartition(".")[2].strip("<>()").lower() if "." in host else ""


def _prose(s: str, sender: str, marked: bool) -> tuple[str | None, str | None]:
    s = s.rstrip()
    if not s:
        return None, None
    lines = s.split("\n")
    split = []
    for line in reversed(lines):  # back to the start of the last paragraph, and far enough to see a signature
        split.append(_QUOTED.match(line).groups())
        if len(split) >= 9 and not split[-1][1].strip():
            break
    split.reverse()
    depth, x = split[-1][0].count(">") + split[-1][0].count("|"), split[-1][1].strip()
    if not x or _ENDED.search(x):
        return None, None
    if marked:
        return None, "ellipsis"
    token = x.split()[-1]
    host = _host_at_end(token)
    if host is not None:
        return (None, "host " + host) if host else ("word", None)
    if "://" in token:
        return None, None
    plain = [t.strip() for _, t in split]
    names = {sender, *sender.split()} - {""}
    before = plain[-2] if len(plain) > 1 else ""
    signed = next((i for i in range(2, min(7, len(plain) + 1)) if plain[-i] == "--"), 0)
    if signed and not all(plain[1 - signed :]):
        signed = 0  # a blank line ends a signature
    if x in names:
        return None, None
    if any(n.startswith(x) for n in names) and (signed == 2 or 0 < len(before) <= 30):
        return "word", None
    if signed:
        return None, None
    # the last paragraph: lines up to a blank one, an introduction of a quote or another depth of quotes
    start = len(split) - 1
    while start > 0 and plain[start - 1] and not _INTRO.search(plain[start - 1]) and split[start - 1][0].count(">") + split[start - 1][0].count("|") == depth:
        start -= 1
    paragraph = plain[start:]
    if len(paragraph) > 1 and _NAME.match(x) and len(before) <= 30 and len(before.split()) <= 4:
        return None, None
    if len(paragraph) == 1 and len(x.split()) <= 4:
        return None, "line " + x.lower()
    joined = " ".join(paragraph)
    if _OPTION.search(joined):
        return None, None
    return None, "tail " + " ".join(joined.lower().split()[-9:])


def ending(text: str) -> tuple[str | None, str | None]:
    """Why a message's end shows that it was cut, or else what has to be looked up to decide (both None: it ends)."""
    t = unix(text)
    base = t.rstrip(" \t\n�")
    if "�" in t[len(base) :]:
        return "character", None
    marked = _MARK.search(base, max(0, len(base) - 8))
    if marked:
        base = base[: marked.start()].rstrip()
    if not base:
        return None, None
    head, _, _ = split_head(t)
    if head and "\n\n" not in t:
        return "part", None
    if "\n\n" not in base and head:
        return None, None  # an empty body
    kind = head.get("content-type", "").lower()
    if kind.startswith("multipart/") and (m := re.search(r'boundary="?([^"\s;]+)', head["content-type"], re.I)):
        end = f"\n--{m[1]}--"
        return (None, None) if f"{end}\n" in base or base.endswith(end) else ("part", None)
    leaf = leaves(base)[-1]
    if leaf.encoding == "base64":
        n = len(re.sub(r"[\s=]", "", leaf.raw))
        pads = leaf.raw.rstrip().endswith("=")
        if (n % 4 and not pads) or n % 4 == 1 or (pads and (n + leaf.raw[-3:].count("=")) % 4):
            return "encoding", None
    elif leaf.encoding == "quoted-printable" and re.search(r"=[0-9A-Fa-f]?$", leaf.raw.rstrip()):
        return "encoding", None
    if not leaf.kind.startswith("text/"):
        return None, None
    s = decode_leaf(leaf)
    if leaf.encoding in ("base64", "quoted-printable") and s.rstrip().endswith("�"):
        return "encoding", None
    if leaf.kind == "text/html":
        low = s.lower()
        for tag in ("html", "body"):
            if f"<{tag}" in low and f"</{tag}>" not in low:
                return "markup", None
        s = s.rstrip()
        tag = s.rfind("<")
        if (tag > s.rfind(">") and re.match(r"[a-zA-Z/!]", s[tag + 1 :])) or re.search(r"&#?\w{1,8}$", s[-10:]):
            return "markup", None
        if "</html>" in low or "</body>" in low:
            return None, None
        s = unmark(s)
    sender = re.sub(r"<.*", "", head.get("from", "")).strip().strip('"')
    return _prose(s, sender, bool(marked))


def _body(text: str) -> tuple[str, str]:
    """Head, and what follows the first blank line (all, if there is none) without what a cutting system may have added at the end."""
    t = unix(text)
    head, blank, rest = t.partition("\n\n")
    body = (rest if blank else t).rstrip(_SPACE)
    for mark in ("...", "…"):
        if body.endswith(mark):
            body = body[: -len(mark)].rstrip(_SPACE)
            break
    return head if blank else "", body


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _told(text: str) -> dict:
    """Of a text what copies are found by: hash and length of its body, hashes of the body's prefixes, hash of its message's identifier."""
    head, body = _body(text)
    m = _MESSAGE_ID.search(head)
    return {"_b": _hash(body), "_n": len(body), "_keys": [_hash(body[:k]) for k in LADDER if k <= len(body)], "_m": _hash(m[1]) if m else None}


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in columns})  # whole numbers stay whole beside nulls


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for i, s, t, c, n in zip(*(batch[c] for c in ("_id", "_s", "_text", "_chars", "_bytes"))):
            reason, ask = ending(t)
            sender = _FROM.search(split_head(unix(t))[0].get("from", ""))
            out.append(_told(t) | {"_id": i, "_s": s, "_chars": c, "_bytes": n, "reason": reason, "_ask": ask, "_label": sender[1].lower() if sender else None})
        yield _frame(out, ["_b", "_n", "_keys", "_m", "_id", "_s", "_chars", "_bytes", "reason", "_ask", "_label"])


def _identities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _frame([_told(t) | {"_id": i} for i, t in zip(batch["_id"], batch["_text"])], ["_b", "_n", "_keys", "_m", "_id"])


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"_g": batch["_g"], "_k": batch["_k"], "_body": [_body(t)[1] for t in batch["_text"]]})


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted partition: the rows that begin their successor in their group, and the first and last row for the seams."""
    before, out, first = None, [], True
    for batch in batches:
        for row in zip(batch["_g"].tolist(), batch["_k"].tolist(), batch["_body"].tolist()):
            if first:
                out.append((*row[:2], False, row[2]))
                first = False
            if before is not None and row[0] == before[0] and len(row[2]) > len(before[2]) and row[2].startswith(before[2]):
                out.append((*before[:2], True, None))
            before = row
        yield pd.DataFrame(out, columns=["_g", "_k", "_cut", "_body"])
        out = []
    if before is not None:
        yield pd.DataFrame([(*before[:2], False, before[2])], columns=["_g", "_k", "_cut", "_body"])


def _cut_bodies(seen: DataFrame, rows: DataFrame) -> DataFrame:
    """_k: the bodies (their hashes, _b of seen) that are strict prefixes of others; rows has _id and _text.

    Bodies meet in groups: 0 for all that share a hashed prefix, else the message's identifier, in
    whose group bodies shorter than the shortest hashed prefix are compared with copies of their
    own message (so short a text says nothing by being a prefix of another message).
    """
    # a body asks with its longest hashed prefix, or its message's identifier, and answers with all; groups of one body fall away
    short = F.size("_keys") == 0
    answers = F.filter(F.concat(F.col("_keys"), F.array("_m")), lambda h: h.isNotNull())
    flat = seen.where("_n > 0").select("_id", F.col("_b").alias("_k"), F.explode(answers).alias("_h"), F.when(short, F.col("_m")).otherwise(F.element_at("_keys", -1)).alias("_a"), F.col("_m").alias("_m"))
    flat = flat.select("_id", "_k", "_h", (F.col("_h") == F.col("_a")).alias("_asks"), F.when(F.col("_h") == F.col("_m"), F.col("_m")).otherwise(0).alias("_g"))
    shared = flat.groupBy("_h").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.max("_asks").alias("asks")).where("asks and lo < hi").select("_h")
    wanted = cut(skew_join(flat, shared, "_h", "left_semi").groupBy("_g", "_k").agg(F.min("_id").alias("_id")), "copies")
    chosen = rows.join(wanted, "_id").select("_g", "_k", "_text").mapInPandas(_bodies, "_g bigint, _k bigint, _body string").distinct()
    n_bytes = wanted.join(seen.select("_id", "_n"), "_id").agg(F.sum("_n")).first()[0] or 0
    chosen = chosen.repartitionByRange(max(1, -(-n_bytes // SORT_BYTES)), "_g", "_body").sortWithinPartitions("_g", "_body")
    seams = cut(chosen.mapInPandas(_neighbours, "_g bigint, _k bigint, _cut boolean, _body string"), "neighbours")
    # two rows of each partition, so few that one window takes them
    seam = seams.where("not _cut").select("_g", "_k", "_body").distinct().withColumn("_next", F.lead(F.struct("_g", "_body")).over(Window.partitionBy(F.lit(0)).orderBy("_g", "_body")))
    over = seam.where((F.col("_next._g") == F.col("_g")) & F.col("_next._body").startswith(F.col("_body")) & (F.length("_next._body") > F.length("_body"))).select("_g", "_k")
    return seams.where("_cut").select("_g", "_k").union(over).distinct()


def _by_copy(seen: DataFrame, rows: DataFrame) -> DataFrame:
    """_id of the texts whose body is a strict prefix of another; a short body only within its own message."""
    found = cut(_cut_bodies(seen, rows), "cut-bodies")
    anywhere = skew_join(seen.select("_id", "_b"), found.where("_g = 0").select(F.col("_k").alias("_b")), "_b", "left_semi")
    inside = skew_join(seen.where(F.size("_keys") == 0).select("_id", "_b", F.col("_m").alias("_g")), found.where("_g <> 0").select(F.col("_k").alias("_b"), "_g"), ["_b", "_g"], "left_semi")
    return anywhere.select("_id").union(inside.select("_id")).distinct()


def _rows(docs: DataFrame, ident: str, text: str, source: str | None = None) -> DataFrame:
    s = F.lower(F.trim(F.col(source))) if source else F.lit(None).cast("string")
    return docs.where(F.col(ident).isNotNull() & (F.length(text) > 0)).select(F.col(ident).alias("_id"), s.alias("_s"), F.col(text).alias("_text"), F.length(text).alias("_chars"), F.octet_length(text).alias("_bytes"))


def cut_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident of every text whose body is a strict prefix of the body of another text.

    A body is what follows the first blank line (all, if there is none), with plain line ends and
    without white space, replacement characters and one ellipsis at its end. A body shorter than the
    shortest hashed prefix counts only if the longer one has the same Message-ID in its head, and an
    empty one not at all.
    """
    rows = _rows(docs, ident, text)
    kind = docs.schema[ident].dataType
    schema = T.StructType([*_TOLD, T.StructField("_id", kind)])
    seen = cut(rows.select("_id", "_text").mapInPandas(_identities, schema), "bodies")
    return _by_copy(seen, rows).select(F.col("_id").alias(ident))


_TOLD = [T.StructField("_b", T.LongType()), T.StructField("_n", T.IntegerType()), T.StructField("_keys", T.ArrayType(T.LongType())), T.StructField("_m", T.LongType())]


def find_truncated(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """ident, source (lower case, trimmed), reason for every text that stops before its message was over.

    reason: copy (a longer copy exists), part, markup, encoding, character, word, sentence or ellipsis.
    An ellipsis counts only where the text has a length at which its source's texts pile up. A short
    last line of its own or an unfinished sentence is no cut if at least the share USUAL of all
    bodies, besides its own, ends so. An address at the end is whole if some sender's address ends
    with the same label. Copies of a body (with any headers) count once, so that a cut text does not
    become usual by being kept twice. White space, replacement characters and ellipses that a
    cutting system adds are no ending. Null and empty texts are not truncated; a null source is a
    source of its own; repeated rows count once; an empty table gives no rows.
    """
    rows = _rows(docs, ident, text, source)
    names = {"_s": T.StringType(), "_chars": T.IntegerType(), "_bytes": T.IntegerType(), "reason": T.StringType(), "_ask": T.StringType(), "_label": T.StringType()}
    schema = T.StructType([*_TOLD, T.StructField("_id", docs.schema[ident].dataType), *[T.StructField(n, t) for n, t in names.items()]])
    seen = cut(rows.mapInPandas(_endings, schema), "endings")
    said = seen.where("reason is not null").select("_id", "_s", "reason")
    asked = lambda kind: seen.where(F.col("_ask").startswith(kind + " "))
    lines = asked("line").unionByName(asked("tail")).select("_id", "_s", "_ask", "_b")
    bodies = seen.agg(F.countDistinct("_b")).first()[0]
    others = F.countDistinct("_b") - 1
    rare = lines.groupBy("_ask").agg(others.alias("n")).where((F.col("n") == 0) | (F.col("n") < bodies * USUAL)).select("_ask")
    short = skew_join(lines, rare, "_ask", "left_semi").select("_id", "_s", F.lit("sentence").alias("reason"))  # many texts may end alike
    labels = seen.where("_label is not null").select(F.concat(F.lit("host "), "_label").alias("_ask")).distinct()
    hosts = skew_join(asked("host").select("_id", "_s", "_ask"), labels, "_ask", "left_anti").select("_id", "_s", F.lit("word").alias("reason"))
    doubtful = seen.where(F.col("_ask") == "ellipsis")
    sizes = seen.select("_s", F.explode(F.array_distinct(F.array("_chars", "_bytes"))).alias("_size")).groupBy("_s", "_size").agg(F.count("*").alias("n"))
    # in ranges of 4096 sizes and a margin of 25 on both sides: a window has at most 4146 rows
    part = F.explode(F.array_distinct(F.array(*[F.floor((F.col("_size") + d) / 4096) for d in (-25, 25)])))
    near = F.sum("n").over(Window.partitionBy("_s", "_part").orderBy("_size").rangeBetween(-25, 25))
    piles = sizes.withColumn("_part", part).withColumn("near", near).where(F.col("_part") == F.floor(F.col("_size") / 4096)).where((F.col("n") >= 3) & (F.col("n") * 10 > (F.col("near") - F.col("n"))))
    piles = piles.select(F.coalesce("_s", F.lit("")).alias("_s0"), "_size")
    at = doubtful.select("_id", "_s", F.col("_ask").alias("reason"), F.coalesce("_s", F.lit("")).alias("_s0"), F.explode(F.array_distinct(F.array("_chars", "_bytes"))).alias("_size"))
    limited = skew_join(at, piles, ["_s0", "_size"], "left_semi").select("_id", "_s", "reason")
    by_copy = seen.join(_by_copy(seen, rows), "_id", "left_semi").select("_id", "_s", F.lit("copy").alias("reason"))
    every = said.unionByName(short).unionByName(hosts).unionByName(limited).unionByName(by_copy)
    return every.groupBy("_id").agg(F.min("_s").alias("source"), F.min("reason").alias("reason")).withColumnRenamed("_id", ident)


def truncation_rates(docs: DataFrame, truncated: DataFrame, ident: str = "doc_id", source: str = "source") -> DataFrame:
    """source, documents, truncated, share: how often each source's texts were cut."""
    per = docs.groupBy(F.lower(F.trim(F.col(source))).alias("source")).agg(F.countDistinct(ident).alias("documents"))
    cut_per = truncated.groupBy("source").agg(F.count("*").alias("truncated"))
    out = per.join(cut_per, per["source"].eqNullSafe(cut_per["source"]), "left").select(per["source"], "documents", F.coalesce("truncated", F.lit(0)).alias("truncated"))
    return out.withColumn("share", F.round(F.col("truncated") / F.col("documents"), 6))
