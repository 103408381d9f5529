"""Evaluation passages inside a corpus, by SimHash windows and multi-index Hamming blocks (problem 6).

Every window of as many words as a test passage has gets a 64-bit SimHash of its word shingles: each
shingle votes with the signs of its words, so that a word counts as often as it is in a shingle of
the window and words at the edges, whose change costs few shingles, move few bits. Two fingerprints
within radius r agree in at least one of r + 1 blocks of bits, so that looking up each block finds
all fingerprints within the radius. Candidates are then compared by the exact weighted similarity of
their shingles. Spark prepares the test items (windows, shingle weights over all of them); the corpus
is read in map tasks alone, once per bounded chunk of test items, and nothing of it is shuffled but
the matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexigrid.llm.mail import readable, words
from plexigrid.session import cut

BITS = 64
#: Words of test items (about) that one pass over the corpus takes: the bound of what is broadcast and of a task's index (about 100 bytes a word).
CHUNK_WORDS = 1_000_000
#: Words of one item that lie in one row; longer items are cut into rows that overlap by a window.
SEGMENT_WORDS = 20_000
#: Words whose fingerprints are computed at once in a task.
BLOCK_WORDS = 40_000
#: Pairs of windows that are compared at once.
PAIRS = 20_000


class Signs(dict):
    """Sign vectors and codes of words by row number, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.rows, self.codes = np.zeros((1024, BITS), np.int8), np.zeros(1024, np.uint64)
        self.most = most

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        if k >= len(self.rows):
            self.rows, self.codes = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.codes, np.zeros_like(self.codes)])
        digest = np.frombuffer(xxhash.xxh3_64_digest(word), np.uint8)
        self.rows[k], self.codes[k] = np.unpackbits(digest).astype(np.int8) * 2 - 1, digest.view(np.uint64)[0]
        return k

    def index(self, ws: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))


def _window_sums(rows: np.ndarray, window: int) -> np.ndarray:
    """Sums of every window of consecutive rows, from sums over powers of two of rows."""
    n, total, at, size = len(rows) - window + 1, None, 0, 1
    while True:
        if window & size:
            part = rows[at : at + n]
            total = part if total is None else total + part
            at += size
        if size * 2 > window:
            return total
        rows = rows[:-size] + rows[size:]
        size *= 2


def fingerprints(rows: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """SimHash of every window of consecutive words (rows: their signs); a bit is set if the votes of its shingles set it."""
    if len(rows) < window:
        return np.empty(0, np.uint64)
    each = window - shingle + 1
    wide = rows if shingle * each < 128 else rows.astype(np.int32)
    return np.packbits(_window_sums(_window_sums(wide, shingle), each) > 0, axis=1).view(np.uint64).ravel()


def shingle_codes(codes: np.ndarray, shingle: int) -> np.ndarray:
    """A code of every shingle of consecutive words."""
    n = max(0, len(codes) - shingle + 1)
    total = np.zeros(n, np.uint64)
    for i in range(shingle if n else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return total


def distinct_windows(codes: np.ndarray, window: int, group: np.ndarray | None = None) -> np.ndarray:
    """Where windows of words begin that no earlier window (of its group, told at its first word) equals: repeats add nothing."""
    whole = shingle_codes(codes, window)
    if group is not None:
        whole = whole * np.uint64(0xD1B54A32D192ED03) + group[: len(whole)].view(np.uint64)
    return np.sort(np.unique(whole, return_index=True)[1])


class Items:
    """A bounded chunk of test items, ready for lookup by blocks of fingerprint bits.

    Rows, each a segment of an item: item_id, fingerprints and begins of its windows, codes of its
    words, and for each word the weight of the shingle that begins there.
    """

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], window: int, radius: int, shingle: int):
        self.window, self.radius, self.shingle = window, radius, shingle
        item, prints, begins, codes, weights = zip(*rows)
        self.prints, self.codes, self.weights = np.concatenate(prints), np.concatenate(codes), np.concatenate(weights)
        self.owner = np.repeat(np.array(item, np.int64), [len(p) for p in prints])
        offset = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        self.start = np.concatenate([o + b for o, b in zip(offset, begins)])
        self.shingles = np.concatenate([np.pad(shingle_codes(c, shingle), (0, min(len(c), shingle - 1))) for c in codes])
        self.blocks = []  # of each block: shift, bits, where each value of its upper bits begins in the order, the order by value, values and fingerprints in it
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        for low, high in zip(edges[:-1], edges[1:]):
            bits = int(high - low)
            values = self._values(self.prints, low, bits)
            order = np.argsort(values, kind="stable")
            top = max(0, bits - 16)  # wide blocks are searched in the order, beyond their upper 16 bits
            begin = np.searchsorted(values[order] >> np.uint64(top), np.arange((1 << min(bits, 16)) + 1, dtype=np.uint64))
            self.blocks.append((int(low), bits, top, begin.astype(np.int32), order, values[order], self.prints[order]))

    @staticmethod
    def _values(prints: np.ndarray, low: int, bits: int) -> np.ndarray:
        return (prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, item window) whose fingerprints differ in at most radius bits."""
        found = []
        for low, bits, top, begin, order, values, sorted_prints in self.blocks:
            v = self._values(prints, low, bits)
            first = (v >> np.uint64(top)).astype(np.int64)
            lo, hi = begin[first], begin[first + 1]
            pos = np.nonzero(hi > lo)[0]
            lo, n = lo[pos], (hi - lo)[pos]
            if top:
                lo = np.searchsorted(values, v[pos], "left")
                n = np.searchsorted(values, v[pos], "right") - lo
                pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
            if len(pos):
                ends = np.cumsum(n)
                k = np.repeat((lo - (ends - n)).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)
                near = np.nonzero(np.bitwise_count(np.repeat(prints[pos], n) ^ sorted_prints[k]) <= self.radius)[0]
                found.append(np.stack([pos[np.searchsorted(ends, near, "right")], order[k[near]]]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]

    def similarity(self, codes: np.ndarray, shingles: np.ndarray, pos: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of the shingles of the window at each pos and item window k; 1.0 only for equal words.

        A shingle weighs what it does in the item window; one that the item window lacks weighs 1.
        """
        each, out = self.window - self.shingle + 1, np.zeros(len(pos))
        for i in range(0, len(pos), PAIRS):
            p, at = pos[i : i + PAIRS, None], self.start[k[i : i + PAIRS], None]
            a, b, w = shingles[p + np.arange(each)], self.shingles[at + np.arange(each)], self.weights[at + np.arange(each)]
            # each shingle counts once in its window, at its first place
            earlier = np.tri(each, k=-1, dtype=bool)
            a_first = ~((a[:, :, None] == a[:, None, :]) & earlier).any(2)
            b_first = ~((b[:, :, None] == b[:, None, :]) & earlier).any(2)
            same = a[:, :, None] == b[:, None, :]
            common = (w * (b_first & same.any(1))).sum(1)
            union = (w * b_first).sum(1) + (a_first & ~same.any(2)).sum(1)
            equal = (codes[p + np.arange(self.window)] == self.codes[at + np.arange(self.window)]).all(1)
            out[i : i + PAIRS] = np.where(equal, 1.0, np.minimum(common / np.maximum(union, 1e-300), 1.0 - 1e-9))
        return out


def _scan(shared, read: Callable[[str], list[str]], min_similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(*shared.value)
        signs, size = Signs(), items.window

        def flush(ws: list[str], bounds: list[tuple[int, int, int]]) -> pd.DataFrame:
            at = signs.index(ws)
            codes = signs.codes[at]
            first, end, doc = np.array(bounds, np.int64).T
            place = distinct_windows(codes, size, np.repeat(doc, end - first))
            part = np.searchsorted(first, place, "right") - 1
            whole = place + size <= end[part]  # no window of two texts
            place, part = place[whole], part[whole]
            pos, k = items.candidates(fingerprints(signs.rows[at], size, items.shingle)[place])
            pos, part = place[pos], part[pos]
            sim = items.similarity(codes, shingle_codes(codes, items.shingle), pos, k)
            got = pd.DataFrame({"doc_id": doc[part], "item_id": items.owner[k], "similarity": sim})
            return got[got["similarity"] >= min_similarity].groupby(["doc_id", "item_id"], as_index=False).max()

        for batch in batches:
            out: list[pd.DataFrame] = []
            ws: list[str] = []
            bounds: list[tuple[int, int, int]] = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                for part in read(text):
                    w = words(part)
                    # a long part is taken in blocks that overlap by a window less one word
                    for at in range(0, max(1, len(w) - size + 1), BLOCK_WORDS):
                        piece = w[at : at + BLOCK_WORDS + size - 1]
                        if len(piece) >= size:
                            bounds.append((len(ws), len(ws) + len(piece), doc))
                            ws.extend(piece)
                        if len(ws) >= BLOCK_WORDS:
                            out.append(flush(ws, bounds))
                            ws, bounds = [], []
            if ws:
                out.append(flush(ws, bounds))
            if out:
                yield pd.concat(out)

    return run


def _segments(window: int, shingle: int):
    """Items as rows of bounded length: item_id, part, codes of the words, fingerprints and begins of the distinct windows, codes of the shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = Signs()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                w = words(text)
                for part, at in enumerate(range(0, max(0, len(w) - window + 1), SEGMENT_WORDS)):
                    k = signs.index(w[at : at + SEGMENT_WORDS + window - 1])
                    codes = signs.codes[k]
                    begins = distinct_windows(codes, window)
                    arrays = codes, fingerprints(signs.rows[k], window, shingle)[begins], begins, shingle_codes(codes, shingle)
                    rows.append((item, part, *[a.view(np.int64) for a in arrays]))
            yield pd.DataFrame(rows, columns=["item_id", "part", "codes", "prints", "begins", "shingles"])

    return run


def weighed_items(items: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """item_id, part, codes, prints, begins, weights of the segments of all items; a shingle weighs 1 / the number of items that have it."""
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).distinct()
    schema = "item_id bigint, part int, codes array<bigint>, prints array<bigint>, begins array<bigint>, shingles array<bigint>"
    segments = cut(rows.mapInPandas(_segments(window, shingle), schema), "leak-items")
    places = segments.select("item_id", "part", F.posexplode("shingles").alias("_at", "_s"))
    having = places.select("item_id", "_s").distinct().groupBy("_s").agg((1.0 / F.count("*")).alias("_w"))
    weights = places.join(having, "_s").groupBy("item_id", "part").agg(F.sort_array(F.collect_list(F.struct("_at", "_w"))).alias("_ws"))
    return cut(segments.join(weights, ["item_id", "part"]).select("item_id", "part", "codes", "prints", "begins", F.col("_ws._w").alias("weights")), "leak-weights")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    window: int = 25,
    radius: int = 5,
    shingle: int = 5,
    min_similarity: float = 0.8,
    read: Callable[[str | None], list[str]] = readable,
    chunk_words: int = CHUNK_WORDS,
) -> DataFrame:
    """doc_id, item_id, similarity: the documents with a window of words that is like a window of an item.

    A window of a document and one of an item match if their SimHashes differ in at most radius bits
    and the weighted similarity of their shingles is at least min_similarity (0.0 is no similarity);
    windows of equal words always match, with 1.0, and no others have 1.0. similarity is the best of
    the document for the item. read turns a document's text into the texts to search (a passage is
    not sought across two of them). Null texts and ids, and items shorter than a window, match
    nothing; empty tables give no rows; repeated rows count once. A shingle weighs 1 / the number of
    items that have it, whatever else is in its chunk. Items are taken in chunks of about
    chunk_words words, each with one pass over docs whose matches are written before the next begins,
    so that the driver and a task hold one chunk at a time.
    """
    if not 0 < shingle <= window:
        raise ValueError("a window has at least one shingle")
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType())])
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ready = weighed_items(items, item_id, text, window, shingle)
    total = ready.agg(F.sum(F.size("codes"))).first()[0] or 0
    chunks, found = -(-total // chunk_words), []
    for c in range(chunks):
        mine = ready.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(chunks)) == c).toPandas()  # about chunk_words words
        columns = [mine[c].map(lambda x, t=t: np.array(x, t)) for c, t in (("prints", np.int64), ("begins", np.int64), ("codes", np.int64), ("weights", float))]
        packed = [(i, p.view(np.uint64), b, x.view(np.uint64), np.pad(w, (0, len(x) - len(w)))) for i, p, b, x, w in zip(mine["item_id"], *columns)]
        if not packed:
            continue
        shared = spark.sparkContext.broadcast((packed, window, radius, shingle))
        one = rows.mapInPandas(_scan(shared, read, min_similarity), schema)
        found.append(cut(one, "leaks") if chunks > 1 else one)
        if chunks > 1:
            shared.destroy()
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
