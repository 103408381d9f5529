"""Mixing sources to target shares by hash thresholds (problem 7).

A document's place in its source is a hash of its identifier. A histogram of tokens by source and
hash bucket gives the bucket in which a source's budget ends; only that bucket is split further,
until it is decided. The mix is then one filter on the hash: nothing is sorted or gathered, and the
sample for a smaller budget is part of the one for a larger.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plexigrid.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are cut into pieces (fixed, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LEVEL_BITS, LEVELS = 16, 3  # 48 bits of hash decide; documents that agree in all of them enter or stay out together


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text under a public vocabulary (path of a .tiktoken file on every machine); null has 0."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def _name(source: Column) -> Column:
    return F.lower(F.trim(source))


class Mix:
    """What mix_sources decided: shares (one row per source) and chosen (one row per document used)."""

    def __init__(self, shares: DataFrame, chosen: DataFrame):
        self.shares, self.chosen = shares, chosen


def mix_sources(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, total: int | None = None) -> Mix:
    """A mix in which each source of targets (source, target_share, max_repeats) has its share of total tokens.

    total defaults to the tokens of all documents of listed sources, each once. A source's budget is
    target_share * total. Documents are used floor(budget / own) times in full and once more up to
    the hash threshold at which the rest of the budget is used up (never beyond it), at most
    max_repeats times in all. Sources are compared without case and outer blanks; documents of other
    or null sources are left out. A listed source without documents has 0 tokens.

    shares: source, documents, own_tokens, budget, used_tokens, target_share, actual_share, reached
    (false where all documents at max_repeats do not fill the budget, or there are none). chosen: ident, source, tokens, copies (1 or more).
    Repeated rows of a document count each; a null target_share is 0, a null max_repeats is 1.
    """
    listed = targets.select(F.col("source").alias("_listed"), _name(F.col("source")).alias("_s"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where(F.col("_s").isNotNull()).dropDuplicates(["_s"])
    wanted = docs.select(F.col(ident), F.col(text).alias("_text"), _name(F.col(source)).alias("_s")).join(listed.select("_s"), "_s", "left_semi")
    h = F.shiftrightunsigned(F.xxhash64(F.col(ident)), 64 - LEVEL_BITS * LEVELS)
    # tokens are counted once and written; the text is not needed again
    sized = cut(wanted.select(ident, "_s", token_counts(F.col("_text"), tokenizer).alias("tokens"), h.alias("_h")), "mix-sizes")
    first = cut(sized.groupBy("_s", F.shiftright("_h", LEVEL_BITS * (LEVELS - 1)).alias("_b")).agg(F.sum("tokens").alias("_t"), F.count("*").alias("_n")), "mix-histogram")
    own = first.groupBy("_s").agg(F.sum("_t").alias("own_tokens"), F.sum("_n").alias("documents"))
    plan = listed.join(own, "_s", "left").fillna(0, ["own_tokens", "documents"])
    everything = F.lit(total) if total is not None else F.lit(own.agg(F.sum("own_tokens")).first()[0] or 0)
    plan = plan.withColumn("_exact", F.col("target_share") * everything).withColumn("budget", F.floor("_exact").cast("bigint"))
    whole = F.when(F.col("own_tokens") > 0, F.least(F.floor(F.col("budget") / F.col("own_tokens")).cast("bigint"), F.col("max_repeats"))).otherwise(0)
    plan = plan.withColumn("_whole", whole)
    plan = plan.withColumn("_rest", F.when(F.col("_whole") < F.col("max_repeats"), F.col("budget") - F.col("_whole") * F.col("own_tokens")).otherwise(0))
    plan = cut(plan, "mix-plan")
    # thresholds: the greatest hash below which a source's tokens fit into the rest
    bound = plan.select("_s", F.col("_rest").alias("_left"), F.lit(0).cast("bigint").alias("_below"))
    level_bins = first
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        # at most 2 ** LEVEL_BITS rows a source
        upto = F.sum("_t").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        at = bound.join(level_bins.withColumn("_upto", upto), "_s").where(F.col("_upto") > F.col("_left"))
        edge = at.groupBy("_s").agg(F.min(F.struct("_b", "_upto", "_t", "_left")).alias("e")).select("_s", F.col("e._b").alias("_b"), (F.col("e._left") - F.col("e._upto") + F.col("e._t")).alias("_left"))
        bound = bound.drop("_left").join(edge, "_s", "left")
        bound = bound.select("_s", F.when(F.col("_b").isNull(), F.col("_below") if level else F.lit(1 << (LEVEL_BITS * LEVELS))).otherwise(F.shiftleft(F.col("_b"), shift)).alias("_below"), "_left", "_b")
        bound = cut(bound, "mix-bound")
        if level + 1 < LEVELS:
            nxt = sized.join(bound.where("_b is not null").select("_s", "_b"), "_s").where(F.shiftright("_h", shift) == F.col("_b"))
            level_bins = nxt.groupBy("_s", F.shiftright("_h", shift - LEVEL_BITS).alias("_b")).agg(F.sum("tokens").alias("_t"))
            bound = bound.select("_s", "_left", "_below")
    marks = plan.select("_s", F.col("_listed").alias("source"), "_whole").join(bound.select("_s", "_below"), "_s")
    chosen = sized.join(marks, "_s").withColumn("copies", F.col("_whole") + (F.col("_h") < F.col("_below")).cast("bigint")).where("copies > 0")
    chosen = chosen.select(ident, "source", "tokens", "copies")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"))
    shares = plan.withColumnRenamed("_listed", "source").join(used, "source", "left").fillna(0, ["used_tokens"])
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # one row per listed source
    # told by the mix itself: every document is in it as often as allowed, and still there are too few tokens
    short = (F.col("used_tokens") == F.col("max_repeats") * F.col("own_tokens")) & (F.col("used_tokens") < F.col("_exact"))
    shares = shares.withColumn("reached", ~short & (F.col("documents") > 0))
    shares = shares.withColumn("actual_share", F.when(all_used > 0, F.col("used_tokens") / all_used).otherwise(0.0))
    return Mix(shares.select("source", "documents", "own_tokens", "budget", "used_tokens", "target_share", "actual_share", "reached"), chosen)
