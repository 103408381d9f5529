"""Groups of pairwise matches by seed-tree pruning (problem 2).

The graph is an edge table; nothing is gathered per vertex. In each round every vertex proposes the
minimum of its closed neighbourhood to all its neighbours; a vertex that is proposed by nobody as a
minimum drops out and hangs below the smallest proposal it received (an edge of the propagation
forest); the proposals of a vertex are linked to the smallest of them, which is the next, smaller
graph. When no edge is left, the vertices that never dropped out are the seeds, and their
identifiers flow down the forest, last dropped first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexigrid.operators.skew import hot_keys, skew_join
from plexigrid.session import cut, discard

#: Rounds needed grow as the logarithm of the longest chain; this many would cover any real table.
MAX_ROUNDS = 64


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def linked_groups(pairs: DataFrame, u: str = "u", v: str = "v", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """id, group_id for every id that is linked to at least one other; group_id is the group's smallest id.

    pairs is undirected: repeated, reversed and self pairs and pairs with a null end add nothing.
    An empty table gives no rows. ids must be orderable (bigint or string); other columns are ignored.
    """
    e = pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.col(u).isNotNull() & F.col(v).isNotNull()).toDF("u", "v", "ok")
    edges = cut(e.where(F.col("ok") & (F.col("u") != F.col("v"))).select("u", "v").distinct(), "cc-edges")
    levels: list[DataFrame] = []  # of each round: the vertices that dropped out, with their parents
    for _ in range(max_rounds):
        n = edges.count()
        if n == 0:
            break
        links = _both_ways(edges)
        hot = hot_keys(links, "u", most=2 * n)
        lowest = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # the minimum of u's closed neighbourhood is proposed to u and to every neighbour of u
        to_others = skew_join(links, lowest, "u", hot=hot).select(F.col("v").alias("x"), "m")
        proposals = cut(to_others.unionByName(lowest.select(F.col("u").alias("x"), "m")).distinct(), "cc-proposals")
        # of every vertex the smallest proposal it got, and whether it was itself proposed
        heard = F.explode(F.array(F.struct(F.col("x").alias("x"), F.col("m").alias("m"), F.lit(0).alias("s")), F.struct(F.col("m").alias("x"), F.lit(None).alias("m"), F.lit(1).alias("s"))))
        got = cut(proposals.select(heard.alias("h")).groupBy(F.col("h.x").alias("x")).agg(F.min("h.m").alias("p"), F.max("h.s").alias("stays")), "cc-got")
        levels.append(got.where("stays = 0").select(F.col("x").alias("id"), F.col("p").alias("parent")))
        # a vertex proposes once to each neighbour and to itself: at most 4 n proposals
        nxt = skew_join(proposals, got.select("x", "p"), "x", hot=hot_keys(proposals, "x", most=4 * n)).where(F.col("m") != F.col("p"))
        smaller = cut(nxt.select(F.least("m", "p").alias("u"), F.greatest("m", "p").alias("v")).distinct(), "cc-edges")
        discard(edges)
        discard(proposals)
        edges = smaller
    else:
        raise RuntimeError(f"pairs still linked after {max_rounds} rounds")
    if not levels:
        return edges.select(F.col("u").alias("id"), F.col("u").alias("group_id")).limit(0)
    # a parent was proposed, so that it dropped out in a later round, whose members are named by now, or never: then it is a seed
    named: list[DataFrame] = []
    for level in reversed(levels):
        if named:
            above = reduce(DataFrame.unionByName, named).withColumnRenamed("id", "parent")
            level = skew_join(level, above, "parent", "left")
            level = level.select("id", F.coalesce("group_id", "parent").alias("group_id"))
        named.append(cut(level.toDF("id", "group_id"), "cc-named"))
    below = reduce(DataFrame.unionByName, named)
    return below.unionByName(below.select(F.col("group_id").alias("id"), "group_id").distinct())
