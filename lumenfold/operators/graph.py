"""Connected components and ordered clustering over edge tables, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over distinct directed pairs (a, b): neighbours are tied to the least of the neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a")
    return tied.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node in ``edges`` (a, b).

    Alternates large-star and small-star steps until nothing changes: a number of
    rounds that grows with the logarithm of the nodes, each with a reliable
    checkpoint. Minima are combined on the map side, so a hub of any degree is no
    hot task. Loops and null ends are dropped; repeated edges count once.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        now = cut(_stars(_stars(now, True), False))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def ordered_clusters(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Greedy clustering in order: each node that no earlier seed reaches is a seed and takes all later ones near it.

    ``nodes`` has ``node`` (its order); ``edges`` (a, b) are the pairs in reach.
    The same as going through the nodes one by one, but in rounds: a node whose
    earlier neighbours are all settled as members is a seed, one with an earlier
    seed is that seed's member. Gives ``node`` and ``seed``.
    """
    up = cut(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low <> high").distinct())
    everyone = nodes.select("node").distinct()
    left, seeds = cut(everyone), None
    for _ in range(most_rounds):
        # neighbours that are settled members can never be seeds: they no longer hold anybody up
        alive = up.join(left.select(F.col("node").alias("high")), "high", "left_semi").join(left.select(F.col("node").alias("low")), "low", "left_semi")
        new = left.join(alive.select(F.col("high").alias("node")).distinct(), "node", "left_anti")
        taken = alive.join(new.select(F.col("node").alias("low")), "low", "left_semi").select(F.col("high").alias("node")).distinct()
        new = cut(new)
        seeds = new if seeds is None else cut(seeds.unionByName(new))
        left = cut(left.join(new, "node", "left_anti").join(taken, "node", "left_anti"))
        if left.isEmpty():
            break
    else:
        raise RuntimeError("clusters did not settle")
    # only now are all seeds known: a member belongs to the first of those in its reach
    first = up.join(seeds.select(F.col("node").alias("low")), "low").groupBy("high").agg(F.min("low").alias("seed"))
    members = first.join(seeds.select(F.col("node").alias("high")), "high", "left_anti").select(F.col("high").alias("node"), "seed")
    return seeds.select("node", F.col("node").alias("seed")).unionByName(members)
