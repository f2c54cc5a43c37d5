"""Connected components of a link table that may hold very large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditspark.llm.text import materialise

ROUNDS = 100
HOT = 1_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's smallest node.

    Large and small stars alternate: every node hands its larger neighbours to the
    smallest node it knows, then its smaller ones. Links only ever move towards the
    root, their number does not grow, and the rounds needed grow with the logarithm
    of a component's diameter. A group's links are never gathered: minima are
    partial aggregates, and the joins on a hot node are split by adaptive execution.
    Every round is written to the shared folder, so a lost executor costs one round.

    Nulls and links of a node to itself are left out; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialise(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(), "links")
    seen = state(edges)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        edges = materialise(small_star(large_star(edges)), "links")
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select("b", "b").distinct())


def named(rooted: DataFrame, first: str = "first", name: str = "component_id") -> DataFrame:
    """Rows of `rooted` (root, ...) with the smallest `first` of their root as `name`; read twice, so written before.

    Roots with more than a thousandth of the rows, fewer than a thousand, are broadcast; rows of the
    others meet by root, and none of these is large. No component gathers its rows in one task.
    """
    best = materialise(rooted.groupBy("root").agg(F.min(first).alias(name), F.count("*").alias("__n")), "roots")
    rows = best.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(best.where(F.col("__n") * HOT > rows).drop("__n"))
    others = rooted.join(hot.select("root"), "root", "left_anti").join(best.where(F.col("__n") * HOT <= rows).drop("__n"), "root")
    return rooted.join(hot, "root").unionByName(others)


def state(edges: DataFrame) -> tuple:
    """Number of links and a sum over their hashes: equal before and after a round that changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(smallest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(smallest.select("a", "m")).distinct()
