"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from factlake.llm.common import stored


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and fingerprint, taken while they are written."""
    seen = Observation()
    marks = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
    now = stored(edges.observe(seen, *marks), "edges")
    return now, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another node: component is the smallest node reachable.

    Alternating stars: each edge (larger, smaller) is turned to the smallest neighbour of its
    smaller end, then all smaller neighbours of a node are tied to the smallest of them. Only
    minima per node move, so a node with very many edges is aggregated before the shuffle. The
    rounds grow with the logarithm of the graph. Null ends and loops are left out; repeated
    edges count once; no edges give no rows.
    """
    now, mark = _written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    while mark[0]:
        lowest = (
            now.select(F.col("a").alias("node"), F.col("b").alias("other"))
            .union(now.select(F.col("b").alias("node"), F.col("b").alias("other")))
            .groupBy("node")
            .agg(F.min("other").alias("low"))
        )
        large = now.join(lowest, now["b"] == lowest["node"]).select("a", F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(least, "a")
            .where(F.col("b") != F.col("low"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(least.select("a", F.col("low").alias("b")))
            .distinct()
        )
        before = mark
        now, mark = _written(small)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def merged(known: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) after more edges, from that of the edges before.

    The edges are turned to the components of their ends first, so that only edges between
    different components go through the rounds, whatever was connected before.
    """
    of_a = known.select(F.col("node").alias(a), F.col("component").alias("__x"))
    of_b = known.select(F.col("node").alias(b), F.col("component").alias("__y"))
    between = edges.select(a, b).join(of_a, a, "left").join(of_b, b, "left")
    between = between.select(F.coalesce("__x", a).alias("a"), F.coalesce("__y", b).alias("b"))
    moved = components(between)
    after = moved.select(F.col("node").alias("component"), F.col("component").alias("__z"))
    again = known.join(after, "component", "left").select("node", F.coalesce("__z", "component").alias("component"))
    # smallest nodes of components and nodes without an edge before are no nodes of `known`
    return again.union(moved)
