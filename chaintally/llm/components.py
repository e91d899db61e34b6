"""Connected components of a distributed list of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chaintally.session import stored


def _both(links):
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(links):
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    near = _both(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return near.filter(F.col("b") > F.col("a")).join(least, "a").select(
        F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small(links):
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").unionByName(
        least.select("a", F.col("least").alias("b"))).distinct()


def _state(links):
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links, most_rounds=60):
    """``(a, root)`` for every node of ``links (a bigint, b bigint)`` but the roots themselves.

    No neighbour list is ever collected: each step is a minimum per node, combined before the
    shuffle, and a join of the links with those minima, whose large nodes skew handling splits.
    Every round is written to the shared folder, which cuts the lineage.
    """
    links = stored(links.filter("a <> b"), "links")
    before = _state(links)
    for _ in range(most_rounds):
        links = stored(_small(_large(links)), "links")
        now = _state(links)
        if now == before:
            return links.select("a", F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
