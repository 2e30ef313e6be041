"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm._common import discard, materialise


def _star(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v): each u with the least of itself and its neighbours, written so that joins with a hub can be split."""
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    return pairs.join(least, "u"), least


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node that links reach.

    Large-star and small-star steps alternate until the edges no longer change; every round is written to the shared
    folder, the tables of the round before are deleted, and only a count and a checksum come to the driver. Loops and repeated edges are fine; no edges: no rows.
    """
    edges = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        starred, first = _star(both)
        large = starred.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        small, second = _star(large)
        linked = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        old, edges = edges, materialise(linked.where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(old, first, second)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
