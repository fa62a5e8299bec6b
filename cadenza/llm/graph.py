"""Connected components of a large undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import discard, staged


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step and a staged table that it reads. Joins every larger neighbour of a vertex to the least of the vertex and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step and a staged table that it reads. Joins a vertex and its smaller neighbours to the least of these."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): for each vertex of `edges` (a, b) but the least of each component, that least vertex.

    Each round of two star steps is written out; rounds grow with the logarithm of the longest path.
    Loops and repeated edges are harmless. Nothing but counts reaches the driver. The least neighbours are
    written out before they are joined, so the join of a vertex with very many edges can be split. A round's
    tables are deleted when the next is written.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    edges = staged(edges)
    before = state(edges)
    while before[0]:
        large, one = _large_star(edges)
        small, two = _small_star(large)
        last, edges = edges, staged(small)
        for old in (last, one, two):
            discard(old)
        if (now := state(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
