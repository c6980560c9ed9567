"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.llm.keyed import join_by_key
from evidencia.sources.store import written


def _star(edges: DataFrame) -> DataFrame:
    """edges {u, v} with {least}: the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.count(F.lit(1)).alias("copies"), F.least(F.min("v"), F.first("u")).alias("least"))
    return join_by_key(edges, least, "u", "copies")


def components(edges: DataFrame) -> DataFrame:
    """edges {a, b} of numbered nodes -> {node, label}: for each node with an edge to another the smallest node it can reach.

    Every round first hangs each node's larger neighbours on the smallest of its neighbourhood, then its smaller
    ones; what remains when nothing changes is one star per component. Rounds grow with the logarithm of
    the longest path. Each is written to the shared folder; hot centres are joined by broadcast.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = written(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = written(_star(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter(
            "u <> v").distinct(), "large")
        starred = _star(large)
        small = starred.select(F.explode(F.array(F.struct(F.col("u"), F.col("least").alias("v")),
                                                 F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.u", "e.v")
        now = written(small.filter("u <> v").distinct(), "small")
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == mark:
            least = now.select("v").distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                least.select(F.col("v").alias("node"), F.col("v").alias("label")))
        mark = new
