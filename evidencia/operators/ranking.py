"""Top-k per group, rank fusion and the result envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60
OVERFETCH = 3


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best `k` rows of each group.

    The `row_number() <= k` shape lets Spark keep only k rows per group inside every input task
    before the shuffle (WindowGroupLimit), so a hot group never reaches one task whole.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def reciprocal_rank_fusion(branches: list[DataFrame], keys: list[str], group: list[str], k: int,
                           constant: int = RRF_K) -> DataFrame:
    """Sum 1/(constant + rank) over the branches and keep the best `k` per group."""
    ranked = None
    for branch in branches:
        part = branch.select(*keys, "rank")
        ranked = part if ranked is None else ranked.unionByName(part)
    fused = ranked.groupBy(*keys).agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 6).alias("score")
    )
    ties = [F.asc(c) for c in keys if c not in group]
    return top_k(fused, group, [F.desc("score"), *ties], k)


def envelope(queries: DataFrame, hits: DataFrame, query_id: str, row: list[str],
             order: str = "rank") -> DataFrame:
    """{query, returned, has_results, rows} with the (at most k) hits of each query nested in order."""
    packed = hits.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("returned"),
        F.array_sort(F.collect_list(F.struct(order, *[c for c in row if c != order]))).alias("rows"),
    )
    return (
        queries.join(packed, query_id, "left")
        .withColumn("returned", F.coalesce("returned", F.lit(0).cast("bigint")))
        .withColumn("has_results", F.col("returned") > 0)
    )
