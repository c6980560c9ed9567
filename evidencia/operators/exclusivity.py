"""Loss of exclusivity: protection dates per product and their lookup by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.operators.matching import contains_join
from evidencia.operators.ranking import top_k


def loe_estimate(products: DataFrame, patents: DataFrame, exclusivities: DataFrame, key: list[str],
                 brand_only: bool = True) -> DataFrame:
    """Latest patent and exclusivity date per product; the later one estimates loss of exclusivity.

    products {*key, appl_type, ...}, patents {*key, expires}, exclusivities {*key, expires}.
    """
    brands = products.filter(F.col("appl_type") == "N") if brand_only else products
    patent = patents.groupBy(*key).agg(F.max("expires").alias("patent_expiry"))
    exclusive = exclusivities.groupBy(*key).agg(F.max("expires").alias("exclusivity_expiry"))
    return (
        brands.join(patent, key, "left").join(exclusive, key, "left")
        .withColumn("loe_estimate", F.greatest("patent_expiry", "exclusivity_expiry"))
    )


def latest_release(rows: DataFrame, key: list[str], release: list[str]) -> DataFrame:
    """The row of the newest release per key, from stacked periodic files."""
    return top_k(rows, key, [F.desc(c) for c in release], 1, "_rank").drop("_rank")


def loe_lookup(products: DataFrame, product: str, columns: list[str], asked: DataFrame, name: str,
               limit: int = 25) -> DataFrame:
    """Products whose names contain the asked name; open-ended dates first, then the newest."""
    hits = None
    for column in columns:
        part = contains_join(products, column, asked, name).join(products.select(product, column, "loe_estimate"), column)
        part = part.select(name, product, "loe_estimate")
        hits = part if hits is None else hits.unionByName(part)
    return top_k(hits.distinct(), [name], [F.desc_nulls_first("loe_estimate"), F.asc(product)], limit)
