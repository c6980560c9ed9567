"""Competitive landscape: mechanism x development stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.operators.graph import canonical_drug, drop_reclassified

STAGES = ["Preclinical", "Phase 1", "Phase 2", "Phase 3", "Approved"]
OTHER = "Other / Unspecified Mechanism"
PMC_PATTERN = r"^PMC[0-9]+$"


def landscape_cells(evidence: DataFrame, mechanisms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """{mechanism, stage, drug, source}: every drug once per mechanism, at its most advanced stage.

    evidence {drug, stage, source}; preclinical evidence must cite a PMC id. Brand names are
    replaced by their concept first; drugs without a mechanism go to the catch-all row.
    """
    valid = evidence.filter(~((F.col("stage") == "Preclinical") & ~F.col("source").rlike(PMC_PATTERN)))
    named = canonical_drug(valid, "drug", synonyms)
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    # one row per drug before the mechanism is joined, so a busy drug is small in that join
    best = named.withColumn("rank", rank).filter("rank > 0").groupBy(F.trim("drug").alias("drug")).agg(
        F.max("rank").alias("rank"), F.min_by("source", F.struct(-F.col("rank"), F.col("source"))).alias("source"))
    placed = best.join(mechanisms.select(F.lower("drug").alias("_d"), "mechanism").distinct(),
                       F.lower("drug") == F.col("_d"), "left").select(
        F.coalesce("mechanism", F.lit(OTHER)).alias("mechanism"),
        F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("rank").cast("int")).alias("stage"), "drug", "source")
    return drop_reclassified(placed, OTHER)


def landscape_matrix(cells: DataFrame) -> DataFrame:
    """Drug counts per mechanism with one column per stage; empty cells are 0."""
    counts = cells.groupBy("mechanism").pivot("stage", STAGES).agg(F.count(F.lit(1)))
    for stage in STAGES:
        counts = counts.withColumnRenamed(stage, stage.lower().replace(" ", "_"))
    columns = [s.lower().replace(" ", "_") for s in STAGES]
    filled = counts.fillna(0, columns)
    return filled.withColumn("total_drugs", sum((F.col(c) for c in columns[1:]), F.col(columns[0]))).orderBy(
        F.desc("total_drugs"), "mechanism")
