"""The result grid: acceptance, citations, export and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidencia.functions.codes import citation_url

PAGE_ROWS = 8


def acceptable(candidate: Column, source: Column, phase: Column, sponsor: Column) -> Column:
    """The candidate names its own source record and has a phase and a sponsor."""
    good = (F.trim(candidate) == source) & (F.trim(phase) != "") & (F.trim(sponsor) != "")
    return F.coalesce(good, F.lit(False))


def gate(rows: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows)."""
    ok = F.coalesce(accepted, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def citation(source_type: Column, reference: Column, url: Column) -> Column:
    return F.struct(source_type.alias("source_type"), reference.alias("reference"), url.alias("url"))


def with_registry_citation(nct_id: Column, sources: Column) -> Column:
    """The registry citation derived from the id comes first; any other registry one is dropped."""
    own = F.array(citation(F.lit("registry"), nct_id, citation_url(nct_id)))
    return F.concat(own, F.filter(sources, lambda s: s["source_type"] != "registry"))


def citation_lines(sources: Column) -> Column:
    """One `reference (url)` line per citation."""
    def line(s):
        linked = F.concat(s["reference"], F.lit(" ("), s["url"], F.lit(")"))
        return F.when(F.length(s["url"]) > 0, linked).otherwise(s["reference"])
    return F.array_join(F.transform(sources, line), "\n")


def export_rows(grid: DataFrame, rank: str = "rank", page_rows: int = PAGE_ROWS) -> DataFrame:
    """Spreadsheet form of ranked grid rows; `rank` counts 1, 2, ... within each result."""
    return (
        grid.withColumn("page", F.ceil(F.col(rank) / page_rows))
        .withColumn("interventions", F.array_join(F.array_distinct("interventions"), ", "))
        .withColumn("mechanism_described", F.when(F.col("mechanism_described"), "Yes").otherwise("No"))
        .withColumn("sources", citation_lines(F.col("sources")))
    )


def grid_summary(grid: DataFrame, by: list[str]) -> DataFrame:
    described = F.col("mechanism_described")
    return grid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(described).alias("mechanism_described"),
        F.count_if(~described).alias("design_only"),
        F.sum(F.size(F.array_distinct("interventions"))).alias("distinct_interventions"),
    )
