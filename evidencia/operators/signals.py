"""Adverse-event disproportionality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.functions.numbers import round_half_up
from evidencia.operators.ranking import top_k

# Reaction terms that describe the report rather than a reaction.
NOISE_TERMS = ["OFF LABEL USE", "DRUG INEFFECTIVE", "PRODUCT DOSE OMISSION ISSUE", "DEATH",
               "MALIGNANT NEOPLASM PROGRESSION", "DISEASE PROGRESSION"]
Z95 = 1.96
MIN_REPORTS = 3


def report_counts(reports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From rows {report, drug, reaction}: pair, drug, reaction and overall counts of distinct reports."""
    def distinct_reports(*by):
        return reports.groupBy(*by).agg(F.count_distinct("report").alias("n"))
    return (distinct_reports("drug", "reaction"), distinct_reports("drug"), distinct_reports("reaction"),
            reports.agg(F.count_distinct("report").alias("n")))


def odds_ratio(a, drug_total, reaction_total, overall):
    """(ror, lower 95 % bound, signal); b, c, d are floored at 1 and rounding comes last."""
    def floored(x):
        return F.greatest(x, F.lit(1)).cast("double")
    ad = a.cast("double")
    b, c = floored(drug_total - a), floored(reaction_total - a)
    d = floored(overall - drug_total - reaction_total + a)
    ror = ad * d / (b * c)
    low = F.exp(F.log(ror) - Z95 * F.sqrt(1 / ad + 1 / b + 1 / c + 1 / d))
    none = a == 0
    return (F.when(none, F.lit(0.0)).otherwise(round_half_up(ror, 2)),
            F.when(none, F.lit(0.0)).otherwise(round_half_up(low, 2)),
            ~none & (a >= MIN_REPORTS) & (low > 1.0))


def ror_signals(reports: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Reporting odds ratio of the observed (drug, reaction) pairs, or of the asked `pairs`."""
    observed, drugs, reactions, overall = report_counts(reports)
    observed = observed.withColumnRenamed("n", "a")
    rows = observed if pairs is None else pairs.join(observed, ["drug", "reaction"], "left").fillna(0, ["a"])
    rows = (
        rows.join(drugs.withColumnRenamed("n", "drug_total"), "drug")
        .join(reactions.withColumnRenamed("n", "reaction_total"), "reaction", "left")
        .fillna(0, ["reaction_total"])
        .withColumn("overall", overall.scalar())
    )
    ror, low, signal = odds_ratio(*[F.col(c) for c in ("a", "drug_total", "reaction_total", "overall")])
    return rows.select("drug", "reaction", "a", ror.alias("ror"), low.alias("ci95_low"), signal.alias("signal"))


def top_reactions(reports: DataFrame, noise: list[str] | None = None, listed: int = 25, kept: int = 8) -> DataFrame:
    """Per drug the `listed` most reported reactions, without noise terms, cut to `kept`."""
    counts = report_counts(reports)[0]
    order = [F.desc("n"), F.asc("reaction")]
    ranked = top_k(counts, ["drug"], order, listed, "_listed")
    real = ranked.filter(~F.col("reaction").isin(NOISE_TERMS if noise is None else noise))
    return top_k(real, ["drug"], order, kept).select("drug", "reaction", F.col("n").alias("reports"), F.col("rank").cast("bigint").alias("rank"))
