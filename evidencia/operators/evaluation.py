"""Golden sets, retrieval quality and claim support."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.functions.numbers import round_half_up
from evidencia.functions.tokens import claim_tokens
from evidencia.operators import lexical
from evidencia.operators.ranking import top_k
from evidencia.sizing import ROWS_PER_TASK, parts_for
from evidencia.sources.store import written

# Intervention labels that name no product.
GENERIC_NAMES = ["placebo", "saline", "questionnaire", "observation", "standard of care"]
MIN_NAME = 4
SINGLE_BAND, PAIR_BAND = (2, 8), (2, 6)
EXPECTED_BAND = (2, 15)
TARGET_QUERIES = 50
SEED = "evidencia-golden"
REGRESSION_MARGIN = 0.05
MIN_OVERLAP = 0.15


def candidate_counts(occurrences: DataFrame, conditions: int | None = None) -> DataFrame:
    """{kind, drug, condition, n} of informative drugs and (drug, condition) pairs inside their bands.

    occurrences {trial, drug, conditions array}; of each trial all conditions count, or the first `conditions` of them.
    """
    counted = F.col("conditions") if conditions is None else F.slice("conditions", 1, conditions)
    rows = occurrences.filter((F.length("drug") >= MIN_NAME) & ~F.lower("drug").isin(GENERIC_NAMES))
    single = rows.groupBy("drug").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(*SINGLE_BAND))
    pair = (
        rows.select("drug", F.explode(counted).alias("condition"))
        .groupBy("drug", "condition").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(*PAIR_BAND))
    )
    return single.select(F.lit("single").alias("kind"), "drug", F.lit(None).cast("string").alias("condition"), "n").unionByName(
        pair.select(F.lit("pair").alias("kind"), "drug", "condition", "n"))


def golden_set(occurrences: DataFrame, target: int = TARGET_QUERIES, seed: str = SEED) -> DataFrame:
    """Golden queries with their exact expected trials: half drug-and-condition pairs, the rest drugs.

    Order is by a seeded hash; a drug is used once. Counts are taken first, so lists are gathered
    only for the chosen queries and hold at most 15 ids.
    """
    rows = written(occurrences.select("trial", "drug", "conditions"), "occurrences")
    # All counts below are by drug, or by drug and more: they stay in the tasks to which its rows are dealt.
    dealt = rows.repartition(parts_for(rows, F.lit(1), ROWS_PER_TASK), "drug")
    edges = dealt.select("trial", "drug", F.explode("conditions").alias("condition")).distinct()
    candidates = candidate_counts(dealt)
    in_band = F.col("expected_n").between(*EXPECTED_BAND)
    draw = F.md5(F.concat_ws("|", F.lit(seed), "drug", F.coalesce("condition", F.lit(""))))
    pair_sizes = edges.groupBy("drug", "condition").agg(F.count(F.lit(1)).alias("expected_n")).filter(in_band)
    pairs = candidates.filter("kind = 'pair'").join(pair_sizes, ["drug", "condition"]).withColumn("draw", draw)
    pairs = top_k(pairs, ["drug"], [F.asc("draw")], 1, "_first").orderBy("draw").limit(target // 2)
    pairs = pairs.select("drug", "condition", "draw")
    drug_sizes = edges.groupBy("drug").agg(F.count_distinct("trial").alias("expected_n")).filter(in_band)
    singles = candidates.filter("kind = 'single'").join(drug_sizes, "drug").join(pairs.select("drug"), "drug", "left_anti")
    singles = singles.withColumn("draw", draw).orderBy("draw").limit(target - target // 2).select("drug", "condition", "draw")
    chosen = pairs.unionByName(singles)
    text = F.when(F.col("condition").isNull(), F.concat(F.lit("Which trials study "), "drug", F.lit("?"))).otherwise(
        F.concat(F.lit("Trials of "), "drug", F.lit(" for "), "condition"))
    found = (
        rows.select("trial", "drug", F.explode("conditions").alias("condition")).join(
            F.broadcast(chosen.withColumnRenamed("condition", "asked")), "drug")
        .filter(F.col("asked").isNull() | (F.col("asked") == F.col("condition")))
        .select("drug", F.col("asked").alias("condition"), "draw", "trial").distinct()
    )
    return found.groupBy("drug", "condition", "draw").agg(F.array_sort(F.collect_list("trial")).alias("expected")).select(
        text.alias("query"), "drug", "condition", "expected")


def recall(golden: DataFrame, hits: DataFrame, query_id: str, item: str) -> DataFrame:
    """Per query: expected, found, recall and hit. golden and hits are rows (query, item)."""
    found = golden.join(hits.select(query_id, item).distinct().withColumn("_hit", F.lit(1)), [query_id, item], "left")
    return found.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found")).withColumn(
        "recall", F.col("found") / F.col("expected")).withColumn("hit", F.col("found") > 0)


def retrieval_summary(per_query: DataFrame) -> DataFrame:
    """Without a single query the recalls are null, and the hit rate, zero of zero, is NaN."""
    some = F.count(F.lit(1)) > 0
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.when(some, round_half_up(F.sum(F.floor(F.col("recall") * 1e6 + 0.5)) / F.count(F.lit(1)) / 1e6, 4)).alias("mean_recall"),
        round_half_up(F.median("recall"), 4).alias("median_recall"),
        F.when(some, round_half_up(F.count_if("hit") / F.count(F.lit(1)), 4)).otherwise(F.lit(float("nan"))).alias("hit_rate"),
        F.count_if(F.col("recall") == 0).alias("zero_recall_queries"),
    )


def metric_rows(summary: DataFrame) -> DataFrame:
    return summary.select(F.explode(F.create_map(
        F.lit("mean_recall"), F.col("mean_recall"), F.lit("hit_rate"), F.col("hit_rate"))).alias("metric", "value"))


def gate(metrics: DataFrame, baseline: DataFrame, margin: float = REGRESSION_MARGIN) -> DataFrame:
    """{metric, value, baseline, passed}: no metric may fall more than `margin` below its baseline."""
    return metrics.join(baseline.withColumnRenamed("value", "baseline"), "metric").withColumn(
        "passed", F.col("value") >= F.col("baseline") - margin)


def claim_sources(claims: DataFrame, claim_id: str, claim: str, sources: DataFrame, source_id: str, text: str,
                  minimum: float = MIN_OVERLAP) -> DataFrame:
    """Most likely source per claim: the largest share of the claim's tokens, if it reaches `minimum`. Sources are scored where they lie;
    one candidate per claim leaves a task."""
    words = claims.select(claim_id, claim_tokens(F.col(claim)).alias("_t")).select(
        claim_id, F.size("_t").cast("double").alias("scale"), F.explode("_t").alias("term")).select(
        claim_id, "term", F.lit(1.0).alias("idf"), F.lit(1.0).alias("mean_length"), F.lit(1.0).alias("bound"), "scale")
    corpus = lexical.Corpus(sources, source_id, text)
    blocks = lexical.dealt(words, claim_id, lexical.bounded, lexical.TERMS_PER_BLOCK)
    found = lexical.matches_of(lexical.tokenised(corpus, claim_tokens), blocks, corpus, claim_id, claims.schema[claim_id].dataType, {})
    best = lexical.scored_topk(found, 1, flat=True).withColumnRenamed("score", "overlap")
    return top_k(best, [claim_id], [F.desc("overlap"), F.asc(source_id)], 1, "_rank").drop("_rank").filter(
        F.col("overlap") >= minimum)


def faithfulness(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Share of supported statements. verdicts {*by, supported 0/1}."""
    return verdicts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("statements"), F.sum("supported").alias("supported"),
        round_half_up(F.sum("supported") / F.count(F.lit(1)), 4).alias("share"))


def unsupported(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("supported") == 0).drop("supported")
