"""Composed search: hybrid, reranked, federated, grounded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from evidencia.functions.records import LEXICAL_FIELDS
from evidencia.functions.tokens import content_tokens
from evidencia.operators.dense import dense_topk
from evidencia.operators.lexical import Corpus, Matches, bm25_topk, match_terms
from evidencia.operators.ranking import OVERFETCH, reciprocal_rank_fusion, top_k
from evidencia.sizing import BROADCAST_ROWS, join_small

RERANK_CANDIDATES = 100
COMMON_SHARE = 0.30
# Words added to a query before it is put to the news corpus.
NEWS_EXPANSION = "PDUFA target action date FDA advisory committee priority review approval decision"


@dataclass
class Vectors:
    """Corpus and query vectors; `match_on` columns must be equal, `within` columns rank separately."""

    corpus: DataFrame
    queries: DataFrame
    dim: int
    match_on: tuple[str, ...] = ()
    within: tuple[str, ...] = ()

    def topk(self, k: int) -> DataFrame:
        return dense_topk(self.corpus, self.queries, k, self.dim, match_on=self.match_on, within=self.within)


def hybrid_topk(found: Matches, vectors: Vectors, k: int) -> DataFrame:
    """Lexical and dense branches over-fetch, reciprocal rank fusion keeps the best k. Conditions belong into both: see `Corpus`
    and `Vectors`."""
    within = list(found.corpus.within)
    group = [found.query_id, *within]
    dense = vectors.topk(OVERFETCH * k)
    if vectors.match_on:
        dense = top_k(dense, group, [F.desc("score"), F.asc(found.corpus.doc_id)], OVERFETCH * k)
    return reciprocal_rank_fusion([bm25_topk(found, OVERFETCH * k), dense],
                                  [*group, found.corpus.doc_id], group, k)


def with_documents(hits: DataFrame, docs: DataFrame, doc_id: str, rows: int) -> DataFrame:
    """Hits with the columns of their documents. There are at most `rows` hits, by the number of queries and of results for each;
    where that is few enough the hits are broadcast, and the corpus is not shuffled."""
    width = len(hits.columns) + 1
    return docs.join(F.broadcast(hits) if rows * width <= BROADCAST_ROWS else hits, doc_id)


def has_lexical_index(corpus: str) -> bool:
    return corpus in LEXICAL_FIELDS


def search_corpus(name: str, corpus: Corpus, queries: DataFrame, vectors: Vectors, k: int) -> DataFrame:
    """Hybrid search where the corpus has a lexical index, dense search where it has none."""
    if has_lexical_index(name):
        hits = hybrid_topk(match_terms(corpus, queries), vectors, k)
    else:
        hits = vectors.topk(k)
    return hits.withColumn("corpus", F.lit(name))


def rerank(candidates: DataFrame, scores: DataFrame, score: str, query_id: str, doc_id: str, k: int,
           enabled: bool = True) -> DataFrame:
    """Reorder fused candidates by a score column (missing = 0) and keep k; disabled: fusion order."""
    if not enabled:
        return candidates.filter(F.col("rank") <= k)
    scored = candidates.select(query_id, doc_id, F.col("rank").alias("fused_rank")).join(
        scores.select(query_id, doc_id, score), [query_id, doc_id], "left").fillna(0.0, [score])
    return top_k(scored, [query_id], [F.desc(score), F.asc("fused_rank"), F.asc(doc_id)], k)


def content_terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (row, content token)."""
    return rows.select(key, F.explode(content_tokens(F.col(text))).alias("token"))


def common_terms(docs: DataFrame, doc_id: str, text: str, share: float = COMMON_SHARE) -> DataFrame:
    """Tokens in at least `share` of the whole corpus. At most 1/share times the mean number of
    distinct tokens per document can qualify, however large the corpus is."""
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = content_terms(docs, doc_id, text).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.filter(F.col("df") / total >= share)


def distinctive_terms(rows: DataFrame, key: str, text: str, common: DataFrame) -> DataFrame:
    """Content tokens without the common ones. Their number is bounded by their very definition (see
    common_terms), so they are broadcast without being counted first."""
    return join_small(content_terms(rows, key, text), common.select("token"), ["token"], "left_anti", small=True)


def grounded(queries: DataFrame, query_id: str, query: str, hits: DataFrame, haystack: str,
             common: DataFrame) -> DataFrame:
    """(query, grounded): does any hit's text contain, as a substring, any distinctive query token?

    A query without distinctive tokens counts as grounded. Tokens are gathered per query, a list no
    longer than the query itself.
    """
    tokens = distinctive_terms(queries, query_id, query, common).groupBy(query_id).agg(
        F.collect_set("token").alias("_tokens"))
    asked = queries.select(query_id).join(tokens, query_id, "left")
    seen = hits.join(tokens, query_id).groupBy(query_id).agg(F.bool_or(F.exists(
        "_tokens", lambda t: F.contains(F.lower(haystack), t))).alias("_seen"))
    return asked.join(seen, query_id, "left").select(
        query_id, (F.col("_tokens").isNull() | F.coalesce("_seen", F.lit(False))).alias("grounded"))


def leak_audit(hits: DataFrame, unfiltered: DataFrame, asked: DataFrame, labels: DataFrame) -> DataFrame:
    """Per query: rows returned, rows that violate the filter, unfiltered rows the filter kept out.

    asked {query_id, asked}; labels {doc_id, label}.
    """
    def violations(rows, out):
        seen = rows.join(labels, "doc_id").join(asked, "query_id")
        return seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"),
                                            F.count_if(F.col("label") != F.col("asked")).alias(out))
    return violations(hits, "leaks").join(violations(unfiltered, "excluded").drop("returned"), "query_id")
