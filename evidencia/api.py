"""Entry points: each takes a table of requests and answers all of them in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidencia.functions.codes import normalize_phase
from evidencia.functions.records import LEXICAL_FIELDS, lexical_text
from evidencia.operators import changes, evidence, exclusivity as loe, graph, landscape as grid, search, signals, statistics, timeline
from evidencia.operators.lexical import Corpus, match_terms, term_coverage
from evidencia.operators.ranking import top_k
from evidencia.sources.store import written

TRIAL_LIMIT = 60


def corpus_text(name: str, rows: DataFrame, doc_id: str) -> Corpus:
    """The searchable form of a corpus table: list columns are joined by commas, typed interventions read
    `TYPE: name`. A field of any other type is refused, as its words would be missing from the index."""
    columns = {}
    for field in rows.schema:
        kind = field.dataType.simpleString()
        if field.name not in LEXICAL_FIELDS.get(name, ()):
            continue
        if kind == "string":
            columns[field.name] = F.col(field.name)
        elif kind == "array<string>":
            columns[field.name] = F.array_join(field.name, ", ")
        elif kind == "array<struct<type:string,name:string>>":
            columns[field.name] = F.array_join(F.transform(field.name, lambda x: F.concat_ws(": ", x["type"], x["name"])), ", ")
        else:
            raise TypeError(f"{name}.{field.name}: {kind} has no searchable form")
    text = lexical_text(name, columns)
    return Corpus(rows.select(F.col(doc_id).alias("doc_id"), text.alias("text")))


def search_trials(trials: DataFrame, vectors: search.Vectors, queries: DataFrame, limit: int = TRIAL_LIMIT,
                  rerank: bool = True) -> DataFrame:
    """trials {doc_id, text, phases}; queries {query_id, query, phase or null}: hybrid search, reranked.

    The phase of a query is a hard filter and is applied before ranking in both branches; `vectors`
    must already carry it (see search.Vectors.match_on).
    """
    asked = queries.withColumn("_phases", F.when(normalize_phase(F.col("phase")).isNotNull(), F.array(normalize_phase(F.col("phase")))))
    found = match_terms(Corpus(trials.select("doc_id", "text", "phases"), tags="phases"), asked, asked="_phases")
    many = max(limit, search.RERANK_CANDIDATES) if rerank else limit
    pool = written(search.hybrid_topk(found, vectors, many), "pool")
    return search.rerank(pool, term_coverage(found, pool, many), "coverage", "query_id", "doc_id", limit, rerank)


def lookup_entity(drugs: graph.Graph, synonyms: DataFrame, entities: DataFrame) -> DataFrame:
    return graph.entity_lookup(drugs, synonyms, entities)


def search_corpus(name: str, corpus: Corpus, vectors: search.Vectors, queries: DataFrame, limit: int) -> DataFrame:
    return search.search_corpus(name, corpus, queries, vectors, limit)


def safety_signals(reports: DataFrame, drugs: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """Signals of the asked drugs: for the asked reactions, or for each drug's most reported ones."""
    asked = drugs.select("drug").distinct()
    if reactions is not None:
        pairs = reactions.select("drug", F.upper("reaction").alias("reaction")).join(asked, "drug", "left_semi")
    else:
        pairs = signals.top_reactions(reports.join(asked, "drug", "left_semi")).select("drug", "reaction")
    return signals.ror_signals(reports, pairs)


def exclusivity(products: DataFrame, names: DataFrame) -> DataFrame:
    return loe.loe_lookup(products, "product", ["trade_name", "ingredient"], names, "name")


def trial_stats(tables: dict[str, DataFrame], statement: str, /, **values) -> DataFrame:
    """A statement of the statistics library over registry tables given by name, with values for its parameters."""
    return statistics.statistic(statement, tables, **values)


def landscape(evidence_rows: DataFrame, mechanisms: DataFrame, synonyms: DataFrame) -> DataFrame:
    return grid.landscape_matrix(grid.landscape_cells(evidence_rows, mechanisms, synonyms))


def catalysts(events: DataFrame, as_of: Column) -> DataFrame:
    """events {query, raw, drug, source}"""
    return timeline.by_period(timeline.timeline(events, "query", "raw", "drug", "source", as_of), "query", "drug", "source")


def watch_digest(entries: DataFrame, updates: DataFrame, letters: DataFrame, as_of: Column) -> DataFrame:
    return changes.watch_digest(entries, updates, letters, as_of)


def smart_table(hits: DataFrame, grounded: DataFrame, attached: DataFrame, trials: DataFrame, per_query: int = TRIAL_LIMIT) -> DataFrame:
    """Rows of the evidence table from ranked hits {query_id, doc_id, rank}, grounding flags, evidence
    counts {query_id, doc_id, evidence} and trials {doc_id, nct_id, sponsor, phase, sources}."""
    rows = changes.dedupe(hits, ["query_id", "doc_id"], ["rank"]).join(grounded, "query_id").join(
        attached, ["query_id", "doc_id"], "left").fillna(0, ["evidence"]).join(trials, "doc_id")
    kept, _ = evidence.gate(rows, evidence.acceptable(F.col("nct_id"), F.trim("nct_id"), F.col("phase"), F.col("sponsor")))
    cited = kept.withColumn("sources", evidence.with_registry_citation(F.col("nct_id"), F.col("sources")))
    return top_k(cited, ["query_id"], [F.asc("rank")], per_query, "row")
