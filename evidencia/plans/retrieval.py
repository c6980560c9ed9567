"""Search queries: documents are the corpus, benchmark texts the queries, embeddings the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.functions.numbers import round_half_up
from evidencia.functions.records import lexical_text
from evidencia.functions.tokens import BOILERPLATE_WORDS, ENGLISH_STOP_WORDS, sql_list
from evidencia.operators import evaluation, evidence, search
from evidencia.operators.changes import dedupe
from evidencia.operators.dense import dense_topk
from evidencia.operators.lexical import Corpus, Matches, bm25_topk, match_terms, term_coverage
from evidencia.operators.ranking import envelope, top_k
from evidencia.operators.embedding import MODEL_DIM, hashed_vectors, model_vectors, word_model
from evidencia.operators.graph import attach_evidence, entity_lookup
from evidencia.plans.graph import (
    LOOKUP, MENTIONS, drug_graph, entities, item_names, name_mentions, synonyms,
)
from evidencia.plans.registry import Tables, query
from evidencia.sizing import spread
from evidencia.sources.store import written

DIM = 64
K = 10


def text_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def text_corpus(t: Tables, *within: str) -> Corpus:
    return Corpus(spread(t.documents.select("doc_id", "text", *within)), within=tuple(within))


def vector_corpus(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_queries(t: Tables) -> DataFrame:
    """Query i carries the vector with the same number."""
    return t.benchmark.select("item_id").join(
        t.embeddings, F.col("item_id") == F.col("vec_id")
    ).select(F.col("item_id").alias("query_id"), "embedding", "label")


def vectors(t: Tables, **options) -> search.Vectors:
    return search.Vectors(vector_corpus(t), vector_queries(t), DIM, **options)


def lexical(t: Tables) -> Matches:
    return match_terms(text_corpus(t), text_queries(t))


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
STOP = sql_list(ENGLISH_STOP_WORDS)
QUERIES = "select item_id as query_id, text from benchmark"


def bm25_sql(queries: str = QUERIES, docs: str = "documents", by: str | None = None) -> str:
    """CTEs words, qterms, tf, idf and bm25 over `docs`; `by` names a column searched separately."""
    c = f"{by}, " if by else ""
    j = f"({by}, term)" if by else "(term)"
    n = f"join n using ({by})" if by else ", n"
    q = f"join qterms using ({by + ', ' if by and by in queries.split('from')[0] else ''}term)"
    return f"""
words as (select {c}doc_id, list_filter({WORDS}, lambda w: w not in ({STOP})) as w from {docs}),
qterms as (select distinct * exclude (text, u), unnest(u) as term from (select *, list_filter({WORDS}, lambda w: w not in ({STOP})) as u from ({queries}))),
tf as (select {c}doc_id, term, len as length, count(*) as tf from (select {c}doc_id, len(w) as len, unnest(w) as term from words)
  where term in (select term from qterms) group by all),
n as (select {c}count(*) as n_docs, sum(len(w))::double / count(*) as mean_length from words {'group by ' + by if by else ''}),
idf as (select {c}term, ln(1.0::double + (n_docs - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from tf {n} group by {c}term, n_docs),
bm25 as (select query_id, {c}doc_id,
    floor(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) * 1000000.0 + 0.5) / 1000000.0 as score
  from tf join idf using {j} {q} {n} group by query_id, {c}doc_id)
"""


BM25 = bm25_sql()
COSINE = "floor(list_cosine_similarity(q.embedding::double[], c.embedding::double[]) * 1000000.0 + 0.5) / 1000000.0"
DENSE = f"""
dense as (
  select q.vec_id as query_id, q.label as query_label, c.vec_id as doc_id, c.label, {COSINE} as score
  from embeddings q join benchmark b on b.item_id = q.vec_id, embeddings c)
"""


def ranked(source: str, k: int, name: str, by: str = "query_id") -> str:
    return f"""
{name} as (
  select * from (select *, row_number() over (partition by {by} order by score desc, doc_id) as rank from {source})
  where rank <= {k})"""


def fused(a: str, b: str, k: int, name: str = "fused", by: str = "query_id") -> str:
    return f"""
rrf as (
  select {by}, doc_id, floor(sum(1.0::double / (60 + rank)) * 1000000.0 + 0.5) / 1000000.0 as score
  from (select {by}, doc_id, rank from {a} union all select {by}, doc_id, rank from {b})
  group by {by}, doc_id), {ranked('rrf', k, name, by)}"""


def hybrid_sql(k: int) -> str:
    return f"{BM25}, {DENSE}, {ranked('bm25', 3 * k, 'lex')}, {ranked('dense', 3 * k, 'den')}, {fused('lex', 'den', k)}"


FINAL = "select query_id, doc_id, rank::bigint as rank, floor(score * 10000.0 + 0.5) / 10000.0 as score from "


def shown(df: DataFrame, *extra: str) -> DataFrame:
    """Rank and the score rounded for display."""
    return df.select("query_id", *extra, "doc_id", F.col("rank").cast("bigint").alias("rank"),
                     round_half_up(F.col("score"), 4).alias("score"))


@query(f"with {DENSE}, {ranked('dense', K, 'best')} {FINAL} best", name="dense_topk")
def dense_topk_query(t: Tables) -> DataFrame:
    return shown(vectors(t).topk(K))


@query(f"with {BM25}, {ranked('bm25', K, 'best')} {FINAL} best", name="bm25_topk")
def bm25_topk_query(t: Tables) -> DataFrame:
    return shown(bm25_topk(lexical(t), K))


def hybrid(t: Tables, k: int, found: Matches | None = None) -> DataFrame:
    return search.hybrid_topk(found or lexical(t), vectors(t), k)


@query(f"with {hybrid_sql(K)} {FINAL} fused")
def hybrid_rrf(t: Tables) -> DataFrame:
    return shown(hybrid(t, K))


@query(f"""with {hybrid_sql(K)}
select item_id as query_id, count(doc_id) as returned, count(doc_id) > 0 as has_results, coalesce(string_agg(doc_id::varchar, ',' order by rank), '') as rows
from benchmark left join fused on query_id = item_id group by item_id""")
def result_envelope(t: Tables) -> DataFrame:
    packed = envelope(text_queries(t), hybrid(t, K), "query_id", ["doc_id", "score"])
    ids = F.array_join(F.transform("rows", lambda r: r["doc_id"].cast("string")), ",")
    return packed.select("query_id", "returned", "has_results", F.coalesce(ids, F.lit("")).alias("rows"))


# filters -------------------------------------------------------------------------------------
ALLOWED = "(query_label, (query_label + 3) % 10)"


def filtered(t: Tables, k: int) -> DataFrame:
    """must: language en; should: the label of the query, or the one three further."""
    tag = F.col("label").cast("string")
    labels = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.array(tag).alias("tags"))
    docs = t.documents.select("doc_id", "text", "lang")
    corpus = Corpus(spread(docs.join(labels, "doc_id", "left")), must=F.col("lang") == "en", tags="tags")
    allowed = F.array("label", ((F.col("label") + 3) % 10).cast("int"))
    wishes = vector_queries(t).select("query_id", "embedding", allowed.alias("allowed"))
    near = search.Vectors(vector_corpus(t).join(docs.filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi"),
                          wishes.select("query_id", "embedding", F.explode("allowed").alias("label")), DIM, ("label",))
    asked = text_queries(t).join(wishes.select("query_id", "allowed"), "query_id", "left").withColumn(
        "allowed", F.coalesce(F.col("allowed").cast("array<string>"), F.array().cast("array<string>")))
    return search.hybrid_topk(match_terms(corpus, asked, asked="allowed"), near, k)


@query(f"""with {BM25}, {DENSE},
lab as (select vec_id as query_id, label as query_label from embeddings),
lx as (select b.query_id, b.doc_id, b.score from bm25 b join lab l using (query_id) join embeddings e on e.vec_id = b.doc_id
  join documents d on d.doc_id = b.doc_id where d.lang = 'en' and e.label in {ALLOWED}),
dx as (select query_id, doc_id, score from dense join documents using (doc_id) where lang = 'en' and label in {ALLOWED}),
{ranked('lx', 3 * K, 'lex')}, {ranked('dx', 3 * K, 'den')}, {fused('lex', 'den', K)} {FINAL} fused""")
def filtered_topk(t: Tables) -> DataFrame:
    return shown(filtered(t, K))


@query(f"""with {DENSE}, f as (select * from dense where label = query_label), {ranked('f', K, 'hits')}, {ranked('dense', K, 'free')}
select h.query_id, h.returned, h.leaks, x.excluded from
 (select query_id, count(*) as returned, count(*) filter (label <> query_label) as leaks from hits group by 1) h
 join (select query_id, count(*) filter (label <> query_label) as excluded from free group by 1) x using (query_id)""")
def leak_audit(t: Tables) -> DataFrame:
    """Filtered hits that break the filter (none may), and how many hits the filter kept out."""
    label = vector_queries(t).select("query_id", F.col("label").alias("asked"))
    labels = vector_corpus(t).select("doc_id", "label")
    hits = vectors(t, match_on=("label",)).topk(K)
    return search.leak_audit(hits, vectors(t).topk(K), label, labels)


# several corpora -----------------------------------------------------------------------------
LIMITS = {"src0": 6, "src1": 3}
LIMIT_SQL = "case source when 'src0' then 6 when 'src1' then 3 else 2 end"


def corpus_limit():
    return F.when(F.col("source") == "src0", 6).when(F.col("source") == "src1", 3).otherwise(2)


def sourced_vectors(t: Tables) -> search.Vectors:
    near = vector_corpus(t).join(t.documents.select("doc_id", "source"), "doc_id")
    return search.Vectors(near, vector_queries(t), DIM, within=("source",))


FEDERATED = f"""
dsrc as (select query_id, source, doc_id, score from dense join documents using (doc_id)),
{ranked('bm25', 18, 'lex', 'query_id, source')}, {ranked('dsrc', 18, 'den', 'query_id, source')}, {fused('lex', 'den', 6, 'fused', 'query_id, source')}"""


@query(f"""with {bm25_sql(by='source')}, {DENSE}, {FEDERATED}
select query_id, source, doc_id, rank::bigint as rank, floor(score * 10000.0 + 0.5) / 10000.0 as score from fused where rank <= {LIMIT_SQL}""")
def federated_topk(t: Tables) -> DataFrame:
    """Every query against every source, each with its own statistics and its own limit."""
    found = match_terms(text_corpus(t, "source"), text_queries(t))
    hits = search.hybrid_topk(found, sourced_vectors(t), max(LIMITS.values()))
    return shown(hits.filter(F.col("rank") <= corpus_limit()), "source")


EXPANSION = "therin thand eronth whthe"


@query(f"""with {bm25_sql(queries="select b.item_id as query_id, s.source, b.text || case s.source when 'src0' then ' " + EXPANSION + "' when 'src1' then ' " + search.NEWS_EXPANSION + "' else '' end as text from benchmark b, (select distinct source from documents) s", by='source')},
{ranked('bm25', 3, 'best', 'query_id, source')}
select query_id, source, doc_id, rank::bigint as rank, floor(score * 10000.0 + 0.5) / 10000.0 as score from best""")
def expanded_topk(t: Tables) -> DataFrame:
    """One source gets extra words appended to every query."""
    words = {"src0": EXPANSION, "src1": search.NEWS_EXPANSION}
    return shown(bm25_topk(match_terms(text_corpus(t, "source"), text_queries(t), expansions=words), 3), "source")


@query(f"""with {bm25_sql(docs="(select * from documents where lang = 'en')")}, {DENSE},
da as (select query_id, doc_id, score from dense join documents using (doc_id) where lang = 'en'),
db as (select query_id, doc_id, score from dense join documents using (doc_id) where lang <> 'en'),
{ranked('bm25', 15, 'lex')}, {ranked('da', 15, 'den')}, {fused('lex', 'den', 5)}, {ranked('db', 5, 'other')}
select query_id, 'literature' as corpus, doc_id, rank::bigint as rank, floor(score * 10000.0 + 0.5) / 10000.0 as score from fused
union all select query_id, 'news', doc_id, rank::bigint, floor(score * 10000.0 + 0.5) / 10000.0 from other""")
def dense_fallback(t: Tables) -> DataFrame:
    """English documents stand for a corpus with a lexical index, the others for one without."""
    docs = spread(t.documents.select("doc_id", "text", "lang"))
    tagged = vector_corpus(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    parts = []
    for name, keep in (("literature", "lang = 'en'"), ("news", "lang <> 'en'")):
        near = search.Vectors(tagged.filter(keep), vector_queries(t), DIM)
        hits = search.search_corpus(name, Corpus(docs.filter(keep)), text_queries(t), near, 5)
        parts.append(shown(hits, "corpus"))
    return parts[0].unionByName(parts[1])


# reranking and grounding ---------------------------------------------------------------------
def coverage_sql(k: int) -> str:
    return f"""
allidf as (select query_id, sum(idf) as all_idf from qterms join idf using (term) group by 1),
cov as (select query_id, doc_id, floor(sum(idf) / all_idf * 1000000.0 + 0.5) / 1000000.0 as coverage
  from tf join idf using (term) join qterms using (term) join allidf using (query_id) group by query_id, doc_id, all_idf),
rr as (select query_id, doc_id, rank as fused_rank, coalesce(coverage, 0.0::double) as score from fused left join cov using (query_id, doc_id)),
best as (select * from (select *, row_number() over (partition by query_id order by score desc, fused_rank, doc_id) as rank from rr) where rank <= {k})"""


def reranked(t: Tables, k: int) -> DataFrame:
    found, many = lexical(t), max(k, search.RERANK_CANDIDATES)
    pool = written(hybrid(t, many, found), "pool")
    return search.rerank(pool, term_coverage(found, pool, many), "coverage", "query_id", "doc_id", k).withColumnRenamed("coverage", "score")


RERANKED = f"{hybrid_sql(search.RERANK_CANDIDATES)}, {coverage_sql(K)}"


@query(f"with {RERANKED} {FINAL} best")
def rerank_topk(t: Tables) -> DataFrame:
    return shown(reranked(t, K))


COMMON = 0.10  # the default share of 0.30 selects nothing in these texts
CONTENT = f"list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9-]+')), lambda w: length(w) >= 5 and w not in ({sql_list(BOILERPLATE_WORDS)}))"
COMMON_SQL = f"""
dtok as (select doc_id, unnest({CONTENT}) as token from documents),
common as (select token, count(*) as df from dtok group by 1 having count(*)::double / (select count(*) from documents) >= {COMMON})"""
GROUNDED = f"""
{COMMON_SQL},
qtok as (select item_id as query_id, token from (select item_id, unnest({CONTENT}) as token from benchmark) where token not in (select token from common)),
ground as (select item_id as query_id, not exists (select 1 from qtok where query_id = item_id)
   or exists (select 1 from best b join documents d on d.doc_id = b.doc_id join qtok q on q.query_id = b.query_id where b.query_id = item_id and contains(lower(d.text), token)) as grounded
  from benchmark)"""


@query(f"with {COMMON_SQL} select token, df from common")
def common_terms(t: Tables) -> DataFrame:
    return search.common_terms(spread(t.documents.select("doc_id", "text")), "doc_id", "text", COMMON)


@query(f"with {COMMON_SQL} select doc_id, token from dtok where token not in (select token from common)")
def content_tokens(t: Tables) -> DataFrame:
    docs = spread(t.documents.select("doc_id", "text"))
    return search.distinctive_terms(docs, "doc_id", "text", search.common_terms(docs, "doc_id", "text", COMMON))


def grounding(t: Tables, seen: DataFrame) -> DataFrame:
    """seen {query_id, text}: the texts of the hits."""
    common = search.common_terms(spread(t.documents.select("doc_id", "text")), "doc_id", "text", COMMON)
    return search.grounded(text_queries(t), "query_id", "query", seen, "text", common)


@query(f"with {BM25}, {ranked('bm25', K, 'best')}, {GROUNDED} select query_id, grounded from ground")
def grounded(t: Tables) -> DataFrame:
    found = lexical(t)
    hits = bm25_topk(found, K).select("query_id", "doc_id")
    return grounding(t, search.with_documents(hits, t.documents.select("doc_id", "text"), "doc_id", found.n_queries * K))


# search fallback for unknown entities ----------------------------------------------------------
FALLBACK = "select entity as query_id, entity as text from missing"


@query(f"""with {LOOKUP}, asked as (select entity from ent union select text from benchmark),
missing as (select entity from asked where entity not in (select entity from lookup)),
{bm25_sql(FALLBACK)}, {ranked('bm25', 5, 'best')}, {COMMON_SQL},
qtok as (select entity, token from (select entity, unnest({CONTENT.replace('text', 'entity')}) as token from missing) where token not in (select token from common)),
good as (select distinct query_id from best b where not exists (select 1 from qtok where entity = query_id)
   or exists (select 1 from best c join documents d on d.doc_id = c.doc_id join qtok q on q.entity = c.query_id where c.query_id = b.query_id and contains(lower(d.text), token)))
select entity, 'knowledge_graph' as origin, trial as item, rank::bigint as rank from lookup
union all select query_id, 'vector_search_fallback', doc_id::varchar, rank::bigint from best where query_id in (select query_id from good)""")
def lookup_fallback(t: Tables) -> DataFrame:
    """Entities the graph does not know are searched in the texts and kept only if grounded."""
    asked = entities(t).union(t.benchmark.select("text")).distinct()
    known = written(entity_lookup(drug_graph(t), synonyms(t), asked), "known")
    missing = written(asked.join(known.select("entity").distinct(), "entity", "left_anti").select(
        F.col("entity").alias("query_id"), F.col("entity").alias("query")), "missing")
    docs = spread(t.documents.select("doc_id", "text"))
    found = match_terms(Corpus(docs), missing)
    hits = written(bm25_topk(found, 5), "hits")
    common = search.common_terms(docs, "doc_id", "text", COMMON)
    seen = search.with_documents(hits.select("query_id", "doc_id"), docs, "doc_id", found.n_queries * 5)
    good = search.grounded(missing, "query_id", "query", seen, "text", common).filter("grounded")
    kept = hits.join(good, "query_id", "left_semi")
    return known.select("entity", "origin", F.col("trial").alias("item"), F.col("rank").cast("bigint").alias("rank")).unionByName(
        kept.select(F.col("query_id").alias("entity"), F.lit("vector_search_fallback").alias("origin"),
                    F.col("doc_id").cast("string").alias("item"), F.col("rank").cast("bigint").alias("rank")))


# quality -----------------------------------------------------------------------------------------
def golden(t: Tables) -> DataFrame:
    """Documents that contain a three-word name of the item, for items with 1 to 15 of them."""
    pairs = attach_evidence(item_names(t), name_mentions(t), "entry", "item_id", "doc_id")
    sizes = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).filter("n between 1 and 15")
    return pairs.join(sizes, "item_id").select(F.col("item_id").alias("query_id"), "doc_id")


EVAL = f"""{MENTIONS},
pairs as (select distinct item_id as query_id, doc_id from names join found using (entry)),
gold as (select * from pairs where query_id in (select query_id from pairs group by 1 having count(*) between 1 and 15))"""


def eval_sql(hits: str, tag: str) -> str:
    return f"""
pq{tag} as (select g.query_id, count(*) as expected, count(h.doc_id) as found from gold g left join {hits} h on h.query_id = g.query_id and h.doc_id = g.doc_id group by 1),
sm{tag} as (select count(*) as queries, floor(sum(floor(found::double / expected * 1000000.0 + 0.5)) / count(*) / 1000000.0 * 10000.0 + 0.5) / 10000.0 as mean_recall,
   floor(median(found::double / expected) * 10000.0 + 0.5) / 10000.0 as median_recall, floor(count(*) filter (found > 0)::double / count(*) * 10000.0 + 0.5) / 10000.0 as hit_rate,
   count(*) filter (found = 0) as zero_recall_queries from pq{tag})"""


@query(f"with {hybrid_sql(20)}, {EVAL}, {eval_sql('fused', '')} select * from sm")
def retrieval_eval(t: Tables) -> DataFrame:
    return evaluation.retrieval_summary(evaluation.recall(golden(t), hybrid(t, 20), "query_id", "doc_id"))


@query(f"""with {hybrid_sql(20)}, {EVAL}, {eval_sql('fused', '1')}, {ranked('dense', 20, 'dense20')}, {eval_sql('dense20', '0')}
select 'mean_recall' as metric, a.mean_recall as value, b.mean_recall as baseline, a.mean_recall >= b.mean_recall - 0.05::double as passed from sm1 a, sm0 b
union all select 'hit_rate', a.hit_rate, b.hit_rate, a.hit_rate >= b.hit_rate - 0.05::double from sm1 a, sm0 b""")
def eval_gate(t: Tables) -> DataFrame:
    """Hybrid search against dense search as the baseline."""
    gold = golden(t)
    now = evaluation.retrieval_summary(evaluation.recall(gold, hybrid(t, 20), "query_id", "doc_id"))
    before = evaluation.retrieval_summary(evaluation.recall(gold, vectors(t).topk(20), "query_id", "doc_id"))
    return evaluation.gate(evaluation.metric_rows(now), evaluation.metric_rows(before))


@query("""
select doc_id, concat_ws(chr(10), 'PMC' || doc_id, case when n_chars % 2 = 0 then 'Title ' || lang end, source, text) as literature,
  concat_ws(chr(10), 'BLA' || doc_id, source, case when lang <> 'en' then lang end, text) as letters from documents where text <> ''""")
def search_text(t: Tables) -> DataFrame:
    """The lexical text of a row in two corpora with different fields."""
    key = F.col("doc_id").cast("string")
    text = {"text": F.col("text")}
    literature = lexical_text("literature", {"pmcid": F.concat(F.lit("PMC"), key), "journal": F.col("source"),
                                             "title": F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("Title "), "lang")), **text})
    letters = lexical_text("letters", {"application_numbers": F.concat(F.lit("BLA"), key), "company_name": F.col("source"),
                                       "letter_type": F.when(F.col("lang") != "en", F.col("lang")).otherwise(""), **text})
    return t.documents.filter("text <> ''").select("doc_id", literature.alias("literature"), letters.alias("letters"))


EMBED_DIM = 256


def slots_sql(words: str, dim: int) -> str:
    """Counts of hashed words per document."""
    return f"""
slots as (select doc_id, ('0x' || substr(md5(w), 1, 8))::bigint % {dim} as slot, count(*) as tf from (select doc_id, unnest({words}) as w from documents) group by all)"""


def long_vectors(vectors: DataFrame) -> DataFrame:
    """The places of vectors that are not 0."""
    cells = vectors.select("doc_id", F.posexplode("embedding").alias("slot", "value"))
    return cells.select("doc_id", "slot", round_half_up(F.col("value").cast("double"), 5).alias("value")).filter("value <> 0")


@query(f"""with {slots_sql(f"list_filter({WORDS}, lambda w: w not in ({STOP}))", EMBED_DIM)},
idf as (select slot, ln(((select count(*) from documents) + 1)::double / (count(*) + 1)) as idf from slots group by slot),
w as (select doc_id, slot, tf * idf as value from slots join idf using (slot)),
n as (select doc_id, sqrt(sum(value * value)) as norm from w group by doc_id),
v as (select doc_id, slot::integer as slot, floor(value / norm * 100000.0 + 0.5) / 100000.0 as value from w join n using (doc_id) where norm > 0)
select * from v where value <> 0""")
def hash_embed(t: Tables) -> DataFrame:
    """Hashed, idf-weighted, unit-length vectors of the documents."""
    docs = spread(t.documents.select("doc_id", "text"))
    return long_vectors(hashed_vectors(docs, "text", EMBED_DIM).select("doc_id", "embedding"))


@query(f"""with {slots_sql("regexp_extract_all(lower(text), '[a-z0-9]+')", MODEL_DIM)},
n as (select doc_id, sqrt(sum(tf)) as norm from slots group by doc_id)
select doc_id, slot::integer as slot, floor((sqrt(tf) / norm)::float::double * 100000.0 + 0.5) / 100000.0 as value from slots join n using (doc_id)""")
def model_embed(t: Tables) -> DataFrame:
    """Vectors of a model that is loaded once per worker."""
    return long_vectors(model_vectors(t.documents.select("doc_id", "text"), "text", word_model).select("doc_id", "embedding"))


# the evidence table ------------------------------------------------------------------------------
@query(f"""with {RERANKED}, {GROUNDED}, {MENTIONS},
ev as (select item_id as query_id, doc_id, count(*) as evidence from names join found using (entry) group by all),
g as (select * from (select *, row_number() over (partition by query_id order by evidence desc, doc_id) as rank from ev) where rank <= {K}),
pool as (select query_id, doc_id, 'search' as origin, rank as arrival, score from best
  union all select query_id, doc_id, 'mention', 1000 + rank, evidence::double from g),
one as (select * from (select *, row_number() over (partition by query_id, doc_id order by arrival) as f from pool) where f = 1)
select query_id, doc_id, origin, arrival::bigint as arrival, floor(score * 10000.0 + 0.5) / 10000.0 as score, grounded, coalesce(evidence, 0) as evidence,
  printf('NCT%08d', doc_id) as nct_id, source as sponsor, lang as phase,
  printf('NCT%08d', doc_id) || ' (https://clinicaltrials.gov/study/' || printf('NCT%08d', doc_id) || ')' || chr(10) || 'document ' || doc_id as sources,
  substr(text, 1, 1200) as summary, text
from one join ground using (query_id) join documents using (doc_id) left join ev using (query_id, doc_id)
where trim(source) <> '' and trim(lang) <> '' """)
def smart_table(t: Tables) -> DataFrame:
    """The evidence table of every query: search, rerank, ground, pool, attach evidence, gate, cite."""
    best = written(reranked(t, K).select("query_id", "doc_id", "rank", "score"), "best")
    evidence_rows = written(attach_evidence(item_names(t), name_mentions(t), "entry", "item_id", "doc_id").select(
        F.col("item_id").alias("query_id"), "doc_id", F.col("matches").alias("evidence")), "evidence")
    named = top_k(evidence_rows, ["query_id"], [F.desc("evidence"), F.asc("doc_id")], K)
    pool = best.select("query_id", "doc_id", F.lit("search").alias("origin"), F.col("rank").cast("bigint").alias("arrival"), "score").unionByName(
        named.select("query_id", "doc_id", F.lit("mention").alias("origin"), (1000 + F.col("rank")).cast("bigint").alias("arrival"),
                     F.col("evidence").cast("double").alias("score")))
    once = dedupe(pool, ["query_id", "doc_id"], ["arrival"]).join(evidence_rows, ["query_id", "doc_id"], "left").fillna(0, ["evidence"])
    docs = t.documents.select("doc_id", "text", F.col("source").alias("sponsor"), F.col("lang").alias("phase"))
    queries = t.benchmark.agg(F.count(F.lit(1))).first()[0]
    # The only join with the documents: grounding and the columns of the table read its rows.
    rows = written(search.with_documents(once, docs, "doc_id", queries * 2 * K), "rows")
    rows = rows.join(grounding(t, rows.filter("origin = 'search'")), "query_id")
    nct_id = F.format_string("NCT%08d", F.col("doc_id"))
    rows = rows.withColumn("nct_id", nct_id)
    accepted, _ = evidence.gate(rows, evidence.acceptable(F.col("nct_id"), nct_id, F.col("phase"), F.col("sponsor")))
    given = F.array(evidence.citation(F.lit("registry"), F.lit("unchecked"), F.lit("")),
                    evidence.citation(F.lit("document"), F.concat(F.lit("document "), F.col("doc_id").cast("string")), F.lit("")))
    cited = accepted.withColumn("sources", evidence.with_registry_citation(F.col("nct_id"), given))
    return cited.select("query_id", "doc_id", "origin", "arrival", round_half_up(F.col("score"), 4).alias("score"), "grounded", "evidence",
                        "nct_id", "sponsor", "phase", evidence.citation_lines(F.col("sources")).alias("sources"),
                        F.substring("text", 1, 1200).alias("summary"), "text")
