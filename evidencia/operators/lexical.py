"""BM25 search for a whole table of queries at once.

A corpus is tokenised once into an index: the words of each document. Term statistics
are one aggregation over it. The weights of the query words, whose number is checked, travel with the task, and every document
is scored where it lies, query by query, as long as the largest score that its words can add up to still reaches the
task's k-th best; filters are applied before. Only the best k rows per query leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidencia.functions.numbers import round_half_up
from evidencia.functions.tokens import search_tokens
from evidencia.operators.dense import best_of, row_groups
from evidencia.operators.ranking import top_k
from evidencia.session import ship_package
from evidencia.sizing import BROADCAST_ROWS
from evidencia.sources.store import written

K1 = 1.2
B = 0.75
TOTAL = ""  # pseudo-term of every document: its statistics are the number and the total length of documents
TERMS_PER_BLOCK = 200_000  # weights of query words, about 50 bytes each, that travel with a task; more are dealt in blocks of queries
WORDS_PER_SLICE = 500_000  # words of documents scored at a time, so that a worker's arrays do not grow with the texts of a batch
MARGIN = 1e-5  # scores are rounded to six digits; a bound must miss the k-th score by more


@dataclass
class Corpus:
    """A table to search; `within` lists corpus columns that are searched and ranked separately. `must` is a condition that every
    result meets, `tags` an array column of which a query may ask one value or more. Neither changes the statistics."""

    df: DataFrame
    doc_id: str = "doc_id"
    text: str = "text"
    within: tuple[str, ...] = ()
    must: Column | None = None
    tags: str | None = None


def tokenised(corpus: Corpus, tokens: Callable[[Column], Column] = search_tokens) -> DataFrame:
    """{doc, within, words, may, tags}, written once for all passes over it; words with repeats."""
    keys = [corpus.doc_id, *corpus.within]
    may = F.coalesce(corpus.must, F.lit(False)) if corpus.must is not None else F.lit(True)
    tags = F.col(corpus.tags).cast("array<string>") if corpus.tags else F.lit(None).cast("array<string>")
    return written(corpus.df.select(*keys, may.alias("may"), tags.alias("tags"), tokens(F.col(corpus.text)).alias("words")), "index")


def query_terms(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    return queries.select(query_id, F.explode(F.array_distinct(search_tokens(F.col(query)))).alias("term"))


def expansion_terms(queries: DataFrame, query_id: str, column: str, expansions: dict[str, str]) -> DataFrame:
    """(query, corpus, term) for the fixed words that single corpora add to every query."""
    parts = [queries.select(query_id, F.lit(corpus).alias(column), F.explode(search_tokens(F.lit(words))).alias("term"))
             for corpus, words in expansions.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def term_statistics(index: DataFrame, wanted: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """(corpus, term) with idf, mean document length and `bound`, the most that a document can get for the term, however often
    it has it. One aggregation; `wanted` has at most TERMS_PER_BLOCK terms."""
    listed = index.select(*within, F.size("words").alias("length"), F.explode(F.concat(F.array_distinct("words"), F.array(F.lit(TOTAL)))).alias("term"))
    some = wanted.unionByName(wanted.sparkSession.range(1).select(F.lit(TOTAL).alias("term")))
    stats = listed.join(F.broadcast(some), "term", "left_semi").groupBy(*within, "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("length").alias("all_length"))
    # One shuffled row per corpus and term: the totals are the row of the pseudo-term, whatever the corpus.
    packed = stats.groupBy(*within).agg(
        F.max(F.when(F.col("term") == TOTAL, F.struct(F.col("df").alias("n"), (F.col("all_length") / F.col("df")).alias("mean")))).alias("_all"),
        F.collect_list(F.when(F.col("term") != TOTAL, F.struct("term", "df"))).alias("_terms"))
    rows = packed.select(*within, F.col("_all.n").alias("n"), F.col("_all.mean").alias("mean_length"), F.inline("_terms"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return rows.select(*within, "term", idf.alias("idf"), "mean_length", (idf * (K1 + 1)).alias("bound"))


@dataclass
class Matches:
    """An index and the weights {query, within, term, idf, mean_length, bound, scale} of query words in blocks of queries: a score is
    the sum of what its terms give, divided by the query's `scale`. `asked` are the tags that a query allows, without an
    entry all; `all_asked` says that every query has one."""

    index: DataFrame
    blocks: list[pa.Table]
    corpus: Corpus
    query_id: str
    key_type: T.DataType
    n_queries: int
    asked: dict
    all_asked: bool

    def weights(self) -> DataFrame:
        spark = self.index.sparkSession
        return reduce(DataFrame.unionByName, [spark.createDataFrame(b) for b in self.blocks])


def bounded(df: DataFrame, rows: int | None) -> pa.Table | None:
    """`df` on the driver, or None if it has more than `rows` rows; no more are fetched."""
    if rows is None:
        return df.toArrow()
    table = df.limit(rows + 1).toArrow()
    return table if table.num_rows <= rows else None


def match_terms(corpus: Corpus, queries: DataFrame, query_id: str = "query_id", query: str = "query",
                expansions: dict[str, str] | None = None, asked: str | None = None, block: int = TERMS_PER_BLOCK) -> Matches:
    """`expansions` maps values of the one `within` column to words appended to every query there; `asked` is a query column of
    tags, any of which a document must have (null: no condition)."""
    spark = queries.sparkSession
    index = tokenised(corpus)
    extra = expansion_terms(queries, query_id, corpus.within[0], expansions) if expansions else None
    kept = queries.select(query_id, query, *([F.col(asked).cast("array<string>").alias(asked)] if asked else []))

    def weighted(some: DataFrame, most: int | None) -> pa.Table | None:
        terms = query_terms(some, query_id, query)
        every = terms if extra is None else terms.select("term").unionByName(
            extra.join(some.select(query_id), query_id, "left_semi").select("term"))
        fetched = bounded(every.select("term").distinct(), most)
        if fetched is None:
            return None
        stats = term_statistics(index, spark.createDataFrame(fetched), corpus.within)
        stats = stats.withColumn("scale", F.lit(1.0))
        weights = terms.join(stats, "term")
        if extra is not None:
            added = extra.join(some.select(query_id), query_id, "left_semi").join(stats, [*corpus.within, "term"])
            weights = weights.unionByName(added.select(weights.columns)).dropDuplicates([*corpus.within, *terms.columns])
        return bounded(weights, most)

    blocks = dealt(kept, query_id, weighted, block)
    wishes = {}
    if asked:
        for row in kept.filter(F.col(asked).isNotNull()).select(query_id, asked).toLocalIterator():
            wishes[row[0]] = set(row[1])
    return matches_of(index, blocks, corpus, query_id, queries.schema[query_id].dataType, wishes)


def dealt(queries: DataFrame, query_id: str, weighted: Callable[[DataFrame, int | None], pa.Table | None], block: int) -> list[pa.Table]:
    """The weights of all queries, in as few blocks of queries as make none larger than `block` rows. `weighted(some, rows)` gives
    None for more than `rows`. A query with more words than a block is a block of its own size."""
    whole = weighted(queries, block)
    if whole is not None:
        return [whole]
    n, n_blocks = queries.select(query_id).distinct().count(), 1
    while True:
        n_blocks *= 8
        most = block if n_blocks < n else None
        share = F.pmod(F.xxhash64(query_id), F.lit(n_blocks))
        blocks = []
        for k in range(n_blocks):
            found = weighted(queries.filter(share == k), most)
            if found is None:
                break
            blocks.append(found)
        else:
            return blocks


def matches_of(index: DataFrame, blocks: list[pa.Table], corpus: Corpus, query_id: str, kind: T.DataType, wishes: dict) -> Matches:
    names = set().union(*(b[query_id].unique().to_pylist() for b in blocks))
    return Matches(index, blocks, corpus, query_id, kind, len(names), wishes, bool(wishes) and names <= set(wishes))


class _Scorer:
    """Best k documents per query (and corpus value) of one block of queries, over the batches of a task."""

    def __init__(self, weights: pa.Table, query_id: str, within: tuple[str, ...], k: int, asked: dict, flat: bool):
        self.query_id, self.within, self.k, self.asked, self.flat = query_id, within, k, asked, flat
        self.corpora = {key: self._prepared(weights.take(pa.array(rows))) for key, rows in row_groups(weights, within) if len(rows)}
        self.held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def _prepared(self, weights: pa.Table) -> tuple:
        """(terms, idf, mean length, [(query, scale, codes, bounds of these and all later terms)]), each query's terms by bound."""
        named = weights["term"].combine_chunks().dictionary_encode()
        code, idf, bound = named.indices.to_numpy(), weights["idf"].to_numpy(), weights["bound"].to_numpy()
        by_code = np.zeros(len(named.dictionary))
        by_code[code] = idf
        queries = []
        for (name,), rows in row_groups(weights, (self.query_id,)):
            order = rows[np.lexsort((code[rows], -bound[rows]))]
            scale = float(weights["scale"][int(order[0])].as_py())
            queries.append((name, scale, code[order], np.cumsum(bound[order][::-1])[::-1] / scale))
        return named.dictionary, by_code, float(weights["mean_length"][0].as_py() or 0), queries

    def add(self, rows: pa.Table, doc_id: str) -> None:
        for key, members in row_groups(rows, self.within):
            if key in self.corpora:
                self._add(key, rows if len(members) == rows.num_rows else rows.take(pa.array(members)), doc_id)

    def _add(self, key: tuple, rows: pa.Table, doc_id: str) -> None:
        vocabulary, idf, mean, queries = self.corpora[key]
        ids = rows[doc_id].combine_chunks()
        words = rows["words"].combine_chunks()
        found = pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        known = found >= 0
        # One entry per term and document, in the order of terms.
        entry, tf = np.unique(found[known].astype(np.int64) * rows.num_rows + np.repeat(np.arange(rows.num_rows), length)[known], return_counts=True)
        code, doc = entry // rows.num_rows, entry % rows.num_rows
        if self.flat:
            impact = idf[code]
        else:
            impact = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        cuts = np.searchsorted(code, np.arange(len(vocabulary) + 1))
        names = ids.to_numpy(zero_copy_only=False)
        tags = rows["tags"].combine_chunks()
        tag_of = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False))
        for name, scale, codes, bounds in queries:
            allowed = None
            if name in self.asked:
                allowed = np.zeros(rows.num_rows, bool)
                wish = pa.array(sorted(self.asked[name]), pa.string())
                allowed[tag_of[pc.is_in(tags.flatten(), value_set=wish).to_numpy(zero_copy_only=False)]] = True
            old = self.held.get((name, key))
            least = old[0][-1] - MARGIN if old is not None and len(old[0]) == self.k else -np.inf
            score, seen = np.zeros(rows.num_rows), np.zeros(rows.num_rows, bool)
            for c, bound in zip(codes.tolist(), bounds.tolist()):
                own, add = doc[cuts[c]:cuts[c + 1]], impact[cuts[c]:cuts[c + 1]]
                if allowed is not None:
                    own, add = own[allowed[own]], add[allowed[own]]
                if bound < least:  # documents without any term so far cannot reach the k-th score any more
                    own, add = own[seen[own]], add[seen[own]]
                else:
                    seen[own] = True
                score[own] += add
            some = np.flatnonzero(seen)
            if not len(some):
                continue
            scores, ids_of = np.floor(score[some] / scale * 1e6 + 0.5) / 1e6, names[some]
            if old is not None:
                scores, ids_of = np.concatenate([old[0], scores]), np.concatenate([old[1], ids_of])
            pick = best_of(scores, ids_of, self.k)
            self.held[name, key] = scores[pick], ids_of[pick]

    def table(self, schema: pa.Schema, doc_id: str) -> pa.Table:
        out = {name: [] for name in schema.names}
        for (name, key), (scores, ids) in self.held.items():
            out[self.query_id] += [name] * len(ids)
            out[doc_id] += ids.tolist()
            out["score"] += scores.tolist()
            for column, value in zip(self.within, key):
                out[column] += [value] * len(ids)
        return pa.Table.from_pydict(out, schema=schema)


def sliced(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose lists in `column` hold at most `most` entries, or one row that holds more."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def scored_topk(found: Matches, k: int, flat: bool = False) -> DataFrame:
    """{query, doc, within, score}: at most k rows per query, corpus value and task. With `flat` a term counts its idf, however
    often it occurs."""
    corpus, index = found.corpus, found.index
    rows = index.filter("may") if corpus.must is not None else index
    wishes = set().union(*found.asked.values()) if found.all_asked else None
    if wishes is not None:  # every query asks for tags: other documents need not leave the scan
        rows = rows.filter(F.arrays_overlap("tags", F.lit(sorted(wishes)).cast("array<string>") if wishes else F.array().cast("array<string>")))
    rows = rows.select(corpus.doc_id, *corpus.within, "words", "tags")
    schema = T.StructType([T.StructField(found.query_id, found.key_type), index.schema[corpus.doc_id],
                           *[index.schema[c] for c in corpus.within], T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    ship_package(index.sparkSession)

    def searched(block: pa.Table) -> DataFrame:
        query_id, within, doc_id, asked = found.query_id, corpus.within, corpus.doc_id, found.asked
        shared = index.sparkSession.sparkContext.broadcast((block, asked))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, wishes = shared.value
            scorer = _Scorer(weights, query_id, within, k, wishes, flat)
            for batch in batches:
                for rows in sliced(batch, "words", WORDS_PER_SLICE):
                    scorer.add(pa.Table.from_batches([rows]), doc_id)
            yield from scorer.table(arrow, doc_id).to_batches()

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [searched(b) for b in found.blocks])


def bm25_topk(found: Matches, k: int) -> DataFrame:
    """Best k documents per query (and per corpus)."""
    return top_k(scored_topk(found, k), [found.query_id, *found.corpus.within], [F.desc("score"), F.asc(found.corpus.doc_id)], k)


def term_coverage(found: Matches, hits: DataFrame, per_query: int) -> DataFrame:
    """Share of the query's idf weight that a document covers, for hits {query, doc}, at most `per_query` for a query."""
    doc_id, query_id = found.corpus.doc_id, found.query_id
    weights = found.weights().select(query_id, "term", "idf")
    total = weights.groupBy(query_id).agg(F.sum("idf").alias("all_idf"))
    pairs = hits.select(query_id, doc_id).distinct()
    side = F.broadcast(pairs) if found.n_queries * per_query <= BROADCAST_ROWS else pairs
    words = found.index.select(doc_id, "words").join(side, doc_id).select(query_id, doc_id, F.explode(F.array_distinct("words")).alias("term"))
    covered = words.join(weights, [query_id, "term"]).groupBy(query_id, doc_id).agg(F.sum("idf").alias("idf"))
    return covered.join(total, query_id).select(
        query_id, doc_id, round_half_up(F.col("idf") / F.col("all_idf"), 6).alias("coverage"))
