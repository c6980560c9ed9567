"""Exact cosine top-k for a whole table of query vectors at once.

Query vectors of a counted, bounded size travel with the task: every corpus partition is multiplied
with them where it lies, and only its best k rows per query are shuffled. Larger query tables and the
corpus are hashed into blocks of bounded size and one task handles one (corpus block, query block)
cell; a hot filter value is split over its blocks like any other. All pairs never leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidencia.operators.ranking import top_k

ROWS_PER_BLOCK = 32_768
QUERIES_PER_BLOCK = 4_096
QUERY_BYTES = 32 << 20
_SLICE = 128  # queries multiplied at a time inside a cell


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    n = len(flat)
    matrix = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


class _Best:
    """Running top-k per (query, corpus value) over blocks of corpus rows."""

    def __init__(self, k: int, qids: list, queries: np.ndarray, match: list, within: tuple[str, ...]):
        self.k, self.qids, self.queries, self.within = k, qids, queries, within
        self.asking: dict[tuple, list[int]] = {}
        for i, m in enumerate(match):
            self.asking.setdefault(m, []).append(i)
        self.held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, ids: np.ndarray, corpus: np.ndarray, rows: pa.Table, match_on: tuple[str, ...]) -> None:
        for key, members in row_groups(rows, (*match_on, *self.within)):
            value, group = key[:len(match_on)], key[len(match_on):]
            asked = np.array(self.asking.get(value, []), dtype=int)
            block, names = corpus[members].T, ids[members]
            for start in range(0, len(asked), _SLICE):
                part = asked[start:start + _SLICE]
                sims = np.floor(self.queries[part] @ block * 1e6 + 0.5) / 1e6
                for q, scores in zip(part, sims):
                    old = self.held.get((q, group))
                    if old is not None:
                        scores, merged = np.concatenate([old[0], scores]), np.concatenate([old[1], names])
                    else:
                        merged = names
                    pick = best_of(scores, merged, self.k)
                    self.held[(q, group)] = (scores[pick], merged[pick])

    def table(self, schema: pa.Schema, query_id: str, doc_id: str) -> pa.Table:
        out = {name: [] for name in schema.names}
        for (q, group), (scores, names) in self.held.items():
            out[query_id] += [self.qids[q]] * len(names)
            out[doc_id] += names.tolist()
            out["score"] += scores.tolist()
            for column, value in zip(self.within, group):
                out[column] += [value] * len(names)
        return pa.Table.from_pydict(out, schema=schema)


def row_groups(table: pa.Table, columns: tuple[str, ...]) -> list[tuple[tuple, np.ndarray]]:
    """The row numbers of each combination of values; only distinct values become Python objects."""
    if not columns:
        return [((), np.arange(table.num_rows))]
    code, values = np.zeros(table.num_rows, np.int64), []
    for name in columns:
        column = table[name].combine_chunks().dictionary_encode()
        known = [*column.dictionary.to_pylist(), None]
        code = code * len(known) + column.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)
        values.append(known)
    found, inverse = np.unique(code, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    parts = np.split(order, np.searchsorted(inverse[order], np.arange(1, len(found))))
    keys = []
    for number in found.tolist():
        key = []
        for known in reversed(values):
            number, k = divmod(number, len(known))
            key.append(known[k])
        keys.append(tuple(reversed(key)))
    return list(zip(keys, parts))


def _tuples(table, columns: tuple[str, ...]) -> list[tuple]:
    if not columns:
        return [()] * table.num_rows
    return list(zip(*[table[c].to_pylist() for c in columns]))


def _search_cell(k: int, match_on: tuple[str, ...], within: tuple[str, ...], doc_id: str, query_id: str, schema: pa.Schema):
    """One (corpus block, query block) cell."""
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        best = _Best(k, right[query_id].to_pylist(), _unit_rows(right["_v"]), _tuples(right, match_on), within)
        best.add(left[doc_id].to_numpy(), _unit_rows(left["_v"]), left, match_on)
        return best.table(schema, query_id, doc_id)

    return search


def _search_partition(k: int, asked: pa.Table, match_on: tuple[str, ...], within: tuple[str, ...], doc_id: str,
                      query_id: str, schema: pa.Schema):
    """All queries against one corpus partition, batch by batch."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, asked[query_id].to_pylist(), _unit_rows(asked["_v"]), _tuples(asked, match_on), within)
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                best.add(rows[doc_id].to_numpy(), _unit_rows(rows["_v"]), rows, match_on)
        yield from best.table(schema, query_id, doc_id).to_batches()

    return search


def valid_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has the expected dimension."""
    return df.filter(F.size(vector) == dim)


def checked_vector(vector: str, dim: int) -> Column:
    """The vector; one of another dimension, or none, stops the job. Set such rows apart beforehand with `valid_vectors`."""
    size = F.coalesce(F.size(vector), F.lit(-1))
    refused = F.raise_error(F.concat(F.lit(f"column {vector}: expected {dim} dimensions, found "), size.cast("string")))
    return F.when(size == dim, F.col(vector).cast("array<double>")).otherwise(refused.cast("array<double>"))


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, dim: int, doc_id: str = "doc_id",
               vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding",
               match_on: tuple[str, ...] = (), within: tuple[str, ...] = (),
               rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK,
               query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Best k corpus rows per query by cosine.

    match_on: columns present on both sides that must be equal (hard filter applied before ranking);
    within: corpus columns that are ranked separately (one top-k per query and value).
    """
    left = corpus.select(doc_id, *match_on, *within, checked_vector(vector, dim).alias("_v"))
    right = queries.select(query_id, *match_on, checked_vector(query_vector, dim).alias("_v"))
    schema = T.StructType([right.schema[query_id], left.schema[doc_id], *[left.schema[c] for c in within],
                           T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    most = query_bytes // (dim * 8)
    asked = right.limit(most + 1).toArrow()  # as many as may travel, and one to see whether there are more
    if asked.num_rows <= most:
        found = left.mapInArrow(_search_partition(k, asked, match_on, within, doc_id, query_id, arrow), schema)
    else:
        found = _by_cells(left, right, right.count(), rows_per_block, queries_per_block, match_on, doc_id, query_id).applyInArrow(
            _search_cell(k, match_on, within, doc_id, query_id, arrow), schema)
    return top_k(found, [query_id, *within], [F.desc("score"), F.asc(doc_id)], k)


def _by_cells(left: DataFrame, right: DataFrame, n_queries: int, rows_per_block: int, queries_per_block: int,
              match_on: tuple[str, ...], doc_id: str, query_id: str):
    """Corpus and queries grouped by (filter value, corpus block, query block)."""
    corpus_blocks = max(1, -(-left.count() // rows_per_block))
    query_blocks = max(1, -(-n_queries // queries_per_block))

    def block(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cell = [*match_on, "_cb", "_qb"]
    left = left.withColumn("_cb", block(doc_id, corpus_blocks)).withColumn("_qb", every(query_blocks))
    right = right.withColumn("_qb", block(query_id, query_blocks)).withColumn("_cb", every(corpus_blocks))
    return left.groupBy(*cell).cogroup(right.groupBy(*cell))
