"""Vectors for texts: hashed terms by default, any model through Arrow."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidencia.functions.tokens import search_tokens
from evidencia.session import ship_package
from evidencia.sources.store import written

SLICE_ROWS = 512  # rows taken at a time from a batch: what a worker holds does not grow with the batch
KNOWN_WORDS = 200_000  # words whose place a worker remembers

_LOADED: dict[str, object] = {}  # models of this worker


def slot_of(term: str, dim: int) -> int:
    """The place of a term in a vector, from the first 32 bits of its MD5, so that any system can repeat it."""
    return int.from_bytes(hashlib.md5(term.encode()).digest()[:4], "big") % dim


def slots_known(dim: int) -> Callable[[str], int]:
    """`slot_of` with a memory of at most KNOWN_WORDS words."""
    known: dict[str, int] = {}

    def slot(w: str) -> int:
        if w not in known:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[w] = slot_of(w, dim)
        return known[w]

    return slot


def _slot_counter(dim: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces the list `_words` by `_counts`, {slot, tf} in the order of slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = slots_known(dim)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                words = rows.column("_words")
                named = words.flatten().dictionary_encode()
                slots = np.array([known(w) for w in named.dictionary.to_pylist()], np.int64)
                length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(rows.num_rows), length)
                tf = np.bincount(row * dim + slots[named.indices.to_numpy()], minlength=rows.num_rows * dim)
                cells = np.flatnonzero(tf)
                ends = np.concatenate([[0], np.cumsum(np.bincount(cells // dim, minlength=rows.num_rows))])
                kind = schema.field("_counts").type
                entries = pa.StructArray.from_arrays([pa.array(cells % dim, pa.int32()), pa.array(tf[cells], pa.int32())], fields=list(kind.value_type))
                counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, type=kind)
                kept = [rows.column(f.name) for f in schema if f.name != "_counts"]
                yield pa.RecordBatch.from_arrays([*kept, counts], schema=schema)

    return run


def _weigher(dim: int, idf: list[float], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces `_counts` by `embedding`, `dim` weighted numbers of unit length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                counts, out = rows.column("_counts"), np.zeros((rows.num_rows, dim))
                entries = counts.flatten()
                row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(counts).to_numpy(zero_copy_only=False))
                out[row, entries.field("term").to_numpy()] = entries.field("tf").to_numpy()
                out *= np.array(idf)
                length = np.sqrt((out * out).sum(axis=1, keepdims=True))
                out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
                kind = schema.field("embedding").type
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1) * dim, pa.int32()), pa.array(out.ravel()), type=kind)
                kept = [rows.column(f.name) for f in schema if f.name != "embedding"]
                yield pa.RecordBatch.from_arrays([*kept, vectors], schema=schema)

    return run


def hashed_vectors(docs: DataFrame, text: str, dim: int) -> DataFrame:
    """Adds `embedding`: hashed term counts, weighted by idf = ln((N + 1) / (df + 1)) of their slots, scaled to unit length.

    Terms are counted inside the row, once, and the counts are written; only one number per slot comes from an aggregation over the corpus.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("_counts", T.ArrayType(T.StructType([
        T.StructField("term", T.IntegerType()), T.StructField("tf", T.IntegerType())])))])
    counted = written(docs.withColumn("_words", search_tokens(F.col(text))).mapInArrow(_slot_counter(dim, to_arrow_schema(schema)), schema), "counts")
    every = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda s: F.struct(s.alias("slot"), F.lit(0).alias("tf")))
    seen = counted.select(F.lit(1).alias("_doc"), F.inline(F.transform("_counts", lambda c: F.struct(c["term"].alias("slot"), c["tf"].alias("tf")))))
    n = counted.agg(F.count(F.lit(1)).alias("n")).scalar()
    slot_rows = docs.sparkSession.range(1).select(F.inline(every)).select("slot")
    idf = slot_rows.join(seen.groupBy("slot").agg(F.count(F.lit(1)).alias("df")), "slot", "left").select(
        "slot", F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1)).alias("idf"))
    weights = [r["idf"] for r in idf.orderBy("slot").collect()]  # `dim` numbers
    out = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return counted.mapInArrow(_weigher(dim, weights, to_arrow_schema(out)), out)


def model_vectors(docs: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """Adds `embedding` from a model; `load`, a function of a module, runs once per worker and rows go through Arrow, so many at a time.

    Not a UDF: Spark repeats one for each filter that it infers from its column, and each repetition has workers of its own.
    """
    ship_package(docs.sparkSession)
    name = f"{load.__module__}.{load.__qualname__}"
    out = T.StructType([*docs.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    schema = to_arrow_schema(out)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from evidencia.operators import embedding

        if name not in embedding._LOADED:
            embedding._LOADED[name] = load()
        model = embedding._LOADED[name]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                texts = pc.fill_null(rows.column(schema.get_field_index(text)), "").to_pylist()
                vectors = pa.array([np.asarray(v, np.float32) for v in model(texts)], schema.field("embedding").type)
                yield pa.RecordBatch.from_arrays([*rows.columns, vectors], schema=schema)

    return docs.mapInArrow(embed, out)


MODEL_DIM = 64


def word_model() -> Callable[[list[str]], list[list[float]]]:
    """A small model without weights: words hashed to slots, square roots of their counts, unit length."""
    word, slot = re.compile(r"[a-z0-9]+"), slots_known(MODEL_DIM)

    def model(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), MODEL_DIM))
        for row, text in zip(out, texts):
            np.add.at(row, [slot(w) for w in word.findall(text.lower())], 1.0)
        out = np.sqrt(out)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0).tolist()

    return model
