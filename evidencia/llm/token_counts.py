"""Token counts from a digest cache.

A text is known by the digest of its content, a tokenizer by the digest of its file. Counts stored under both
digests are joined; of the texts without a count, one row per distinct content is encoded, and the new counts
are appended to the cache. Copies are found by digest with map-side partial sums, so a text that a third
of all rows share is encoded once and hot digests get their count by broadcast.

Content is normalised only as far as the tokenizer cannot see: null is the empty text. Null ids and repeated
rows are counted like any other row; an empty table gives an empty result and leaves the cache as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencia.llm.keyed import join_by_key
from evidencia.llm.tokenizing import PieceCounts, file_digest, loaded
from evidencia.session import ship_package, table
from evidencia.sources.store import scratch_path, written

LIMIT_TOKENS = 4096
CACHE = "digest binary, tokenizer string, n_tokens bigint"


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def stored(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """{digest, n_tokens} of one tokenizer; empty if there is no cache yet. A digest appended twice counts once."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(CACHE).parquet(cache_path) if there else spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, blob: bytes, version: str) -> DataFrame:
    """texts {digest, text} -> {digest, n_tokens}, once for rows of a task with the same digest: repeated rows of one id and
    text come to one task."""
    ship_package(texts.sparkSession)
    model = texts.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = loaded(PieceCounts, version, model.value), set()
        for batch in batches:
            fresh = [k for k, d in enumerate(batch.column(0).to_pylist()) if d not in seen and not seen.add(d)]
            some = batch.take(pa.array(fresh, pa.int64()))
            counts = pa.array(list(counter.counts(some.column(1).to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([some.column(0), counts], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens bigint")


def counted(docs: DataFrame, model_path: str, cache_path: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """docs {doc_id, text, ...} -> {doc_id, n_bytes, n_tokens, over_limit}; appends to the cache."""
    spark = docs.sparkSession
    blob, version = file_digest(model_path)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = written(texts.select("doc_id", content_digest(F.col("text")).alias("digest"),
                                 F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")
    contents = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    misses = contents.join(stored(spark, cache_path, version), "digest", "left_anti").select("digest", "first_id")
    # By digest and id, so that rows of one id, or copies of one text, are spread over tasks.
    named = texts.withColumn("digest", content_digest(F.col("text")))
    fresh = named.join(misses.hint("shuffle_hash"), (named["digest"] == misses["digest"]) & named["doc_id"].eqNullSafe(
        misses["first_id"])).select(named["digest"], "text")
    encoded(fresh, blob, version).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    facts = contents.drop("first_id").join(stored(spark, cache_path, version), "digest")
    return join_by_key(keyed, facts, "digest", "copies").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that the counts are made from the given table."""
    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "token-cache"))
