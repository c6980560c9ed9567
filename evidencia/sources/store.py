"""Landing, verification and keyed tables on the cluster's file system."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidencia.operators.changes import upsert
from evidencia.session import shared_folder


class CutoverRefused(RuntimeError):
    """The new table may not replace the old one."""


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: a result read several times is computed once, and a lost
    executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing will read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def land(df: DataFrame, path: str, date: str, mode: str = "append") -> None:
    """Write raw rows under `<date column>=yyyy-mm-dd/`; the rebalance hint splits a hot day."""
    df.hint("rebalance", date).write.mode(mode).partitionBy(date).parquet(path)


def fingerprint(df: DataFrame, sized: list[str]) -> DataFrame:
    """Row count, character count and an order-free checksum over all columns."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in sized[1:]), F.coalesce(F.length(sized[0]), F.lit(0)))
    digest = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).cast("bigint").alias("n_chars"),
                  F.bit_xor(digest).alias("mark"), F.sum(digest.cast("decimal(20,0)")).alias("mark_sum"))


def archive_report(source: DataFrame, copy: DataFrame, sized: list[str]) -> DataFrame:
    """Compare an archived copy with what was sent."""
    sent = fingerprint(source, sized).select(F.lit(1).alias("_one"), F.struct("*").alias("sent"))
    kept = fingerprint(copy, sized).select(F.lit(1).alias("_one"), F.struct("*").alias("kept"))
    return sent.join(kept, "_one").select(
        "sent.n_rows", "sent.n_chars", F.col("sent").eqNullSafe(F.col("kept")).alias("matches"))


def archive(df: DataFrame, path: str, sized: list[str]) -> DataFrame:
    """Write a copy, read it back and fail closed when it differs."""
    df.write.mode("errorifexists").parquet(path)
    report = archive_report(df, df.sparkSession.read.parquet(path), sized)
    row = report.first()
    if not row["matches"]:
        raise CutoverRefused(f"archive at {path} differs from its source")
    return report


class KeyedTable:
    """Parquet rows partitioned by a hash of their key, so that a merge reads and rewrites the touched partitions only.

    The merged rows are first written to the shared folder and then replace their partitions by dynamic overwrite; a merge that
    is repeated, after a crash at any point, gives the same table, as the key and version alone decide.
    """

    BUCKET = "bucket"

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _numbered(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _put(self, numbered: DataFrame) -> None:
        numbered.repartition(self.BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            self.BUCKET).parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def exists(self) -> bool:
        """Is there a partition? A table that never got a row has none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.BUCKET}=*")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        return bool(found)

    def read(self) -> DataFrame:
        return self._stored().drop(self.BUCKET)

    def create(self, rows: DataFrame) -> None:
        """The first rows of the table, each key once."""
        self._put(self._numbered(rows))

    def merge(self, delta: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the partitions that `delta` touches by `rule(their rows, delta)`. The touched partitions are at most `buckets`
        numbers."""
        new = written(delta, "delta")
        touched = [r[0] for r in self._numbered(new).select(self.BUCKET).distinct().collect()]
        if touched:
            old = self._stored().filter(F.col(self.BUCKET).isin(touched)).drop(self.BUCKET) if self.exists() else new.limit(0)
            self._put(written(self._numbered(rule(old, new)), "merged"))

    def upsert(self, delta: DataFrame, version: str) -> None:
        """The highest version of a key wins and, at equal versions, the delta."""
        self.merge(delta, lambda old, new: upsert(old, new, self.key, version))


def rebuilt(before: DataFrame, after: DataFrame, path: str, name: str) -> DataFrame:
    """Write the rebuilt rows to `path` and show them as view `name`; refuse the cut-over if rows were lost."""
    n = before.count()
    after.write.mode("errorifexists").parquet(path)
    fresh = before.sparkSession.read.parquet(path)
    m = fresh.count()
    if m < n:
        raise CutoverRefused(f"{name}: {m} rows rebuilt from {n}")
    fresh.createOrReplaceTempView(name)
    return fresh
