"""Deltas as streams of landed files: every run takes what is new and stops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidencia.session import ship_package
from evidencia.sources.store import KeyedTable

KEYED_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


def landed_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they land in a folder. To stream a single file give a pattern that matches it."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has landed since the last run, then stop."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def keyed_state(spark: SparkSession) -> None:
    """State of keyed operators lives in the store that supports it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", KEYED_STATE)


def stream_upserts(stream: DataFrame, target: KeyedTable, version: str, checkpoint: str) -> None:
    """Merge new rows into the table. Late and repeated rows are safe: the id and version decide."""
    run_available(stream, checkpoint, lambda batch, _: target.upsert(batch, version))


def microseconds(ts: Column) -> Column:
    """A timestamp without zone as a number; independent of the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def timestamp(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


class Watch(StatefulProcessor):
    """What is new about one watched entity.

    State: for each type under which the entity is watched, the last check before the stream and the high-water mark, the newest
    update reported. An update counts if it lies after that check, whenever it arrives: the mark decides nothing but whether
    it is reported as late. So every update is reported in the batch that brings it, once, and the sum of all reports does not
    depend on how updates fall into batches.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watched = handle.getMapState("watched", "type string", "since bigint, high bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            self.watched.updateValue((row.type,), (int(row.since), -(1 << 62)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = [(name[0], *value) for name, value in self.watched.iterator()]
        if not entries:
            for _ in rows:  # an entity that nobody watches
                pass
            return
        found = {name: [0, 0, None, None] for name, _, _ in entries}
        for some in rows:
            n, first, last, letters = (some[c].to_numpy() for c in ("n", "first", "last", "letter"))
            letters = letters.astype(bool)
            day = last // DAY_US
            for name, since, _ in entries:
                # Updates count from the day after the check, letters from the moment after it, for companies.
                change = ~letters & (day > since // DAY_US)
                letter = letters & (last > since) & (name == "company")
                one, news = found[name], change | letter
                one[0] += int(n[change].sum())
                one[1] += int(n[letter].sum())
                if news.any():
                    one[2] = min(x for x in (one[2], int(first[news].min())) if x is not None)
                if change.any():
                    one[3] = max(x for x in (one[3], int(last[change].max())) if x is not None)
        out = []
        for name, since, high in entries:
            changes, letters, first, last = found[name]
            if changes or letters:
                out.append((key[0], name, changes, letters, last, first <= high))
                self.watched.updateValue((name,), (since, max(high, last if last is not None else first)))
        if out:
            entity, name, changes, letters, last, late = zip(*out)
            yield pd.DataFrame({"entity": entity, "type": name, "changes": changes, "letters": letters,
                                "latest": pd.array(last, dtype="Int64"), "late": late})

    def close(self) -> None:
        pass


def partial_updates(updates: DataFrame) -> DataFrame:
    """{entity, us, letter} -> {entity, letter, n, first, last}: updates of a day, and letters of a moment, added up within each
    batch of a task, so that an entity with a third of all updates sends few rows to the task that keeps its state."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            unit = (rows["us"] // DAY_US).where(~rows["letter"], rows["us"])
            yield rows.groupby([rows["entity"], rows["letter"], unit.rename("unit")], dropna=True)["us"].agg(
                n="size", first="min", last="max").reset_index()[["entity", "letter", "n", "first", "last"]]

    kind = updates.schema["entity"].dataType.simpleString()
    return updates.mapInPandas(run, f"entity {kind}, letter boolean, n bigint, first bigint, last bigint")


def watch_stream(updates: DataFrame, entries: DataFrame, letter_types: list[str], as_of: Column, first_days: int = 7,
                 update_id: str | None = None) -> DataFrame:
    """Streamed updates {entity, ts, kind} -> reports {entity, type, changes, letters, latest_change, late}, one per batch, entity and
    type with news; `late` says that some of it is older than what was reported before.

    entries {entity, type, last_checked} are the watch list when the stream starts; without a last check it is `first_days` before
    `as_of`. Rows that are delivered again are counted again unless `update_id` names a column that tells them apart. Rows without
    an entity or time are left out.
    """
    ship_package(updates.sparkSession)
    keyed_state(updates.sparkSession)
    since = F.coalesce(F.col("last_checked").cast("timestamp_ntz"), F.date_sub(as_of, first_days).cast("timestamp_ntz"))
    initial = entries.filter("entity is not null and type is not null").groupBy("entity", "type").agg(
        F.min(microseconds(since)).alias("since"))
    once = updates.dropDuplicates([update_id]) if update_id else updates
    rows = once.filter("entity is not null and ts is not null").select(
        "entity", microseconds(F.col("ts")).alias("us"), F.coalesce(F.col("kind").isin(letter_types), F.lit(False)).alias("letter"))
    kind = updates.schema["entity"].dataType.simpleString()
    reports = partial_updates(rows).groupBy("entity").transformWithStateInPandas(
        Watch(), f"entity {kind}, type string, changes bigint, letters bigint, latest bigint, late boolean", "append", "none",
        initial.groupBy("entity"))
    return reports.select("entity", "type", "changes", "letters", timestamp(F.col("latest")).alias("latest_change"), "late")


def digest(reports: DataFrame) -> DataFrame:
    """Reports of any batches added up: one row per entity and type with news."""
    return reports.groupBy("entity", "type").agg(
        F.sum("changes").alias("changes"), F.sum("letters").alias("letters"), F.max("latest_change").alias("latest_change"))


def landed_rows(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = False) -> DataFrame:
    """Drain a stream into a folder and read it. In `complete` mode the rows of the last batch are the table. With `once` the run is one
    batch: a stream with processing-time timers always has another batch to run."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(once=True) if once else writer.trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_digests(updates: DataFrame, entries: DataFrame, reports: str, checkpoint: str, letter_types: list[str], as_of: Column,
                   first_days: int = 7, update_id: str | None = None) -> DataFrame:
    """Report everything that has landed since the last run below `reports` and return the digest of all runs so far."""
    found = watch_stream(updates, entries, letter_types, as_of, first_days, update_id)
    return digest(landed_rows(found, reports, checkpoint))
