"""Event logs as streams: replay up to the terminal event, expiring leases, activity sessions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidencia.session import ship_package
from evidencia.sizing import join_small
from evidencia.sources.store import KeyedTable, written
from evidencia.streaming.delta import keyed_state, microseconds, run_available, timestamp


def stream_until_terminal(stream: DataFrame, ends: KeyedTable, out: str, checkpoint: str, terminal: list[str]) -> None:
    """Events {job, event_id, event} of each job up to its first terminal one, one folder per batch below `out`.

    The end of a job is the smallest terminal id in all that has arrived, found over the whole batch before
    any row passes; `ends` {job, ended}, keyed by job, keeps it between batches: only partitions with jobs that end in the batch
    are rewritten, only those with its jobs are read. A repeated batch gives the same folder.
    """
    def earliest(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("job").agg(F.min("ended").alias("ended"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch.select("job", "event_id", "event"), "batch")
        own = rows.filter(F.col("event").isin(terminal)).groupBy("job").agg(F.min("event_id").alias("ended"))
        ends.merge(own, earliest)
        known = ends.read() if ends.exists() else own.limit(0)
        met = known.join(rows.select("job").distinct(), "job", "left_semi")
        kept = join_small(rows, met, ["job"], "left", F.col("event_id"))
        kept.filter(F.col("ended").isNull() | (F.col("event_id") <= F.col("ended"))).drop("ended").write.mode(
            "overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(stream, checkpoint, handle)


class Lease(StatefulProcessor):
    """The lease of one job: its newest event, and how often it was claimed. A processing-time timer stands at the end of the
    lease of a running job; a newer event moves or removes it."""

    def __init__(self, lease_us: int, max_attempts: int, ahead_us: int):
        self.lease_us, self.max_attempts, self.ahead_us = lease_us, max_attempts, ahead_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us bigint, event_id bigint, running boolean, attempts bigint")

    def _due(self, us: int) -> int:
        """When the lease that began at `us` has run out, by the clock of the timers, in milliseconds."""
        return (us + self.lease_us + self.ahead_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        us, event_id, running, attempts = self.newest.get() if self.newest.exists() else (-(1 << 62), -1, False, 0)
        for some in rows:
            attempts += int(some["claims"].sum())
            last = some.sort_values(["us", "event_id"]).iloc[-1]
            if (int(last["us"]), int(last["event_id"])) > (us, event_id):
                us, event_id, running = int(last["us"]), int(last["event_id"]), bool(last["running"])
        self.newest.update((us, event_id, running, attempts))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if running:
            self.handle.registerTimer(self._due(us))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, event_id, running, attempts = self.newest.get()
        if running and self._due(us) <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.update((us, event_id, False, attempts))
            yield pd.DataFrame({"job": [key[0]], "claimed_us": [us], "attempts": [attempts],
                                "action": ["requeue" if attempts < self.max_attempts else "fail"]})

    def close(self) -> None:
        pass


def expiring_leases(events: DataFrame, running: list[str], claims: list[str], lease_minutes: float = 20, max_attempts: int = 3,
                    clock: datetime | None = None) -> DataFrame:
    """Jobs whose lease runs out, {job, claimed_at, attempts, action}: requeue while attempts are left, else fail.

    events {job, event_id, ts, event}, ts in UTC: the newest event of a job, by ts and id, tells whether it runs (`running`) and
    since when; `claims` count as attempts. The lease ends by a processing-time timer, whether or not anything else arrives.
    `clock` sets the time that it is when the stream starts, for logs of another day. Rows without job or time are left out.
    """
    ship_package(events.sparkSession)
    keyed_state(events.sparkSession)
    ahead = 0 if clock is None else int((datetime.now(timezone.utc).replace(tzinfo=None) - clock).total_seconds() * 1_000_000)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The newest event and the claims of each job in a batch: a busy job sends few rows to the task that keeps its state.
        for rows in batches:
            ordered = rows.sort_values(["us", "event_id"])
            yield ordered.groupby("job").agg(us=("us", "last"), event_id=("event_id", "last"), running=("running", "last"),
                                             claims=("claims", "sum")).reset_index()

    kind = events.schema["job"].dataType.simpleString()
    rows = events.filter("job is not null and ts is not null").select(
        "job", microseconds(F.col("ts")).alias("us"), F.col("event_id").cast("bigint").alias("event_id"),
        F.coalesce(F.col("event").isin(running), F.lit(False)).alias("running"), F.coalesce(F.col("event").isin(claims).cast("bigint"), F.lit(0)).alias("claims"))
    fields = f"job {kind}, us bigint, event_id bigint, running boolean, claims bigint"
    ended = rows.mapInPandas(partial, fields).groupBy("job").transformWithStateInPandas(
        Lease(int(lease_minutes * 60_000_000), max_attempts, ahead), f"job {kind}, claimed_us bigint, attempts bigint, action string", "append",
        "processingTime")
    return ended.select("job", timestamp(F.col("claimed_us")).alias("claimed_at"), "attempts", "action")


def activity_sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of a job without silence longer than `gap`; what lies between two sessions is a gap."""
    return events.withWatermark("ts", delay).groupBy("job", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("events")).select(
        "job", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
