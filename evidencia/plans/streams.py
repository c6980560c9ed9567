"""Streaming twins on the driver tables; each run drains what has landed and stops."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from evidencia.plans.registry import Tables, query
from evidencia.sources.store import KeyedTable, scratch_path
from evidencia.streaming import delta, eventlog


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def stream_upsert(t: Tables) -> DataFrame:
    """Orders arrive as a file stream over a base in which all prices are out of date."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    target = KeyedTable(t.spark, scratch_path(t.spark, "orders"), ["o_orderkey"], 16)
    target.create(t.orders.select(*columns).withColumn("o_totalprice", F.lit(0.0)).withColumn("version", F.lit(0)))
    stream = delta.landed_stream(t.spark, f"{t.root}/orders.parquet*", t.orders.schema).select(*columns, F.lit(1).alias("version"))
    delta.stream_upserts(stream, target, "version", scratch_path(t.spark, "checkpoint"))
    return target.read().select(*columns)


@query("""
with seen as (select max(ts) as now from events),
entries as (select user_id as entity, case user_id % 2 when 0 then 'drug' else 'company' end as type, coalesce(timestamp '2024-01-20 06:00:00', now) as since
  from events, seen where event_type = 'signup' group by user_id, now),
c as (select entity, type, count(*) as changes, max(ts) as latest_change from entries join events on user_id = entity where event_type <> 'error' and ts::date > since::date group by all),
l as (select entity, type, count(*) as letters from entries join events on user_id = entity where event_type = 'error' and type = 'company' and ts > since group by all)
select entity, type, coalesce(changes, 0) as changes, coalesce(letters, 0) as letters, latest_change from c full join l using (entity, type)""")
def stream_digest(t: Tables) -> DataFrame:
    """Updates arrive as a file stream; each watched entity keeps its last check and reports what is newer."""
    entries = t.events.filter("event_type = 'signup'").select(F.col("user_id").alias("entity")).distinct().select(
        "entity", F.when(F.col("entity") % 2 == 0, "drug").otherwise("company").alias("type"),
        F.lit("2024-01-20 06:00:00").cast("timestamp_ntz").alias("last_checked"))
    stream = delta.landed_stream(t.spark, f"{t.root}/events.parquet*", t.events.schema).select(
        F.col("user_id").alias("entity"), "ts", F.col("event_type").alias("kind"))
    return delta.stream_digests(stream, entries, scratch_path(t.spark, "reports"), scratch_path(t.spark, "checkpoint"), ["error"],
                                F.lit("2024-01-30").cast("date")).select("entity", "type", "changes", "letters", "latest_change")


@query("""
with ends as (select user_id, min(event_id) as last_id from events where event_type = 'error' group by user_id)
select user_id as job, event_id, event_type as event from events left join ends using (user_id) where last_id is null or event_id <= last_id""")
def stream_replay(t: Tables) -> DataFrame:
    """Events arrive as a file stream; those of a user up to the first error pass."""
    stream = delta.landed_stream(t.spark, f"{t.root}/events.parquet*", t.events.schema).select(
        F.col("user_id").alias("job"), "event_id", F.col("event_type").alias("event"))
    out = scratch_path(t.spark, "replayed")
    eventlog.stream_until_terminal(stream, KeyedTable(t.spark, scratch_path(t.spark, "ends"), ["job"], 16), out, scratch_path(t.spark, "checkpoint"), ["error"])
    return t.spark.read.parquet(out).select("job", "event_id", "event")


@query("""
with latest as (select user_id as job, arg_max(event_type, (ts, event_id)) as last_type, max(ts) as claimed_at,
    count(*) filter (event_type = 'signup') as attempts from events group by user_id)
select job, claimed_at, attempts, case when attempts < 14 then 'requeue' else 'fail' end as action from latest
where last_type in ('click', 'view') and claimed_at < timestamp '2024-01-30 12:00:00' - interval 20 minute""")
def stream_leases(t: Tables) -> DataFrame:
    """Events arrive as a file stream; leases that have run out by the given moment end by timers."""
    stream = delta.landed_stream(t.spark, f"{t.root}/events.parquet*", t.events.schema).select(
        F.col("user_id").alias("job"), "event_id", "ts", F.col("event_type").alias("event"))
    ended = eventlog.expiring_leases(stream, ["click", "view"], ["signup"], 20, 14, datetime(2024, 1, 30, 12))
    return delta.landed_rows(ended, scratch_path(t.spark, "leases"), scratch_path(t.spark, "checkpoint"), once=True)


@query("""
with e as (select user_id, ts, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as us from events),
s as (select *, sum(case when us is null or us >= 43200000000 then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as no from e)
select user_id as job, min(ts) as start, max(ts) + interval 12 hour as "end", count(*) as events from s group by user_id, no""")
def stream_sessions(t: Tables) -> DataFrame:
    """Events arrive as a file stream; a user's events without a silence of half a day are one session."""
    stream = delta.landed_stream(t.spark, f"{t.root}/events.parquet*", t.events.schema).select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"))
    sessions = eventlog.activity_sessions(stream, "12 hours", "0 seconds").select(
        "job", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")
    return delta.landed_rows(sessions, scratch_path(t.spark, "sessions"), scratch_path(t.spark, "checkpoint"), "complete")
