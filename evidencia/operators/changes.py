"""Upserts, de-duplication, deltas, watch lists, event replay and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidencia.operators.ranking import top_k


def upsert(base: DataFrame, delta: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key; the highest version wins and, at equal versions, the delta."""
    both = base.withColumn("_delta", F.lit(0)).unionByName(delta.withColumn("_delta", F.lit(1)), allowMissingColumns=True)
    return top_k(both, key, [F.desc(version), F.desc("_delta")], 1, "_rank").drop("_rank", "_delta")


def dedupe(df: DataFrame, key: list[str], arrival: list[str], last: bool = False,
           drop_null: bool = False) -> DataFrame:
    """First (or last) row per key by arrival. Rows whose single key is null may be dropped instead."""
    rows = df.dropna(subset=key) if drop_null else df
    order = [F.desc(c) if last else F.asc(c) for c in arrival]
    return top_k(rows, key, order, 1, "_rank").drop("_rank")


def dated_between(df: DataFrame, date: Column, as_of: Column, days: int) -> DataFrame:
    """Rows dated in the inclusive window [as_of - days, as_of]."""
    return df.filter((date >= F.date_sub(as_of, days)) & (date <= as_of))


def any_dated_between(df: DataFrame, date_list: Column, as_of: Column, days: int) -> DataFrame:
    """Rows with any date of the list in the inclusive window."""
    return df.filter(F.exists(date_list, lambda d: (d >= F.date_sub(as_of, days)) & (d <= as_of)))


def add_watches(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Insert watch entries; a value already watched under the type (ignoring case) is left alone."""
    folded = F.lower(F.trim("value"))
    first = dedupe(new.withColumn("value", F.trim("value")).withColumn("_fold", folded), ["type", "_fold"], ["id"])
    known = entries.select("type", folded.alias("_fold")).distinct()
    return entries.unionByName(first.join(known, ["type", "_fold"], "left_anti").select(entries.columns))


def remove_watches(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id"), "id", "left_anti")


def watch_digest(entries: DataFrame, updates: DataFrame, letters: DataFrame, as_of: Column,
                 first_days: int = 7) -> DataFrame:
    """Findings per watched entity since its last check.

    entries {entity, type, last_checked}; updates {entity, ts}; letters {entity, ts}. Updates count
    from the day after the last check, letters from the moment after it and only for companies;
    entities without findings are left out. Updates are counted per day before the join.
    """
    since = F.coalesce("last_checked", F.date_sub(as_of, first_days).cast("timestamp_ntz"))
    watched = entries.select("entity", "type", since.alias("since"))
    daily = updates.groupBy("entity", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))
    changed = (
        watched.join(daily, "entity").filter(F.col("day") > F.to_date("since"))
        .groupBy("entity", "type").agg(F.sum("n").alias("changes"), F.max("latest").alias("latest_change"))
    )
    posted = letters.groupBy("entity", "ts").agg(F.count(F.lit(1)).alias("n"))
    company = (
        watched.filter(F.col("type") == "company").join(posted, "entity").filter(F.col("ts") > F.col("since"))
        .groupBy("entity", "type").agg(F.sum("n").alias("letters"))
    )
    return changed.join(company, ["entity", "type"], "full").select(
        "entity", "type", F.coalesce("changes", F.lit(0)).alias("changes"),
        F.coalesce("letters", F.lit(0)).alias("letters"), "latest_change")


def replay(events: DataFrame, cursors: DataFrame, job: str, event_id: str, terminal: Column) -> DataFrame:
    """Events after each job's cursor, up to and including its first terminal event."""
    ends = events.filter(terminal).groupBy(job).agg(F.min(event_id).alias("_end"))
    return (
        events.join(cursors, job, "left").join(ends, job, "left")
        .filter((F.col(event_id) > F.coalesce("cursor", F.lit(-1)))
                & (F.col("_end").isNull() | (F.col(event_id) <= F.col("_end"))))
        .select(events.columns)
    )


def classify_leases(jobs: DataFrame, as_of: Column, lease_minutes: int = 20) -> DataFrame:
    """jobs {status, claimed_at, attempts, max_attempts} -> `action`: requeue, fail or keep."""
    expired = (F.col("status") == "running") & (
        F.col("claimed_at") < as_of - F.expr(f"interval {lease_minutes} minutes"))
    return jobs.withColumn("action", F.when(~expired, "keep").when(
        F.col("attempts") < F.col("max_attempts"), "requeue").otherwise("fail"))
