import datetime as dt
import time

import pandas as pd
from pyspark.sql import functions as F

from evidencia.sources.store import KeyedTable
from evidencia.streaming import delta, eventlog


def drain(stream, tmp_path, name, mode="append"):
    out = str(tmp_path / f"out-{name}")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(
        availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.parquet(out)


def test_upserts_are_idempotent(spark, tmp_path):
    src, target = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "t"), ["id"], 8)
    schema = "id int, v string, version int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    run = lambda: delta.stream_upserts(delta.landed_stream(spark, src, schema), target, "version", str(tmp_path / "cp"))
    rows((1, "a", 1), (2, "b", 5)).write.mode("append").parquet(src)
    run()
    rows((2, "late", 3), (1, "new", 2)).write.mode("append").parquet(src)
    run()
    rows((1, "new", 2)).write.mode("append").parquet(src)
    run()
    assert sorted(map(tuple, target.read().collect())) == [(1, "new", 2), (2, "b", 5)]


def test_merges_rewrite_touched_partitions_only(spark, tmp_path):
    target = KeyedTable(spark, str(tmp_path / "t"), ["id"], 16)
    schema = "id int, v string, version int"
    target.create(spark.createDataFrame([(k, "old", 1) for k in range(200)] + [(None, "no id", 1)], schema))
    before = {(f.parent.name, f.name) for f in (tmp_path / "t").glob("*/*.parquet")}
    delta_rows = spark.createDataFrame([(7, "new", 2), (7, "older", 0), (None, "now", 3)], schema)
    target.upsert(delta_rows, "version")
    after = {(f.parent.name, f.name) for f in (tmp_path / "t").glob("*/*.parquet")}
    changed = {bucket for bucket, _ in before - after}
    assert len(before) == len(after) == 16 and 1 <= len(changed) <= 2 and {b for b, _ in after - before} == changed
    rows = {r["id"]: r["v"] for r in target.read().collect()}
    assert len(rows) == 201 and rows[7] == "new" and rows[None] == "now" and rows[8] == "old"
    target.upsert(delta_rows, "version")
    assert {r["id"]: r["v"] for r in target.read().collect()} == rows and target.read().count() == 201
    target.upsert(spark.createDataFrame([], schema), "version")  # nothing arrives, nothing is touched
    assert target.read().count() == 201


def made_updates():
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    return [(1, at(10), "trial"), (1, at(3), "trial"), (1, at(3, 9), "trial"), (1, at(10, 5), "letter"), (1, at(2, 5), "letter"), (2, at(10, 6), "letter"),
            (3, at(9), "trial"), (1, at(10, 7), "trial"), (2, at(11), "trial"), (2, at(4), None), (None, at(9), "trial"), (1, None, "trial"), (4, at(5), "trial"),
            (4, at(12), "trial"), (1, at(3, 1), "letter"), (5, at(20), "letter")] + [(1, at(6, k % 24), "trial") for k in range(30)]


def python_digest(updates, entries, as_of):
    out = {}
    for entity, kind, last in entries:
        since = last or dt.datetime.combine(as_of - dt.timedelta(days=7), dt.time())
        changes = [t for e, t, k in updates if e == entity and t and k != "letter" and t.date() > since.date()]
        letters = [t for e, t, k in updates if e == entity and t and k == "letter" and t > since and kind == "company"]
        if changes or letters:
            out[entity, kind] = (len(changes), len(letters), max(changes, default=None))
    return out


def test_digest_does_not_depend_on_the_files(spark, tmp_path):
    schema, updates = "entity int, ts timestamp_ntz, kind string", made_updates()
    watched = [(1, "company", dt.datetime(2024, 1, 3)), (2, "drug", None), (4, "company", dt.datetime(2024, 1, 5, 12)), (4, "drug", None), (5, "drug", None), (6, "nct", None)]
    entries = spark.createDataFrame(watched, "entity int, type string, last_checked timestamp_ntz")
    want = python_digest(updates, watched, dt.date(2024, 1, 10))
    for name, cuts in (("one", [updates]), ("many", [[u] for u in reversed(updates)])):
        src = str(tmp_path / name)
        for rows in cuts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = delta.landed_stream(spark, src, schema, files_per_batch=None if name == "one" else 9)
        got = delta.stream_digests(stream, entries, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"), ["letter"], F.lit("2024-01-10").cast("date"))
        assert {(r["entity"], r["type"]): (r["changes"], r["letters"], r["latest_change"]) for r in got.collect()} == want
    # A later run reports what arrived since, late rows too, and nothing twice.
    more = [(1, dt.datetime(2024, 1, 4), "trial"), (1, dt.datetime(2024, 1, 10, 8), "trial")]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "one"))
    stream = delta.landed_stream(spark, str(tmp_path / "one"), schema)
    got = delta.stream_digests(stream, entries, str(tmp_path / "one-out"), str(tmp_path / "one-cp"), ["letter"], F.lit("2024-01-10").cast("date"))
    assert {(r["entity"], r["type"]): (r["changes"], r["letters"], r["latest_change"]) for r in got.collect()} == python_digest(updates + more, watched, dt.date(2024, 1, 10))
    assert spark.read.parquet(str(tmp_path / "one-out")).filter("late").count() == 1


def test_updates_delivered_again_count_once(spark, tmp_path):
    schema, src = "entity int, ts timestamp_ntz, kind string, id int", str(tmp_path / "in")
    rows = [(1, dt.datetime(2024, 1, d), "trial", d) for d in range(4, 9)]
    for some in (rows[:3], rows[2:], rows):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(src)
    entries = spark.createDataFrame([(1, "drug", None)], "entity int, type string, last_checked timestamp_ntz")
    stream = delta.landed_stream(spark, src, schema, files_per_batch=1)
    got = delta.stream_digests(stream, entries, str(tmp_path / "out"), str(tmp_path / "cp"), ["letter"], F.lit("2024-01-10").cast("date"), update_id="id")
    assert [(r["changes"], r["letters"]) for r in got.collect()] == [(5, 0)]


def test_until_terminal(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "job long, event_id long, event string"
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(src)
    ends, out = KeyedTable(spark, str(tmp_path / "ends"), ["job"], 8), str(tmp_path / "out")

    def run():
        eventlog.stream_until_terminal(delta.landed_stream(spark, src, schema), ends, out, str(tmp_path / "cp"), ["result", "error"])
        return sorted(r["event_id"] for r in spark.read.parquet(out).collect())

    # Ids do not arrive in order: what stands behind the end goes, wherever it stands in the batch.
    put((1, 5, "progress"), (1, 6, "progress"), (1, 7, "error"), (1, 2, "result"), (1, 1, "progress"), (2, 4, "progress"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    assert run() == [1, 2, 4]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    put((1, 8, "progress"), (2, 9, "error"), (2, 10, "progress"), (3, 3, "progress"))
    assert run() == [1, 2, 3, 4, 9]
    assert run() == [1, 2, 3, 4, 9]


def test_expiring_leases(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "job long, event_id long, ts timestamp_ntz, event string"
    at = lambda m: dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=m)
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(src)

    def run(minute):
        stream = delta.landed_stream(spark, src, schema)
        ended = eventlog.expiring_leases(stream, ["claimed", "beat"], ["claimed"], 20, 3, at(minute))
        rows = delta.landed_rows(ended, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).collect()
        return sorted((r["job"], r["claimed_at"].minute, r["attempts"], r["action"]) for r in rows)

    # Job 1 goes silent, 2 ends, 3 is out of attempts, 4 beats late in the file but early in time, 5 still has time.
    put((1, 1, at(0), "claimed"), (2, 2, at(0), "claimed"), (3, 3, at(0), "claimed"), (3, 5, at(2), "claimed"), (5, 6, at(25), "claimed"), (None, 7, at(0), "claimed"))
    put((3, 4, at(1), "claimed"), (2, 8, at(5), "done"), (4, 10, at(28), "beat"), (4, 9, at(3), "claimed"), (6, 11, None, "claimed"))
    ended = [(1, 0, 1, "requeue"), (3, 2, 3, "fail")]
    assert run(30) == ended


def test_timers_end_leases_without_new_events(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "job long, event_id long, ts timestamp_ntz, event string"
    now = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    begin = now()
    spark.createDataFrame([(1, 1, begin + dt.timedelta(hours=1), "claimed"), (2, 2, begin, "claimed"), (3, 3, begin, "done")], schema).coalesce(1).write.parquet(src)

    def run():
        ended = eventlog.expiring_leases(delta.landed_stream(spark, src, schema), ["claimed"], ["claimed"], 0.5, 3)
        return [(r["job"], r["action"]) for r in delta.landed_rows(ended, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).collect()]

    assert run() == []
    time.sleep(max(0.0, 31 - (now() - begin).total_seconds()))
    spark.createDataFrame([(9, 4, now(), "done")], schema).coalesce(1).write.mode("append").parquet(src)  # another job wakes the stream
    assert run() == [(2, "requeue")]  # the first lease has time left


def test_activity_sessions(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "job long, ts timestamp"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([(1, at(0)), (1, at(10)), (1, at(40)), (1, at(500))], schema).coalesce(1).write.parquet(src)
    stream = lambda: eventlog.activity_sessions(delta.landed_stream(spark, src, schema), "15 seconds", "0 seconds")
    drain(stream(), tmp_path, "s")
    spark.createDataFrame([(2, at(5000))], schema).coalesce(1).write.mode("append").parquet(src)
    rows = drain(stream(), tmp_path, "s").filter("job = 1").orderBy("start").select(F.col("events")).collect()
    assert [r["events"] for r in rows] == [2, 1, 1]


def test_an_entity_costs_one_read_of_its_state():
    class State:
        def __init__(self, entries):
            self.entries, self.calls = entries, []

        def iterator(self):
            self.calls.append("read")
            return iter(self.entries.items())

        def updateValue(self, key, value):
            self.calls.append("write")
            self.entries[key] = value

    rows = [pd.DataFrame({"entity": 7, "letter": [False, True], "n": [3, 2], "first": [0, delta.DAY_US], "last": [5, 2 * delta.DAY_US]}),
            pd.DataFrame({"entity": 7, "letter": [False], "n": [4], "first": [delta.DAY_US], "last": [delta.DAY_US + 1]})]
    watch = delta.Watch()
    watch.watched = State({("company",): (9, -(1 << 62)), ("drug",): (-delta.DAY_US, -(1 << 62))})
    [out] = watch.handleInputRows((7,), iter(rows), None)
    assert out.values.tolist() == [[7, "company", 4, 2, delta.DAY_US + 1, False], [7, "drug", 7, 0, delta.DAY_US + 1, False]]
    assert watch.watched.calls == ["read", "write", "write"]
    watch.watched = State({})
    assert list(watch.handleInputRows((8,), iter(rows), None)) == [] and watch.watched.calls == ["read"]
