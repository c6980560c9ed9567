"""Landing, upserts, de-duplication, set operations, ordered windows and deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from evidencia.functions.tokens import matches, WORD_PATTERN
from evidencia.operators import changes, ordered
from evidencia.operators.ranking import top_k
from evidencia.plans.registry import Tables, query
from evidencia.sources import store


@query("select cast(ts as date) as ingest_date, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def land_roundtrip(t: Tables) -> DataFrame:
    path = store.scratch_path(t.spark, "landed")
    store.land(t.events.withColumn("ingest_date", F.to_date("ts")), path, "ingest_date")
    back = t.spark.read.parquet(path)
    return back.groupBy("ingest_date").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


ARCHIVED = {"orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type", "props"],
            "documents": ["text", "lang", "source"]}


@query(" union all ".join(
    f"select '{name}' as source, count(*) as n_rows, sum({' + '.join(f'length({c})' for c in sized)})::bigint as n_chars, true as matches from {name}"
    for name, sized in ARCHIVED.items()))
def archive_verify(t: Tables) -> DataFrame:
    parts = [store.archive(getattr(t, name), store.scratch_path(t.spark, name), sized)
             .select(F.lit(name).alias("source"), "n_rows", "n_chars", "matches") for name, sized in ARCHIVED.items()]
    return reduce(DataFrame.unionByName, parts)


@query("""
select o_orderkey, o_totalprice, version from (
  select *, row_number() over (partition by o_orderkey order by version desc, delta desc) as rn from (
    select o_orderkey, o_totalprice, 1 as version, 0 as delta from orders
    union all select o_orderkey + 100, o_totalprice * 2, case when o_orderkey % 3 = 0 then 0 else 2 end, 1 from orders where o_orderstatus = 'F'))
where rn = 1""")
def upsert_latest(t: Tables) -> DataFrame:
    base = t.orders.select("o_orderkey", "o_totalprice", F.lit(1).alias("version"))
    delta = t.orders.filter("o_orderstatus = 'F'").select(
        (F.col("o_orderkey") + 100).alias("o_orderkey"), (F.col("o_totalprice") * 2).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(2).alias("version"))
    return changes.upsert(base, delta, ["o_orderkey"], "version")


@query(r"select doc_id, source, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::integer as n_words from documents")
def rebuild_swap(t: Tables) -> DataFrame:
    current = store.written(t.documents.select("doc_id", "source", "text"), "corpus")
    derived = current.withColumn("n_words", F.size(matches(F.col("text"), WORD_PATTERN)))
    fresh = store.rebuilt(current, derived, store.scratch_path(t.spark, "corpus-rebuilt"), "corpus_rebuilt")
    return fresh.select("doc_id", "source", "n_words")


@query("""
select user_id, event_type, event_id, ts from (
  select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events where value > 1)
where rn = 1""")
def dedupe_first(t: Tables) -> DataFrame:
    """A null key part is kept in a composite key; a null event id drops the row."""
    pool = t.events.select(F.when(F.col("value") > 1, F.col("event_id")).alias("event_id"), "user_id", "event_type", "ts")
    kept = pool.dropna(subset=["event_id"])
    return changes.dedupe(kept, ["user_id", "event_type"], ["ts", "event_id"])


@query("""
with entries as (select event_id as id, case when event_id % 2 = 0 then 'drug' else 'company' end as type, 'User ' || user_id as value, value > 30 as dropped
                 from events where event_type = 'signup'),
fresh as (select event_id as id, case when event_id % 2 = 0 then 'drug' else 'company' end as type, ' USER ' || (user_id + 20) || ' ' as value, value > 30 as dropped
          from events where event_type = 'purchase')
select id, type, value from entries where not dropped
union all
select id, type, trim(value) as value from (
  select *, row_number() over (partition by type, lower(trim(value)) order by id) as rn from fresh) f
where rn = 1 and not dropped and not exists (select 1 from entries e where e.type = f.type and lower(trim(e.value)) = lower(trim(f.value)))""")
def watch_insert(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "drug").otherwise("company").alias("type")
    user = F.col("user_id")
    entries = t.events.filter("event_type = 'signup'").select(
        F.col("event_id").alias("id"), kind, F.concat(F.lit("User "), user.cast("string")).alias("value"))
    fresh = t.events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), kind, F.concat(F.lit(" USER "), (user + 20).cast("string"), F.lit(" ")).alias("value"))
    gone = t.events.filter("value > 30").select(F.col("event_id").alias("id"))
    return changes.remove_watches(changes.add_watches(entries, fresh), gone)


def day_slice():
    return F.to_date("ts")


@query("""
select user_id, run_no::bigint as run_no, event_type, count(*) as n, min(event_id) as first_event from (
  select *, sum(step) over (partition by user_id order by ts, event_id) as run_no from (
    select *, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as step from events))
group by all""")
def run_groups(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "event_type")
    numbered = ordered.runs(rows, ["user_id"], ["ts", "event_id"], day_slice(), "event_type")
    return numbered.groupBy("user_id", "run_no", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""
select conv_id, turn, count(*) over (partition by conv_id order by turn) as completed, count(*) over (partition by conv_id) as total
from conversations""")
def progress_counts(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn")
    return ordered.running_sum(rows, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1024), F.lit(1), "completed", "total")


@query("""
select user_id, gap_start, gap_end, seconds from (
  select user_id, lag(ts) over (partition by user_id order by ts, event_id) as gap_start, ts as gap_end,
    (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000000.0::double as seconds from events)
where seconds > 43200""")
def silence_gaps(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id")
    return ordered.gaps(rows, ["user_id"], "ts", ["ts", "event_id"], day_slice(), 43200.0)


@query("""
select o_custkey, o_orderkey, o_totalprice, rank from (
  select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 5""")
def sorted_limit(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    best = top_k(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


@query("""
select 'order' as kind, o_orderkey as key, o_orderpriority as title, null as host from orders
union all select 'page', page_id, null, regexp_extract(url, '^https?://([^/?#]+)', 1) from pages""")
def union_sources(t: Tables) -> DataFrame:
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("title"))
    b = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("key"),
                       F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select o_custkey as id from orders where o_orderstatus = 'P' intersect select o_custkey from orders where o_orderpriority = '1-URGENT'")
def intersect_ids(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).intersect(
        t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("select c_custkey as id from customer except select o_custkey from orders where o_orderstatus = 'P'")
def except_ids(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(
        t.orders.filter("o_orderstatus = 'P'").select("o_custkey"))


AS_OF = "2001-07-31"


@query(f"""
select o_orderkey, o_totalprice, version from (
  select *, row_number() over (partition by o_orderkey order by version desc) as rn from (
    select o_orderkey, o_totalprice, 0 as version from orders
    union all select o_orderkey, o_totalprice + 1, 1 from orders
    where o_orderdate::date between date '{AS_OF}' - 30 and date '{AS_OF}')) where rn = 1""")
def delta_window(t: Tables) -> DataFrame:
    """The last 30 days arrive again, changed, and are merged into the base."""
    base = t.orders.select("o_orderkey", "o_totalprice", F.lit(0).alias("version"))
    fresh = changes.dated_between(t.orders, F.to_date("o_orderdate"), F.lit(AS_OF).cast("date"), 30).select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("version"))
    return changes.upsert(base, fresh, ["o_orderkey"], "version")


@query(f"""
select o_orderkey from orders where list_contains(list_transform([0, 40, 365], lambda k: (o_orderdate::date + k::int) between date '{AS_OF}' - 14 and date '{AS_OF}'), true)""")
def delta_nested(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    listed = t.orders.select("o_orderkey", F.array(day, F.date_add(day, 40), F.date_add(day, 365)).alias("submissions"))
    return changes.any_dated_between(listed, F.col("submissions"), F.lit(AS_OF).cast("date"), 14).select("o_orderkey")


CHECKED = "2024-01-30"


@query(f"""
with entries as (select user_id as entity, case user_id % 4 when 0 then 'drug' when 1 then 'company' when 2 then 'nct' else 'topic' end as type,
    coalesce(case when user_id % 3 = 0 then timestamp '2024-01-29 10:00:00' end, timestamp '{CHECKED}' - interval 7 day) as since
  from events where event_type = 'signup' group by user_id),
c as (select entity, type, count(*) as changes, max(ts) as latest_change from entries join events on user_id = entity
      where event_type in ('click', 'view') and ts::date > since::date group by all),
l as (select entity, type, count(*) as letters from entries join events on user_id = entity
      where event_type = 'error' and type = 'company' and ts > since group by all)
select entity, type, coalesce(changes, 0) as changes, coalesce(letters, 0) as letters, latest_change from c full join l using (entity, type)""")
def watch_digest(t: Tables) -> DataFrame:
    user = F.col("user_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("drug", "company", "nct", "topic")]), (user % 4 + 1).cast("int"))
    entries = t.events.filter("event_type = 'signup'").select(user.alias("entity")).distinct().select(
        "entity", F.element_at(F.array(*[F.lit(k) for k in ("drug", "company", "nct", "topic")]), (F.col("entity") % 4 + 1).cast("int")).alias("type"),
        F.when(F.col("entity") % 3 == 0, F.lit("2024-01-29 10:00:00").cast("timestamp_ntz")).alias("last_checked"))
    updates = t.events.filter(F.col("event_type").isin("click", "view")).select(user.alias("entity"), "ts")
    letters = t.events.filter("event_type = 'error'").select(user.alias("entity"), "ts")
    return changes.watch_digest(entries, updates, letters, F.lit(CHECKED).cast("date"))


@query("""
with cursors as (select user_id, min(event_id) as cursor from events where event_type = 'click' group by user_id),
ends as (select user_id, min(event_id) as last_id from events where event_type = 'error' and value > 10 group by user_id)
select event_id, e.user_id, event_type from events e left join cursors c on c.user_id = e.user_id left join ends n on n.user_id = e.user_id
where event_id > coalesce(cursor, -1) and (last_id is null or event_id <= last_id)""")
def replay_after(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    cursors = rows.filter("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("cursor"))
    ended = (F.col("event_type") == "error") & (F.col("value") > 10)
    return changes.replay(rows, cursors, "user_id", "event_id", ended).select("event_id", "user_id", "event_type")


@query("""
with latest as (select user_id as job, arg_max(event_type, (ts, event_id)) as last_type, max(ts) as claimed_at,
    count(*) filter (event_type = 'signup') as attempts from events group by user_id)
select job, case when last_type in ('click', 'view') then 'running' else 'done' end as status, claimed_at, attempts,
  case when not (last_type in ('click', 'view') and claimed_at < timestamp '2024-01-30 12:00:00' - interval 20 minute) then 'keep'
       when attempts < 14 then 'requeue' else 'fail' end as action from latest""")
def stale_leases(t: Tables) -> DataFrame:
    """The newest event of a user gives the state of the job."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    jobs = t.events.groupBy(F.col("user_id").alias("job")).agg(
        F.when(last.isin("click", "view"), "running").otherwise("done").alias("status"), F.max("ts").alias("claimed_at"),
        F.count_if(F.col("event_type") == "signup").alias("attempts")).withColumn("max_attempts", F.lit(14))
    return changes.classify_leases(jobs, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).drop("max_attempts")


@query("""
select user_id, arg_max(event_id, (strftime(ts, '%Y-%m'), ts, event_id)) as event_id,
  arg_max(greatest(ts, ts + interval 1 day * (event_id % 5), ts - interval 1 day), (strftime(ts, '%Y-%m'), ts, event_id)) as newest
from events group by user_id""")
def latest_per_key(t: Tables) -> DataFrame:
    from evidencia.operators.exclusivity import latest_release
    ts = F.col("ts")
    rows = t.events.select("user_id", "event_id", "ts", F.date_format("ts", "yyyy-MM").alias("month"), F.greatest(
        ts, (ts + F.make_dt_interval(days=(F.col("event_id") % 5).cast("int"))), ts - F.expr("interval 1 day")).alias("newest"))
    return latest_release(rows, ["user_id"], ["month", "ts", "event_id"]).select("user_id", "event_id", "newest")
