"""Signals, statistics, golden sets, landscape and timeline on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.functions.tokens import CLAIM_STOP_WORDS, WORD_PATTERN, sql_list
from evidencia.operators import evaluation, landscape, signals, statistics, timeline
from evidencia.plans.registry import Tables, query
from evidencia.plans.scalars import PERIODS, period_renderings
from evidencia.sizing import ROWS_PER_TASK, parts_for, spread


def reports(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("report"), F.col("user_id").alias("drug"), F.col("event_type").alias("reaction"))


@query("""
with p as (select user_id as drug, event_type as reaction, count(distinct event_id) as a from events group by all),
r as (select drug, reaction, a, dt, rt, (select count(distinct event_id) from events) as n from p
  join (select user_id as drug, count(distinct event_id) as dt from events group by 1) using (drug)
  join (select event_type as reaction, count(distinct event_id) as rt from events group by 1) using (reaction)),
x as (select *, a::double as ad, greatest(dt - a, 1)::double as b, greatest(rt - a, 1)::double as c, greatest(n - dt - rt + a, 1)::double as d from r),
y as (select *, ad * d / (b * c) as ror0, exp(ln(ad * d / (b * c)) - 1.96 * sqrt(1 / ad + 1 / b + 1 / c + 1 / d)) as low from x)
select drug, reaction, a, floor(ror0 * 100.0 + 0.5) / 100.0 as ror, floor(low * 100.0 + 0.5) / 100.0 as ci95_low, a >= 3 and low > 1.0 as signal from y""")
def ror_signals(t: Tables) -> DataFrame:
    return signals.ror_signals(reports(t))


@query("""
with p as (select event_type as drug, 'R' || json_extract_string(props, '$.k') as reaction, count(distinct event_id) as n from events group by all),
a as (select *, row_number() over (partition by drug order by n desc, reaction) as r1 from p),
b as (select *, row_number() over (partition by drug order by n desc, reaction) as rank from a where r1 <= 25 and reaction not in ('R1', 'R10', 'R50', 'R77'))
select drug, reaction, n as reports, rank from b where rank <= 8""")
def top_reactions(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("report"), F.col("event_type").alias("drug"),
                           F.concat(F.lit("R"), F.get_json_object("props", "$.k")).alias("reaction"))
    return signals.top_reactions(rows, ["R1", "R10", "R50", "R77"])


def registry(t: Tables) -> dict[str, DataFrame]:
    """Orders as studies, customers as sponsors, segments as conditions, suppliers as sites."""
    study, line = F.col("o_orderkey").alias("nct_id"), F.col("l_orderkey").alias("nct_id")
    sponsored = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    sites = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    strength = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 40).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "%").otherwise(" mg"))
    return {
        "studies": t.orders.select(study, F.col("o_orderstatus").alias("overall_status"), F.col("o_orderpriority").alias("phase"),
                                   F.col("o_totalprice").alias("enrollment"), F.col("o_orderdate").alias("start_date")),
        "sponsors": sponsored.select(study, F.col("c_name").alias("name")),
        "conditions": sponsored.select(study, F.col("c_mktsegment").alias("name")),
        "interventions": t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(line, strength.alias("name")),
        "facilities": sites.select(line, F.col("s_suppkey").alias("facility"), F.col("n_name").alias("country")),
    }


@query("""
select c_name as sponsor, count(*) as studies, count(distinct o_orderpriority) as phases
from orders join customer on c_custkey = o_custkey where lower(c_mktsegment) like '%hold%'
group by c_name order by studies desc, sponsor limit 50""")
def stats_top_sponsors(t: Tables) -> DataFrame:
    return statistics.statistic("top_sponsors", registry(t), condition="HOLD")


@query("""
select o_orderpriority as phase, cast(extract(year from o_orderdate) as bigint) as started, count(*) as studies
from orders group by o_orderpriority, cast(extract(year from o_orderdate) as bigint)""")
def stats_phase_year(t: Tables) -> DataFrame:
    return statistics.statistic("phase_year", registry(t))


@query("""
select o_orderstatus as status, count(*) as studies,
  floor(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*) * 1e2 + 5e-1) / 1e2 as avg_enrollment
from orders group by o_orderstatus""")
def stats_avg_enrollment(t: Tables) -> DataFrame:
    return statistics.statistic("average_enrollment", registry(t))


@query("""
select n_name as country, count(distinct s_suppkey) as facilities, count(*) as study_sites
from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by n_name""")
def stats_country_counts(t: Tables) -> DataFrame:
    return statistics.statistic("country_counts", registry(t))


@query("""
with i as (select l_orderkey as nct_id, p_name || ' ' || p_partkey % 40 || case when p_partkey % 2 = 0 then '%' else ' mg' end as name
  from lineitem join part on p_partkey = l_partkey)
select name as intervention, count(distinct nct_id) as studies from i where contains(lower(name), ' 2%') group by name order by studies desc, intervention limit 30""")
def stats_interventions(t: Tables) -> DataFrame:
    """A name with a sign that LIKE would take for a wildcard."""
    return statistics.statistic("intervention_studies", registry(t), name=" 2%", top=30)


TRIALS = """
occ as (select l_orderkey as trial, p_name || '-' || p_partkey as drug, c_mktsegment as condition
  from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey)"""


def trial_drugs(t: Tables) -> DataFrame:
    drug = t.part.select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("drug"))
    segment = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.array("c_mktsegment").alias("conditions"))
    trial = t.orders.select("o_orderkey", "o_custkey").join(segment, "o_custkey")
    tasks = parts_for(t.lineitem, F.lit(1), ROWS_PER_TASK)
    lines = t.lineitem.select("l_orderkey", "l_partkey").repartition(tasks, "l_partkey").join(drug, "l_partkey").repartition(tasks, "l_orderkey")
    return lines.join(trial, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("trial"), "drug", "conditions")


CANDIDATES = f"""{TRIALS},
cand as (select 'single' as kind, drug, null::varchar as condition, count(*) as n from occ group by drug having count(*) between 2 and 8
  union all select 'pair', drug, condition, count(*) from occ group by drug, condition having count(*) between 2 and 6)"""


@query(f"with {CANDIDATES} select * from cand")
def golden_candidates(t: Tables) -> DataFrame:
    return evaluation.candidate_counts(trial_drugs(t))


GOLDEN = f"""{CANDIDATES},
edge as (select distinct trial, drug, condition from occ),
pr as (select drug, condition, md5('{evaluation.SEED}|' || drug || '|' || condition) as draw from cand
  join (select drug, condition, count(*) as m from edge group by all) using (drug, condition) where kind = 'pair' and m between 2 and 15),
p1 as (select drug, condition, draw from (select *, row_number() over (partition by drug order by draw) as f from pr) where f = 1 order by draw limit 25),
s1 as (select drug, null::varchar as condition, md5('{evaluation.SEED}|' || drug || '|') as draw from cand
  join (select drug, count(distinct trial) as m from edge group by all) using (drug)
  where kind = 'single' and m between 2 and 15 and drug not in (select drug from p1) order by draw limit 25),
chosen as (select * from p1 union all select * from s1)"""


@query(f"""with {GOLDEN}
select case when c.condition is null then 'Which trials study ' || c.drug || '?' else 'Trials of ' || c.drug || ' for ' || c.condition end as query,
  array_to_string(list_sort(list(distinct e.trial)), ',') as expected
from chosen c join edge e on e.drug = c.drug and (c.condition is null or c.condition = e.condition) group by c.drug, c.condition""")
def golden_truth(t: Tables) -> DataFrame:
    return evaluation.golden_set(trial_drugs(t)).select("query", F.array_join(F.col("expected").cast("array<string>"), ",").alias("expected"))


@query(f"""
with c as (select item_id, unnest(w) as token, len(w) as n from (select item_id,
    list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) > 2 and x not in ({sql_list(CLAIM_STOP_WORDS)})) as w from benchmark)),
d as (select doc_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) > 2 and x not in ({sql_list(CLAIM_STOP_WORDS)}))) as token from documents),
s as (select item_id, doc_id, floor(count(*)::double / n * 1000000.0 + 0.5) / 1000000.0 as overlap from c join d using (token) group by item_id, doc_id, n)
select item_id, doc_id, overlap from (select *, row_number() over (partition by item_id order by overlap desc, doc_id) as rn from s) where rn = 1 and overlap >= 0.15""")
def claim_source(t: Tables) -> DataFrame:
    docs = spread(t.documents.select("doc_id", "text"))
    return evaluation.claim_sources(t.benchmark.select("item_id", F.col("text").alias("claim")), "item_id", "claim", docs, "doc_id", "text")


@query("""
select source, count(*) as statements, sum(quality)::bigint as supported, floor(sum(quality)::double / count(*) * 10000.0 + 0.5) / 10000.0 as share
from labels join documents using (doc_id) group by source""")
def faithfulness(t: Tables) -> DataFrame:
    return evaluation.faithfulness(verdicts(t), ["source"])


@query("select doc_id, source from labels join documents using (doc_id) where quality = 0")
def unsupported_claims(t: Tables) -> DataFrame:
    return evaluation.unsupported(verdicts(t))


def verdicts(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", F.col("quality").alias("supported")).join(t.documents.select("doc_id", "source"), "doc_id")


CELLS = f"""
ev as (select case when p_size % 10 = 9 then upper('brand ' || p_brand) else p_name || ' ' || p_partkey % 40 end as drug,
  case p_size % 5 when 0 then 'Preclinical' when 1 then 'Phase 1' when 2 then 'Phase 2' when 3 then 'Phase 3' else 'Approved' end as stage,
  case when p_size % 3 = 0 then 'PMC' || p_partkey else 'NCT' || p_partkey end as source from part),
valid as (select case when starts_with(drug, 'BRAND ') then 'concept ' || lower(replace(drug, 'BRAND ', '')) else drug end as drug, source,
   list_position(['Preclinical', 'Phase 1', 'Phase 2', 'Phase 3', 'Approved'], stage) as rank
  from ev where not (stage = 'Preclinical' and not starts_with(source, 'PMC'))),
best as (select drug, max(rank) as rank, arg_min(source, (-rank, source)) as source from valid group by drug),
mech as (select distinct lower(p_name || ' ' || p_partkey % 40) as d, p_type as mechanism from part where p_size > 35),
placed as (select coalesce(mechanism, '{landscape.OTHER}') as mechanism,
   (['Preclinical', 'Phase 1', 'Phase 2', 'Phase 3', 'Approved'])[rank] as stage, drug, source from best left join mech on d = lower(drug)),
cells as (select * from placed where mechanism <> '{landscape.OTHER}'
  or lower(trim(drug)) not in (select lower(trim(drug)) from placed where mechanism <> '{landscape.OTHER}'))"""


def cells(t: Tables) -> DataFrame:
    name = F.concat_ws(" ", "p_name", (F.col("p_partkey") % 40).cast("string"))
    brand = F.concat(F.lit("brand "), "p_brand")
    evidence = t.part.select(
        F.when(F.col("p_size") % 10 == 9, F.upper(brand)).otherwise(name).alias("drug"),
        F.element_at(F.array(*[F.lit(s) for s in landscape.STAGES]), (F.col("p_size") % 5 + 1).cast("int")).alias("stage"),
        F.concat(F.when(F.col("p_size") % 3 == 0, "PMC").otherwise("NCT"), F.col("p_partkey").cast("string")).alias("source"))
    mechanisms = t.part.filter("p_size > 35").select(name.alias("drug"), F.col("p_type").alias("mechanism"))
    synonyms = t.part.select(F.concat(F.lit("concept "), F.lower("p_brand")).alias("concept"), brand.alias("brand")).distinct()
    return landscape.landscape_cells(evidence, mechanisms, synonyms)


@query(f"with {CELLS} select * from cells")
def landscape_cells(t: Tables) -> DataFrame:
    return cells(t)


@query(f"""with {CELLS}
select mechanism, count(*) filter (stage = 'Preclinical') as preclinical, count(*) filter (stage = 'Phase 1') as phase_1,
  count(*) filter (stage = 'Phase 2') as phase_2, count(*) filter (stage = 'Phase 3') as phase_3,
  count(*) filter (stage = 'Approved') as approved, count(*) as total_drugs from cells group by mechanism""")
def landscape_matrix(t: Tables) -> DataFrame:
    return landscape.landscape_matrix(cells(t))


AS_OF = "1998-08-15"


@query(f"""
with d as (select o_orderkey, case when o_orderkey % 4 <> 0 then o_orderdate::date + 10 end as p, case when o_orderkey % 6 <> 0 then o_orderdate::date + 60 end as c from orders where o_orderstatus <> 'P')
select o_orderkey, coalesce(p, c) as due from orders left join d using (o_orderkey) where coalesce(p, c) >= date '{AS_OF}'""")
def upcoming_dated(t: Tables) -> DataFrame:
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    dates = t.orders.filter("o_orderstatus <> 'P'").select(
        "o_orderkey", F.when(key % 4 != 0, F.date_add(day, 10)).alias("primary_completion"),
        F.when(key % 6 != 0, F.date_add(day, 60)).alias("completion"))
    return timeline.upcoming_dated(t.orders.select("o_orderkey"), dates, "o_orderkey", F.lit(AS_OF).cast("date"))


@query(f"""
with {PERIODS},
ev as (select c_mktsegment as query, case when o.o_orderkey % 6 = 0 then 'Placebo ' else 'drug ' || o.o_orderkey % 500 end as drug,
   'C' || o.o_custkey % 700 as source, p.raw, p.year, p.period,
   case period when '' then 0 when 'H1' then 1 when 'Q1' then 1 when 'Q2' then 2 when 'H2' then 3 when 'Q3' then 3 when 'Q4' then 4 end as pr
  from periods p join orders o using (o_orderkey) join customer on c_custkey = o_custkey where p.year is not null),
up as (select * from ev where lower(trim(drug)) <> 'placebo' and not (year < 1998 or (year = 1998 and period <> '' and pr < 3))),
one as (select * from (select *, row_number() over (partition by query, drug, source order by year, pr, raw) as f from up) where f = 1),
top as (select * from (select *, row_number() over (partition by query order by year, pr, source, drug) as rank from one) where rank <= 30)
select query, year, period, count(*) as n, string_agg(drug || '@' || source, '|' order by rank) as events from top group by all""")
def catalyst_timeline(t: Tables) -> DataFrame:
    segment = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("query"))
    events = period_renderings(t).join(segment, "o_custkey").select(
        "query", "raw", F.when(F.col("o_orderkey") % 6 == 0, "Placebo ").otherwise(
            F.concat(F.lit("drug "), (F.col("o_orderkey") % 500).cast("string"))).alias("drug"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 700).cast("string")).alias("source"))
    best = timeline.timeline(events, "query", "raw", "drug", "source", F.lit(AS_OF).cast("date"))
    return timeline.by_period(best, "query", "drug", "source")


READOUT, READOUT_WINDOW = "readout", (70, 80, 10)
NEWS = f"""
pair as (select l_orderkey as o_orderkey, min(l_partkey) as first, max(l_partkey) as last from lineitem group by 1),
news as (select o_custkey, string_agg('Work on ' || b.p_name || ' goes on. A readout for ' || a.p_name || ' is planned ' || raw || '. '
    || case when o.o_orderkey % 3 = 0 then repeat('No other update was given at the meeting. ', 5) else '' end, '' order by o.o_orderkey) as text
  from periods p join orders o using (o_orderkey) join pair using (o_orderkey) join part a on a.p_partkey = first join part b on b.p_partkey = last
  group by o_custkey)"""


def news(t: Tables) -> DataFrame:
    """A text per customer: a sentence with a drug, a keyword and a date for each of the orders."""
    pair = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last"))
    a, b = (t.part.select(F.col("p_partkey").alias(k), F.col("p_name").alias(f"{k}_name")) for k in ("first", "last"))
    rows = period_renderings(t).join(pair, "o_orderkey").join(a, "first").join(b, "last")
    sentence = F.concat(F.lit("Work on "), "last_name", F.lit(" goes on. A readout for "), "first_name", F.lit(" is planned "), "raw", F.lit(". "), F.when(
        F.col("o_orderkey") % 3 == 0, F.repeat(F.lit("No other update was given at the meeting. "), F.lit(5))).otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", sentence.alias("sentence"))))
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["sentence"]), "").alias("text"))


EVENT_PHRASE = timeline.DATE_PHRASE.replace("'", "''")
EVENT_HITS = f"list_transform(range(1, len(string_split(lower(text), '{READOUT}'))), lambda i: list_sum(list_transform((string_split(lower(text), '{READOUT}'))[1:i], lambda x: length(x)))::bigint + (i - 1) * {len(READOUT)})"


def pieces_sql(source: str, text: str, pattern: str, name: str) -> str:
    """Matches of a pattern with their offsets in each span."""
    return f"""
{name}p as (select doc, s, i, g[i] as gap, m[i] as hit from (select doc, s, g, m, unnest(range(1, len(g) + 1)) as i from (
   select doc, s, string_split_regex({text}, '{pattern}') as g, regexp_extract_all({text}, '{pattern}') as m from {source}))),
{name} as (select doc, s, i, hit, coalesce(sum(length(gap) + coalesce(length(hit), 0)) over (partition by doc, s order by i rows between unbounded preceding and 1 preceding), 0) + length(gap) as pos
   from {name}p qualify hit is not null)"""


TEXT_EVENTS = f"""
{PERIODS}, {NEWS},
hits as (select o_custkey as doc, text, unnest({EVENT_HITS}) as h from news),
wins as (select *, greatest(h - {READOUT_WINDOW[0]}, 0) as a, least(h + {READOUT_WINDOW[1]}, length(text)) as e from hits),
flag as (select *, case when a > max(e) over (partition by doc order by h rows between unbounded preceding and 1 preceding) + {READOUT_WINDOW[2]}
   or row_number() over (partition by doc order by h) = 1 then 1 else 0 end as opens from wins),
isle as (select *, sum(opens) over (partition by doc order by h) as no from flag),
spans as (select doc, min(a) as s, substr(any_value(text), min(a)::int + 1, (max(e) - min(a))::int) as ex from isle group by doc, no),
{pieces_sql("spans", "ex", EVENT_PHRASE, "dts")},
{pieces_sql("spans", "lower(ex)", WORD_PATTERN, "wrd")},
seqs as (select doc, s, array_agg(hit order by i) as w, array_agg(pos order by i) as ats from wrd group by doc, s),
surf as (select doc, s, ats[i] as pos, ats[i + n] + length(w[i + n]) as stop, array_to_string(w[i:i + n], ' ') as surface
  from (select *, unnest(range(1, len(w) + 1)) as i from seqs) q, (select unnest([0, 1, 2, 3, 4]) as n) k where i + n <= len(w)),
men as (select doc, s, pos, stop, name from surf join (select distinct p_name as name, array_to_string(regexp_extract_all(lower(p_name), '{WORD_PATTERN}'), ' ') as surface from part) using (surface)),
near as (select d.doc, d.s, d.pos, d.hit as raw, m.name, case when m.stop <= d.pos then d.pos - m.stop else m.pos - d.pos - length(d.hit) end as distance, m.stop <= d.pos as front, m.pos as m_pos, m.stop
  from dts d join men m on m.doc = d.doc and m.s = d.s and (m.stop <= d.pos or m.pos >= d.pos + length(d.hit))),
evt as (select * from near qualify row_number() over (partition by doc, s, pos order by distance, front desc, case when front then -m_pos else m_pos end, stop, case when front then name end desc, name) = 1)"""


@query(f"with {TEXT_EVENTS} select doc as o_custkey, (s + pos)::int as place, raw, name as drug, distance::int as distance from evt")
def text_events(t: Tables) -> DataFrame:
    """Date phrases near a keyword, each with the drug mentioned nearest."""
    return timeline.text_events(news(t), "o_custkey", "text", t.part.select("p_name"), "p_name", [READOUT], READOUT_WINDOW).withColumnRenamed(
        "at", "place")


@query(f"""with {TEXT_EVENTS},
ph as (select distinct regexp_extract(raw, '{EVENT_PHRASE}') as raw, year, period from periods),
ev as (select c_mktsegment as query, name as drug, 'C' || doc as source, raw, year, period,
   case period when '' then 0 when 'H1' then 1 when 'Q1' then 1 when 'Q2' then 2 when 'H2' then 3 when 'Q3' then 3 when 'Q4' then 4 end as pr
  from evt join ph using (raw) join customer on c_custkey = doc where year is not null),
up as (select * from ev where not (year < 1998 or (year = 1998 and period <> '' and pr < 3))),
one as (select * from up qualify row_number() over (partition by query, drug, source order by year, pr, raw) = 1),
top as (select *, row_number() over (partition by query order by year, pr, source, drug) as rank from one qualify rank <= 30)
select query, year, period, count(*) as n, string_agg(drug || '@' || source, '|' order by rank) as events from top group by all""")
def catalyst_events(t: Tables) -> DataFrame:
    """The timeline of the events that texts state."""
    segment = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("query"))
    found = text_events(t).join(segment, "o_custkey").select(
        "query", "raw", "drug", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source"))
    best = timeline.timeline(found, "query", "raw", "drug", "source", F.lit(AS_OF).cast("date"))
    return timeline.by_period(best, "query", "drug", "source")
