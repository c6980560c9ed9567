"""Record shaping, codes, dates, ids and markup on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidencia.functions import codes, dates, ids, markup, records
from evidencia.operators.dense import dense_topk
from evidencia.plans.registry import Tables, query
from evidencia.plans.retrieval import DENSE, DIM, ranked, vector_corpus, vector_queries
from evidencia.sizing import spread
from evidencia.sources import registry

def digit() -> Column:
    return F.substring("o_orderpriority", 1, 1)


def nct(key: Column) -> Column:
    return F.format_string("NCT%08d", key)


NCT = "printf('NCT%08d', o_orderkey)"


def pick(n: Column, *cases: Column) -> Column:
    """The case numbered n modulo the number of cases."""
    return F.element_at(F.array(*cases), (F.pmod(n, F.lit(len(cases))) + 1).cast("int"))


def switch(n: str, *cases: str) -> str:
    """The same choice as SQL."""
    arms = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
    return f"case ({n}) % {len(cases)} {arms} end"


def nested_studies(t: Tables) -> DataFrame:
    """Orders as nested registry studies, with the usual gaps."""
    key = F.col("o_orderkey")
    item = "array<struct<type:string,name:string,otherNames:array<string>>>"
    none = F.lit(None).cast("array<string>")
    return t.orders.select(F.struct(F.struct(
        F.struct(F.when(key % 97 != 0, nct(key)).alias("nctId"),
                 F.when(key % 5 != 0, F.concat(F.lit("Study "), "o_orderpriority")).alias("briefTitle")
                 ).alias("identificationModule"),
        F.struct(F.array(F.concat(F.lit("PHASE"), digit()), F.when(F.col("o_orderstatus") == "F", "NA").otherwise("EARLY_PHASE1")).alias("phases"),
                 F.when(key % 3 != 0, "INTERVENTIONAL").alias("studyType")).alias("designModule"),
        F.struct(F.col("o_orderstatus").alias("overallStatus"),
                 F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("lastUpdatePostDateStruct"),
                 F.lit(None).cast("struct<date:string,type:string>").alias("primaryCompletionDateStruct"),
                 F.lit(None).cast("struct<date:string>").alias("completionDateStruct")).alias("statusModule"),
        F.struct(F.struct(F.concat(F.lit("Sponsor "), F.col("o_custkey").cast("string")).alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(F.when(key % 11 == 0, "  ").otherwise(F.concat(F.lit(" Total "), F.col("o_totalprice").cast("bigint").cast("string"), F.lit(" "))).alias("briefSummary")).alias("descriptionModule"),
        F.struct(F.when(key % 4 != 0, F.array("o_orderpriority")).alias("conditions")).alias("conditionsModule"),
        F.when(key % 7 != 0, F.struct(F.array(
            F.struct(F.lit("DRUG").alias("type"), F.concat(F.lit(" Drug "), digit(), F.lit(" ")).alias("name"), none.alias("otherNames")),
            F.struct(F.lit(None).cast("string").alias("type"), F.lit("  ").alias("name"), none.alias("otherNames")),
            F.struct(F.lit(None).cast("string").alias("type"), F.col("o_orderstatus").alias("name"), none.alias("otherNames")),
        ).cast(item).alias("interventions"))).alias("armsInterventionsModule"),
    ).alias("protocolSection")).alias("study"))


@query(f"""
select {NCT} as nct_id,
  case when o_orderkey % 5 <> 0 then 'Study ' || o_orderpriority else '(no title)' end as title,
  case substr(o_orderpriority, 1, 1) when '5' then 'PHASE5' else 'Phase ' || substr(o_orderpriority, 1, 1) end
    || '|' || case when o_orderstatus = 'F' then 'Not Applicable' else 'Early Phase 1' end as phases,
  o_orderstatus as status, 'Sponsor ' || o_custkey as sponsor,
  case when o_orderkey % 4 <> 0 then o_orderpriority else '' end as conditions,
  case when o_orderkey % 7 <> 0 then 'Drug ' || substr(o_orderpriority, 1, 1) || '|' || o_orderstatus else '' end as interventions,
  case when o_orderkey % 3 <> 0 then 'INTERVENTIONAL' end as study_type,
  'Total ' || trunc(o_totalprice)::bigint as summary,
  'https://clinicaltrials.gov/study/' || {NCT} as source_url
from orders where o_orderkey % 97 <> 0 and o_orderkey % 11 <> 0""")
def normalize_records(t: Tables) -> DataFrame:
    flat = registry.normalize_studies(nested_studies(t))
    return flat.select("nct_id", "title", F.array_join("phases", "|").alias("phases"), "status", "sponsor",
                       F.array_join("conditions", "|").alias("conditions"),
                       F.array_join("intervention_names", "|").alias("interventions"),
                       "study_type", "summary", "source_url")


@query("""
select count(*) filter (o_orderkey % 97 <> 0 and o_orderkey % 11 <> 0) as records,
  count(*) filter (o_orderkey % 97 <> 0 and o_orderkey % 11 = 0) as skipped_no_summary,
  count(*) filter (o_orderkey % 97 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 4 <> 0) as with_conditions,
  count(*) filter (o_orderkey % 97 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 7 <> 0) as with_interventions,
  count(*) filter (o_orderkey % 97 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 3 <> 0) as with_study_type
from orders""")
def coverage(t: Tables) -> DataFrame:
    return registry.coverage(nested_studies(t))


@query(f"select {NCT} as nct_id, o_orderstatus as status from orders where o_orderkey % 97 <> 0")
def flatten_pages(t: Tables) -> DataFrame:
    """Pages of at most 100 studies are packed into JSON envelopes and read back."""
    study = nested_studies(t).select("study", F.col("study.protocolSection.identificationModule.nctId").alias("id"))
    study = study.filter("id is not null").withColumn("page", F.floor(F.substring("id", 4, 20).cast("bigint") / 100))
    pages = study.groupBy("page").agg(F.collect_list("study").alias("studies"))
    text = pages.select(F.to_json(F.struct(F.array(F.struct(
        F.size("studies").alias("totalCount"), F.lit("").alias("nextPageToken"), "studies")).alias("pages"))).alias("json"))
    envelopes = text.select(F.from_json("json", registry.ENVELOPE).alias("e")).select("e.*")
    p = F.col("study.protocolSection")
    return registry.flatten_pages(envelopes).select(
        p["identificationModule"]["nctId"].alias("nct_id"), p["statusModule"]["overallStatus"].alias("status"))


PHASE_CASE = """case when d = '5' then 'PHASE5' else 'Phase ' || d end"""


@query(f"""
select o_orderkey, {PHASE_CASE} || '|' || case o_orderstatus when 'F' then 'Early Phase 1' when 'O' then 'Not Applicable' else 'P' end as labels
from (select *, substr(o_orderpriority, 1, 1) as d from orders)""")
def label_map(t: Tables) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "F", "EARLY_PHASE1").when(F.col("o_orderstatus") == "O", "NA").otherwise(F.col("o_orderstatus"))
    labels = codes.phase_labels(F.array(F.concat(F.lit("PHASE"), digit()), code))
    return t.orders.select("o_orderkey", F.array_join(labels, "|").alias("labels"))


@query(f"""
select o_orderkey, raw, case when trim(raw) = '' then null
  when key in ('PHASE1','PHASE2','PHASE3','PHASE4') then 'Phase ' || substr(key, 6)
  when key in ('1','2','3','4') then 'Phase ' || key
  when key = 'EARLYPHASE1' then trim(raw) when key = 'NA' then 'Not Applicable' else trim(raw) end as label
from (select *, regexp_replace(upper(trim(raw)), '[ _-]', '', 'g') as key
  from (select o_orderkey, {switch('o_orderkey', "'phase' || d", "'PHASE-' || d", "d", "' Phase ' || d || ' '",
                                   "'phase_' || d", "'Early Phase 1'", "'n-a'", "'  '")} as raw
        from (select *, substr(o_orderpriority, 1, 1) as d from orders)))""")
def normalize_code(t: Tables) -> DataFrame:
    raw = pick(F.col("o_orderkey"), F.concat(F.lit("phase"), digit()), F.concat(F.lit("PHASE-"), digit()), digit(),
               F.concat(F.lit(" Phase "), digit(), F.lit(" ")), F.concat(F.lit("phase_"), digit()),
               F.lit("Early Phase 1"), F.lit("n-a"), F.lit("  "))
    return t.orders.select("o_orderkey", raw.alias("raw")).withColumn("label", codes.normalize_phase(F.col("raw")))


@query(f"""
select o_orderkey, text, case when m = '' then null else {switch('1', "null", "m")} end as phase from (
 select o_orderkey, text, coalesce(case lower(r) when '1' then 'Phase 1' when 'i' then 'Phase 1' when '2' then 'Phase 2' when 'ii' then 'Phase 2'
   when '3' then 'Phase 3' when 'iii' then 'Phase 3' when '4' then 'Phase 4' when 'iv' then 'Phase 4' end, '') as m
 from (select o_orderkey, text, regexp_extract(text, '(?i)\\bphase\\s*(1|2|3|4|iv|iii|ii|i)\\b', 1) as r from (
  select o_orderkey, {switch('o_orderkey', "'Upcoming Phase ' || d || ' readouts'", "'PHASE' || d || ' results'",
                             "'phase ' || case d when '1' then 'i' when '2' then 'II' when '3' then 'iii' when '4' then 'IV' else 'v' end || ', late'",
                             "'phased approach ' || d", "'approval dates ' || d")} as text
  from (select *, substr(o_orderpriority, 1, 1) as d from orders))))""")
def phase_mention(t: Tables) -> DataFrame:
    roman = F.element_at(F.array(*[F.lit(r) for r in ("i", "II", "iii", "IV", "v")]), digit().cast("int"))
    text = pick(F.col("o_orderkey"), F.concat(F.lit("Upcoming Phase "), digit(), F.lit(" readouts")),
                F.concat(F.lit("PHASE"), digit(), F.lit(" results")), F.concat(F.lit("phase "), roman, F.lit(", late")),
                F.concat(F.lit("phased approach "), digit()), F.concat(F.lit("approval dates "), digit()))
    return t.orders.select("o_orderkey", text.alias("text")).withColumn("phase", codes.phase_mention(F.col("text")))


@query("""
select o_orderkey, case greatest(case d when '1' then 1 when '2' then 2 when '3' then 3 else 0 end,
    case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end)
  when 1 then 'Phase 1' when 2 then 'Phase 2' when 3 then 'Phase 3' end as bucket
from (select *, substr(o_orderpriority, 1, 1) as d from orders)""")
def max_bucket(t: Tables) -> DataFrame:
    other = F.when(F.col("o_orderstatus") == "F", "Early Phase 1").when(F.col("o_orderstatus") == "O", "Phase 2").otherwise("Not Applicable")
    labels = F.array(F.concat(F.lit("Phase "), digit()), other)
    return t.orders.select("o_orderkey", codes.most_advanced(labels).alias("bucket"))


@query(f"""
select o_orderkey, raw, coalesce(try_strptime(raw, '%b %d, %Y'), try_strptime(raw, '%m/%d/%Y'), try_strptime(raw, '%Y-%m-%d'))::date as parsed
from (select o_orderkey, {switch('o_orderkey', "strftime(o_orderdate, '%b %d, %Y')", "strftime(o_orderdate, '%m/%d/%Y')",
                                 "strftime(o_orderdate, '%Y-%m-%d')", "'n/a ' || o_orderstatus")} as raw from orders)""")
def parse_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    raw = pick(F.col("o_orderkey"), F.date_format(d, "MMM dd, yyyy"), F.date_format(d, "MM/dd/yyyy"),
               F.date_format(d, "yyyy-MM-dd"), F.concat(F.lit("n/a "), "o_orderstatus"))
    return t.orders.select("o_orderkey", raw.alias("raw")).withColumn("parsed", dates.parse_date(F.col("raw")))


PERIOD_FORMS = ["strftime(o_orderdate, '%Y-%m-%d')", "strftime(o_orderdate, '%Y-%m')", "'est. Q' || quarter(o_orderdate) || ' ' || year(o_orderdate)",
                "'h' || (1 + (month(o_orderdate) > 6)::int) || '''' || strftime(o_orderdate, '%y')",
                "'in the second half of ' || year(o_orderdate)", "year(o_orderdate)::varchar",
                "'on ' || strftime(o_orderdate, '%B %d, %Y')", "'soon'", "year(o_orderdate) || '-13'"]
PERIODS = f"""
forms as (select o_orderkey, o_orderdate as d, o_orderkey % 9 as f, {switch('o_orderkey', *PERIOD_FORMS)} as raw from orders),
periods as (select o_orderkey, raw,
  (case when f in (7, 8) then null when f = 3 then 2000 + year(d) % 100 else year(d) end)::int as year,
  case f when 3 then 'H' || (1 + (month(d) > 6)::int) when 4 then 'H2' when 5 then '' when 7 then null when 8 then null
    else 'Q' || quarter(d) end as period,
  case f when 0 then strftime(d, '%B ') || day(d) || ', ' || year(d) when 1 then strftime(d, '%B %Y')
    when 2 then 'Q' || quarter(d) || ' ' || year(d) when 3 then 'H' || (1 + (month(d) > 6)::int) || ' ' || (2000 + year(d) % 100)
    when 7 then null when 8 then null else raw end as display from forms)"""


def period_renderings(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    year = F.year(d).cast("string")
    raw = pick(F.col("o_orderkey"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy-MM"),
               F.concat(F.lit("est. Q"), F.quarter(d).cast("string"), F.lit(" "), year),
               F.concat(F.lit("h"), F.when(F.month(d) > 6, "2").otherwise("1"), F.lit("'"), F.date_format(d, "yy")),
               F.concat(F.lit("in the second half of "), year), year,
               F.concat(F.lit("on "), F.date_format(d, "MMMM dd, yyyy")), F.lit("soon"), F.concat(year, F.lit("-13")))
    orders = spread(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"))
    return orders.select("o_orderkey", "o_custkey", raw.alias("raw"))


@query(f"with {PERIODS} select * from periods")
def parse_periods(t: Tables) -> DataFrame:
    return dates.with_period(period_renderings(t), "raw").select("o_orderkey", "raw", "year", "period", "display")


@query(f"""
select o_orderkey, source, {switch('o_orderkey', "'https://clinicaltrials.gov/study/' || source",
    "'https://www.ncbi.nlm.nih.gov/pmc/articles/' || source || '/'",
    "'https://www.accessdata.fda.gov/scripts/cder/daf/index.cfm?event=overview.process&ApplNo=' || substr(source, 5)",
    "'https://www.sec.gov/Archives/edgar/data/' || o_orderkey || '/' || replace(source, '-', '') || '/'", "null")} as url
from (select o_orderkey, {switch('o_orderkey', NCT, "'PMC' || o_orderkey", "'ANDA' || printf('%06d', o_orderkey)",
                                 "printf('%010d', o_orderkey) || '-24-' || printf('%06d', o_custkey)", "'poster ' || o_orderkey")} as source from orders)""")
def citation_url(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    source = pick(key, nct(key), F.concat(F.lit("PMC"), key.cast("string")), F.format_string("ANDA%06d", key),
                  F.format_string("%010d-24-%06d", key, F.col("o_custkey")), F.concat(F.lit("poster "), key.cast("string")))
    return t.orders.select("o_orderkey", source.alias("source")).withColumn("url", codes.citation_url(F.col("source")))


@query(f"""
select doc_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-'
  || substr('89ab', (strpos('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) as id
from (select doc_id, sha1(unhex('{ids.CHUNKS.hex}') || encode(source || ':' || doc_id)) as h from documents)""")
def uuid5_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ids.uuid5(ids.CHUNKS, F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("id"))


def sentences(text: str) -> Column:
    return F.split(F.col(text), r"[.,\n]")


SENTENCES = "string_split_regex(text, '[.,\\n]')"


@query(f"""
select doc_id, array_to_string(list_transform(list_filter(s, lambda x: length(trim(x)) > 0),
    lambda x: case when length(x) > 20 then 'DRUG' else 'UNKNOWN' end || ':' || trim(x)), '|') as items
from (select doc_id, {SENTENCES} as s from documents)""")
def clean_items(t: Tables) -> DataFrame:
    """Every sentence piece is an item; the short ones carry no type."""
    raw = F.transform(sentences("text"), lambda s: F.struct(F.when(F.length(s) > 20, "DRUG").alias("type"), s.alias("name")))
    shown = F.transform(records.named_items(F.col("raw")), lambda i: F.concat(i["type"], F.lit(":"), i["name"]))
    return spread(t.documents).select("doc_id", raw.alias("raw")).select("doc_id", F.array_join(shown, "|").alias("items"))


@query(f"""
select doc_id, 'Conditions: ' || lang || ', ' || source || chr(10) || 'Interventions: ' || coalesce(nullif(array_to_string(list_transform(
    list_filter(s, lambda x: length(trim(x)) > 0), lambda x: case when length(x) > 20 then 'DRUG' else 'UNKNOWN' end || ': ' || trim(x)), ', '), ''), 'Not specified')
  || chr(10) || 'Study Type: ' || case when n_chars % 2 = 0 then 'INTERVENTIONAL' else 'Not specified' end || chr(10) || 'Summary: ' || text as document
from (select *, {SENTENCES} as s from documents)""")
def embedding_text(t: Tables) -> DataFrame:
    raw = F.transform(sentences("text"), lambda s: F.struct(F.when(F.length(s) > 20, "DRUG").alias("type"), s.alias("name")))
    return spread(t.documents).select("doc_id", "lang", "source", "n_chars", "text", raw.alias("raw")).select(
        "doc_id", records.study_text(F.array("lang", "source"), records.named_items(F.col("raw")),
                                     F.when(F.col("n_chars") % 2 == 0, "INTERVENTIONAL"), F.col("text")).alias("document"))


@query(f"""
select doc_id, array_to_string(list_filter(list_transform(s, lambda x: split_part(trim(x), ' ', 1)), lambda x: x <> ''), '|') as brands,
  array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(s, lambda x: string_split(x, ' '))), lambda x: x <> ''))), '|') as ingredients
from (select doc_id, {SENTENCES} as s from documents)""")
def nested_distinct(t: Tables) -> DataFrame:
    """A document is an application, its sentence pieces are products, their words ingredients."""
    s = F.col("s")
    brands = F.transform(s, lambda p: F.split_part(F.trim(p), F.lit(" "), F.lit(1)))
    words = F.flatten(F.transform(s, lambda p: F.split(p, " ")))
    return spread(t.documents).select("doc_id", sentences("text").alias("s")).select(
        "doc_id", F.array_join(records.present(brands), "|").alias("brands"),
        F.array_join(records.sorted_distinct(words), "|").alias("ingredients"))


@query(r"""
select page_id, trim(regexp_replace(replace(t, '&amp;', '&'), '\s+', ' ', 'g')) as text from (
 select page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
   '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
   '(?s)</?[a-zA-Z!?][^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©') as t from pages)""")
def html_text(t: Tables) -> DataFrame:
    pages = spread(t.pages.select("page_id", "html"))
    return pages.select("page_id", markup.flat_text(F.col("html")).alias("text"))


@query(r"""
select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host,
  case when regexp_extract(dated, '/([0-9]{4}/[0-9]{2}/[0-9]{2})/', 1) <> '' then replace(regexp_extract(dated, '/([0-9]{4}/[0-9]{2}/[0-9]{2})/', 1), '/', '-') end as url_date
from (select *, case when page_id % 3 = 0 then url else regexp_replace(url, '/(en|fr|de|es)/', '/\1/call-transcripts/2024/0' || (1 + page_id % 9) || '/1' || (page_id % 10) || '/') end as dated from pages)""")
def url_parts(t: Tables) -> DataFrame:
    day = F.concat(F.lit("/$1/call-transcripts/2024/0"), (1 + F.col("page_id") % 9).cast("string"), F.lit("/1"),
                   (F.col("page_id") % 10).cast("string"), F.lit("/"))
    dated = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(
        F.regexp_replace("url", F.lit("/(en|fr|de|es)/"), day))
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), dates.url_date(dated).alias("url_date"))


@query(f"""
select o_orderkey, candidate, phase, c_name as sponsor,
  coalesce(trim(candidate) = {NCT} and trim(phase) <> '' and trim(c_name) <> '', false) as accepted
from (select *, {switch('o_orderkey', NCT, "' ' || " + NCT, "printf('NCT%08d', o_orderkey + 1)", NCT, NCT)} as candidate,
        case when substr(o_orderpriority, 1, 1) = '5' then ' ' else 'Phase ' || substr(o_orderpriority, 1, 1) end as phase from orders)
left join customer on c_custkey = o_custkey and c_nationkey <> 3""")
def accept_gate(t: Tables) -> DataFrame:
    """Candidate rows against the record they were made from; the rest is routed apart."""
    key = F.col("o_orderkey")
    phase = F.when(digit() == "5", " ").otherwise(F.concat(F.lit("Phase "), digit()))
    candidate = pick(key, nct(key), F.concat(F.lit(" "), nct(key)), nct(key + 1), nct(key), nct(key))
    rows = t.orders.select("o_orderkey", "o_custkey", candidate.alias("candidate"), phase.alias("phase"))
    named = t.customer.filter("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("sponsor"))
    rows = rows.join(named, "o_custkey", "left")
    passed = records_accept(F.col("candidate"), nct(key), F.col("phase"), F.col("sponsor"))
    return rows.select("o_orderkey", "candidate", "phase", "sponsor", passed.alias("accepted"))


def records_accept(candidate: Column, source: Column, phase: Column, sponsor: Column) -> Column:
    from evidencia.operators.evidence import acceptable
    return acceptable(candidate, source, phase, sponsor)


@query(f"""
select o_orderkey, 'registry|' || {NCT} || '|https://clinicaltrials.gov/study/' || {NCT} || ';' ||
  'literature|PMC' || o_custkey || '|' || case when o_orderstatus = 'F' then ';news|n' || o_custkey || '|x' else '' end as sources
from orders""")
def attach_citation(t: Tables) -> DataFrame:
    from evidencia.operators.evidence import citation, with_registry_citation
    given = F.filter(F.array(
        citation(F.lit("registry"), F.lit("made up"), F.lit("http://wrong")),
        citation(F.lit("literature"), F.concat(F.lit("PMC"), F.col("o_custkey").cast("string")), F.lit("")),
        F.when(F.col("o_orderstatus") == "F", citation(F.lit("news"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")), F.lit("x")))),
        lambda s: s.isNotNull())
    rows = t.orders.select("o_orderkey", with_registry_citation(nct(F.col("o_orderkey")), given).alias("sources"))
    return rows.select("o_orderkey", F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["source_type"], s["reference"], s["url"])), ";").alias("sources"))


@query(f"""
select count(*) filter (len(embedding) = {DIM}) as good, count(*) filter (len(embedding) <> {DIM}) as bad
from (select case when vec_id % 10 = 0 then embedding[1:63] else embedding end as embedding from embeddings)""")
def dim_guard(t: Tables) -> DataFrame:
    cut = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    right = F.size("v") == DIM
    return t.embeddings.select(cut.alias("v")).agg(F.count_if(right).alias("good"), F.count_if(~right).alias("bad"))


@query("""
select label, count(*) as studies from (
  select unnest([case when d = '5' then 'PHASE5' else 'Phase ' || d end, case when o_orderstatus = 'F' then 'Not Applicable' else 'Early Phase 1' end]) as label
  from (select *, substr(o_orderpriority, 1, 1) as d from orders) where o_orderkey % 97 <> 0 and o_orderkey % 11 <> 0)
group by label""")
def phase_mix(t: Tables) -> DataFrame:
    flat = registry.normalize_studies(nested_studies(t))
    return flat.select(F.explode("phases").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("studies"))


@query(f"""
with {DENSE}, {ranked('dense', 20, 'best')},
grid as (select query_id, rank, printf('NCT%08d', b.doc_id) as nct_id, lang || ', ' || source as interventions,
  case when n_chars > 800 then 'Yes' else 'No' end as mechanism_described,
  printf('NCT%08d', b.doc_id) || ' (https://clinicaltrials.gov/study/' || printf('NCT%08d', b.doc_id) || ')' || chr(10) || source as sources
  from best b join documents d on d.doc_id = b.doc_id)
select query_id, ceil(rank / 8.0)::bigint as page, nct_id, interventions, mechanism_described, sources from grid""")
def export_pages(t: Tables) -> DataFrame:
    from evidencia.operators.evidence import export_rows
    hits = dense_topk(vector_corpus(t), vector_queries(t), 20, DIM)
    rows = hits.join(t.documents, "doc_id").select(
        "query_id", "rank", nct(F.col("doc_id")).alias("nct_id"), F.array("lang", "source", "lang").alias("interventions"),
        (F.col("n_chars") > 800).alias("mechanism_described"),
        F.array(*[F.struct(F.lit(k).alias("source_type"), r.alias("reference"), u.alias("url")) for k, r, u in (
            ("registry", nct(F.col("doc_id")), codes.citation_url(nct(F.col("doc_id")))),
            ("news", F.col("source"), F.lit(None).cast("string")))]).alias("sources"))
    return export_rows(rows).select("query_id", "page", "nct_id", "interventions", "mechanism_described", "sources")


@query("""
select o_orderstatus as status, count(*) as total, count(*) filter (o_totalprice > 200000) as mechanism_described,
  count(*) filter (o_totalprice <= 200000) as design_only,
  sum(case when o_orderstatus = substr(o_orderpriority, 1, 1) then 1 else 2 end)::bigint as distinct_interventions
from orders group by o_orderstatus""")
def grid_summary(t: Tables) -> DataFrame:
    from evidencia.operators.evidence import grid_summary as summarize
    rows = t.orders.select(F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 200000).alias("mechanism_described"),
                           F.array("o_orderstatus", digit(), "o_orderstatus").alias("interventions"))
    return summarize(rows, ["status"])
