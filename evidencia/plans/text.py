"""Chunking and keyword windows on the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.functions import segments
from evidencia.plans.registry import Tables, query
from evidencia.sizing import spread

KEYWORDS = ["pour", "thention", "for"]
WINDOW = (40, 120, 30)
HITS = " || ".join(
    f"list_transform(range(1, len(string_split(lower(text), '{k}'))), lambda i: list_sum(list_transform((string_split(lower(text), '{k}'))[1:i], lambda x: length(x)))::bigint + (i - 1) * {len(k)})"
    for k in KEYWORDS)
SPANS = f"""
hits as (select doc_id, text, unnest(list_sort(list_distinct({HITS}))) as h from documents),
wins as (select *, greatest(h - {WINDOW[0]}, 0) as s, least(h + {WINDOW[1]}, length(text)) as e from hits),
flag as (select *, case when s > max(e) over (partition by doc_id order by h rows between unbounded preceding and 1 preceding) + {WINDOW[2]}
   or row_number() over (partition by doc_id order by h) = 1 then 1 else 0 end as opens from wins),
isle as (select *, sum(opens) over (partition by doc_id order by h) as span_no from flag),
spans as (select doc_id, span_no, min(s) as start_at, max(e) as end_at, any_value(text) as text from isle group by doc_id, span_no)"""


def windowed(t: Tables) -> DataFrame:
    docs = spread(t.documents.select("doc_id", "text"))
    return segments.with_windows(docs, "text", KEYWORDS, WINDOW)


@query(f"with {SPANS} select doc_id, span_no::bigint as span_no, start_at::bigint as start_at, end_at::bigint as end_at, md5(substr(text, start_at + 1, end_at - start_at)) as mark from spans")
def keyword_windows(t: Tables) -> DataFrame:
    spans = windowed(t).select("doc_id", "text", F.posexplode("spans").alias("i", "span"))
    start, end = F.col("span.start"), F.col("span.end")
    return spans.select("doc_id", (F.col("i") + 1).cast("bigint").alias("span_no"), start.cast("bigint").alias("start_at"),
                        end.cast("bigint").alias("end_at"), F.md5(F.substr("text", start + 1, end - start)).alias("mark"))


@query(f"""with {SPANS}
select doc_id, case when trim(text) = '' then 'empty text' else 'no keyword' end as reason from documents where doc_id not in (select doc_id from spans)""")
def skip_report(t: Tables) -> DataFrame:
    return segments.skip_report(windowed(t), "doc_id", "text", "hits")


@query("""
select doc_id, i::integer as chunk_index, substr(text, i * 300 + 1, 350) as chunk from (
  select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 350) / 300.0), 0)::bigint + 1)) as i from documents where length(text) > 0)""")
def chunk_fixed(t: Tables) -> DataFrame:
    chunks = segments.stride_chunks(F.col("text"), 350, 50)
    return t.documents.select("doc_id", F.posexplode(chunks).alias("chunk_index", "chunk"))


@query()
def chunk_recursive(t: Tables) -> DataFrame:
    docs = spread(t.documents.select("doc_id", "text"))
    chunks = segments.recursive_chunks(F.col("text"), *segments.CHUNKING["literature"])
    return segments.chunk_rows(docs, "doc_id", chunks).select("doc_id", "chunk_id", "chunk_index", "chunk_count", "chunk")
