"""The SQL functions on the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evidencia.functions import ids, sql, tables
from evidencia.plans.registry import Tables, query
from evidencia.sizing import spread


@query()
def sql_functions(t: Tables) -> DataFrame:
    sql.register(t.spark)
    return t.spark.sql(f"""
        SELECT doc_id, chunk_index, evidence_uuid5('{ids.CHUNKS}', concat_ws(':', doc_id, chunk_index)) AS chunk_id, chunk
        FROM (SELECT doc_id, posexplode(chunks) AS (chunk_index, chunk)
              FROM (SELECT doc_id, evidence_chunks(text, 1500, 150) AS chunks FROM {{docs}}))""",
                       docs=spread(t.documents.select("doc_id", "text")))


MARKDOWN = """concat('Document of ', source, '.', chr(10), chr(10), '| field | value |', chr(10), '|---|---|', chr(10), '| lang | ', lang, ' |', chr(10),
  '| characters | ', cast(n_chars as varchar(20)), ' |', chr(10), text)"""


@query(f"""
with md as (select doc_id, {MARKDOWN} as body from documents),
lines as (select doc_id, i, l[i] as line, starts_with(ltrim(l[i]), '|') as is_table from (
  select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) as l from md))),
flag as (select *, case when is_table = lag(is_table) over (partition by doc_id order by i) then 0 else 1 end as opens from lines),
isle as (select *, sum(opens) over (partition by doc_id order by i) as no from flag)
select doc_id, string_agg(line, chr(10) order by i) as table_text from isle where is_table group by doc_id, no""")
def markdown_tables(t: Tables) -> DataFrame:
    """Documents with a table in front, cut by the table function in SQL; tables come back whole."""
    tables.register(t.spark)
    docs = spread(t.documents)
    return t.spark.sql(f"""
        SELECT d.doc_id, c.chunk AS table_text
        FROM (SELECT doc_id, {MARKDOWN.replace("varchar(20)", "string")} AS body FROM {{docs}}) d,
             LATERAL markdown_chunks(d.body, {tables.SIZE}, {tables.OVERLAP}) c
        WHERE c.is_table""", docs=docs)
