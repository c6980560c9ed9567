"""The text and id functions for use in SQL, as temporary functions over SQL expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

UUID5 = """
CREATE OR REPLACE TEMPORARY FUNCTION evidence_uuid5(namespace STRING, key STRING) RETURNS STRING RETURN
  transform(array(sha1(concat(unhex(replace(namespace, '-', '')), encode(key, 'UTF-8')))), h -> concat_ws('-',
    substr(h, 1, 8), substr(h, 9, 4), concat('5', substr(h, 14, 3)),
    concat(substr('89ab', pmod(instr('0123456789abcdef', substr(h, 17, 1)) - 1, 4) + 1, 1), substr(h, 18, 3)), substr(h, 21, 12)))[0]
"""

STRIDE = """
CREATE OR REPLACE TEMPORARY FUNCTION evidence_stride(text STRING, size INT, overlap INT) RETURNS ARRAY<STRING> RETURN
  CASE WHEN length(text) > 0 THEN transform(
    sequence(0, cast(greatest(ceil((length(text) - size) / (size - overlap)), 0) AS INT)),
    i -> substr(text, i * (size - overlap) + 1, size)) ELSE cast(array() AS ARRAY<STRING>) END
"""


def _pieces(text: str, separators: list[str], depth: int = 0) -> str:
    """SQL of the pieces of `text` with NULL marks where packing must break."""
    p = f"p{depth}"
    if not separators:
        cut = (f"transform(sequence(0, cast(greatest(ceil((length({text}) - size) / (size - overlap)), 0) AS INT)), "
               f"i -> substr({text}, i * (size - overlap) + 1, size))")
        return f"flatten(transform({cut}, c -> array(NULL, c, NULL)))"
    sep = separators[0]
    parts = f"filter(split(replace({text}, '{sep}', '\\uffff{sep}'), '\\uffff'), q -> q <> '')"
    finer = _pieces(p, separators[1:], depth + 1)
    return (f"flatten(transform({parts}, {p} -> CASE WHEN length({p}) < size THEN array({p}) "
            f"ELSE concat(array(cast(NULL AS STRING)), {finer}, array(cast(NULL AS STRING))) END))")


_STATE = "STRUCT<chunks: ARRAY<STRING>, held: ARRAY<STRING>, total: INT>"
_CLOSED = "CASE WHEN size(acc.held) > 0 THEN concat(acc.chunks, array(array_join(acc.held, ''))) ELSE acc.chunks END"
_TAIL = """aggregate(reverse(acc.held),
      cast(named_struct('kept', array(), 'total', 0, 'open', true) AS STRUCT<kept: ARRAY<STRING>, total: INT, open: BOOLEAN>),
      (t, q) -> CASE WHEN t.open AND t.total + length(q) <= overlap AND t.total + length(q) + length(p) <= size
        THEN named_struct('kept', concat(array(q), t.kept), 'total', t.total + length(q), 'open', true)
        ELSE named_struct('kept', t.kept, 'total', t.total, 'open', false) END)"""

RECURSIVE = rf"""
CREATE OR REPLACE TEMPORARY FUNCTION evidence_chunks(text STRING, size INT, overlap INT) RETURNS ARRAY<STRING> RETURN
  filter(transform(aggregate({_pieces("text", ["\\n\\n", "\\n", " "])},
    cast(named_struct('chunks', array(), 'held', array(), 'total', 0) AS {_STATE}),
    (acc, p) -> cast(CASE
      WHEN p IS NULL THEN named_struct('chunks', {_CLOSED}, 'held', cast(array() AS ARRAY<STRING>), 'total', 0)
      WHEN acc.total + length(p) > size AND size(acc.held) > 0 THEN transform(array({_TAIL}),
        k -> named_struct('chunks', {_CLOSED}, 'held', concat(k.kept, array(p)), 'total', k.total + length(p)))[0]
      ELSE named_struct('chunks', acc.chunks, 'held', concat(acc.held, array(p)), 'total', acc.total + length(p)) END AS {_STATE}),
    acc -> {_CLOSED}), c -> regexp_replace(c, '^\\s+|\\s+$', '')), c -> c <> '')
"""


def register(spark: SparkSession) -> list[str]:
    """Create evidence_uuid5, evidence_stride and evidence_chunks in the session."""
    for statement in (UUID5, STRIDE, RECURSIVE):
        spark.sql(statement)
    return ["evidence_uuid5", "evidence_stride", "evidence_chunks"]
