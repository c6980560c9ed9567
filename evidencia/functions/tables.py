"""Markdown chunks as a table function for SQL.

`SELECT d.id, c.* FROM docs d, LATERAL markdown_chunks(d.text) c` gives what `segments.markdown_chunks` gives as an array; the tests hold
the two together. The column form stays in generated code; this one is for statements that want rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession, functions as F

from evidencia.functions.segments import CHUNKING, MARKDOWN_SEPARATORS
from evidencia.session import ship_package

WHITE = " \t\n\v\f\r"


def _pieces(text: str, separators: list[str], size: int, overlap: int) -> Iterator[str | None]:
    """Pieces shorter than `size`, and None where packing must break."""
    if not separators:
        step = size - overlap
        for at in range(0, max(len(text) - size, 0) + step, step):
            if at == 0 or at < len(text) - overlap:
                yield from (None, text[at:at + size], None)
        return
    first, *rest = text.split(separators[0])
    for piece in [first, *[separators[0] + r for r in rest]]:
        if not piece:
            continue
        if len(piece) < size:
            yield piece
        else:
            yield None
            yield from _pieces(piece, separators[1:], size, overlap)
            yield None


def _packed(pieces: Iterator[str | None], size: int, overlap: int) -> Iterator[str]:
    """Greedy packing; a new chunk starts with the trailing pieces of the last that fit into the overlap."""
    held: list[str] = []
    for piece in pieces:
        if piece is None:
            if held:
                yield "".join(held)
            held = []
            continue
        if held and sum(map(len, held)) + len(piece) > size:
            yield "".join(held)
            kept, total = [], 0
            for last in reversed(held):
                total += len(last)
                if total > overlap or total + len(piece) > size:
                    break
                kept.insert(0, last)
            held = kept
        held.append(piece)
    if held:
        yield "".join(held)


class MarkdownChunks:
    """Rows {chunk_index, chunk_count, is_table, chunk} of a text; a null text has none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        blocks: list[tuple[bool, list[str]]] = []
        for line in (text or "").replace("\r\n", "\n").split("\n"):
            is_table = line.lstrip(" ").startswith("|")
            if not blocks or blocks[-1][0] != is_table:
                blocks.append((is_table, []))
            blocks[-1][1].append(line)
        out = []
        for is_table, lines in blocks:
            body = "\n".join(lines)
            if is_table:
                out.append((True, body))
            else:
                chunks = [body] if len(body) <= size else _packed(_pieces(body, MARKDOWN_SEPARATORS, size, overlap), size, overlap)
                out += [(False, c.strip(WHITE)) for c in chunks if c.strip(WHITE)]
        for index, (is_table, chunk) in enumerate(out):
            yield index, len(out), is_table, chunk


def register(spark: SparkSession) -> None:
    """Create markdown_chunks(text, size, overlap) in the session; Arrow carries the rows."""
    ship_package(spark)
    made = F.udtf(MarkdownChunks, returnType="chunk_index int, chunk_count int, is_table boolean, chunk string", useArrow=True)
    spark.udtf.register("markdown_chunks", made)


SIZE, OVERLAP = CHUNKING["markdown"]
