"""Cutting texts into chunks and keyword windows, row by row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidencia.functions.binding import let
from evidencia.functions.ids import CHUNKS, uuid5

# (size, overlap) per corpus
CHUNKING = {"literature": (1500, 150), "filings": (1500, 150), "letters": (1500, 200),
            "news": (1200, 150), "markdown": (2000, 200)}
SEPARATORS = ["\n\n", "\n", " "]
MARKDOWN_SEPARATORS = ["```\n", "\n\n", "\n", " "]
# (characters before a hit, after a hit, merge gap)
FILING_WINDOW = (500, 2500, 500)
TRANSCRIPT_WINDOW = (400, 1800, 400)
# Keywords around which filings and call transcripts are cut.
FILING_KEYWORDS = ["Pipeline", "Clinical Trials", "Research and Development"]
TRANSCRIPT_KEYWORDS = [
    "pipeline", "forward-looking", "guidance", "Phase 1", "Phase 2", "Phase 3",
    "FDA", "PDUFA", "deprioritiz", "discontinu", "topline", "readout",
    "regulatory", "approval", "label", "accelerat",
]
_CUT = "\uffff"  # a noncharacter: marks cut points while a text is being split
_EMPTY = "array<string>"


def _empty() -> Column:
    return F.array().cast(_EMPTY)


def _break() -> Column:
    """A null piece: chunks never reach across it."""
    return F.array(F.lit(None).cast("string"))


def stride_chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each starting `size - overlap` after the one before."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, chunks).otherwise(_empty())


def _pieces(text: Column, separators: list[str], size: int, overlap: int) -> Column:
    """Pieces shorter than `size` in text order; a longer piece is cut at the next finer separator
    and set apart by breaks, since its parts are packed on their own."""
    if not separators:
        return F.flatten(F.transform(stride_chunks(text, size, overlap),
                                     lambda c: F.concat(_break(), F.array(c), _break())))
    sep = separators[0]
    parts = F.filter(F.split(F.replace(text, F.lit(sep), F.lit(_CUT + sep)), _CUT), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) < size, F.array(p)).otherwise(
        F.concat(_break(), _pieces(p, separators[1:], size, overlap), _break()))))


def _pack(pieces: Column, size: int, overlap: int) -> Column:
    """Greedy packing of pieces into chunks; a new chunk starts with the trailing pieces of the last
    one that fit into the overlap.

    The fold walks over piece numbers and keeps only where the open chunk starts and how long it is,
    so a step costs the same however many pieces the chunk holds.
    """
    state = "struct<cuts:array<struct<start:int,stop:int>>,start:int,total:int>"

    def cut(acc, stop):
        return F.when(acc["start"] < stop, F.concat(acc["cuts"], F.array(F.struct(
            acc["start"].alias("start"), stop.alias("stop"))))).otherwise(acc["cuts"])

    def tail(lengths, acc, stop, length):
        """(how many trailing pieces carry over, their length)"""
        def step(t, n):
            total = t["total"] + n
            fits = t["open"] & (total <= overlap) & (total + length <= size)
            return F.struct((t["kept"] + fits.cast("int")).alias("kept"),
                            F.when(fits, total).otherwise(t["total"]).alias("total"), fits.alias("open"))
        start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("total"), F.lit(True).alias("open"))
        return F.aggregate(F.reverse(F.slice(lengths, acc["start"] + 1, stop - acc["start"])), start, step)

    def fold(parts, lengths):
        def step(acc, i):
            length = F.get(lengths, i)
            broken = F.struct(cut(acc, i).alias("cuts"), (i + 1).alias("start"), F.lit(0).alias("total"))
            rolled = let(tail(lengths, acc, i, length), lambda kept: F.struct(
                cut(acc, i).alias("cuts"), (i - kept["kept"]).alias("start"), (kept["total"] + length).alias("total")))
            grown = F.struct(acc["cuts"].alias("cuts"), acc["start"].alias("start"), (acc["total"] + length).alias("total"))
            full = (acc["total"] + length > size) & (acc["start"] < i)
            return F.when(length.isNull(), broken).when(full, rolled).otherwise(grown).cast(state)

        start = F.struct(F.array().alias("cuts"), F.lit(0).alias("start"), F.lit(0).alias("total")).cast(state)
        numbers = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        cuts = F.aggregate(numbers, start, step, lambda acc: cut(acc, F.size(parts)))
        return F.transform(cuts, lambda c: F.array_join(F.slice(parts, c["start"] + 1, c["stop"] - c["start"]), ""))

    return let(pieces, lambda parts: let(F.transform(parts, F.length), lambda lengths: fold(parts, lengths)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def recursive_chunks(text: Column, size: int, overlap: int, separators: list[str] | None = None) -> Column:
    """Chunks of at most `size` characters cut at the coarsest separator that works."""
    packed = _pack(_pieces(text, SEPARATORS if separators is None else separators, size, overlap), size, overlap)
    chunks = F.when(F.length(text) <= size, F.array(text)).otherwise(packed)
    return F.filter(F.transform(chunks, stripped), lambda c: c != "")


def _is_table(line: Column) -> Column:
    return F.ltrim(line).startswith("|")


def markdown_blocks(text: Column) -> Column:
    """Alternating prose and table blocks as array<struct(is_table, text)>."""
    def blocks(lines):
        index = F.sequence(F.lit(1), F.size(lines))
        starts = F.filter(index, lambda i: (i == 1) | (
            _is_table(F.get(lines, i - 1)) != _is_table(F.get(lines, i - 2))))
        return let(starts, lambda at: F.transform(at, lambda s, i: F.struct(
            _is_table(F.get(lines, s - 1)).alias("is_table"),
            F.array_join(F.slice(lines, s, F.coalesce(F.get(at, i + 1), F.size(lines) + 1) - s), "\n").alias("text"))))
    return let(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), blocks)


def table_blocks(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: b["is_table"]), lambda b: b["text"])


def markdown_chunks(blocks: Column, size: int, overlap: int) -> Column:
    """Chunks in which every table stands alone and whole; each stretch of prose between tables is packed on its own."""
    return F.filter(F.flatten(F.transform(blocks, lambda b: F.when(b["is_table"], F.array(b["text"])).otherwise(
        recursive_chunks(b["text"], size, overlap, MARKDOWN_SEPARATORS)))), lambda c: c != "")


def table_audit(docs: DataFrame, doc_id: str, tables: str, chunks: str) -> DataFrame:
    """Per document: tables found, kept whole inside one chunk, and split."""
    intact = F.size(F.filter(tables, lambda t: F.exists(chunks, lambda c: F.contains(c, t))))
    return docs.select(doc_id, F.size(tables).alias("tables_found"), intact.alias("tables_intact"),
                       (F.size(tables) - intact).alias("tables_split"))


def chunk_rows(docs: DataFrame, key: str, chunks: Column) -> DataFrame:
    """One row per chunk with its index, the number of chunks and a deterministic id."""
    listed = docs.withColumn("_chunks", F.explode(F.array(chunks)))  # a generator: computed once, not per use
    rows = listed.select(*docs.columns, F.size("_chunks").alias("chunk_count"),
                         F.posexplode("_chunks").alias("chunk_index", "chunk"))
    return rows.withColumn("chunk_id", uuid5(CHUNKS, F.concat_ws(":", F.col(key).cast("string"), F.col("chunk_index").cast("string"))))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Sorted distinct 0-based offsets of every keyword occurrence, ignoring case."""
    def offsets(keyword):
        parts = F.split(text, r"(?i)\Q" + keyword + r"\E")
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))

        def step(acc, part):
            hit = acc["at"] + F.length(part)
            return F.struct((hit + len(keyword)).alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))
        return let(parts, lambda p: F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), start, step, lambda acc: acc["hits"]))
    return F.array_sort(F.array_distinct(F.concat(*[offsets(k) for k in keywords])))


def keyword_spans(hits: Column, length: Column, before: int, after: int, gap: int) -> Column:
    """Windows around the hits, clamped to the text and merged when at most `gap` apart.

    All windows have the same reach, so ends never decrease and the merged end so far is always the
    end of the hit before: a span starts where a window begins past that end plus the gap.
    """
    def begin(hit):
        return F.greatest(hit - before, F.lit(0))

    def end(hit):
        return F.least(hit + after, length)

    def spans(h):
        index = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(index, lambda i: (i == 0) | (begin(F.get(h, i)) > end(F.get(h, i - 1)) + gap))
        return let(starts, lambda at: F.transform(at, lambda s, i: F.struct(
            begin(F.get(h, s)).alias("start"), end(F.get(h, F.coalesce(F.get(at, i + 1), F.size(h)) - 1)).alias("end"))))
    return let(hits, spans)


def with_windows(docs: DataFrame, text: str, keywords: list[str], window: tuple[int, int, int]) -> DataFrame:
    """Adds `hits` and `spans`; the two steps are kept apart so each is computed once."""
    return docs.withColumn("hits", F.explode(F.array(keyword_hits(F.col(text), keywords)))).withColumn(
        "spans", let(F.length(text), lambda n: keyword_spans(F.col("hits"), n, *window)))


def excerpt(text: Column, spans: Column) -> Column:
    """The text of the spans, joined by a blank line."""
    return F.array_join(F.transform(spans, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])), "\n\n")


def skip_report(docs: DataFrame, doc_id: str, text: str, hits: str) -> DataFrame:
    """Documents left out, with the reason."""
    reason = F.when(F.length(F.trim(text)) == 0, "empty text").when(F.size(hits) == 0, "no keyword")
    return docs.select(doc_id, F.coalesce(reason, F.when(F.col(text).isNull(), "empty text")).alias("reason")).filter("reason is not null")
