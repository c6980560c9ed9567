"""Token ids as files of canonical Huffman codes.

Documents are dealt over tasks by ranges of doc_id and encoded once; their ids wait in a scratch table, with the counts of each
task. Package merging turns the counts of the whole corpus into the best codes of at most `LIMIT_BITS` bits, whose lengths alone
make the codebook, as codes are canonical. A second pass writes the ids as blocks of whole documents with at least `BLOCK_IDS`
ids, the last of a stretch less.

Files lie below one folder, as Parquet, so that a lost task is repeated and leaves nothing behind:

* `codebook`: {id, bits}, the length of each id's code.
* `blocks/part=<n>`: {first, n_ids, docs, lengths, checkpoints, payload}. Parts are ranges of ascending doc_id, `first`
  is how many ids stand before the block in its part, `docs` and `lengths` name its documents in order, `checkpoints` are the bit
  offsets of every `STRIDE`th id as little-endian 32-bit numbers, `payload` the codes, first bit highest.

A block is read without any other: a table of 2^bits entries gives id and length for the next bits, and all
stretches between checkpoints advance together, one id at a time.

Null and empty texts are their end mark alone. Rows are in the order of doc_id, null ids first, those of one id in that of a hash of
the text; a third part of the range's bounds, the row, spreads an id that many rows have. Equal rows may swap places, which
nobody can see. Other columns are not looked at. An empty table gives an empty codebook, no blocks and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidencia.llm.parts import PartIds, gathered, slices
from evidencia.llm.tokenizing import file_digest, loaded
from evidencia.session import ship_package, table
from evidencia.sources.store import discard, scratch_path

END_ID = 2
LIMIT_BITS = 16  # more if there are more ids than that can tell apart
MOST_BITS = 24  # a code and its place in a byte fit into 32 bits
BLOCK_IDS = 1 << 16
STRIDE = 128
TOGETHER = 32  # blocks decoded at a time


def code_lengths(counts: np.ndarray, limit: int = LIMIT_BITS) -> np.ndarray:
    """The bits of each id's code, 0 for ids that do not occur: least in total among codes of at most `limit` bits."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        bits[used] = 1
        return bits
    limit = max(limit, int(len(used) - 1).bit_length())
    if limit > MOST_BITS:
        raise ValueError(f"{len(used)} ids need codes of more than {MOST_BITS} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, packages = [], weights[:0]
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        place = np.argsort(both, kind="stable")
        levels.append(place < len(weights))
        both = both[place]
        packages = both[0:len(both) // 2 * 2:2] + both[1::2]
    lengths, take = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for leaves in reversed(levels):
        single = int(leaves[:take].sum())
        lengths[:single] += 1
        take = 2 * (take - single)
    bits[order] = lengths
    return bits


def canonical(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of each id, and the decoding table: id and bits by the next max(bits) bits."""
    order = np.flatnonzero(bits)
    order = order[np.argsort(bits[order], kind="stable")]
    widest = int(bits.max(initial=1))
    span = np.int64(1) << (widest - bits[order].astype(np.int64))
    codes = np.zeros(len(bits), np.uint64)
    codes[order] = ((np.cumsum(span) - span) // span).astype(np.uint64)
    spare = (1 << widest) - int(span.sum())
    ids = np.concatenate([np.repeat(order, span), np.zeros(spare, np.int64)]).astype(np.uint32)
    return codes, ids, np.concatenate([np.repeat(bits[order], span), np.ones(spare, np.uint8)])


def pack(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(checkpoints, payload) of a block."""
    length, code = bits[ids].astype(np.int64), codes[ids]
    ends = np.cumsum(length)
    starts = ends - length
    word, room = starts >> 6, 64 - (starts & 63)
    spill = np.maximum(length - room, 0)
    shifted = np.where(spill > 0, code >> spill.astype(np.uint64), code << np.maximum(room - length, 0).astype(np.uint64))
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))  # a code is shorter than a word, so every word has a first one
    words[:len(first)] = np.bitwise_or.reduceat(shifted, first) if len(first) else 0
    over = spill > 0
    words[word[over] + 1] |= code[over] << (64 - spill[over]).astype(np.uint64)
    return starts[::STRIDE].astype("<u4").tobytes(), words.astype(">u8").tobytes()[:(total + 7) // 8]


def unpack(blocks: list[tuple[int, bytes, bytes]], ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The ids of blocks (n_ids, checkpoints, payload), one after the other."""
    widest = len(ids).bit_length() - 1
    joined = b"".join(payload for _, _, payload in blocks) + bytes(8)
    begin = np.cumsum([0, *(len(payload) for _, _, payload in blocks)][:-1])
    at = np.concatenate([np.frombuffer(marks, "<u4").astype(np.int64) + 8 * b for b, (_, marks, _) in zip(begin, blocks)])
    left = np.concatenate([np.minimum(STRIDE, n - np.arange(0, n, STRIDE)) for n, _, _ in blocks])
    windows = np.ndarray((len(joined) - 4,), ">u4", joined, strides=(1,))
    out = np.zeros((STRIDE, len(at)), np.uint32)
    last, mask = len(windows) - 1, np.int64((1 << widest) - 1)
    for step in range(int(left.max(initial=0))):
        seen = windows[np.minimum(at >> 3, last)].astype(np.int64)
        code = (seen >> (32 - widest - (at & 7))) & mask
        out[step] = ids[code]
        at += bits[code]
    return out.T[np.arange(STRIDE) < left[:, None]]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """docs {doc_id, text} in ascending order, dealt in ranges -> {part, start, doc_id, n, ids} per document, `start` counted in its part,
    and one row {part, counts} per part: how often it has each id, as pairs of 64-bit numbers."""
    spark = docs.sparkSession
    ship_package(spark)
    blob, version = file_digest(tokenizer_path)
    model = spark.sparkContext.broadcast(blob)
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = loaded(PartIds, version, model.value), TaskContext.get().partitionId(), 0
        total, kind = np.zeros(end_id + 1, np.int64), None
        for batch in slices(batches, 1):
            flat, sizes, order, words = encoder.ids(batch.column(1))
            stops = np.concatenate([[0], np.cumsum(sizes[order])])[np.cumsum(words)]  # where each text ends among the ids
            ids = np.insert(gathered(flat, sizes, order), stops, end_id)
            own = np.diff(stops, prepend=0) + 1
            found = np.bincount(ids, minlength=len(total))
            found[:len(total)] += total
            total, kind = found, batch.column(0).type
            n, width = batch.num_rows, encoder.encoder.width
            offsets = np.concatenate([[0], np.cumsum(own * width.itemsize)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int64)), pa.array(np.cumsum(own) - own + before), batch.column(0), pa.array(own),
                 pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(width))]).cast(pa.binary()),
                 pa.nulls(n, pa.binary())], ["part", "start", "doc_id", "n", "ids", "counts"])
            before += int(own.sum())
        if kind is not None:
            some = np.flatnonzero(total)
            pairs = np.stack([some, total[some]], 1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.int64()),
                                              pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())],
                                             ["part", "start", "doc_id", "n", "ids", "counts"])

    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", "text", mark.alias("_mark"), F.monotonically_increasing_id().alias("_row"))
    ordered = keyed.repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("_mark"), F.asc("_row")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "_mark", "_row")
    return ordered.select("doc_id", "text").mapInArrow(
        run, f"part bigint, start bigint, doc_id {id_type.simpleString()}, n bigint, ids binary, counts binary")


def global_counts(table: DataFrame) -> np.ndarray:
    """How often each id occurs, from the rows of `encoded`; at most one row per id of the vocabulary comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 2)
            ids, place = np.unique(pairs[:, 0], return_inverse=True)
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, place, pairs[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total)], ["id", "n"])

    rows = table.filter("counts is not null").select("counts").mapInArrow(run, "id bigint, n bigint")
    counts = rows.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    dense[counts["id"]] = counts["n"]
    return dense


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """The ids of docs {doc_id, text, ...}, each document with `end_id` behind it, as files below `path`."""
    spark = docs.sparkSession
    scratch = scratch_path(spark, "ids")
    encoded(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(scratch)
    # Texts were shuffled once and are not needed any more: let Spark's cleaner drop that shuffle before the files are written.
    spark._jvm.System.gc()
    table = spark.read.parquet(scratch)
    bits = code_lengths(global_counts(table))
    some = np.flatnonzero(bits)
    spark.createDataFrame(list(zip(some.tolist(), bits[some].tolist())), "id bigint, bits bigint").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((bits, canonical(bits)[0]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codes = shared.value
        names, lengths, kept, part, first, n = [], [], [], None, 0, 0

        def full() -> pa.RecordBatch:
            marks, payload = pack(np.concatenate(kept), bits, codes)
            docs = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                 pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([marks]), pa.array([payload])],
                ["part", "first", "n_ids", "docs", "lengths", "checkpoints", "payload"])

        for batch in batches:
            parts, starts, own = (batch.column(k).to_numpy() for k in (0, 1, 3))
            # Documents of a block follow each other in one part; a table that is read in pieces breaks blocks, not documents.
            breaks = np.concatenate([[True], (parts[1:] != parts[:-1]) | (starts[1:] != starts[:-1] + own[:-1])])
            at = 0
            while at < len(own):
                if n and (breaks[at] if at else (parts[0] != part or starts[0] != first + n)):
                    yield full()
                    names, lengths, kept, n = [], [], [], 0
                if not n:
                    part, first = int(parts[at]), int(starts[at])
                # Documents up to the next break, as many as fill the block.
                end = at + 1 + int(np.argmax(np.append(breaks[at + 1:], True)))
                stop = min(end, at + 1 + int(np.searchsorted(np.cumsum(own[at:end]), BLOCK_IDS - n)))
                names.append(batch.column(2).slice(at, stop - at)), lengths.append(own[at:stop])
                raw = b"".join(batch.column(4).slice(at, stop - at).to_pylist())
                kept.append(np.frombuffer(raw, f"<u{len(raw) // int(own[at:stop].sum())}"))
                n, at = n + len(kept[-1]), stop
                if n >= BLOCK_IDS:
                    yield full()
                    names, lengths, kept, n = [], [], [], 0
        if n:
            yield full()

    rows = table.filter("counts is null").select("part", "start", "doc_id", "n", "ids")
    rows.mapInArrow(run, f"part bigint, first bigint, n_ids bigint, docs array<{kind}>, lengths array<bigint>, checkpoints binary, "
                         "payload binary").write.partitionBy("part").parquet(f"{path}/blocks")
    discard(spark, scratch)


def stored_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all files. A corpus without documents has none, and no file that could tell their columns."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/blocks/part=*")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder):
        return spark.read.parquet(f"{path}/blocks").withColumn("part", F.col("part").cast("bigint"))
    return spark.createDataFrame([], "first bigint, n_ids bigint, docs array<bigint>, lengths array<bigint>, checkpoints binary, payload binary, part bigint")


def read(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """Files below `path` -> {doc_id, start, n_tokens, ids}: the ids before the document and its own as little-endian 32-bit
    numbers; with `digests` their CRC-32 `ids_crc32` instead, so that ids stay in the tasks."""
    blocks = stored_blocks(spark, path)
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    bits = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    bits[book["id"]] = book["bits"]
    shared = spark.sparkContext.broadcast(canonical(bits)[1:])
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("part", "_before")
    placed = blocks.join(parts, "part").select((F.col("_before") + F.col("first")).alias("start"), "n_ids", "docs", "lengths",
                                               "checkpoints", "payload")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, width = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                ids = unpack(list(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())), names, width)
                sizes = batch.column(3).flatten().to_numpy()
                many = np.diff(batch.column(3).offsets.to_numpy())
                stops = np.cumsum(sizes)
                # Where each block's ids begin among those decoded here, to turn places here into places in the corpus.
                shift = np.repeat(batch.column(0).to_numpy() - (np.cumsum(batch.column(1).to_numpy()) - batch.column(1).to_numpy()), many)
                flat = memoryview(ids.astype("<u4").tobytes())
                own = [flat[4 * b:4 * e] for b, e in zip((stops - sizes).tolist(), stops.tolist())]
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if digests else pa.array([bytes(x) for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(2).flatten(), pa.array(stops - sizes + shift), pa.array(sizes), last],
                                                 ["doc_id", "start", "n_tokens", "last"])

    out = placed.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, last {'bigint' if digests else 'binary'}")
    return out.withColumnRenamed("last", "ids_crc32" if digests else "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back."""
    path = scratch_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read(spark, path, digests=True)
