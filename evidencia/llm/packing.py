"""Packing by minimum bin slack.

Each document becomes its token ids and an end mark, cut into windows of `WINDOW` ids and a rest. Full
windows are sequences. What matters of the rests is how many there are of each length, at most `WINDOW` - 1
numbers however many documents there are; with these the driver fills window after window: the longest
rest left opens it, and a subset-sum dynamic program over the remaining multiset, kept as a bitset of reachable
lengths, gives the rests that come closest to the capacity, with their counts by walking the bitsets back.
A filling is repeated as often as its counts allow, so the plan stays small. Tasks number the rests of each length
and read their sequence and offset from the plan. Pieces keep their ids, and the number of the row that they come
from, as ids of documents may be null or repeat; only lengths and numbers are ranked, then ids meet their places.
`sequences` puts the pieces of a sequence together and pads them.

Null and empty texts are one end mark. Null ids and repeated rows are packed like any other; an empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidencia.llm.keyed import ranked
from evidencia.llm.parts import gathered, slices
from evidencia.llm.tokenizing import WordIds, file_digest, loaded
from evidencia.session import ship_package, table
from evidencia.sources.store import written

WINDOW = 2048
END_ID = 1
RANK_BITS = 44  # ranks below 2^44; lengths are above them in the plan's keys


def tokenized(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """docs {doc_id, text} -> {doc_id, row, start, length, doc_tokens, ids}: windows and rests of every document. `row` is
    a number of the row, `ids` are little-endian 32-bit numbers."""
    spark = docs.sparkSession
    ship_package(spark)
    blob, version = file_digest(tokenizer_path)
    model = spark.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(WordIds, version, model.value)
        for batch in slices(batches, 2):
            flat, sizes, order, parts = encoder.ids(batch.column(2))
            stops = np.concatenate([[0], np.cumsum(sizes[order])])[np.cumsum(parts)]  # where each text ends among the ids
            ids = np.insert(gathered(flat, sizes, order), stops, END_ID)
            total = np.diff(stops, prepend=0) + 1
            pieces = -(-total // window)
            take = np.repeat(np.arange(len(total)), pieces)
            start = (np.arange(len(take)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, total[take] - start)
            offsets = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(start), pa.array(length), pa.array(total[take]),
                 pa.BinaryArray.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])],
                ["doc_id", "row", "start", "length", "doc_tokens", "ids"])

    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, "
                                 "row bigint, start bigint, length bigint, doc_tokens bigint, ids binary")


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset out of `counts` {length: how many} whose sum is nearest to `capacity` from below."""
    reach, before = 1, []
    goal, mask = 1 << capacity, (1 << (capacity + 1)) - 1
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        before.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left > 0:  # 1, 2, 4, ... copies at a time
            copies = min(step, left)
            reach |= (reach << (copies * length)) & mask
            left, step = left - copies, step * 2
        if reach & goal:
            break
    target, used = reach.bit_length() - 1, {}
    for length, earlier in reversed(before):
        copies = 0
        while not earlier >> target & 1:
            target, copies = target - length, copies + 1
        if copies:
            used[length] = copies
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """Fillings as (times, {length: how many in each window}) that use up `counts`."""
    counts = {k: n for k, n in counts.items() if n > 0}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fill(counts, window - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return out


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """{doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row, ids}, one row per piece."""
    spark = docs.sparkSession
    pieces = written(tokenized(docs, tokenizer_path, window), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    full = counts.pop(window, 0)
    # The plan as sorted intervals of (length, rank): first sequence, how many per sequence, offset in it.
    keys, steps, sequence, taken = [window << RANK_BITS], [(0, 1, 0)], full, dict.fromkeys(counts, 0)
    for times, used in plan(counts, window):
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            keys.append(length << RANK_BITS | taken[length])
            steps.append((sequence, n, offset))
            taken[length] += times * n
            offset += length * n
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    shared = spark.sparkContext.broadcast((np.array(keys, np.int64)[order], np.array(steps, np.int64)[order]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, facts = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            key = length << RANK_BITS | rank
            at = np.searchsorted(begins, key, side="right") - 1
            inside = key - begins[at]
            first, per, offset = facts[at].T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(first + inside // per), pa.array(offset + inside % per * length)],
                ["row", "start", "sequence_id", "offset"])

    numbered = ranked(pieces.select("row", "start", "length"), "length", [F.asc("row"), F.asc("start")], F.struct("row", "start"))
    placed = numbered.select("row", "start", "length", "rank").mapInArrow(
        place, "row bigint, start bigint, sequence_id bigint, offset bigint")
    return pieces.join(placed, ["row", "start"]).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "row", "ids")


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of `packed` -> {sequence_id, length, ids}: the training sequences, `window` ids each of which those from
    `length` on are `END_ID`. A sequence has at most `window` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_join(
        F.transform(parts, lambda x: F.hex(x["ids"])), "").alias("_digits"))
    pad = END_ID.to_bytes(4, "little").hex()
    padded = F.concat("_digits", F.repeat(F.lit(pad), F.lit(window) - F.col("length").cast("int")))
    return joined.select("sequence_id", "length", F.unhex(padded).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece went, with a digest of its ids."""
    pieces = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.drop("row", "ids")
