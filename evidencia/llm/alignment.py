"""Token sequences of two tokenizers aligned by the places where both end a token.

Bytes that both tokenizers see are the text with a space in front. Where the ends of both meet, a group ends. The two arrays of ends
are walked together at an index shift: while they agree at that shift, tokens are one to one and a probe that doubles with every
success jumps over the stretch; where they differ, one group is resolved locally by stepping on in the array that is behind
until both meet, and the difference of the two indices is the new shift.

Most texts repeat their words, so what is aligned are the parts of texts (see `parts`), whose ends are ends of both sequences; new parts
are aligned in one long run, known ones kept in the worker. A text that cannot be cut is one part.

How many documents hold a pair of ids is counted in two steps. Texts are dealt in slices of bounded size; each slice counts
its pairs, one row per slice and pair, which are added up and compared with the other pairs of their first id (at most as many as the
second vocabulary has ids). Each slice then gets back the facts of its own pairs and adds them up over its links, which it
finds again in what the first step left, the slice's parts in numbers: no text is encoded twice. So nothing that grows with the
corpus is broadcast, and a pair in all documents makes one row per slice.

Null and empty texts, and those whose tokens do not spell the text (the second file has other signs for some), have no tokens. Null
and repeated ids and repeated rows are documents of their own. Columns of other names are not looked at. Ties of the
highest count all count as best. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidencia.llm import parts
from evidencia.llm.parts import PartIds, Pieces, cut, gathered, run_of, runs
from evidencia.llm.tokenizing import file_digest, loaded
from evidencia.session import ship_package, table
from evidencia.sources.store import written

PAIR_BITS = 32  # a pair is its first id above its second
WIDE = 4_096  # links of a group from which equal pairs in it are added up at once
ENTRIES = 2_000_000  # (document, pair) entries sorted at a time
REMEMBERED = 300_000  # parts kept in memory
SLICE_CHARS = 4_000_000  # texts linked at a time; their links are held several times over


def aligned(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Ends of tokens in bytes, ascending and with the same last -> how many tokens of either stand before the end of each group."""
    i = j = 0
    ends_a, ends_b = [], []
    while i < len(a):
        step = 1
        while step:  # one to one at this shift, as far as it goes
            if i + step <= len(a) and a[i:i + step] == b[j:j + step]:
                ends_a += range(i + 1, i + step + 1)
                ends_b += range(j + 1, j + step + 1)
                i, j, step = i + step, j + step, step * 2
            else:
                step //= 2
        if i == len(a):
            break
        while a[i] != b[j]:  # one group of another shape
            if a[i] < b[j]:
                i += 1
            else:
                j += 1
        i, j = i + 1, j + 1
        ends_a.append(i), ends_b.append(j)
    return ends_a, ends_b


class Aligner:
    """What is known of parts: ids of both tokenizers, tokens of either in each group, and whether both spell the part. Parts are
    numbered; the numbers of one kind stand one part after the other in one array."""

    def __init__(self, blobs: tuple[bytes, bytes]):
        self.words, self.second = PartIds(blobs[0], plain=True, remembered=REMEMBERED // 4), Pieces(blobs[1])
        self.first = self.words.encoder
        self.apart = self.first.apart and self.second.apart
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.a = self.b = self.in_a = self.in_b = self.n_a = self.n_b = self.n_groups = np.zeros(0, np.int32)
        self.spelled = np.zeros(0, bool)

    def _second(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(the parts in the order in which they were encoded, their ids, how many each has, which are spelled)."""
        order, flat, many, single = [], [], [], []
        for places, together in runs(parts, range(len(parts))):
            some = [parts[k] for k in places]
            found = run_of(self.second, some, "".join(some)) if together and self.apart else None
            if found:
                order += some
                flat.append(found[0]), many.append(found[1])
            else:
                single += some
        fits = [True] * len(order)
        for part in single:
            ids = self.second.after(part) if part and self.apart else self.second.encode([part])[0]
            fits.append(self.second.fits(ids, part.encode()))
            flat.append(ids), many.append(np.array([len(ids)]))
        none = [np.zeros(0, np.int64)]
        return order + single, np.concatenate(flat + none).astype(np.int64), np.concatenate(many + none), np.array(fits, bool)

    def learn(self, parts: list[str]) -> np.ndarray:
        """The number of each part."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        fresh = [p for p in parts if p not in self.numbers]
        if fresh:
            fresh, b, many_b, fits = self._second(fresh)
            texts = pa.array(fresh, pa.large_string())
            flat, sizes, codes, counts = self.words.ids(texts)
            a, many_a = gathered(flat, sizes, codes).astype(np.int64), stretched(sizes[codes], counts)
            fits &= stretched(self.first.lengths[a], many_a) == pc.binary_length(texts).to_numpy(zero_copy_only=False)
            a, b = a[np.repeat(fits, many_a)], b[np.repeat(fits, many_b)]
            many_a, many_b = np.where(fits, many_a, 0), np.where(fits, many_b, 0)
            ends = aligned(np.cumsum(self.first.lengths[a]).tolist(), np.cumsum(self.second.lengths[b]).tolist())
            ends_a, ends_b = (np.array(e, np.int64) for e in ends)
            groups = np.diff(np.searchsorted(ends_a, np.cumsum(many_a), side="right"), prepend=0)
            self.numbers.update(zip(fresh, range(len(self.numbers), len(self.numbers) + len(fresh))))
            for name, new in (("a", a), ("b", b), ("in_a", np.diff(ends_a, prepend=0)), ("in_b", np.diff(ends_b, prepend=0)), ("n_a", many_a),
                              ("n_b", many_b), ("n_groups", groups), ("spelled", fits)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, new.astype(old.dtype)]))
        return np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    return parts.slices(batches, column, SLICE_CHARS)


def stretched(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of `values`."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


class Linked:
    """Texts as parts, and the links of each distinct part: the parts of each text, and of each distinct part its ids of both
    tokenizers and its tokens of either in each group."""

    ARRAYS = ("counts", "codes", "n_a", "n_b", "n_groups", "a", "b", "in_a", "in_b")

    def __init__(self, *arrays: np.ndarray):
        self.counts, self.codes, self.n_a, self.n_b, self.n_groups, self.a, self.b, self.in_a, self.in_b = (x.astype(np.int64) for x in arrays)
        self.n_parts = len(self.n_a)

    @classmethod
    def of(cls, texts: pa.Array, aligner: Aligner) -> Linked:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        codes, counts, names = cut(spaced, aligner.apart, aligner.second.glued)
        known = aligner.learn(names.to_pylist())
        fails = ~aligner.spelled[known]
        failed = stretched(fails[codes].astype(np.int64), counts) > 0
        own = [n[known] for n in (aligner.n_a, aligner.n_b, aligner.n_groups)]
        flat = [gathered(getattr(aligner, name), getattr(aligner, many), known) for name, many in (
            ("a", "n_a"), ("b", "n_b"), ("in_a", "n_groups"), ("in_b", "n_groups"))]
        return cls(np.where(failed, 0, counts), codes[~np.repeat(failed, counts)], *own, *flat)

    def packed(self) -> bytes:
        """The arrays as narrow as their numbers allow, compressed."""
        narrow = (x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (getattr(self, name) for name in self.ARRAYS))
        batch = pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), pa.array(x)) for x in narrow], self.ARRAYS)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        return out.getvalue().to_pybytes()

    @classmethod
    def unpacked(cls, blob: bytes) -> Linked:
        batch = pa.ipc.open_stream(blob).read_next_batch()
        return cls(*(batch.column(name).flatten().to_numpy(zero_copy_only=False) for name in cls.ARRAYS))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, times, links per distinct part): all links of each distinct part, equal ones of a wide group added up."""
        times = self.in_a * self.in_b
        start_a, start_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        part = np.repeat(np.arange(self.n_parts), self.n_groups)
        narrow = np.flatnonzero(times <= WIDE)
        group = np.repeat(narrow, times[narrow])
        inside = np.arange(len(group)) - np.repeat(np.cumsum(times[narrow]) - times[narrow], times[narrow])
        pairs = [(self.a[start_a[group] + inside // self.in_b[group]] << PAIR_BITS) | self.b[start_b[group] + inside % self.in_b[group]]]
        weights, owners = [np.ones(len(group), np.int64)], [part[group]]
        for g in np.flatnonzero(times > WIDE).tolist():
            a, n = np.unique(self.a[start_a[g]:start_a[g] + self.in_a[g]], return_counts=True)
            b, m = np.unique(self.b[start_b[g]:start_b[g] + self.in_b[g]], return_counts=True)
            pairs.append(((a[:, None] << PAIR_BITS) | b).ravel())
            weights.append((n[:, None] * m).ravel())
            owners.append(np.full(len(a) * len(b), part[g]))
        pair, weight, owner = map(np.concatenate, (pairs, weights, owners))
        if len(pairs) > 1:
            order = np.argsort(owner, kind="stable")
            pair, weight, owner = pair[order], weight[order], owner[order]
        return pair, weight, np.bincount(owner, minlength=self.n_parts)

    def documents_of_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, in how many of the texts each is linked)."""
        pair, _, many = self.links()
        names = np.unique(pair)
        local = np.searchsorted(names, pair)
        total = np.zeros(len(names), np.int64)
        # Each distinct part of a text once, then each distinct pair of those, for some texts at a time.
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        own = np.sort(doc * max(1, self.n_parts) + self.codes)
        own = own[np.diff(own, prepend=-1) != 0]
        doc, code = own // max(1, self.n_parts), own % max(1, self.n_parts)
        ends = np.concatenate([[0], np.cumsum(many[code])])
        at = 0
        while at < len(code):
            stop = int(np.searchsorted(ends, ends[at] + ENTRIES, side="right")) - 1
            stop = int(np.searchsorted(doc, doc[max(at, min(stop, len(doc) - 1))]))  # whole texts
            if stop <= at:
                stop = int(np.searchsorted(doc, doc[at], side="right"))
            if len(code) - stop and ends[-1] - ends[at] <= ENTRIES:
                stop = len(code)
            some = code[at:stop]
            key = np.sort(np.repeat(doc[at:stop], many[some]) * len(names) + gathered(local, many, some))
            key = key[np.diff(key, prepend=-1) != 0]
            total += np.bincount(key % max(1, len(names)), minlength=len(names))
            at = stop
        return names, total

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """A number of each distinct part, added up over each text."""
        return stretched(values[self.codes], self.counts)

    def groups(self) -> pa.Array:
        """Groups of each text as `a1,a2|b1;a3|b2`."""
        def joined(values: pa.Array, lengths: np.ndarray, sign: str) -> pa.Array:
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int64())
            return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), pa.scalar(sign, values.type))

        ids_a, ids_b = (joined(pa.array(ids).cast(pa.large_string()), n, ",") for ids, n in ((self.a, self.in_a), (self.b, self.in_b)))
        both = pc.binary_join_element_wise(ids_a, ids_b, pa.scalar("|", pa.large_string()))
        words = joined(both, self.n_groups, ";")
        return joined(words.take(pa.array(self.codes)), self.counts, ";")


def shared_files(spark: SparkSession, first_path: str, second_path: str):
    """(digest of both files, their broadcast contents)."""
    (first, a), (second, b) = file_digest(first_path), file_digest(second_path)
    return f"{a} {b}", spark.sparkContext.broadcast((first, second))


def sliced(docs: DataFrame, version: str, files) -> DataFrame:
    """docs {doc_id, text} -> rows of both kinds: {slice, doc_id, place, packed}, a slice's arrays in equal shares on its rows
    (so that no row is much longer than a text), and {slice, pair, docs} (pair not null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = loaded(Aligner, version, files.value), TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1):
            linked = Linked.of(batch.column(1), aligner)
            names, total = linked.documents_of_pairs()
            n, k = batch.num_rows, len(names)
            blob = linked.packed()
            ends = [len(blob) * i // n for i in range(n + 1)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n + k, number, np.int64)),
                pa.concat_arrays([batch.column(0), pa.nulls(k, batch.column(0).type)]),
                pa.concat_arrays([pa.array(np.arange(n), pa.int32()), pa.nulls(k, pa.int32())]),
                pa.concat_arrays([pa.array([blob[x:y] for x, y in zip(ends, ends[1:])], pa.binary()), pa.nulls(k, pa.binary())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(names, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(total, pa.int64())])], ["slice", "doc_id", "place", "packed", "pair", "docs"])
            number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"slice bigint, doc_id {kind}, place int, packed binary, pair bigint, docs bigint")


def counted(pairs: DataFrame) -> DataFrame:
    """{slice, pair, docs} -> {pair, count, best}: documents of each pair in the corpus, and whether no other pair of its first
    id has more. A first id has at most as many pairs as the second vocabulary has ids."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", PAIR_BITS)))
    return counts.select("pair", "count", (F.col("count") == highest).alias("best"))


def links(docs: DataFrame, first_path: str, second_path: str) -> DataFrame:
    """docs {doc_id, text, ...} -> {doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups}, groups as
    `a1,a2|b1;a3|b2,b3`."""
    spark = docs.sparkSession
    ship_package(spark)
    version, files = shared_files(spark, first_path, second_path)
    both = sliced(docs, version, files)
    kind = both.schema["doc_id"].dataType.simpleString()
    both = written(both, "slices")
    pairs = both.filter("pair is not null").select("slice", "pair", "docs")
    facts = pairs.select("slice", "pair").join(counted(pairs), "pair").select(F.col("slice").alias("of"), "pair", "count", "best")
    texts = both.filter("pair is null").select("slice", "doc_id", "place", "packed")

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        names = known.column("pair").to_numpy()
        order = np.argsort(names)
        names, count, best = names[order], known.column("count").to_numpy()[order], known.column("best").to_numpy()[order]
        places = pa.array(np.argsort(own.column("place").to_numpy()))
        linked = Linked.unpacked(b"".join(own.column("packed").take(places).to_pylist()))
        pair, times, many = linked.links()
        at = np.searchsorted(names, pair)
        sums = {
            "n_a": linked.n_a, "n_b": linked.n_b, "n_groups": linked.n_groups, "n_links": stretched(times, many),
            "n_best": stretched(times * best[at], many) if len(names) else np.zeros(len(many), np.int64),
            "count_sum": stretched(times * count[at], many) if len(names) else np.zeros(len(many), np.int64),
        }
        return pa.table({"doc_id": own.column("doc_id").take(places), **{k: pa.array(linked.per_text(v), pa.int64()) for k, v in sums.items()},
                         "groups": linked.groups().cast(pa.string())})

    return texts.groupBy("slice").cogroup(facts.groupBy("of")).applyInArrow(
        run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups as a digest, empty without tokens."""
    found = links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
