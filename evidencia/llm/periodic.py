"""Periodic runs of words by seeds on diagonals.

A run is a stretch of words with smallest period q, at least max(6, 4q) long, that no neighbour extends. On the diagonal of
lag q it is a stretch of equal words w[i] = w[i + q] of at least max(5, 3q), so it holds equal k-grams q apart for every k up to
that overlap. k-grams that are at least q long stand, inside such a run, at distances that are multiples of q. Hence, with k
the overlap guaranteed for the smallest lag of a class and also the largest lag of it, neighbouring occurrences of a k-gram are
enough as seeds: every run shows up as an unbroken chain of them, and a k-gram found a thousand times makes a thousand pairs.
The classes are lags 1 to 5 (k = 5), 6 to 18 (k = 18), 19 to 57, ... each k three times the smallest lag. A k-gram can only
repeat if the shorter ones in it do, so longer ones are named, exactly, by four names of the class before, at places that
repeat; most texts have none after the first class.

Seeds are taken by lag and place. For every lag the table of the furthest place covered drops seeds inside a stretch that
was extended before; the others are extended word by word to both sides. Work is in proportion to words and classes.

Null and empty texts have no words, one run of none and the digest of the empty string. A null doc_id is treated as given (its text
is not made periodic by the query). Repeated rows give repeated results. Other columns are not looked at. Ties between runs of the
same exponent go to the smallest start, then the smallest period. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidencia.llm.parts import slices
from evidencia.llm.shingles import mix
from evidencia.session import ship_package, table

LEAST = 6  # words of the shortest run
TIMES = 4  # and periods
_STEPS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def least_length(period: int) -> int:
    return max(LEAST, TIMES * period)


def classes() -> Iterator[tuple[int, int]]:
    """(smallest lag, k) of each class; k is the largest lag too, and a run of any of these lags has equal k-grams."""
    low, k = 1, least_length(1) - 1
    while True:
        yield low, k
        low = k + 1
        k = least_length(low) - low


def named(doc: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows equal in all columns get one number -> (the rows in order of number and place, their numbers in that order, which of them
    have the same number as the row before). Rows are given in the order of their places."""
    value = doc.astype(np.uint64)
    for column, step in zip(columns, _STEPS):
        value = mix(value + (column.astype(np.uint64) + np.uint64(1)) * step)
    order = np.argsort(value, kind="stable")
    same = np.ones(len(order), bool)
    for column in (doc, *columns):
        ranked = column[order]
        same[1:] &= ranked[1:] == ranked[:-1]
    same[:1] = False
    return order, np.cumsum(~same) - 1, same


def seeds(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, lags) of each class: neighbouring occurrences of a k-gram in one document. `words` are the names of the words of all
    documents, `doc` the document of each, `ends` where each document ends."""
    place, names, before = np.arange(len(words)), None, 0
    for low, k in classes():
        if names is None:
            place = place[place + k <= ends[doc]]
            columns = [words[place + j] for j in range(k)]
        else:
            # The gram is covered by four of the class before, all of which must repeat.
            number = np.full(len(words), -1, np.int64)
            number[place] = names
            place = place[place + k <= ends[doc[place]]]
            columns = [number[place + j] for j in (0, before, 2 * before, k - before)]
            known = np.logical_and.reduce([c >= 0 for c in columns])
            place, columns = place[known], [c[known] for c in columns]
        if not len(place):
            return
        order, numbers, same = named(doc[place], *columns)
        spots = place[order]
        pair = np.flatnonzero(same)
        lag = spots[pair] - spots[pair - 1]
        fits = (lag >= low) & (lag <= k)
        yield k, spots[pair - 1][fits], lag[fits]
        again = same.copy()
        again[:-1] |= same[1:]
        back = np.argsort(spots[again], kind="stable")
        place, names, before = spots[again][back], numbers[again][back], k
        if not len(place):
            return


def extended(words: np.ndarray, begin: int, end: int, at: int, stop: int, lag: int) -> tuple[int, int]:
    """The stretch of places i in [begin, end - lag) around [at, stop) with words[i] = words[i + lag]."""
    while at > begin and words[at - 1] == words[at - 1 + lag]:
        at -= 1
    while stop + lag < end and words[stop] == words[stop + lag]:
        stop += 1
    return at, stop


def runs(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Names of words, and how many each document has -> rows (document, start, length, period), by document, start and period."""
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    found = []
    for k, place, lag in seeds(words, doc, ends):
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # Unbroken chains of seeds; a run is one chain as long as its stretch on the diagonal.
        head = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(lag, prepend=-1) != 0))
        size = np.diff(np.append(head, len(place)))
        long = size + k - 1 + lag[head] >= np.maximum(LEAST, TIMES * lag[head])
        furthest: dict[int, int] = {}
        for h, n in zip(head[long].tolist(), size[long].tolist()):
            at, q = int(place[h]), int(lag[h])
            if at < furthest.get(q, 0):
                continue
            d = int(doc[at])
            begin, end = int(ends[d] - counts[d]), int(ends[d])
            start, stop = extended(words, begin, end, at, at + n + k - 1, q)
            furthest[q] = stop
            found.append((d, start - begin, stop + q - start, q))
    return np.array(sorted(found), np.int64).reshape(-1, 4)


def collapsed(n: int, own: np.ndarray) -> np.ndarray:
    """Which of n words stay if every run (start, length, period) keeps its first period only."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, own[:, 0] + own[:, 2], 1)
    np.add.at(delta, own[:, 0] + own[:, 1], -1)
    return np.cumsum(delta[:n]) == 0


def repeated(n: int, h: int) -> np.ndarray | None:
    """The contract's places for a text of n words whose id has the checksum h: a periodic tail for every tenth."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def found(docs: DataFrame, planted: bool = False) -> DataFrame:
    """docs {doc_id, text} -> {doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed, runs}: the run of the
    greatest exponent, the text without repetitions and all runs as (start, length, period). With `planted` every
    tenth text, by its id, is made periodic before."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            split = pc.ascii_split_whitespace(pc.ascii_trim(texts, " \t\n\v\f\r"))
            named_words = split.flatten().dictionary_encode()
            codes = named_words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            empty = pc.index(named_words.dictionary, "").as_py()
            counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            begins = np.cumsum(counts) - counts
            if empty >= 0:  # the only part of a text without words
                hollow = codes == empty
                counts = counts - np.add.reduceat(np.append(hollow, False).astype(np.int64), np.minimum(begins, len(codes))) * (counts > 0)
                codes = codes[~hollow]
                begins = np.cumsum(counts) - counts
            ids = batch.column(0).to_pylist()
            if planted:
                take = np.arange(len(codes))
                for k in range(len(ids)):
                    h = 1 if ids[k] is None else zlib.crc32(str(ids[k]).encode())
                    places = repeated(int(counts[k]), h)
                    if places is not None:
                        take[begins[k]:begins[k] + counts[k]] = begins[k] + places
                codes = codes[take]
            all_runs = runs(codes, counts)
            first = np.searchsorted(all_runs[:, 0], np.arange(len(ids) + 1))
            stays = np.ones(len(codes), bool)
            best, digests, lists = [], [], []
            for k in range(len(ids)):
                own = all_runs[first[k]:first[k + 1], 1:]
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
                digests.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own.tolist()).encode()).hexdigest())
                top = None
                for s, n, q in own.tolist():
                    if top is None or n * top[2] > top[1] * q:
                        top = (s, n, q)
                best.append((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
                if top:
                    stays[begins[k]:begins[k] + counts[k]] = collapsed(int(counts[k]), own)
            kept = np.add.reduceat(np.append(stays, False).astype(np.int64), np.minimum(begins, len(codes))) * (counts > 0) if len(counts) else counts
            words = named_words.dictionary.take(pa.array(codes[stays]))
            bodies = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int64()), words),
                                    pa.scalar(" ", words.type))
            columns = [pa.array(c, pa.int64()) for c in zip(*best)] if best else [pa.array([], pa.int64())] * 4
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), *columns, pa.array(digests, pa.string()), bodies.cast(pa.string()), pa.array(lists, kind)],
                ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
             "collapsed string, runs array<struct<start:bigint,length:bigint,period:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"), planted=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))
