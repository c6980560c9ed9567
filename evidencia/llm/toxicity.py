"""Toxicity with a subsequence string kernel and a support vector machine.

Words are compared by the subsequences of `ORDER` characters that they share, gaps allowed up to a total of
`SPAN` characters, each gap weighing `DECAY`: an insult with a character put in, taken out of its place or
replaced still shares most of its subsequences. Signs and digits inside a word are dropped, a
letter stands at most twice in a row and single letters in a row are one word, so spelled-out insults are words
again. The marks of a word's start and end
count as characters, so stems are told from endings.

Training is on labelled texts, where the label says only that some word is toxic. The word that speaks most for
it in each toxic text is its witness: at first by how often its subsequences occur in toxic and in clean
texts, then by the machine itself. Witnesses against words of clean texts are described by their kernel
with landmark words (Nyström) and separated with a squared hinge loss; this is repeated `ROUNDS` times. A text
scores as its worst word, calibrated by a logistic fit on the training texts. The kernel is linear in the
subsequences, so landmarks and machine fold into one weight per subsequence for scoring.

At most `SAMPLE_TOXIC` toxic and `SAMPLE_CLEAN` clean texts are used for the fit, drawn by the hash of their id;
every text is scored whole in the task that reads it. Null and empty texts, and all texts if there are no labels of
both kinds, have score 0. Null ids count as an empty id; repeated rows are scored alike; a document labelled
twice counts as toxic if one label says so.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencia.session import ship_package, table

ORDER, SPAN, DECAY = 4, 6, 0.8
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 1500
LANDMARKS = 256
ROUNDS = 4
VARIANTS = 8  # of each witness, with an inserted letter
COST = 10.0
THRESHOLD = 0.7
CHUNK = 1 << 20

# Bytes become classes: 0 between words, 1-26 letters, 27-31 others by remainder; signs and digits vanish, and so
# do the lead bytes of Latin letters.
SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalpha()) + b"\xc2\xc3\x00\x7f"
FOLD = bytes(b - 0x60 if 0x61 <= b <= 0x7A else b - 0x40 if 0x41 <= b <= 0x5A else 27 + b % 5 if b >= 0x80 else 0 for b in range(256))
BITS = 5
SPELLED = re.compile(rb"(?<=[ \n][a-z]) (?=[a-z][ \n])")
# Offsets of the characters of a subsequence, by the span they take; weights fall with each gap.
OFFSETS = [((0, *inner, span - 1), DECAY ** (span - ORDER)) for span in range(ORDER, SPAN + 1)
           for inner in combinations(range(1, span - 1), ORDER - 2)]


def classes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts in a row, words apart by one 0, and where each text starts."""
    parts, starts, at = [b"\0"], [], 1
    for text in texts:
        body = b" " + (text or "").lower().encode("utf-8", "replace").translate(None, SIGNS) + b" "
        line = b" ".join(SPELLED.sub(b"", body).split()).translate(FOLD) + b"\0"
        starts.append(at)
        parts.append(line)
        at += len(line)
    chars, starts = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32), np.array(starts, np.int64)
    # A letter more than twice in a row is there twice.
    stays = np.ones(len(chars), bool)
    stays[2:] = (chars[2:] == 0) | (chars[2:] != chars[1:-1]) | (chars[2:] != chars[:-2])
    return chars[stays], starts - np.concatenate([[0], np.cumsum(~stays)])[starts]


def positions(chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(start, subsequence, weight) for each pattern of offsets, within words and their marks."""
    n = len(chars)
    after = np.where(chars == 0, np.arange(n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]  # the first mark at or behind each place
    end = np.append(after[1:], n)  # the first mark behind each place
    for offsets, weight in OFFSETS:
        last = offsets[-1]
        if n <= last:
            continue
        start = np.flatnonzero(end[:n - last] >= np.arange(last, n))
        code = chars[start]
        for k in offsets[1:]:
            code = (code << BITS) | chars[start + k]
        yield start, code, weight


class Words:
    """Distinct words as class strings, with their subsequences."""

    def __init__(self, words: list[bytes]):
        self.words = words
        line = b"\0" + b"\0".join(words) + b"\0"
        chars = np.frombuffer(line, np.uint8).astype(np.int32)
        begins = np.cumsum([0, *[len(w) + 1 for w in words]])[:-1]
        rows, codes, weights = [], [], []
        for start, code, weight in positions(chars):
            rows.append(np.searchsorted(begins, start, side="right") - 1)
            codes.append(code)
            weights.append(np.full(len(start), weight, np.float32))
        self.row, self.code, self.weight = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (rows, codes, weights))
        self.size = np.sqrt(np.bincount(self.row, self.weight ** 2, len(words)) + 1e-9)

    def dot(self, table: np.ndarray) -> np.ndarray:
        """Sum of weight times table value over each word's subsequences, over the word's size."""
        return np.bincount(self.row, self.weight * table[self.code], len(self.words)) / self.size

    def expanded(self, chosen: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The table with sum of values[k] times the normalised subsequences of word chosen[k]."""
        share = np.zeros(len(self.words))
        np.add.at(share, chosen, values / self.size[chosen])
        used = share[self.row] != 0
        return np.bincount(self.code[used], self.weight[used] * share[self.row[used]], 1 << (BITS * ORDER)).astype(np.float32)


def squared_hinge(rows: np.ndarray, sign: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine by Newton steps: half the squared norm plus `COST` times the weighted squared hinge losses."""
    x = np.column_stack([rows, np.ones(len(rows))])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):
        active = sign * (x @ w) < 1
        a, s = x[active], COST * weight[active]
        new = np.linalg.solve(keep + (a.T * s) @ a, (a.T * s) @ sign[active])
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def logistic(value: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic fit with both kinds of texts counting alike; the slope is positive."""
    x = np.column_stack([value, np.ones(len(value))])
    share = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())) if 0 < toxic.mean() < 1 else np.ones(len(value))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (x.T * (share * p * (1 - p))) @ x + np.diag([0.05, 1e-6])
        w = w - np.linalg.solve(slope, x.T @ (share * (p - toxic)) + np.array([0.05 * w[0], 0]))
    return max(1e-3, float(w[0])), float(w[1])


class Model:
    """Weights per subsequence, bias of the machine, slope and intercept of the score."""

    def __init__(self):
        self.key, self.table, self.bias, self.slope, self.shift = uuid.uuid4().hex, None, 0.0, 1.0, 0.0

    def fit(self, texts: list[set[bytes]], toxic: np.ndarray) -> "Model":
        """texts: the distinct words of each training text."""
        vocabulary = sorted(set().union(*texts)) if texts else []
        if not vocabulary or not toxic.any() or toxic.all():
            return self
        number = {w: k for k, w in enumerate(vocabulary)}
        words = Words(vocabulary)
        held = [np.array(sorted(number[w] for w in t), np.int64) for t in texts]
        full = [(h, y) for h, y in zip(held, toxic) if len(h)]
        held, toxic = [h for h, _ in full], np.array([y for _, y in full], bool)
        clean = np.unique(np.concatenate([h for h, y in zip(held, toxic) if not y]))
        chance = np.random.default_rng(7)
        value = self._first(words, held, toxic)
        for _ in range(ROUNDS):
            witness = np.array([h[value[h].argmax()] for h, y in zip(held, toxic) if y])
            bad, often = np.unique(witness, return_counts=True)
            sure = ~np.isin(bad, clean)
            bad, often = (bad[sure], often[sure]) if sure.any() else (bad, often)
            hard = clean[np.argsort(-value[clean], kind="stable")[:3000]]
            good = np.unique(np.concatenate([hard, chance.choice(clean, min(len(clean), 5000), replace=False)]))
            half = LANDMARKS // 2
            top = bad[np.argsort(-often, kind="stable")[:half]]
            marks = np.concatenate([top, hard[:half // 2], chance.choice(good, min(len(good), half // 2), replace=False)])
            marks = np.unique(marks)
            rows = np.concatenate([bad, good])
            # Each witness is also shown with a strange letter inside, which the machine has to tolerate.
            bent = [(w, n) for w, n in zip((vocabulary[k] for k in bad), often) if len(w) > ORDER]
            cuts = [int(chance.integers(1, len(w))) for w, _ in bent for _ in range(VARIANTS)]
            twice = [x for x in bent for _ in range(VARIANTS)]
            changed = [w[:c] + bytes([int(chance.integers(1, 27))]) + w[c:] for (w, _), c in zip(twice, cuts)]
            part = Words([vocabulary[k] for k in np.concatenate([marks, rows])] + changed)
            near = np.stack([part.dot(part.expanded(np.array([k]), np.ones(1))) for k in range(len(marks))], 1)
            values, vectors = np.linalg.eigh(near[:len(marks)] + 1e-6 * np.eye(len(marks)))
            rotate = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
            sign = np.concatenate([np.ones(len(bad)), -np.ones(len(good)), np.ones(len(changed))])
            weight = np.concatenate([often, np.full(len(good), often.sum() / len(good)), [n / VARIANTS for _, n in twice]]) * 100 / often.sum()
            w, self.bias = squared_hinge(near[len(marks):] @ rotate, sign, weight)
            self.table = words.expanded(marks, rotate @ w)
            value = words.dot(self.table) + self.bias
        self.slope, self.shift = logistic(np.array([value[h].max() for h in held]), toxic)
        return self

    @staticmethod
    def _first(words: Words, held: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
        """Each word by its subsequence without gaps that speaks most for toxic texts, in units of log odds."""
        plain = words.weight == 1
        order = np.argsort(words.row[plain], kind="stable")
        row, code = words.row[plain][order], words.code[plain][order]
        begin = np.searchsorted(row, np.arange(len(words.words) + 1))
        seen = np.zeros((2, 1 << (BITS * ORDER)), np.float32)
        for h, y in zip(held, toxic):
            here = np.concatenate([code[begin[k]:begin[k + 1]] for k in h])
            seen[int(y)][np.unique(here)] += 1
        odds = np.log((seen[1] + 0.1) / toxic.sum()) - np.log((seen[0] + 0.1) / (~toxic).sum())
        odds *= np.minimum(1, seen[1] / 3)
        out = np.full(len(words.words), -10.0, np.float32)
        np.maximum.at(out, row, odds[code])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None or not texts:
            return np.zeros(len(texts))
        chars, starts = classes(texts)
        total, size = np.zeros(len(chars), np.float32), np.zeros(len(chars), np.float32)
        for start, code, weight in positions(chars):
            total[start] += weight * self.table[code]
            size[start] += np.float32(weight ** 2)
        marks = np.flatnonzero(chars[:-1] == 0)  # each word starts behind a mark, with which its subsequences start
        value = np.add.reduceat(total, marks) / np.sqrt(np.add.reduceat(size, marks) + 1e-9)
        worst = np.full(len(texts), -np.inf)
        owner = np.searchsorted(starts, marks + 1, side="right") - 1
        real = chars[marks + 1] != 0
        np.maximum.at(worst, owner[real], value[real])
        return np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(self.slope * (worst + self.bias) + self.shift, -30, 30))), 0.0)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, as class strings joined by 0."""
    for batch in batches:
        sets = []
        for text in batch.column(0).to_pylist():
            chars, _ = classes([text])
            sets.append(b"\0".join(sorted(set(chars.astype(np.uint8).tobytes().split(b"\0")) - {b""})))
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *batch.columns[1:]], ["words", *batch.schema.names[1:]])


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the rows of docs {doc_id, text} that labels {doc_id, toxic} covers and that are not held out."""
    ship_package(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64(F.lit("sample"), "doc_id"))
    chosen = None
    for toxic, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = known.filter(F.col("toxic") == toxic).orderBy("place").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids meet the documents; a repeated id brings its first texts by hash.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "place", F.xxhash64("text").alias("mark"))
    drawn = rows.orderBy("place", "mark").limit(2 * (SAMPLE_TOXIC + SAMPLE_CLEAN))
    got = drawn.mapInArrow(word_sets, f"words binary, toxic {drawn.schema['toxic'].dataType.simpleString()}, place bigint, mark bigint").collect()
    got.sort(key=lambda r: (r["place"], r["mark"]))
    return Model().fit([set(bytes(r["words"]).split(b"\0")) - {b""} for r in got], np.array([r["toxic"] == 1 for r in got], bool))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs {doc_id, text, ...} -> {doc_id, score}"""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores, group, size = batch.column(1).to_pylist(), [], [], 0
            for text in texts:
                group.append(text)
                size += len(text or "")
                if size >= CHUNK:
                    scores.append(shared.value.scores(group))
                    group, size = [], 0
            scores.append(shared.value.scores(group))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
