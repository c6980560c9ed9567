"""Language identification with string kernels.

Two texts are as similar as the sets of byte n-grams (one to `GRAMS` long, blended) that they have in common,
over the geometric mean of their sizes. Labelled texts are described by their similarity to a few of them, the
landmarks, rotated so that inner products approximate the kernel (Nyström), and one ridge regression
per language is fitted on that (one against the rest). Documents are scored in blocks: presence matrix times
landmark matrix, scaled by the sizes, times the folded regression.

The fit uses at most `SAMPLE_ROWS` labelled texts, spread evenly over the languages and drawn by the hash of
their id; what reaches the driver of a text is its set of n-grams. Scoring runs inside the tasks that read
the texts; nothing is shuffled.

A null text, and a text without any letter, is `und` with score 0; so is everything if nothing is labelled.
Null ids count as an empty id; repeated rows are scored alike; ties go to the first language by name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencia.session import ship_package, table

GRAMS = 3
SAMPLE_ROWS = 2000
PER_LANGUAGE = 300
LANDMARKS = 24  # per language
RIDGE = 1e-2
BLOCK = 64
UNKNOWN = "und"
LEAST_SCORE = 0.2  # below this a text is in none of the languages

# Bytes fall into classes: 0 all ASCII but letters, 1-26 letters, then one per byte beyond ASCII.
CLASSES = 27 + 128
FOLD = bytes(b - 0x60 if 0x61 <= b <= 0x7A else b - 0x40 if 0x41 <= b <= 0x5A else b - 0x80 + 27 if b >= 0x80 else 0
             for b in range(256))
FEATURES = sum(CLASSES ** n for n in range(1, GRAMS + 1))
ASCII_LETTER = re.compile("[A-Za-z]")


class Grams:
    """The set of n-grams of a text, as numbers below `FEATURES`."""

    def __init__(self):
        self.last = np.zeros(FEATURES, np.int32)

    def of(self, text: str) -> np.ndarray:
        classes = np.frombuffer(text.lower().encode("utf-8", "replace").translate(FOLD), np.uint8).astype(np.int32)
        codes, parts, base = classes, [classes], CLASSES
        for n in range(2, GRAMS + 1):
            codes = codes[:-1] * CLASSES + classes[n - 1:]
            parts.append(codes + base)
            base += CLASSES ** n
        every = np.concatenate(parts)
        places = np.arange(len(every), dtype=np.int32)
        self.last[every] = places  # the last place of each n-gram stays
        return every[self.last[every] == places]


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


class Model:
    def __init__(self, labels: list[str], sets: list[np.ndarray]):
        """Fit on texts given by their n-gram sets."""
        self.key, self.languages = uuid.uuid4().hex, sorted(set(labels))
        marks = [k for lang in self.languages for k in [i for i, x in enumerate(labels) if x == lang][:LANDMARKS]]
        self.marks = [sets[k] for k in marks]
        self.weights = np.zeros((len(marks), len(self.languages)), np.float32)
        self.bias = np.zeros(len(self.languages), np.float32)
        if not marks:
            return
        near = Scorer(self).similarity(sets).astype(np.float64)
        values, vectors = np.linalg.eigh(near[marks] + 1e-6 * np.eye(len(marks)))
        rotate = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        rows = near @ rotate
        goal = np.array([[x == lang for lang in self.languages] for x in labels], float)
        # Every language counts as much as any other in the fit.
        share = (goal / goal.sum(0)).sum(1)
        centre, level = share @ rows / share.sum(), share @ goal / share.sum()
        rows, goal = rows - centre, goal - level
        fit = np.linalg.solve(rows.T * share @ rows + RIDGE * share.sum() / len(rows) * np.eye(len(marks)), rows.T * share @ goal)
        self.weights = (rotate @ fit).astype(np.float32)
        self.bias = (level - centre @ fit).astype(np.float32)


class Scorer:
    """A model laid out for scoring: landmark n-grams as columns."""

    def __init__(self, model: Model):
        self.model, self.grams = model, Grams()
        known = np.unique(np.concatenate([*model.marks, np.zeros(0, np.int32)])).astype(np.int64)
        self.column = np.full(FEATURES, len(known), np.int32)  # unknown n-grams share a last column of zeros
        self.column[known] = np.arange(len(known))
        self.landmarks = np.zeros((len(known) + 1, len(model.marks)), np.float32)
        for k, mark in enumerate(model.marks):
            self.landmarks[self.column[mark], k] = 1
        self.sizes = np.sqrt([max(1, len(m)) for m in model.marks], dtype=np.float32)

    def similarity(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel of each set with each landmark."""
        out = np.zeros((len(sets), len(self.model.marks)), np.float32)
        for at in range(0, len(sets), BLOCK):
            some = sets[at:at + BLOCK]
            present = np.zeros((len(some), len(self.landmarks)), np.float32)
            for k, grams in enumerate(some):
                present[k, self.column[grams]] = 1
            size = np.sqrt([max(1, len(s)) for s in some], dtype=np.float32)
            out[at:at + BLOCK] = present @ self.landmarks / size[:, None] / self.sizes
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if self.model.languages and has_letter(t)]
        for at in range(0, len(known), BLOCK):
            some = known[at:at + BLOCK]
            values = self.similarity([self.grams.of(texts[k]) for k in some]) @ self.model.weights + self.model.bias
            for k, row in zip(some, values):
                best = int(row.argmax())
                langs[k], scores[k] = self.model.languages[best], float(min(1.0, max(0.0, row[best])))
        return langs, scores


_SCORERS: dict[str, Scorer] = {}


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        sets = [grams.of(t or "").astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column(2)], ["lang", "grams", "place"])


def fitted(docs: DataFrame) -> Model:
    """Fit on the rows of docs {doc_id, text, lang} that have a language and are not held out."""
    ship_package(docs.sparkSession)
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang", F.xxhash64(
        F.lit("sample"), "doc_id").alias("place"))
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [])
    each = min(PER_LANGUAGE, max(1, SAMPLE_ROWS // len(sizes)))
    # Hashes are uniform over 64 bits: those below a share of the range are about `each` rows of a language.
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n) * 2.0 ** 64 - 2.0 ** 63)])
    drawn = usable.filter(F.col("place") <= bound[F.col("lang")]).orderBy("place").limit(2 * SAMPLE_ROWS)
    rows = drawn.select("lang", "text", "place").mapInArrow(gram_sets, "lang string, grams binary, place bigint").collect()
    rows.sort(key=lambda r: (r["place"], r["lang"], bytes(r["grams"])))
    return Model([r["lang"] for r in rows], [np.frombuffer(r["grams"], np.int32) for r in rows])


def predicted(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score under `names`; columns of these names are replaced."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model.key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model.key] = Scorer(model)
        scorer = _SCORERS[model.key]
        for batch in batches:
            langs, scores = scorer.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*batch.schema.names, *names])

    schema = rows.withColumn(names[0], F.lit("")).withColumn(names[1], F.lit(0.0)).schema
    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that are in some learned language, with the columns they came with; all of them if nothing
    could be learned but those without any letter."""
    model = fitted(docs.select("doc_id", "text", "lang"))
    sure = F.col("_score") >= (least if model.languages else 0.0)
    lettered = F.col("_language") != UNKNOWN if model.languages else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return predicted(docs, model, ("_language", "_score")).filter(lettered & sure).drop("_language", "_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs.select("doc_id", "text", "lang"))
    # The text goes through the tasks but not into the result.
    return predicted(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
