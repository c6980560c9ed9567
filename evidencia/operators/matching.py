"""Name matching as equi-joins: substring, similarity and mention search without pairwise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidencia.functions.binding import let
from evidencia.functions.numbers import round_half_up
from evidencia.functions.tokens import WORD_PATTERN, matches
from evidencia.operators.ranking import top_k
from evidencia.sizing import join_small

GRAM = 3
RESOLVE_THRESHOLD = 0.75
MENTION_THRESHOLD = 0.85
BANDS, BAND_ROWS = 16, 3  # of a MinHash signature


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct character n-grams; empty for shorter texts."""
    def cut(t):
        starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(t, i, F.lit(n)))
    return F.array_distinct(let(text, cut))


def contains_join(names: DataFrame, name: str, needles: DataFrame, needle: str) -> DataFrame:
    """Distinct (name, needle) values where the name contains the needle, ignoring case.

    Each needle meets only the names that hold its rarest gram, then containment is verified.
    """
    low = names.select(name).distinct().withColumn("_low", F.lower(name))
    indexed = low.select(name, "_low", F.explode(F.concat(*[grams(F.col("_low"), n) for n in (1, 2, 3)])).alias("_gram"))
    frequency = indexed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    want = needles.select(needle).distinct().withColumn("_needle", F.lower(needle)).filter(F.length("_needle") > 0)
    keys = F.when(F.length("_needle") < GRAM, F.array("_needle")).otherwise(grams(F.col("_needle")))
    rarest = (
        want.select(needle, "_needle", F.explode(keys).alias("_gram")).join(frequency, "_gram")
        .groupBy(needle, "_needle").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    )
    return indexed.join(rarest, "_gram").filter(F.contains(F.col("_low"), F.col("_needle"))).select(name, needle)


def _gram_sets(names: DataFrame, name: str) -> DataFrame:
    """Distinct names with the gram set of their lower-cased, edge-marked form."""
    marked = F.concat(F.lit("^"), F.lower(F.trim(name)), F.lit("$"))
    return names.select(name).distinct().withColumn("_set", grams(marked))


def _with_prefix(sets: DataFrame, name: str, frequency: DataFrame, threshold: float) -> DataFrame:
    """Each set's rarest grams: enough of them that two sets reaching the threshold must share one."""
    need = F.ceil(F.size("_set") * threshold / (2 - threshold) - 1e-9)
    exploded = sets.select(name, "_set", F.explode("_set").alias("_gram")).join(frequency, "_gram")
    ordered = exploded.groupBy(name, "_set").agg(F.array_sort(F.collect_list(F.struct("_n", "_gram"))).alias("_ordered"))
    kept = F.slice("_ordered", F.lit(1), (F.size("_set") - need + 1).cast("int"))
    return ordered.select(name, "_set", F.explode(F.transform(kept, lambda g: g["_gram"])).alias("_gram"))


def similar_names(raw: DataFrame, raw_name: str, dictionary: DataFrame, entry: str, threshold: float) -> DataFrame:
    """All (raw, entry) pairs whose Dice similarity over character trigrams reaches the threshold.

    Exact prefix filtering: grams are ordered from rare to common over both sides and only the rare
    head of each set is joined, so frequent grams produce no candidates and no pair is lost.
    """
    left, right = _gram_sets(raw, raw_name), _gram_sets(dictionary, entry)
    every = left.select(F.explode("_set").alias("_gram")).unionByName(right.select(F.explode("_set").alias("_gram")))
    frequency = every.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    a = _with_prefix(left, raw_name, frequency, threshold)
    b = _with_prefix(right, entry, frequency, threshold).withColumnRenamed("_set", "_other")
    pairs = a.join(b, "_gram").select(raw_name, entry, "_set", "_other").dropDuplicates([raw_name, entry])
    dice = 2.0 * F.size(F.array_intersect("_set", "_other")) / (F.size("_set") + F.size("_other"))
    return pairs.select(raw_name, entry, round_half_up(dice, 6).alias("score")).filter(F.col("score") >= threshold)


def _banded(sets: DataFrame, name: str, bands: int, rows: int) -> DataFrame:
    """Each set once per band, with the hash of the band's `rows` minima of the MinHash signature."""
    minima = F.transform(F.sequence(F.lit(0), F.lit(bands * rows - 1)), lambda k: F.array_min(
        F.transform("_set", lambda g: F.xxhash64(g, k))))
    keys = let(minima, lambda found: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(
        b, F.slice(found, b * rows + 1, F.lit(rows)))))
    return sets.filter(F.size("_set") > 0).select(name, "_set", F.explode(F.array_distinct(keys)).alias("_band"))


def similar_names_lsh(raw: DataFrame, raw_name: str, dictionary: DataFrame, entry: str, threshold: float,
                      bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """The (raw, entry) pairs of `similar_names` that share a band of their MinHash signatures.

    For large dictionaries: each name makes `bands` rows however long it is, where the exact form makes one per rare gram. A
    pair of Jaccard similarity j (dice / (2 - dice)) meets with probability 1 - (1 - j^rows)^bands, 0.98 at the threshold
    of 0.75 and more above it; whatever meets is checked exactly.
    """
    a = _banded(_gram_sets(raw, raw_name), raw_name, bands, rows)
    b = _banded(_gram_sets(dictionary, entry), entry, bands, rows).withColumnRenamed("_set", "_other")
    pairs = a.join(b, "_band").select(raw_name, entry, "_set", "_other").dropDuplicates([raw_name, entry])
    dice = 2.0 * F.size(F.array_intersect("_set", "_other")) / (F.size("_set") + F.size("_other"))
    return pairs.select(raw_name, entry, round_half_up(dice, 6).alias("score")).filter(F.col("score") >= threshold)


def resolve_names(raw: DataFrame, raw_name: str, dictionary: DataFrame, entry: str,
                  threshold: float = RESOLVE_THRESHOLD, lsh: bool = False) -> DataFrame:
    """Best dictionary entry per distinct raw name; with `lsh` among the entries that MinHash banding finds."""
    pairs = (similar_names_lsh if lsh else similar_names)(raw, raw_name, dictionary, entry, threshold)
    return top_k(pairs, [raw_name], [F.desc("score"), F.asc(entry)], 1, "_rank").drop("_rank")


def shingles(words: Column, sizes: list[int]) -> Column:
    """Distinct runs of consecutive words, joined by blanks, for each run length."""
    def of(n):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def mentions(docs: DataFrame, doc_id: str, text: str, dictionary: DataFrame, entry: str,
             sizes: list[int] = [1, 2, 3, 4, 5], fuzzy: bool = False,  # noqa: B006
             threshold: float = MENTION_THRESHOLD) -> DataFrame:
    """(document, entry, score): dictionary entries found in the whole text, best score per edge.

    Entries are matched as lower-cased word runs; with `fuzzy`, the distinct word runs of the corpus
    are first resolved to entries by similarity.
    """
    words = docs.select(doc_id, matches(F.col(text), WORD_PATTERN).alias("_words"))
    found = words.select(doc_id, F.explode(shingles(F.col("_words"), sizes)).alias("surface"))
    if fuzzy:
        pairs = similar_names(found, "surface", dictionary, entry, threshold)
        linked = found.join(pairs, "surface")
        return linked.groupBy(doc_id, entry).agg(F.max("score").alias("score"))
    key = dictionary.select(entry).distinct().withColumn(
        "surface", F.array_join(matches(F.col(entry), WORD_PATTERN), " "))
    return join_small(found, key, ["surface"], "inner", F.col(doc_id)).select(
        doc_id, entry, F.lit(1.0).alias("score")).distinct()
