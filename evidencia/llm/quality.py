"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over the words and lines of the whole text, so a document is
judged inside its own row: no shuffle, no user function. Null text counts as empty; an empty text has
no words and fails the base rule. Rows are independent, so repeated rows are judged alike, an empty
table gives an empty result, and other columns of the input pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencia.session import table

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[ \x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
VERDICT = ("base_failed", "broken", "kept")
WINDOW = 3

# Frequent function words of the languages the corpus is written in.
STOP_WORDS = (
    "the of and to in is that for it on with as was be this by are from an or "
    "der die und das von den mit zu auf für ist im dem nicht ein eine des "
    "le la les de et des en un une du est que pour dans sur par au "
    "el los las y que del se por con una para su lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """`measure` must lie between `low` and `high` (either may be open)."""
    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self, value: Column) -> Column:
        test = F.lit(True)
        if self.low is not None:
            test = test & (value >= self.low)
        if self.high is not None:
            test = test & (value <= self.high)
        return test


# measure, lowest, highest: see `ratios` for what each one means.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("stop_words", 2, None),
    Rule("duplicate_line_share", None, 0.50),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the `COUNTS`; columns of these names, or of the verdict's, are replaced.

    The steps are separate projections because each array is read more than once below it; Spark
    then computes it once per row.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (*COUNTS, *VERDICT)]
    words = docs.select(
        F.struct(*keep).alias("_row"), body.alias("_body"), F.split(F.trim(body, F.lit(SPACES)), SPACE_RUN).alias("_split"),
        F.filter(F.split(body, "\n"), lambda line: F.length(F.trim(line, F.lit(SPACES))) > 0).alias("_lines"))
    counted = words.withColumn("_words", F.when(F.get("_split", F.lit(0)) != "", F.col("_split")).otherwise(
        F.array().cast("array<string>"))).withColumn("_windows", F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)))
    # Windows of words with their position, in the order of their words: equal windows become neighbours.
    parts = [F.slice("_words", k + 1, F.col("_windows")) for k in range(WINDOW)]
    places = F.when(F.col("_windows") > 0, F.sequence(F.lit(0), F.col("_windows") - 1)).otherwise(F.array().cast("array<int>"))
    sorted_windows = counted.withColumn("_sorted", F.sort_array(F.arrays_zip(
        *[p.alias(f"w{k}") for k, p in enumerate(parts)], places.alias("at"))))

    def twins(a: Column, b: Column) -> Column:
        same = F.lit(True)
        for k in range(WINDOW):
            same = same & (a[f"w{k}"] == b[f"w{k}"])
        return F.when(same, F.array(a["at"], b["at"]))

    # The positions of all windows that occur at least twice, then the words that they cover.
    repeated = sorted_windows.withColumn("_repeated", F.sort_array(F.array_distinct(F.flatten(F.filter(
        F.zip_with("_sorted", F.slice("_sorted", F.lit(2), F.greatest(F.col("_windows") - 1, F.lit(0))), twins),
        lambda x: x.isNotNull())))))
    covered = F.aggregate(
        F.zip_with("_repeated", F.slice("_repeated", F.lit(2), F.greatest(F.size("_repeated") - 1, F.lit(0))),
                   lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)
    return repeated.select(
        "_row.*",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(F.col("_body"), F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        F.size(F.array_intersect("_words", F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)]))).cast("bigint").alias("n_stop_words"))


def ratios() -> dict[str, Column]:
    """The measures that the rules speak of; each is 0 for a text without words."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return {
        "mean_word_chars": share("word_chars", "n_words"),  # code points per word
        "symbols_per_word": share("n_symbols", "n_words"),
        "stop_words": F.col("n_stop_words").cast("double"),  # different function words in the text
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
    }


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`measured` with base_failed, kept and `broken`, the measures that lie outside their rule."""
    values = ratios()
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    broken = F.array_compact(F.array(*[F.when(~rule.holds(values[rule.measure]), F.lit(rule.measure)) for rule in rules]))
    return measured(docs, text).withColumn("base_failed", failed).withColumn("broken", broken).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken") == 0))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with.

    The judgement works on a copy of the text beside the row, so no column name of the input can clash. The
    verdict passes a generator before the filter: a filter on it would be pushed down through the projections
    with the whole expression tree pasted into it, and every array computed again at each mention.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    verdicts = judged(packed.select("doc", F.col("doc.text").alias("text")), rules)
    return verdicts.select("doc", F.explode(F.array("kept")).alias("_stays")).filter("_stays").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

ORACLE_SQL = rf"""
with t as (
  select doc_id, coalesce(text, '') as body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
numbered as (select row_number() over () as id, * from t),
windows as (select id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (
  select id, words, unnest(range(1, len(words) - 1)) as i from numbered) w),
repeated as (select id, i from (select id, i, count(*) over (partition by id, a, b, c) as n from windows) w where n > 1),
covered as (select id, count(distinct i + d) as n from repeated, (select unnest([0, 1, 2]) as d) s group by id),
counts as (
  select doc_id, len(words) as n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
    len(list_intersect(list_distinct(words), [{_STOPS}])) as n_stop
  from numbered left join covered using (id)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and word_chars / n_words between 2 and 14 and n_symbols / n_words <= 0.1 and n_stop >= 2
    and case when n_lines > 0 then n_dup_lines / n_lines else 0 end <= 0.5 as kept
from judged"""
