"""Catalyst events on a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidencia.functions.dates import period_rank, with_period
from evidencia.functions.segments import with_windows
from evidencia.functions.tokens import WORD_PATTERN, matches
from evidencia.operators.ranking import top_k
from evidencia.sizing import join_small, parts_for
from evidencia.sources.store import written

MAX_EVENTS = 30
# Arms of a trial that are no product.
GENERIC_ARMS = ["placebo", "control", "standard of care", "saline", "observation"]


# Dates as texts state them: day or month, quarter or half, spoken half, prose date. A bare year says too little.
DATE_PHRASE = (
    r"(?i)\b(?:[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[QH][1-4][ ']?(?:[0-9]{4}|[0-9]{2})|(?:first|1st|second|2nd|latter) half of [0-9]{4}"
    r"|(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?"
    r"|dec(?:ember)?)\.? (?:[0-9]{1,2},? )?[0-9]{4})\b")
ENTRY_WORDS = 5  # words of the longest dictionary entry searched
CHARS_PER_TASK = 1_500_000  # characters of windows taken apart by one task: a word makes up to ENTRY_WORDS rows


def located(rows: DataFrame, keys: list[str], text: Column, pattern: str) -> DataFrame:
    """{keys, at, hit}: every match with its 0-based offset. Offsets are running sums over the pieces of a row, so work grows
    with the text and not with its square."""
    pieces = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    cut = rows.select(*keys, F.posexplode(pieces).alias("_i", "_p")).select(*keys, "_i", "_p.gap", "_p.hit")
    size = F.length("gap") + F.coalesce(F.length("hit"), F.lit(0))
    before = F.sum(size).over(Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("at", (F.coalesce(before, F.lit(0)) + F.length("gap")).cast("int")).filter("hit is not null").select(*keys, "at", "hit")


def text_events(docs: DataFrame, doc: str, text: str, dictionary: DataFrame, entry: str, keywords: list[str],
                window: tuple[int, int, int]) -> DataFrame:
    """Dated events that texts state: {doc, at, raw, drug, distance}, one row per date phrase inside a keyword window with the
    dictionary entry whose mention in that window is nearest, the one in front at equal distance.

    `at` is the offset of the phrase in the text, `distance` the characters between the two. Phrases in a window without a
    mention are left out. Entries are found as runs of up to `ENTRY_WORDS` lower-cased words. Dates and mentions meet in
    one pass over each window in the order of their places.
    """
    spans = written(with_windows(docs.select(doc, text), text, keywords, window).select(doc, text, F.explode("spans").alias("_s")).select(
        doc, F.col("_s.start").alias("_from"), F.substr(text, F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")).alias("_span")), "spans")
    keys = [doc, "_from"]
    # Every step below keeps to the windows of a task, so their characters decide how much it holds.
    spans = spans.repartition(parts_for(spans, F.length("_span"), CHARS_PER_TASK), *keys)
    dates = located(spans, keys, F.col("_span"), DATE_PHRASE).select(
        *keys, F.lit(True).alias("_date"), "at", (F.col("at") + F.length("hit")).alias("end"), F.col("hit").alias("name"))
    words = located(spans, keys, F.lower("_span"), WORD_PATTERN)
    known = dictionary.select(F.col(entry).alias("name")).distinct().withColumn("_words", matches(F.col("name"), WORD_PATTERN)).select(
        "name", F.array_join("_words", " ").alias("surface"), F.get("_words", 0).alias("_first"))
    ahead = Window.partitionBy(*keys).orderBy("at")
    next_words = words.select(*keys, "at", *[F.struct(F.lead("hit", n).over(ahead).alias("word"), F.lead("at", n).over(ahead).alias("at")).alias(f"_{n}")
                                             for n in range(ENTRY_WORDS)])
    runs = [F.struct(F.concat_ws(" ", *[f"_{k}.word" for k in range(n + 1)]).alias("surface"), (F.col(f"_{n}.at") + F.length(f"_{n}.word")).alias("end"))
            for n in range(ENTRY_WORDS)]
    # Runs are made only of words that begin an entry.
    begun = join_small(next_words.withColumn("_first", F.col("_0.word")), known.select("_first").filter("_first is not null").distinct(),
                       ["_first"], "left_semi", F.col(doc))
    surfaces = begun.select(*keys, "at", F.inline(F.array(*runs))).filter("end is not null")  # null behind the last word
    mentions = join_small(surfaces, known.drop("_first"), ["surface"], "inner", F.col(doc)).select(*keys, F.lit(False).alias("_date"), "at", "end", "name")

    both = dates.unionByName(mentions)
    mention = ~F.col("_date")
    front = Window.partitionBy(*keys).orderBy(F.when(mention, F.col("end")).otherwise(F.col("at")), "_date").rowsBetween(
        Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys).orderBy(F.desc(F.when(mention, F.col("at")).otherwise(F.col("end"))), "_date").rowsBetween(
        Window.unboundedPreceding, 0)  # from the end: Spark adds up a frame that opens in front once, one that closes behind for every row
    placed = both.select(
        "*", F.max(F.when(mention, F.struct("end", "at", "name"))).over(front).alias("_front"),
        F.min(F.when(mention, F.struct("at", "end", "name"))).over(behind).alias("_behind")).filter("_date")
    to_front, to_behind = F.col("at") - F.col("_front.end"), F.col("_behind.at") - F.col("end")
    nearer = to_behind.isNull() | (to_front <= to_behind)
    return placed.filter("_front is not null or _behind is not null").select(
        doc, (F.col("_from") + F.col("at")).alias("at"), F.col("name").alias("raw"),
        F.when(nearer, F.col("_front.name")).otherwise(F.col("_behind.name")).alias("drug"),
        F.when(nearer, to_front).otherwise(to_behind).alias("distance"))


def upcoming_dated(trials: DataFrame, dates: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Trials with a primary (else overall) completion date that has not passed."""
    due = F.coalesce("primary_completion", "completion")
    return trials.join(dates, key, "left").withColumn("due", due).filter(
        F.col("due").isNotNull() & (F.col("due") >= as_of)).drop("primary_completion", "completion")


def upcoming_events(events: DataFrame, raw: str, as_of: Column) -> DataFrame:
    """Events with parsed year, period and display; unparseable and past ones are dropped.

    A year without period, in the current year, cannot be judged and is kept.
    """
    year, rank = F.year(as_of), F.quarter(as_of)
    parsed = with_period(events, raw).filter(F.col("year").isNotNull()).withColumn(
        "period_rank", period_rank(F.col("period")))
    past = (F.col("year") < year) | (
        (F.col("year") == year) & (F.col("period") != "") & (F.col("period_rank") < rank))
    return parsed.filter(~past)


def timeline(events: DataFrame, query: str, raw: str, drug: str, source: str, as_of: Column,
             limit: int = MAX_EVENTS) -> DataFrame:
    """At most `limit` upcoming events per query, one per drug and source, generic arms skipped."""
    real = events.filter(~F.lower(F.trim(drug)).isin(GENERIC_ARMS))
    order = [F.asc("year"), F.asc("period_rank"), F.asc(source), F.asc(drug)]
    dated = upcoming_events(real, raw, as_of)
    single = top_k(dated, [query, drug, source], [F.asc("year"), F.asc("period_rank"), F.asc(raw)], 1, "_one").drop("_one")
    return top_k(single, [query], order, limit)


def by_period(events: DataFrame, query: str, drug: str, source: str) -> DataFrame:
    """The (bounded) events of each query grouped by period, in order."""
    return events.groupBy(query, "year", "period").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", drug, source))),
                                 lambda e: F.concat_ws("@", e[drug], e[source])), "|").alias("events"))
