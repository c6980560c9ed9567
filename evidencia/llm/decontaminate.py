"""Benchmark decontamination by spaced seeds.

A seed is a run of words of which a fixed mask ignores some: a passage with a replaced word still shares
seeds whose ignored places fall on it. The masks ignore places 2, 3, 4 and 5 apart, and `RUN_WORDS` words in a row
are a seed too, so words replaced at regular distances leave seeds whatever the distance. Every position of every document is hashed under every mask and
meets the seeds of the benchmark by broadcast join, inside the task that reads the document; nothing of a
document is shuffled but its hits. Each hit is verified word by word over its whole window, ignored places
included. A pair counts as a leak, with at least `MIN_AGREE` agreeing words (all of a shorter item), if along one
alignment the agreeing places of the item are `MIN_SHARE` of its words, or an excerpt of it, `MIN_RUN` agreeing places
of which neighbours are at most `RUN_GAP` apart; or if the alignments within a span of the document together agree in
`MIN_SHARE` of its places, each counted once, as words put in or taken out shift what follows. Spans are four items
long and start every two, so every stretch of twice the item's length lies in one.

The benchmark is broadcast in blocks of at most about `BLOCK_SEEDS` seeds, one pass over the documents per
block, so its size is bounded whatever the benchmark holds. Items shorter than a mask are sought as whole
runs of words; items of fewer than `MIN_WORDS` words say nothing about a document and are left out. Words
are compared by 64-bit hashes.

Null texts count as empty; empty texts and empty benchmarks leak nothing. A document whose id repeats with
another text is judged by itself and reported once per id and item, with its best find. Ids may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencia.session import table
from evidencia.sources.store import written

# Fixed masks: 1 takes the word, 0 ignores it.
MASKS = ("1101110111", "1011101101", "1110011111")
# Further masks, for words replaced at every 5th, 3rd and 2nd place; every 4th is seen by the first mask.
SPACED = ("1101111011", "1011011011", "1010101010")
RUN_WORDS = 5
SPAN = 10
WINDOW = [f"w{k}" for k in range(SPAN)]
MIN_WORDS = 5
MIN_SHARE = 0.4
MIN_AGREE = 7  # the fewest words that one of `MASKS` takes
MIN_RUN = 13
RUN_GAP = 3
BLOCK_SEEDS = 200_000  # about 100 bytes each
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits and characters beyond ASCII."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def windows(rows: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """rows {keep..., words} -> {keep..., at, w0, w1, ...}: the hashes of the `SPAN` words from each word on,
    null beyond the end. Each row carries its window only, so long texts stay linear."""
    hashed = rows.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_hashes"))
    shifted = [F.slice("_hashes", k + 1, F.size("_hashes")).alias(f"w{k}") for k in range(SPAN)]
    placed = hashed.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("at", "_window"))
    return placed.select(*keep, "at", *[F.col("_window")[f"w{k}"].alias(f"w{k}") for k in range(SPAN)])


def seeded(rows: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """Rows of `windows` with `seed`: one row per mask, run and whole length that fits before the end."""
    patterns = [([k for k, c in enumerate(mask) if c == "1"], SPAN) for mask in MASKS + SPACED]
    patterns += [(list(range(n)), n) for n in [RUN_WORDS, *lengths]]
    hashes = [F.when(F.col(f"w{span - 1}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"w{i}") for i in places]))
              for k, (places, span) in enumerate(patterns)]
    sown = rows.select(*keep, "at", *WINDOW, F.explode(F.array(*hashes)).alias("seed"))
    return sown.filter(F.col("seed").isNotNull())


def longest_run(places: Column) -> Column:
    """Of sorted places, how many the longest run has whose neighbours are at most `RUN_GAP` apart."""
    def step(state, place):
        n = F.when(place - state["last"] <= RUN_GAP, state["n"] + 1).otherwise(1)
        return F.struct(place.alias("last"), n.alias("n"), F.greatest(state["most"], n).alias("most"))

    none = F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))
    return F.aggregate(places, none, step, lambda state: state["most"])


def leaks(docs: DataFrame, benchmark: DataFrame, key: list[str], min_share: float = MIN_SHARE) -> DataFrame:
    """docs {key..., text}, benchmark {item_id, text} ->
    {key..., item_id, item_words, matched, start}: the leaks, one row per key and item. `matched` counts along the
    best alignment with a share of `min_share`; without one, over a span or an excerpt, whichever has more, with the
    start of the span's first alignment."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item")).filter(F.size("item") >= MIN_WORDS).distinct()
    sized = items.select("item_id", F.size("item").alias("item_words"), "item")
    # At most SPAN - MIN_WORDS different values, whatever the benchmark holds.
    short = sorted(r[0] for r in sized.filter(F.col("item_words") < SPAN).select("item_words").distinct().collect())
    item_windows = windows(sized, "item", ["item_id", "item_words"])
    long_seeds = seeded(item_windows.filter(F.col("item_words") >= SPAN), ["item_id", "item_words"], [])
    # An item shorter than the masks is one seed, the one of its own length.
    own = [seeded(item_windows.filter((F.col("item_words") == n) & (F.col("at") == 0)), ["item_id", "item_words"], short).filter(
        F.col("seed") == F.xxhash64(F.lit(len(MASKS + SPACED) + 1 + k), *WINDOW[:n])) for k, n in enumerate(short)]
    seeds = reduce(DataFrame.unionByName, own, long_seeds)
    blocks = max(1, -(-seeds.count() // BLOCK_SEEDS))
    row = [*key, "_text"]  # the same id may come with several texts
    texts = docs.select(*key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text"), words_of(F.col("text")).alias("words"))
    doc_seeds = seeded(windows(texts, "words", row), row, short)
    agree = F.array_compact(F.array(*[F.when(F.col(w) == F.col(f"i{w}"), F.col("item_at") + k) for k, w in enumerate(WINDOW)]))

    def hits(block: int) -> DataFrame:
        index = seeds.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select(
            "seed", "item_id", "item_words", F.col("at").alias("item_at"), *[F.col(w).alias(f"i{w}") for w in WINDOW])
        return doc_seeds.join(F.broadcast(index), "seed").select(
            *row, "item_id", "item_words", (F.col("at") - F.col("item_at")).alias("start"), agree.alias("places"))

    laid = reduce(DataFrame.unionByName, [hits(b) for b in range(blocks)]).groupBy(*row, "item_id", "item_words", "start").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("places"))
    matched = F.size("places")
    enough = lambda n: (n >= F.col("item_words") * min_share) & (n >= F.least(F.col("item_words"), F.lit(MIN_AGREE)))
    lines = written(laid.withColumn("whole", enough(matched)).withColumn(
        "run", F.when(~F.col("whole"), longest_run(F.col("places")))), "alignments")
    found = lines.filter(F.col("whole") | (F.col("run") >= MIN_RUN)).select(
        *key, "item_id", "item_words", "whole", matched.alias("matched"), "start")
    # An alignment lies where its first agreeing place is, in the span that starts there and in the one before.
    step = F.floor((F.col("start") + F.get("places", 0)) / (2 * F.col("item_words")))
    parts = lines.filter("not whole").select(
        *row, "item_id", "item_words", "start", "places", F.explode(F.array(step - 1, step)).alias("span"))
    summed = parts.select(*row, "item_id", "item_words", "span", "start", F.explode("places").alias("place")).groupBy(
        *row, "item_id", "item_words", "span").agg(F.count_distinct("place").alias("n"), F.min("start").alias("start"))
    added = summed.filter(enough(F.col("n"))).select(
        *key, "item_id", "item_words", F.lit(False).alias("whole"), F.col("n").cast("int").alias("matched"), "start")
    best = F.max_by(F.struct("item_words", "matched", "start"), F.struct("whole", "matched", -F.col("start"), "item_words"))
    return found.unionByName(added).groupBy(*key, "item_id").agg(best.alias("best")).select(*key, "item_id", "best.*")


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with the columns they came with."""
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    bad = leaks(docs.select("doc_id", mark.alias("mark"), "text"), benchmark, ["doc_id", "mark"]).select(
        F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    marked = rows.select("doc", F.xxhash64(F.coalesce(F.col("doc.text"), F.lit(""))).alias("mark"))
    return marked.join(bad.hint("shuffle_hash"), marked["doc.doc_id"].eqNullSafe(F.col("_bad_id")) & (
        F.col("mark") == F.col("_bad_mark")), "left_anti").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return leaks(docs, benchmark, ["doc_id"])


def _pattern(at: str, places: list[int]) -> str:
    return " || ' ' || ".join(f"words[{at} + {k}]" for k in places)


def _seeds(source: str, key: str) -> str:
    """SQL rows of seeds, as text instead of hashes: masks and runs of long items, items shorter than the masks whole."""
    patterns = [(f"m{m}", [k for k, c in enumerate(mask) if c == "1"], SPAN) for m, mask in enumerate(MASKS + SPACED)]
    patterns.append(("run", list(range(RUN_WORDS)), RUN_WORDS))
    long = f" and len(words) >= {SPAN}" if source == "item" else ""
    parts = [f"select {key}, pos, '{name} ' || {_pattern('pos', places)} as seed from {source}_places where pos + {span - 1} <= len(words){long}"
             for name, places, span in patterns]
    for n in range(MIN_WORDS, SPAN):
        where = f"pos = 1 and len(words) = {n}" if source == "item" else f"pos + {n - 1} <= len(words) and {n} in (select len(words) from items)"
        parts.append(f"select {key}, pos, 'w{n} ' || {_pattern('pos', list(range(n)))} from {source}_places where {where}")
    return " union all ".join(parts)


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _enough(n: str) -> str:
    return f"({n} >= item_words * {MIN_SHARE} and {n} >= least(item_words, {MIN_AGREE}))"


ORACLE_SQL = f"""
with docs as (select row_number() over () as row, doc_id, {_WORDS} as words from (select distinct doc_id, coalesce(text, '') as text from documents)),
items as (select row_number() over () as item, * from (select distinct item_id, {_WORDS} as words from benchmark) where len(words) >= {MIN_WORDS}),
doc_places as (select row, words, unnest(range(1, len(words) + 1)) as pos from docs),
item_places as (select item, words, unnest(range(1, len(words) + 1)) as pos from items),
doc_seeds as ({_seeds('doc', 'row')}),
item_seeds as ({_seeds('item', 'item')}),
hits as (select distinct row, item, doc_seeds.pos - item_seeds.pos as start, item_seeds.pos as item_pos from doc_seeds join item_seeds using (seed)),
agree as (
  select distinct row, item_id, item_words, start, place from (
    select row, item_id, start, len(items.words) as item_words, unnest(list_transform(list_filter(
      range(item_pos, item_pos + least({SPAN}, len(items.words) - item_pos + 1)),
      lambda k: start + k >= 1 and items.words[k] = docs.words[start + k]), lambda k: k - 1)) as place
    from hits join docs using (row) join items using (item)) x),
laid as (select row, item_id, item_words, start, count(*) as matched, min(place) as first from agree group by all),
judged as (select *, {_enough('matched')} as whole from laid),
gaps as (select *, case when place - lag(place) over w <= {RUN_GAP} then 0 else 1 end as opens from agree window w as (partition by row, item_id, item_words, start order by place)),
isles as (select *, sum(opens) over (partition by row, item_id, item_words, start order by place) as isle from gaps),
runs as (select row, item_id, item_words, start, max(n) as run from (select row, item_id, item_words, start, isle, count(*) as n from isles group by all) group by all),
found as (select row, item_id, item_words, whole, matched, start from judged join runs using (row, item_id, item_words, start) where whole or run >= {MIN_RUN}),
spans as (select row, item_id, item_words, start, unnest([s - 1, s]) as span from (
  select *, floor((start + first)::double / (2 * item_words)) as s from judged where not whole)),
summed as (select row, item_id, item_words, span, count(distinct place) as n, min(start) as start
  from spans join agree using (row, item_id, item_words, start) group by row, item_id, item_words, span),
every as (select * from found union all select row, item_id, item_words, false, n, start from summed where {_enough('n')})
select doc_id, item_id, item_words::integer as item_words, matched::integer as matched, start::integer as start
from (select * from every join docs using (row)) x
qualify row_number() over (partition by doc_id, item_id order by whole desc, matched desc, start, item_words desc) = 1"""
