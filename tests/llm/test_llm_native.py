"""Quality rules, URL rules, shards and decontamination against plain Python, and in awkward cases."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from evidencia.llm import decontaminate, keyed, quality, sharding, urls


def python_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    repeat = {i + d for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat),
            len(words) < 50 or 100 * len(repeat) > 50 * len(words))


def test_quality_counts(awkward, documents):
    for docs in (awkward, documents):
        got = quality.judged(docs).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert len(got) == docs.count()
        for text, *values, kept in got:
            assert tuple(values) == python_quality(text)
            assert not (kept and values[-1])


def test_quality_rules(spark, awkward, empty):
    clean = "The cat sat on the mat and it was in the house of a man. " * 3 + " ".join(f"word{k}" for k in range(80))
    rows = [(1, clean), (2, clean.upper()), (3, " | ".join(clean.split())), (4, "a " * 200), (5, "\n".join(["the and of " + clean] * 4))]
    got = {r.doc_id: (r.kept, r.broken) for r in quality.judged(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == (True, [])
    assert not got[2][0] and "stop_words" in got[2][1]
    assert not got[3][0] and "symbols_per_word" in got[3][1]
    assert not got[4][0] and not got[5][0]
    assert quality.accepted(awkward).columns == awkward.columns and quality.accepted(empty).count() == 0
    assert quality.accepted(awkward).filter("doc_id = 1").count() == 0  # repeats itself
    plan = quality.judged(empty)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def python_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = re.split("[?#]", rest[cut:])[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_url_rules(spark):
    rules = [*urls.RULES, ("example.net", "/en/x", "block"), ("a.example.net", "/", "block"), ("b.net", "/p", "allow"), ("", "/", "block"),
             ("example.net", "/en/", "allow"), ("a.example.net.", "/", "block")]
    hosts = ["example.net", "a.example.net", "b.a.example.net", "notexample.net", "net", "a.b.net", "example.com", "X.Example.COM", "org", "z.org",
             "a..net", ".net", "net.", "a.example.net.", "exämple.net", "example.net:80", "b.net", "example", "zzz"]
    tails = ["", "/", "/en/", "/en/x?y=/de/", "/de/1#x", "/fr/", "?q=/en/", "#f", "/p\u0301"]
    pages = [(k, u) for k, u in enumerate([None, "", "no scheme", "://", "http://", "a://b://c.net/"] + [f"http://{h}{t}" for h in hosts for t in tails])]
    pages += pages[:40]
    df = spark.createDataFrame([(*p, "c", "r") for p in pages], "page_id int, url string, host string, rule string")
    got = urls.judged(df, urls.rule_table(spark, rules)).select("url", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(pages)
    for url, *values in got:
        assert tuple(values) == python_verdict(url, rules), url
    assert urls.judged(df.limit(0), urls.rule_table(spark)).count() == 0
    assert {r.verdict for r in urls.judged(df, urls.rule_table(spark).limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("limit", [1000, 20_000, 10 ** 9])
def test_shards_fit(spark, awkward, documents, limit):
    docs = documents.select("doc_id", "text").unionByName(awkward.select("doc_id", "text").filter("doc_id < 5 or doc_id is null"))
    docs = docs.unionByName(documents.select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("x" * 300).alias("text")))
    got = sharding.sharded(docs, limit).collect()
    assert len(got) == docs.count()
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard, r.page].append(r.n_bytes)
    for (bits, _), sizes in shards.items():
        assert sum(sizes) <= limit or len(sizes) == 1 or len(set(r.doc_id for r in got if r.shard == bits)) == 1
        assert sum(sizes) <= limit or max(sizes) > limit
    depth = {r.shard for r in got}
    assert all(not any(a != b and b.startswith(a) for b in depth) for a in depth)  # prefix free
    total = collections.Counter()
    for r in got:
        for d in range(len(r.shard)):
            total[r.shard[:d]] += r.n_bytes
    assert all(n > limit for n in total.values())  # only oversized buckets were split
    assert sharding.sharded(docs.limit(0), limit).count() == 0


def test_spaced_seeds(spark, awkward, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "one two three four five six seven"), (3, "too short"), (4, None), (5, "")], "item_id int, text string")
    bent = list(item)
    bent[4], bent[11] = "changed", "other"
    noise = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(noise + item + noise)), (2, " ".join(noise + bent)), (3, " ".join(noise)), (4, "One, two; THREE four five six seven!"),
            (5, " ".join(item[:6] + noise)), (6, " ".join(noise + item[::-1])), (7, None), (8, ""), (None, " ".join(item)), (1, " ".join(noise + item + noise))]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.start) for r in decontaminate.leaks(docs, bench, ["doc_id"]).collect()}
    assert got == {(1, 1): (18, 40), (2, 1): (16, 40), (4, 2): (7, 0), (None, 1): (18, 0)}
    assert sorted(r.doc_id for r in decontaminate.cleaned(docs, bench).collect()) == [3, 5, 6, 7, 8]
    assert decontaminate.cleaned(awkward, bench).columns == awkward.columns
    assert decontaminate.cleaned(awkward, bench).count() == awkward.count()
    assert decontaminate.leaks(empty, bench, ["doc_id"]).count() == 0
    assert decontaminate.cleaned(docs, bench.limit(0)).count() == len(rows)


def test_excerpts_insertions_and_spaced_replacements(spark):
    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    a, b, ten = words("a", 59), words("b", 500), words("t", 10)
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(ten))], "item_id int, text string")
    noise = words("n", 300)
    hit = {"excerpt of 23": (a[20:43], 1, 23), "excerpt of 199": (b[100:299], 2, 199), "words put in": (a[:20] + ["x"] + a[20:40] + ["y", "z"] + a[40:], 1, 59),
           "words taken out": (a[:19] + a[20:39] + a[40:], 1, 57), "parts in another order": (a[30:42] + noise[:5] + a[10:22], 1, 24),
           **{f"word {k} of ten": (ten[:k] + ["x"] + ten[k + 1:], 3, 9) for k in range(10)},
           **{f"every {p}th from {r}": ([f"x{k}" if k % p == r else w for k, w in enumerate(a)], 1, None) for p in range(2, 10) for r in range(p)}}
    clean = {"nothing": noise, "twelve words": a[:12], "six of ten": ten[:6], "far apart": a[:12] + noise + a[30:42], "single words": [w for x in a for w in (x, "y")]}
    rows = [(name, " ".join(noise + text + noise)) for name, (text, *_) in hit.items()] + [(name, " ".join(text)) for name, text in clean.items()]
    rows += [("two texts", " ".join(a[:12])), ("two texts", " ".join(a[30:42]))]
    got = {r.doc_id: (r.item_id, r.matched) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id string, text string"), bench, ["doc_id"]).collect()}
    assert set(got) == set(hit)
    for name, (text, item, matched) in hit.items():
        assert got[name][0] == item and (matched is None or got[name][1] == matched) and got[name][1] <= len(text), name
        assert matched or got[name][1] >= 0.9 * sum(w in a for w in text) - 5, name


def test_decontamination_equals_its_sql(spark):
    """Random texts with excerpts, words put in, taken out and replaced, items of all lengths, repeated ids and rows."""
    import duckdb
    import pandas as pd
    chance = random.Random(21)
    words = [f"v{k}" for k in range(60)]
    items = [[chance.choice(words) for _ in range(n)] for n in (4, 5, 6, 7, 9, 10, 11, 15, 23, 40, 59)]
    rows = [(1, None), (2, ""), (None, " ".join(items[5]))]
    for k in range(220):
        text = list(chance.choice(items))
        kind = chance.randrange(5)
        if kind == 0:
            at = chance.randrange(len(text))
            text = text[at:at + chance.randint(5, 40)]
        for _ in range(chance.randint(0, 4) if kind == 1 else 0):
            text.insert(chance.randrange(len(text) + 1), "new")
        if kind == 2:
            step, r = chance.randint(2, 9), chance.randint(0, 3)
            text = ["other" if j % step == r else w for j, w in enumerate(text)]
        if kind == 3 and len(text) > 12:
            cut = chance.randint(6, len(text) - 6)
            text = text[cut:] + ["x"] * chance.randint(0, 8) + text[:cut]
        around = [chance.choice(words + ["n1", "n2", "n3"]) for _ in range(chance.randint(0, 60))]
        rows.append((chance.randrange(180), " ".join(around[:20] + text + around[20:])))
    rows += rows[:9]
    bench = [(k, " ".join(item)) for k, item in enumerate(items)] + [(99, None), (3, " ".join(items[3]))]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(bench, "item_id int, text string"), ["doc_id"])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int32"}))
    con.register("benchmark", pd.DataFrame(bench, columns=["item_id", "text"]))
    want = con.execute(decontaminate.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, got.select("doc_id", "item_id", "item_words", "matched", "start").collect()), key=str) == sorted(want, key=str) and len(want) > 120


def test_blocks_of_the_benchmark_change_nothing(spark, small, documents, monkeypatch):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    whole = decontaminate.leaks(documents, bench, ["doc_id"]).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 1000)
    assert sorted(decontaminate.leaks(documents, bench, ["doc_id"]).collect()) == sorted(whole)


def test_ranks_and_hot_joins(spark, monkeypatch):
    monkeypatch.setattr(keyed, "RANK_SLICE", 7)
    rows = spark.createDataFrame([(k if k % 2 else None, 1 if k % 3 else k) for k in range(120)], "v int, k int")
    got = collections.defaultdict(list)
    for r in keyed.ranked(rows, "k", [F.asc("v")], F.col("v")).collect():
        got[r.k].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    monkeypatch.setattr(keyed, "HOT_SHARE", 3)
    facts = rows.groupBy("k").agg(F.count("*").alias("copies"), F.max("v").alias("top"))
    joined = keyed.join_by_key(rows, facts, "k", "copies").collect()
    assert len(joined) == 120 and all(r.top == max([x.v for x in joined if x.k == r.k and x.v is not None], default=None) for r in joined)


def test_shards_are_written_whole(spark, documents, tmp_path):
    from evidencia.sources.store import scratch_path
    extra = spark.createDataFrame([(77, "same id " * 40, "en", "x", 1)] * 30 + [(None, None, None, None, None), (78, "y" * 9000, "en", "x", 1)], documents.schema)
    docs = documents.unionByName(extra).withColumns({"shard": F.lit("own"), "page": F.lit(-1)}).repartition(3)
    path, limit = scratch_path(spark, "shards"), 4_000
    sharding.write_shards(docs, path, limit)
    back = spark.read.parquet(path)
    key = lambda rows: collections.Counter(tuple(r) for r in rows)
    assert key(back.select("doc.*").collect()) == key(docs.collect())
    sizes = back.groupBy("shard", "page").agg(F.sum(F.coalesce(F.octet_length("doc.text"), F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sizes) > 50 and all(r.bytes <= limit or r.n == 1 for r in sizes) and max(r.page for r in sizes) > 0
    assert sharding.query(spark, "/root/testdata/sf0.001").select("shard").distinct().count() > 1


def test_a_filter_on_the_verdict_copies_no_expression(spark, documents):
    """The words of a text are split once, however often the rules speak of them."""
    plan = quality.accepted(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("split(") <= 2
