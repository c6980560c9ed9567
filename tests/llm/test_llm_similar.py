"""The Jaccard join against all pairs in plain Python, its parts, and the pipeline."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from evidencia.llm import decontaminate, langid, quality, similar
from evidencia.llm.components import components
from evidencia.llm.shingles import Shingler, digest
from evidencia.sources.store import written


def python_set(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def python_groups(rows):
    """{row number: smallest id reachable}, with all pairs compared."""
    sets = [python_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)].append(doc_id)
    return [(d, len(sets[k]), min(least[find(k)], default=None)) for k, (d, _) in enumerate(rows)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "é", "cc", "D.", " "]), max_size=9), max_size=6), st.sampled_from([" ", "\n", "\t \x0b"]))
def test_shingles_are_exact(docs, gap):
    texts = [gap.join(d) for d in docs]
    for text, got in zip(texts, Shingler().sets([t.encode() for t in texts])):
        assert len(got) == len(python_set(text))
    sets = [python_set(t) for t in texts]
    names = [digest(s) for s in Shingler().sets([t.encode() for t in texts])]
    assert all((a == b) == (x == y) for a, x in zip(sets, names) for b, y in zip(sets, names))


def test_prefixes_hold_the_shared_shingles():
    chance = random.Random(3)
    for _ in range(3000):
        n = chance.randint(2, 40)
        a = set(chance.sample(range(60), n))
        b = set(x for x in a if chance.random() > 0.12) | set(chance.sample(range(60), chance.randint(0, 4)))
        if 100 * len(a & b) >= 75 * len(a | b):
            firsts = [set(sorted(s)[:similar.prefix(len(s), k)]) for k in (1, 2) for s in (a, b)]
            assert firsts[0] & firsts[1]
            assert a == b or len(firsts[2] & firsts[3]) >= 2 or len(a & b) < 2


def made_rows(seed):
    chance = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for group in range(30):
        base = [chance.choice(words) for _ in range(chance.choice([1, 3, 6, 8, 9, 12, 20, 28, 29, 60, 150]))]
        for _ in range(chance.choice([1, 2, 5])):
            text = list(base)
            for _ in range(chance.randint(0, max(1, len(text) // 25))):
                text[chance.randrange(len(text))] = chance.choice(words)
            if chance.random() < 0.3:
                text = text[:-1] + ["Tail"]
            rows.append((len(rows), " ".join(text)))
    shared = " ".join(chance.choice(words) for _ in range(55))
    for k in range(25):  # one passage in many texts of little else
        rows.append((len(rows), " ".join([chance.choice(words) for _ in range(chance.choice([3, 10, 18]))]) + " " + shared))
    chain = [f"c{k}" for k in range(60)]
    for k in range(25):  # neighbours link, ends do not
        rows.append((len(rows), " ".join(chain[k:k + 34])))
    chance.shuffle(rows)
    return rows + rows[:3] + [(900, None), (901, ""), (902, "\n"), (None, rows[0][1]), (0, "the same id elsewhere")]


@pytest.mark.parametrize("hot, share", [(similar.HOT_FROM, similar.SALT_PARTNERS), (2, 2)])
def test_components_against_all_pairs(spark, monkeypatch, hot, share):
    monkeypatch.setattr(similar, "HOT_FROM", hot)
    monkeypatch.setattr(similar, "FREQUENT_FROM", min(hot, similar.FREQUENT_FROM))
    monkeypatch.setattr(similar, "SALT_PARTNERS", share)
    rows = made_rows(11)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit(1), "key": F.lit(""), "mark": F.lit(None)}).repartition(3)
    got = similar.grouped(docs).select("doc_id", "n_shingles", "component_id").collect()
    # A repeated id may differ in text, so rows are compared as a multiset.
    assert collections.Counter(map(tuple, got)) == collections.Counter(python_groups(rows))


@pytest.mark.parametrize("small", [0, 24])
def test_either_side_of_the_boundary_finds_all_links(spark, monkeypatch, small):
    monkeypatch.setattr(similar, "small_limit", lambda *_: small)
    rows = [(k, t) for k, t in made_rows(5) if k is not None and len((t or "").split()) < 40]
    got = similar.grouped(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(python_groups(rows))


@pytest.mark.parametrize("with_base", [True, False])
def test_groups_of_near_copies_cost_few_comparisons(spark, monkeypatch, with_base):
    """Copies of one text with two words changed each: they link with it and hardly with each other."""
    chance = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))] if with_base else []
    for k in range(1, 160):
        text = list(base)
        for _ in range(2):
            text[chance.randrange(150)] = f"x{chance.random()}"
        rows.append((k, " ".join(text)))
    compared, real = [], similar.compared
    monkeypatch.setattr(similar, "compared", lambda pairs, texts: compared.append(pairs.count()) or real(pairs, texts))
    got = similar.grouped(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(python_groups(rows))
    assert sum(compared) < (6 if with_base else 20) * len(rows)


def test_one_of_each_group_stays(spark, awkward, empty):
    kept = similar.deduplicated(awkward)
    assert kept.columns == awkward.columns
    texts = [r.text for r in kept.collect()]
    assert sorted(t or "" for t in texts if not (t or "").strip()) == sorted(r.text or "" for r in awkward.collect() if not (r.text or "").strip())
    assert len([t for t in texts if t and t.strip()]) == 5  # the repeated row stays once
    assert similar.deduplicated(empty).count() == 0 and similar.grouped(empty).count() == 0


def test_connected_components(spark):
    chance = random.Random(2)
    edges = [(k, k + 1) for k in range(1, 40)] + [(500, k) for k in range(501, 640)] + [(1000 + chance.randrange(60), 1000 + chance.randrange(60)) for _ in range(45)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in list(root)}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k in got} and len(got) == len({x for a, b in edges if a != b for x in (a, b)})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_boundary_follows_cost():
    assert similar.small_limit({s: 1000 for s in range(1, 13)}, 0, 50.0) > similar.small_limit({s: 1000 for s in range(1, 13)}, 0, 1.0)
    assert similar.small_limit({}, 0, 1.0) == 0


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small), "test")
        assert docs.columns == columns
        kept[name] = docs.collect()
    good = quality.judged(spark.createDataFrame(before, docs.schema)).filter("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept["quality_rules"]) == sorted(r.doc_id for r in good)
    assert {r.doc_id for r in kept["language_id"]} == {r.doc_id for r in kept["quality_rules"]}  # all clean documents are in a language
    groups = python_groups([(r.doc_id, r.text) for r in kept["language_id"]])
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted({c for _, _, c in groups})
    bench = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for r in kept["near_duplicates"]:
        line = " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower())) + " "
        leaks = any(f" {' '.join(item)} " in line for item in bench)
        assert not leaks or r.doc_id not in {x.doc_id for x in kept["decontamination"]}
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept["decontamination"]}
    total = collections.Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in pieces)
