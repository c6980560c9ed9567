"""Search and statistics against brute force on small inputs."""

import collections
import datetime as dt
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencia.operators import dense, embedding, evaluation, lexical, ordered, signals
from evidencia.sizing import join_small


def test_dense_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(70, 6)).round(1)
    vecs[10:14] = vecs[9]  # ties
    asked = rng.normal(size=(9, 6))
    corpus = spark.createDataFrame([(i, v.tolist(), i % 3, "a" if i % 2 else "b") for i, v in enumerate(vecs)] + [(99, [1.0], 0, "a")],
                                   "doc_id long, embedding array<double>, label int, corpus string")
    queries = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(asked)], "query_id long, embedding array<double>, label int")

    def brute(match, within):
        out = set()
        for q, u in enumerate(asked):
            groups = {}
            for d, v in enumerate(vecs):
                if match and q % 3 != d % 3:
                    continue
                s = math.floor(u @ v / np.linalg.norm(u) / np.linalg.norm(v) * 1e6 + 0.5) / 1e6
                groups.setdefault(d % 2 if within else 0, []).append((-s, d))
            for rows in groups.values():
                out |= {(q, d) for _, d in sorted(rows)[:4]}
        return out
    with pytest.raises(Exception, match="expected 6 dimensions, found 1"):
        dense.dense_topk(corpus, queries, 4, 6).collect()
    corpus = dense.valid_vectors(corpus, "embedding", 6)
    for match in ((), ("label",)):
        for within in ((), ("corpus",)):
            for size in (dict(), dict(query_bytes=0, rows_per_block=16, queries_per_block=4)):
                got = dense.dense_topk(corpus, queries, 4, 6, match_on=match, within=within, **size)
                assert {(r["query_id"], r["doc_id"]) for r in got.collect()} == brute(match, within), (match, within, size)


def test_dense_with_any_key_types(spark):
    day = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
    rows = [(f"d{k}", [1.0, k / 10], day[k % 3], k % 2 == 0) for k in range(12)]
    corpus = spark.createDataFrame(rows, "doc_id string, embedding array<double>, day date, even boolean")
    queries = spark.createDataFrame([(dt.date(2025, 1, k + 1), [1.0, 0.0], k == 0) for k in range(2)], "query_id date, embedding array<double>, even boolean")
    got = {}
    for r in dense.dense_topk(corpus, queries, 1, 2, match_on=("even",), within=("day",)).collect():
        got[r["query_id"].day, r["day"]] = r["doc_id"]
    assert got == {(1, day[0]): "d0", (1, day[2]): "d2", (1, day[1]): "d4", (2, day[1]): "d1", (2, day[0]): "d3", (2, day[2]): "d5"}


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    side = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = join_small(big, side, ["k"], how, small=True)
        b = join_small(big, side, ["k"], how, F.col("id"), small=False)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def python_bm25(docs, queries, k, within=False, must=lambda d: True, asked=None):
    """Every document of every query scored, then cut to k."""
    out = {}
    for part in sorted({d[2] for d in docs}) if within else [None]:
        own = [(d, [w for w in d[1].split() if w not in ("the",)]) for d in docs if not within or d[2] == part]
        mean = sum(len(w) for _, w in own) / len(own)
        for q, text in queries:
            scores = []
            for d, words in own:
                total = 0.0
                for term in dict.fromkeys(w for w in text.split() if w != "the"):
                    df, tf = sum(term in w for _, w in own), words.count(term)
                    if tf:
                        total += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
                if total > 0 and must(d) and (asked is None or asked.get(q) is None or set(asked[q]) & set(d[3] or [])):
                    scores.append((-math.floor(total * 1e6 + 0.5) / 1e6, d[0]))
            for rank, (score, doc) in enumerate(sorted(scores)[:k], 1):
                out[(q, part, rank) if within else (q, rank)] = (doc, -score)
    return out


@pytest.mark.parametrize("block", [200_000, 2])
def test_bm25_against_all_documents(spark, block):
    chance = random.Random(4)
    words = "alpha beta gamma delta the omega rare".split()
    rows = [(i, " ".join(chance.choices(words, [9, 6, 5, 4, 9, 2, 0.3], k=i % 23)), i % 2, chance.choice([None, [], ["x"], ["y"], ["x", "z"]])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int, tags array<string>").repartition(5)
    asked = {1: ["x"], 2: None, 3: None, 4: ["y", "z"], 5: []}
    queries = [(1, "alpha delta"), (2, "gamma zeta rare"), (3, ""), (4, "the omega omega alpha beta"), (5, "alpha")]
    table = spark.createDataFrame([(q, t, asked[q]) for q, t in queries], "query_id long, query string, asked array<string>")

    def found(**options):
        corpus = {k: options.pop(k) for k in ("within", "must", "tags") if k in options}
        matches = lexical.match_terms(lexical.Corpus(docs, **corpus), table, block=block, **options)
        # Rows that leave a task: at most k per query and corpus value.
        scored = lexical.scored_topk(matches, 5)
        per_task = scored.groupBy(F.spark_partition_id(), "query_id", *corpus.get("within", ())).count().agg(F.max("count")).first()[0]
        assert per_task <= 5
        return lexical.bm25_topk(matches, 5).collect()

    assert {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found()} == python_bm25(rows, queries, 5)
    assert {(r["query_id"], r["kind"], r["rank"]): (r["doc_id"], r["score"]) for r in found(within=("kind",))} == python_bm25(rows, queries, 5, within=True)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found(must=F.col("kind") == 1, tags="tags", asked="asked")}
    assert got == python_bm25(rows, queries, 5, must=lambda d: d[2] == 1, asked=asked)


def test_bounds_skip_documents(spark, monkeypatch):
    """With a k-th score at hand, documents with common words only are not scored, and the result is the same."""
    rows = [(i, "rare rare rare" if i < 4 else "common common filler") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "rare common")], "query_id long, query string")
    touched = []
    real = lexical.best_of
    monkeypatch.setattr(lexical, "best_of", lambda scores, ids, k: touched.append(len(scores)) or real(scores, ids, k))
    matches = lexical.match_terms(lexical.Corpus(docs), queries)
    scorer = lexical._Scorer(matches.blocks[0], "query_id", (), 3, {}, False)
    for part in matches.index.orderBy("doc_id").toArrow().to_batches(max_chunksize=50):
        scorer.add(pa.Table.from_batches([part]), "doc_id")
    assert scorer.held[1, ()][1].tolist() == [0, 1, 2] and len(touched) == 1  # later batches have no document that can reach it


def test_the_filter_is_below_the_score(spark):
    docs = spark.createDataFrame([(1, "alpha", "en", ["x"]), (2, "alpha", "de", ["x"])], "doc_id long, text string, lang string, tags array<string>")
    queries = spark.createDataFrame([(1, "alpha", ["x"])], "query_id long, query string, asked array<string>")
    found = lexical.match_terms(lexical.Corpus(docs, must=F.col("lang") == "en", tags="tags"), queries, asked="asked")
    plan = lexical.bm25_topk(found, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Filter" in below and "may" in below[below.index("Filter"):] and "arrays_overlap" in below
    assert [r["doc_id"] for r in lexical.bm25_topk(found, 3).collect()] == [1]


def test_ordered_across_slices(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice("xy")) for g in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, key string")
    for width in (1, 7, 1000):
        slice_by = F.floor(F.col("i") / width)
        got = {(r["g"], r["i"]): r for r in ordered.running_sum(df, ["g"], ["i"], slice_by, F.lit(1), "n", "all").collect()}
        assert len(got) == 120 and all(r["n"] == i + 1 and r["all"] == 40 for (_, i), r in got.items())
        runs = {(r["g"], r["i"]): r["run_no"] for r in ordered.runs(df, ["g"], ["i"], slice_by, "key").collect()}
        for g in (1, 2, None):
            no, last = 0, None
            for _, i, key in (r for r in rows if r[0] == g):
                no += key != last
                last = key
                assert runs[(g, i)] == no


def test_odds_ratio_traps(spark):
    rows = [(f"r{i}", "D", "X") for i in range(3)] + [("r0", "D", "X")] + [(f"o{i}", "E", "Y") for i in range(50)] + [("p1", "D", "Z"), ("p2", "E", "Z")]
    reports = spark.createDataFrame(rows, "report string, drug string, reaction string")
    asked = spark.createDataFrame([("D", "X"), ("D", "Y"), ("D", "NONE")], "drug string, reaction string")
    got = {r["reaction"]: r for r in signals.ror_signals(reports, asked).collect()}
    a, b, c, d = 3, 1, 1, 55 - 4 - 3 + 3
    ror = a * d / (b * c)
    low = math.exp(math.log(ror) - 1.96 * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    assert got["X"]["a"] == 3 and got["X"]["ror"] == round(ror, 2) and got["X"]["ci95_low"] == round(low, 2) and got["X"]["signal"]
    assert got["Y"]["ror"] == 0.0 and not got["Y"]["signal"] and got["NONE"]["a"] == 0


def test_evaluation_without_queries(spark):
    gold = spark.createDataFrame([], "query_id long, doc_id long")
    hits = spark.createDataFrame([(1, 2)], "query_id long, doc_id long")
    summary = evaluation.retrieval_summary(evaluation.recall(gold, hits, "query_id", "doc_id"))
    [row] = summary.collect()
    assert (row["queries"], row["mean_recall"], row["median_recall"], row["zero_recall_queries"]) == (0, None, None, 0)
    assert math.isnan(row["hit_rate"])
    got = {r["metric"]: r["passed"] for r in evaluation.gate(evaluation.metric_rows(summary), evaluation.metric_rows(summary)).collect()}
    assert got == {"mean_recall": None, "hit_rate": True}  # as the SQL has it: NaN equals NaN


def test_hashed_vectors_against_plain_python(spark):
    """Words are hashed and weighted once for each row, not again for every place of the vector."""
    texts = ["Red pill, red dot", "", None, "blue", " ".join(f"w{k}" for k in range(900))] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = embedding.hashed_vectors(docs, "text", 32)
    got = {r["doc_id"]: r["embedding"] for r in found.collect()}
    tf = [collections.Counter(embedding.slot_of(w.strip(","), 32) for w in (t or "").lower().split()) for t in texts]
    df = collections.Counter(s for c in tf for s in c)
    for d, counts in enumerate(tf):
        want = [counts[s] * math.log((len(texts) + 1) / (df[s] + 1)) for s in range(32)]
        length = math.sqrt(sum(x * x for x in want)) or 1.0
        assert np.allclose(got[d], [x / length for x in want])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "array_repeat" not in plan


def test_models_hold_little(spark, monkeypatch):
    monkeypatch.setattr(embedding, "KNOWN_WORDS", 10)
    slot = embedding.slots_known(64)
    assert [slot(f"w{k}") for k in range(100)] == [embedding.slot_of(f"w{k}", 64) for k in range(100)]
    assert len(slot.__closure__[[c for c in slot.__code__.co_freevars].index("known")].cell_contents) <= 10

    def counting_model():
        return lambda texts: [[float(len(texts))]] * len(texts)
    docs = spark.range(3000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    most = embedding.model_vectors(docs, "text", counting_model).agg(F.max(F.col("embedding")[0]), F.count("embedding")).first()
    assert most[0] <= embedding.SLICE_ROWS and most[1] == 3000


def test_models_run_once(spark):
    """A filter on the places of the vectors, which Spark infers, does not run the model again."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    cells = embedding.model_vectors(docs, "text", embedding.word_model).select("doc_id", F.posexplode("embedding"))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
    assert {r["doc_id"] for r in cells.collect()} == {1, 2}


def test_documents_are_scored_in_slices_of_bounded_words():
    words = [["a"] * n for n in (3, 0, 4, 20, 1, 1)] + [None]
    batch = pa.record_batch({"doc_id": list(range(7)), "words": pa.array(words, pa.list_(pa.string()))})
    assert [s.column("doc_id").to_pylist() for s in lexical.sliced(batch, "words", 7)] == [[0, 1, 2], [3], [4, 5, 6]]
    assert list(lexical.sliced(batch.slice(0, 0), "words", 7)) == []


def test_golden_set_is_dealt_by_its_rows(spark, monkeypatch):
    rows = [(t, f"drug{t // 3}", ["a", "b"][:t % 3]) for t in range(60)] + [(900 + t, "placebo", ["a"]) for t in range(5)]
    occurrences = spark.createDataFrame(rows, "trial long, drug string, conditions array<string>")
    want = sorted(evaluation.golden_set(occurrences).collect())
    assert {(r["drug"], tuple(r["expected"])) for r in want} == {(f"drug{k}", (3 * k + 1, 3 * k + 2)) for k in range(20)}
    monkeypatch.setattr(evaluation, "ROWS_PER_TASK", 5)
    found = evaluation.golden_set(occurrences)
    assert sorted(found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"RepartitionByExpression \[drug#\d+\], (\d+)", plan)) == {"13"}  # 65 rows
    assert "ExternalRDD" not in plan and "LogicalRDD" not in plan  # the rows are made once
