import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidencia import api
from evidencia.operators import evaluation, graph, search


def test_search_trials_with_phase(spark):
    trials = spark.createDataFrame([(1, "aspirin for pain", ["Phase 3"]), (2, "aspirin for fever", ["Phase 1", "Phase 2"]), (3, "ibuprofen", ["Phase 3"])],
                                   "doc_id long, text string, phases array<string>")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, "aspirin pain", "phase3")], "query_id long, query string, phase string")
    near = search.Vectors(vecs.filter("doc_id <> 2"), spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>"), 2)
    rows = api.search_trials(trials, near, queries, 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [1, 3]
    plain = api.search_trials(trials, near, queries, 2, rerank=False).collect()
    assert {r["doc_id"] for r in plain} == {1, 3}


def test_corpus_text(spark):
    rows = spark.createDataFrame([("NCT1", "T", "S", ["a", "b"], ["x"], None, "sum")],
                                 "nct_id string, title string, sponsor string, conditions array<string>, interventions array<string>, study_type string, summary string")
    assert api.corpus_text("trials", rows, "nct_id").df.first()["text"] == "NCT1\nT\nS\na, b\nx\nsum"
    typed = rows.withColumn("interventions", F.expr("array(struct('DRUG' as type, 'Drug 4' as name), struct('DEVICE' as type, 'x' as name))"))
    assert api.corpus_text("trials", typed, "nct_id").df.first()["text"] == "NCT1\nT\nS\na, b\nDRUG: Drug 4, DEVICE: x\nsum"
    with pytest.raises(TypeError):
        api.corpus_text("trials", rows.withColumn("summary", F.lit(1)), "nct_id")


def test_lookup_finds_brand_generic_substring_and_unresolved(spark):
    occ = spark.createDataFrame([("NCT1", "Pembrolizumab 200 mg", "pembrolizumab", 1), ("NCT2", "ABX464", None, 1), ("NCT3", "pembro", "pembrolizumab", 2)],
                                "trial string, drug string, concept string, v int")
    syn = spark.createDataFrame([("pembrolizumab", "Keytruda")], "concept string, brand string")
    asked = spark.createDataFrame([("KEYTRUDA",), ("pembrolizumab",), ("abx464",), ("unknown",)], "entity string")
    got = {}
    for r in api.lookup_entity(graph.build_graph(occ, "v"), syn, asked).collect():
        got.setdefault(r["entity"], []).append(r["trial"])
    assert got == {"KEYTRUDA": ["NCT1", "NCT3"], "pembrolizumab": ["NCT1", "NCT3"], "abx464": ["NCT2"]}


def test_safety_signals(spark):
    rows = [(f"a{i}", "D", "RASH") for i in range(5)] + [(f"b{i}", "E", "ACHE") for i in range(20)] + [("c", "D", "DEATH")]
    reports = spark.createDataFrame(rows, "report string, drug string, reaction string")
    drugs = spark.createDataFrame([("D",)], "drug string")
    assert [r["reaction"] for r in api.safety_signals(reports, drugs).collect()] == ["RASH"]  # noise terms are left out
    asked = spark.createDataFrame([("D", "death")], "drug string, reaction string")
    assert api.safety_signals(reports, drugs, asked).first()["a"] == 1


def test_exclusivity_puts_open_dates_first(spark):
    d = dt.date
    products = spark.createDataFrame([(1, "Keytruda", "pembrolizumab", d(2028, 1, 1)), (2, "KeyX", "y", None), (3, "Z", "z", d(2030, 1, 1))],
                                     "product int, trade_name string, ingredient string, loe_estimate date")
    rows = api.exclusivity(products, spark.createDataFrame([("key",)], "name string")).orderBy("rank").collect()
    assert [r["product"] for r in rows] == [2, 1]


def test_landscape_keeps_most_advanced_stage(spark):
    ev = spark.createDataFrame([("Keytruda", "Phase 2", "NCT1"), ("pembrolizumab", "Approved", "BLA1"), ("X", "Preclinical", "NDA1"), ("Y", "Preclinical", "PMC1")],
                               "drug string, stage string, source string")
    mech = spark.createDataFrame([("pembrolizumab", "PD-1")], "drug string, mechanism string")
    syn = spark.createDataFrame([("pembrolizumab", "KEYTRUDA")], "concept string, brand string")
    rows = {r["mechanism"]: r.asDict() for r in api.landscape(ev, mech, syn).collect()}
    assert rows["PD-1"]["approved"] == 1 and rows["PD-1"]["total_drugs"] == 1
    assert rows["Other / Unspecified Mechanism"]["preclinical"] == 1 and rows["Other / Unspecified Mechanism"]["total_drugs"] == 1


def test_catalysts(spark):
    events = spark.createDataFrame([("q", "2026", "A", "s1"), ("q", "Q1 2026", "B", "s2"), ("q", "Q4 2026", "C", "s3"), ("q", "soon", "D", "s4"), ("q", "2027", "Placebo", "s5")],
                                   "query string, raw string, drug string, source string")
    rows = api.catalysts(events, F.lit("2026-08-24").cast("date")).collect()
    assert {(r["year"], r["period"], r["events"]) for r in rows} == {(2026, "", "A@s1"), (2026, "Q4", "C@s3")}


def test_every_condition_of_a_trial_counts(spark):
    rows = [(f"T{k}", "drugname", ["a", "b", "c", "d"]) for k in range(3)]
    trials = spark.createDataFrame(rows, "trial string, drug string, conditions array<string>")
    pairs = lambda **o: {r["condition"] for r in evaluation.candidate_counts(trials, **o).collect() if r["kind"] == "pair"}
    assert pairs() == {"a", "b", "c", "d"} and pairs(conditions=3) == {"a", "b", "c"}


def test_statistics_bind_their_values(spark):
    tables = {"interventions": spark.createDataFrame([(1, "Salve 5%"), (2, "Salve 5%"), (3, "Salve 50"), (4, "A_B"), (5, "AxB"), (6, "it's")], "nct_id int, name string")}
    found = lambda name: {r["intervention"]: r["studies"] for r in api.trial_stats(tables, "intervention_studies", name=name).collect()}
    assert found("5%") == {"Salve 5%": 2} and found("a_b") == {"A_B": 1} and found("'s") == {"it's": 1} and len(found("")) == 5
    assert found("' or 1=1") == {}
    with pytest.raises(ValueError, match="no statement"):
        api.trial_stats(tables, "drop table")
    with pytest.raises(ValueError, match="no parameter"):
        api.trial_stats(tables, "intervention_studies", phase="x")
