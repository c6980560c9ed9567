import json
import zipfile

import pytest
from pyspark.sql import Observation, functions as F

from evidencia.operators import exclusivity, signals
from evidencia.sources import corpora, readers, registry, store


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def study(nct, summary="Text", phases=("PHASE3",), arms=(("DRUG", "Aspirin"),), **extra):
    proto = {
        "identificationModule": {"nctId": nct, "briefTitle": extra.get("title")},
        "designModule": {"phases": list(phases), "studyType": "INTERVENTIONAL"},
        "descriptionModule": {"briefSummary": summary},
        "conditionsModule": {"conditions": ["Café au lait"]},
    }
    if arms is not None:
        proto["armsInterventionsModule"] = {"interventions": [{"type": t, "name": n} for t, n in arms]}
    return {"protocolSection": proto}


def test_registry_envelope(spark, tmp_path):
    pages = [
        {"studies": [study("NCT1", phases=["PHASE1", "PHASE2"]), study(None), study("NCT2", summary="  ")]},
        {"studies": [study("NCT3", arms=None), study("NCT4", arms=[(None, " Rest "), ("DRUG", " ")], phases=["EARLY_PHASE1", "NA", "ODD"])]},
    ]
    path = write(tmp_path / "env.json", json.dumps({"source": "x", "pages": pages}, indent=1))
    studies = registry.flatten_pages(registry.read_envelopes(spark, path))
    assert studies.count() == 5
    rows = {r["nct_id"]: r for r in registry.normalize_studies(studies).collect()}
    assert set(rows) == {"NCT1", "NCT3", "NCT4"}
    assert rows["NCT1"]["phases"] == ["Phase 1", "Phase 2"]
    assert rows["NCT1"]["title"] == "(no title)"
    assert rows["NCT3"]["interventions"] == [] and "Interventions: Not specified" in rows["NCT3"]["document"]
    assert [tuple(i) for i in rows["NCT4"]["interventions"]] == [("UNKNOWN", "Rest")]
    assert rows["NCT4"]["phases"] == ["Early Phase 1", "Not Applicable", "ODD"]
    c = registry.coverage(studies).first()
    assert (c["records"], c["skipped_no_summary"], c["with_interventions"]) == (3, 1, 2)


def test_bulk_zip_adverse_events(spark, tmp_path):
    reports = [
        {"safetyreportid": str(i), "receivedate": "20240105", "serious": "1" if i % 2 else "2",
         "patient": {"drug": [{"medicinalproduct": "B"}, {"medicinalproduct": "A", "drugindication": "Pain"}, {"medicinalproduct": "A"}],
                     "reaction": [{"reactionmeddrapt": "RASH"}, {"reactionmeddrapt": "ACHE [x]"}]}}
        for i in range(2500)
    ] + [{"receivedate": "20240105"}]
    with zipfile.ZipFile(tmp_path / "part.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("part.json", json.dumps({"meta": {"note": "results follow"}, "results": reports}, indent=1))
    raw = readers.read_bulk_zips(spark, str(tmp_path / "part.zip"), readers.ADVERSE_EVENT).rows
    assert raw.count() == 2501
    records = corpora.adverse_event_records(raw)
    one = records.filter("report_id = '7'").first()
    assert one["drugs"] == ["A", "B"] and one["indications"] == ["Pain"] and one["reactions"] == ["RASH", "ACHE [x]"]
    assert one["serious"] is True and str(one["receive_date"]) == "2024-01-05"
    assert corpora.report_pairs(records).count() == 2500 * 4
    assert signals.ror_signals(corpora.report_pairs(records)).count() == 4


def zipped(path, *members):
    with zipfile.ZipFile(path, "w") as z:
        for k, text in enumerate(members):
            z.writestr(f"part{k}.json", text)
    return str(path)


def test_bulk_zip_takes_the_outer_array_of_every_member(spark, tmp_path):
    nested = '{"meta": {"results": {"total": 1}, "terms": ["x", "y"], "more": {"results": [{"a": 9}]}}, "results": [{"a": 1}, {"a": 2}]}'
    path = zipped(tmp_path / "a.zip", nested, '{"results": [{"a": 3}]}', '{"results": [], "last": [1, 2]}')
    assert sorted(r["a"] for r in readers.read_bulk_zips(spark, path, "a int").rows.collect()) == [1, 2, 3]


@pytest.mark.parametrize("damaged, kept", [
    ('{"results":[{"a":1},{"a":2},{', [1, 2]), ('{"results":[{"a":1},{"a"::2},{"a":3}]}', [1]), ('{"results":[{"a":1}', [1]), ('{"results":[{"a":1}]', [1]),
    ('{"other":[]}', []), ('[{"a":1}]', []), ("", [])])
def test_damaged_bulk_zip_is_rejected_from_there(spark, tmp_path, damaged, kept):
    zipped(tmp_path / "a.zip", damaged)
    zipped(tmp_path / "b.zip", '{"results": [{"a": 9}]}')
    (tmp_path / "c.zip").write_bytes(b"no archive")
    landed = readers.read_bulk_zips(spark, str(tmp_path), "a int")
    assert sorted(r["a"] for r in landed.rows.collect()) == [*kept, 9]
    rejects = {r["file"].rsplit("/", 1)[1]: (r["at"], bool(r["reason"])) for r in landed.rejects.collect()}
    assert rejects == {"a.zip": (len(kept), True), "c.zip": (0, True)}


def test_elements_of_another_shape_are_rejected(spark, tmp_path):
    path = zipped(tmp_path / "a.zip", '{"results": [{"a": 1}, {"a": "x"}, 5, {"b": 1}, null, {"a": 2, "more": [1]}]}')
    landed = readers.read_bulk_zips(spark, path, "a int")
    assert sorted(r["a"] or 0 for r in landed.rows.collect()) == [0, 1, 2]  # an element without the field fits
    rejects = {r["at"]: r["raw"] for r in landed.rejects.collect()}
    assert rejects == {1: '{"a": "x"}', 2: "5", 4: "null"} and {r["reason"] for r in landed.rejects.collect()} == {"does not fit the schema"}
    counters = Observation()
    assert landed.observed(counters).count() == 3 and counters.get == {"read": 6, "kept": 3, "rejected": 3}


def test_array_items_over_chunks(monkeypatch):
    import io
    items = [{"k": i, "t": "x" * (i % 50), "n": [i, {"results": [i]}]} for i in range(300)] + [12345, "é", None]
    for size in (1, 7, 64):
        monkeypatch.setattr(readers, "_CHUNK", size)
        stream = io.BytesIO(json.dumps({"a": 1.5, "results": items, "z": {}}, ensure_ascii=False).encode())
        assert [json.loads(x) for x in readers._array_items(stream, "results")] == items


def test_approvals(spark, tmp_path):
    raw = spark.createDataFrame([(json.dumps({
        "application_number": "ANDA001", "products": [
            {"brand_name": "Z", "dosage_form": "TABLET", "active_ingredients": [{"name": "B"}, {"name": "A"}]},
            {"brand_name": "Y", "dosage_form": "TABLET", "active_ingredients": [{"name": "A"}]}],
        "submissions": [{"submission_status_date": "20240301"}]}),), (json.dumps({"sponsor_name": "none"}),)], "j string")
    rows = corpora.approval_records(raw.select(F.from_json("j", readers.APPROVAL).alias("r")).select("r.*")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["brand_names"] == ["Z", "Y"] and r["active_ingredients"] == ["A", "B"] and r["dosage_forms"] == ["TABLET"]
    assert r["source_url"].endswith("ApplNo=001") and "Sponsor: Unknown" in r["document"]
    assert str(r["submission_dates"][0]) == "2024-03-01"


def test_delimited_exclusivity(spark, tmp_path):
    p = write(tmp_path / "products.txt", "Ingredient~Trade_Name~Applicant~Applicant_Full_Name~Appl_Type~Appl_No~Product_No~Approval_Date\n"
              "ASPIRINA~CAFÉ~A~Á Corp~N~1~001~Jan 5, 2001\nX~GEN~B~B Corp~A~2~001~Jan 5, 2001\nY~SOLO~C~C Corp~N~3~001~Approved\n", "latin-1")
    q = write(tmp_path / "patent.txt", "Appl_No~Product_No~Patent_Expire_Date_Text\n1~001~Aug 24, 2026\n1~001~Aug 24, 2030\n1~001~junk\n")
    e = write(tmp_path / "exclusivity.txt", "Appl_No~Product_No~Exclusivity_Date\n1~001~01/02/2031\n")
    tables = readers.exclusivity_tables(*[readers.read_delimited(spark, x).rows for x in (p, q, e)])
    rows = {r["appl_no"]: r for r in exclusivity.loe_estimate(*tables, ["appl_no", "product_no"]).collect()}
    assert set(rows) == {"1", "3"}
    assert rows["1"]["trade_name"] == "CAFÉ" and str(rows["1"]["patent_expiry"]) == "2030-08-24"
    assert str(rows["1"]["loe_estimate"]) == "2031-01-02"
    assert rows["3"]["loe_estimate"] is None and rows["3"]["approval_date"] is None


def test_delimited_lines_of_another_width_are_rejected(spark, tmp_path):
    landed = readers.read_delimited(spark, write(tmp_path / "t.txt", "A~B~C\n1~2~3\n4~5\n6~7~8~9\n~~\n"))
    assert sorted(tuple(r) for r in landed.rows.filter("A is not null").collect()) == [("1", "2", "3")] and landed.rows.count() == 2
    assert sorted(r["raw"] for r in landed.rejects.collect()) == ["4~5", "6~7~8~9"]


def test_monthly_csv(spark, tmp_path):
    head = 'Report,,\n"made, for test"\n\nN/R/U,BLA Number,Applicant,Proper Name,Proprietary Name,Approval Date,Exclusivity Expiration Date,Ref. Product Exclusivity Exp. Date,Orphan Exclusivity Exp. Date\n'
    write(tmp_path / "PurpleBook-april-2024.csv", "﻿" + head + 'N,100,"A, Inc",oldmab,Old,01/02/2020,,01/02/2032,\nN,,x,y,z,,,,\n')
    write(tmp_path / "PurpleBook-february-2025.csv", head + 'N,100,"A, Inc",newmab,New,01/02/2020,01/02/2030,,01/05/2033\nN,200,B,solo,Solo,,,,\n')
    landed = readers.read_monthly_csv(spark, str(tmp_path))
    rows = landed.rows
    assert rows.count() == 3 and [r["reason"] for r in landed.rejects.collect()] == ["no number or proper name"]
    latest = {r["appl_no"]: r for r in exclusivity.latest_release(rows, ["appl_no"], ["month", "file"]).collect()}
    assert latest["100"]["ingredient"] == "newmab" and latest["100"]["applicant"] == "A, Inc"
    assert str(latest["100"]["loe_estimate"]) == "2033-01-05" and latest["200"]["loe_estimate"] is None


def test_wide_monthly_csv(spark, tmp_path):
    fill = ",".join(f"c{i}" for i in range(90))
    write(tmp_path / "PurpleBook-may-2024.csv", f'N/R/U,{fill},BLA Number,Proper Name\nN,{"," * 89},7,"a ""b"", c"\n')
    r = readers.read_monthly_csv(spark, str(tmp_path)).rows.first()
    assert (r["appl_no"], r["ingredient"], r["applicant"]) == ("7", 'a "b", c', None)


def test_monthly_csv_loses_nothing(spark, tmp_path):
    head = "N/R/U,BLA Number,Applicant,Proper Name\n"
    write(tmp_path / "PurpleBook-may-2024.csv", "Note\n" + head + 'N,1,"two\nlines, one cell","a ""b"""\n,,,\nN,2,x\nN,,x,y\n' + "N,3," + "," * 20 + "z\n")
    write(tmp_path / "PurpleBook-june-2024.csv", "Type,BLA Number,Proper Name\nN,4,lost\n")
    write(tmp_path / "PurpleBook-july-2024.csv", "N/R/U,Number,Proper Name\nN,5,five\nN,6,six\n")
    landed = readers.read_monthly_csv(spark, str(tmp_path), most_cells=16)
    assert [(r["appl_no"], r["applicant"], r["ingredient"]) for r in landed.rows.collect()] == [("1", "two\nlines, one cell", 'a "b"')]
    found = sorted((r["file"].rsplit("-", 2)[1], r["reason"]) for r in landed.rejects.collect())
    assert found == [("july", "no column BLA Number")] * 2 + [("june", "no N/R/U header line"), ("may", "more than 16 cells")] + [("may", "no number or proper name")] * 2
    counters = Observation()
    assert landed.observed(counters).count() == 1 and counters.get == {"read": 7, "kept": 1, "rejected": 6}

def test_articles(spark, tmp_path):
    body = lambda i, pid, extra: f"<article xmlns:xlink='u'><front><article-meta>{pid}<title-group><article-title>On <italic>x</italic>{i}</article-title></title-group>{extra}</article-meta></front></article>\n"
    text = "<?xml version='1.0'?><pmc-articleset>" + body(1, "<article-id pub-id-type='pmc'>77</article-id>", "<abstract><p>A <b>bold</b>\n claim</p></abstract>") \
        + body(2, "<article-id pub-id-type='pmcid'>PMC78</article-id>", "") + body(3, "<article-id pub-id-type='doi'>9</article-id>", "<abstract>z</abstract>") + "</pmc-articleset>"
    articles = readers.read_articles(spark, write(tmp_path / "a.xml", text))
    rows = articles.collect()
    assert [(r["pmcid"], r["title"], r["abstract"], r["journal"]) for r in rows] == [("PMC77", "On x1", "A bold claim", "Unknown journal")]
    chunks = corpora.article_chunks(articles).collect()
    assert chunks[0]["chunk"] == "A bold claim" and chunks[0]["chunk_count"] == 1


def test_feeds_filings_and_transcripts(spark, tmp_path):
    items = "".join(f"<item><title>T{i}</title><link>http://x/{i}</link><description><![CDATA[<p>Hello <b>{i}</b></p>]]></description></item>" for i in range(4))
    items += "<item><title> </title><link>http://x/9</link></item><item><title>Last</title><link>u</link></item>"
    assert readers.read_feeds(spark, write(tmp_path / "all.xml", f"<rss><channel>{items}</channel></rss>")).count() == 5
    feeds = readers.read_feeds(spark, write(tmp_path / "wire.xml", f"<rss><channel>{items}</channel></rss>"), limit=5)
    rows = feeds.orderBy("position").collect()
    assert [r["title"] for r in rows] == ["T0", "T1", "T2", "T3", "Last"] and rows[0]["text"] == "Hello 0" and rows[-1]["text"] == "Last"
    assert rows[0]["feed"] == "wire" and [r["position"] for r in rows] == [0, 1, 2, 3, 5]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    many = "".join(f"<item><title>N{i}</title><link>l{i}</link><description>{'x' * 100}</description></item>\n" for i in range(300))
    large = readers.read_feeds(spark, write(tmp_path / "large" / "b.xml", f"<rss><channel>{many}</channel></rss>"))
    source = spark.read.text(str(tmp_path / "large"), lineSep="</item>")
    assert source.rdd.getNumPartitions() > 5 and [r["title"] for r in large.orderBy("position").collect()] == [f"N{i}" for i in range(300)]
    assert {r["feed"]: r["count"] for r in readers.read_feeds(spark, str(tmp_path / "*.xml")).groupBy("feed").count().collect()} == {"all": 5, "wire": 5}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    filing = "COMPANY CONFORMED NAME:\t\tACME INC\nFILED AS OF DATE:\t\t20240105\n" + "a" * 5000 + " our PIPELINE is full " + "b" * 5000
    write(tmp_path / "f" / "0000078003-24-000012" / "full.txt", filing)
    write(tmp_path / "f" / "0000078003-24-000013" / "full.txt", "a" * 5000 + "</SEC-HEADER> FILED AS OF DATE: 20240105")
    write(tmp_path / "f" / "0000078003-24-000014" / "full.txt", "a" * 5000 + "\nFILED AS OF DATE: 20240106\n</SEC-HEADER>")
    filings = readers.read_filings(spark, str(tmp_path / "f" / "*"))
    heads = {r["accession"]: r for r in readers.filing_headers(filings).collect()}
    assert heads["0000078003-24-000012"]["filed_date"] == "2024-01-05" and heads["0000078003-24-000012"]["company_name"] == "ACME INC"
    assert heads["0000078003-24-000013"]["filed_date"] is None and heads["0000078003-24-000014"]["filed_date"] == "2024-01-06"
    assert heads["0000078003-24-000012"]["source_url"] == "https://www.sec.gov/Archives/edgar/data/78003/000007800324000012/"
    chunks = corpora.filing_chunks(filings).collect()
    assert {c["accession"] for c in chunks} == {"0000078003-24-000012"} and any("PIPELINE" in c["chunk"] for c in chunks)
    calls = spark.createDataFrame([("AB", "Ab Co", "http://h/call-transcripts/2024/03/04/q.html", "We expect approval soon"), ("C", "C", "http://h/x", "nothing")],
                                  "ticker string, company string, url string, text string")
    news = corpora.news_chunks(feeds, calls)
    call = news.filter("source_type = 'earnings_transcript'").collect()
    assert len(call) == 1 and call[0]["call_date"] == "2024-03-04" and call[0]["title"] is None


def test_letters(spark):
    raw = spark.createDataFrame([("  x " * 10, ["BLA1", "BLA2"], "f", "Co", "01/02/2024", "CRL", "2024", "no"), (" ", None, "g", "Co", None, None, None, None),
                                 ("y", [], "h", "Co", None, None, None, None)], readers.LETTER)
    rows = corpora.letter_chunks(raw).collect()
    assert sorted(r["file_name"] for r in rows) == ["f", "h"]


def test_store(spark, tmp_path):
    t = store.KeyedTable(spark, str(tmp_path / "t"), ["id"], 4)
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    delta = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "id int, v string, version int")
    t.create(base)
    t.upsert(delta, "version")
    once = sorted(map(tuple, t.read().collect()))
    t.upsert(delta, "version")
    assert sorted(map(tuple, t.read().collect())) == once == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    assert store.rebuilt(t.read(), t.read().withColumn("n", F.length("v")), str(tmp_path / "wide"), "wide").count() == 3
    assert spark.table("wide").columns == ["id", "v", "version", "n"]
    with pytest.raises(store.CutoverRefused):
        store.rebuilt(t.read(), t.read().filter("id > 1"), str(tmp_path / "short"), "short")
    report = store.archive(base, str(tmp_path / "copy"), ["v"]).first()
    assert report["matches"] and report["n_rows"] == 2
    assert not store.archive_report(base, delta, ["v"]).first()["matches"]
    store.land(base.withColumn("ingest_date", F.lit("2024-01-02")), str(tmp_path / "raw"), "ingest_date")
    assert spark.read.parquet(str(tmp_path / "raw" / "ingest_date=2024-01-02")).count() == 2


def test_golden_lines(spark, tmp_path):
    path = str(tmp_path / "g")
    readers.write_json_lines(spark.createDataFrame([("q", ["N1"], ("d", "c"))],
                             "query string, expected_nct_ids array<string>, ground_truth struct<drug: string, condition: string>"), path)
    assert readers.read_golden(spark, path).first()["ground_truth"]["drug"] == "d"
