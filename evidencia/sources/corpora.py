"""From parsed sources to the records and chunks that are indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.functions.codes import citation_url
from evidencia.functions.dates import url_date
from evidencia.functions.ids import RECORDS, uuid5
from evidencia.functions.records import labelled, listed, present, sorted_distinct
from evidencia.functions.segments import (
    CHUNKING, FILING_KEYWORDS, FILING_WINDOW, TRANSCRIPT_KEYWORDS, TRANSCRIPT_WINDOW, chunk_rows, excerpt,
    markdown_blocks, markdown_chunks, recursive_chunks, stripped, table_blocks, with_windows,
)


def approval_records(raw: DataFrame) -> DataFrame:
    """One record per application, with sorted distinct ingredients and dosage forms over its products."""
    products = F.coalesce("products", F.from_json(F.lit("[]"), raw.schema["products"].dataType.json()))
    ingredients = F.flatten(F.transform(products, lambda p: F.coalesce(
        F.transform(p["active_ingredients"], lambda a: a["name"]), F.array().cast("array<string>"))))
    shaped = raw.filter(F.length("application_number") > 0).select(
        F.col("application_number"), F.col("sponsor_name"),
        present(F.transform(products, lambda p: p["brand_name"])).alias("brand_names"),
        sorted_distinct(ingredients).alias("active_ingredients"),
        sorted_distinct(F.transform(products, lambda p: p["dosage_form"])).alias("dosage_forms"),
        F.coalesce("openfda.rxcui", F.array().cast("array<string>")).alias("rxcui"),
        F.coalesce("openfda.product_type", F.array().cast("array<string>")).alias("product_type"),
        F.transform(F.coalesce("submissions", F.from_json(F.lit("[]"), raw.schema["submissions"].dataType.json())),
                    lambda s: F.to_date(F.try_to_timestamp(s["submission_status_date"], F.lit("yyyyMMdd")))).alias("submission_dates"),
    )
    document = F.concat_ws("\n", F.concat(F.lit("Application: "), "application_number"),
                           labelled([("Sponsor", F.col("sponsor_name"))], "Unknown"),
                           labelled([("Brand names", listed(F.col("brand_names"))),
                                     ("Active ingredients", listed(F.col("active_ingredients"))),
                                     ("Dosage forms", listed(F.col("dosage_forms")))]))
    return shaped.select(uuid5(RECORDS, F.concat(F.lit("drugsfda:"), "application_number")).alias("id"), "*",
                         document.alias("document"), citation_url(F.col("application_number")).alias("source_url"))


def adverse_event_records(raw: DataFrame) -> DataFrame:
    """One record per safety report: sorted distinct drugs and indications, reactions in order."""
    shaped = raw.filter(F.length("safetyreportid") > 0).select(
        F.col("safetyreportid").alias("report_id"),
        F.to_date(F.try_to_timestamp("receivedate", F.lit("yyyyMMdd"))).alias("receive_date"),
        F.coalesce(F.col("serious") == "1", F.lit(False)).alias("serious"),
        F.coalesce(sorted_distinct(F.transform("patient.drug", lambda d: d["medicinalproduct"])), F.array().cast("array<string>")).alias("drugs"),
        F.coalesce(sorted_distinct(F.transform("patient.drug", lambda d: d["drugindication"])), F.array().cast("array<string>")).alias("indications"),
        F.coalesce(present(F.transform("patient.reaction", lambda r: r["reactionmeddrapt"])), F.array().cast("array<string>")).alias("reactions"),
    )
    document = labelled([("Drugs", listed(F.col("drugs"))), ("Indications", listed(F.col("indications"))),
                         ("Reactions", listed(F.col("reactions"))), ("Serious", F.when(F.col("serious"), "Yes").otherwise("No"))])
    return shaped.select(uuid5(RECORDS, F.concat(F.lit("event:"), "report_id")).alias("id"), "*", document.alias("document"))


def report_pairs(records: DataFrame) -> DataFrame:
    """{report, drug, reaction} rows for the disproportionality operator."""
    return records.select(F.col("report_id").alias("report"), F.explode("drugs").alias("drug"), "reactions").select(
        "report", "drug", F.explode("reactions").alias("reaction"))


def letter_chunks(raw: DataFrame) -> DataFrame:
    text = stripped(F.col("text"))
    letters = raw.withColumn("text", text).filter(F.length("text") > 0).withColumn(
        "file_name", F.coalesce("file_name", F.lit(""))).withColumn(
        "key", F.concat_ws("|", F.coalesce(F.get("application_number", 0), F.lit("UNKNOWN")), "file_name"))
    return chunk_rows(letters, "key", recursive_chunks(F.col("text"), *CHUNKING["letters"])).drop("text", "key")


def article_chunks(articles: DataFrame) -> DataFrame:
    full = articles.withColumn("text", F.concat_ws("\n\n", *[F.when(F.col(c) != "", F.col(c)) for c in ("abstract", "body")]))
    chunks = chunk_rows(full, "pmcid", recursive_chunks(F.col("text"), *CHUNKING["literature"]))
    return chunks.drop("text", "abstract", "body").withColumn("document", F.concat(
        F.lit("Title: "), "title", F.lit("\nJournal: "), "journal", F.lit("\n\n"), "chunk"))


def filing_chunks(filings: DataFrame) -> DataFrame:
    """{accession, text}: the passages around the filing keywords, chunked; filings without any are left out."""
    kept = with_windows(filings, "text", FILING_KEYWORDS, FILING_WINDOW).filter(F.size("hits") > 0)
    sections = kept.withColumn("section", excerpt(F.col("text"), F.col("spans"))).drop("text", "hits", "spans")
    return chunk_rows(sections, "accession", recursive_chunks(F.col("section"), *CHUNKING["filings"])).drop("section")


def feed_chunks(entries: DataFrame) -> DataFrame:
    full = entries.withColumn("full", F.concat("title", F.lit("\n\n"), "text"))
    chunks = chunk_rows(full, "link", recursive_chunks(F.col("full"), *CHUNKING["news"]))
    return chunks.select(F.lit("press_release").alias("source_type"), F.col("feed").alias("feed_name"), "title",
                         F.col("published"), "chunk_id", "chunk_index", F.col("chunk").alias("text"), F.col("link").alias("source_url"))


def transcript_chunks(transcripts: DataFrame) -> DataFrame:
    """{ticker, company, url, text}: passages around forward-looking keywords, dated by the address."""
    kept = with_windows(transcripts, "text", TRANSCRIPT_KEYWORDS, TRANSCRIPT_WINDOW).filter(F.size("hits") > 0)
    sections = kept.withColumn("section", excerpt(F.col("text"), F.col("spans")))
    chunks = chunk_rows(sections, "url", recursive_chunks(F.col("section"), *CHUNKING["news"]))
    return chunks.select(F.lit("earnings_transcript").alias("source_type"), "ticker", "company", url_date(F.col("url")).alias("call_date"),
                         "chunk_id", "chunk_index", F.col("chunk").alias("text"), F.col("url").alias("source_url"))


def news_chunks(entries: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Both kinds of news in one table."""
    return feed_chunks(entries).unionByName(transcript_chunks(transcripts), allowMissingColumns=True)


def markdown_records(docs: DataFrame) -> DataFrame:
    """{source_file, markdown} -> chunks with whole tables, plus `blocks` tables for the audit."""
    blocked = docs.withColumn("blocks", F.explode(F.array(markdown_blocks(F.col("markdown")))))
    chunked = blocked.withColumn("chunks", F.explode(F.array(markdown_chunks(F.col("blocks"), *CHUNKING["markdown"]))))
    return chunked.select("source_file", "chunks", table_blocks(F.col("blocks")).alias("tables"))
