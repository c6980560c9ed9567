"""Readers of landed raw files: ZIP bulk partitions, delimited tables, monthly CSV, XML, feeds, filings."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from evidencia.functions.codes import filing_url, pmc_id
from evidencia.functions.dates import MONTHS, parse_date
from evidencia.functions.markup import flat_text
from evidencia.operators.ranking import top_k
from evidencia.sources.store import written

APPROVAL = """application_number string, sponsor_name string,
  products array<struct<brand_name: string, dosage_form: string, active_ingredients: array<struct<name: string>>>>,
  openfda struct<rxcui: array<string>, product_type: array<string>>,
  submissions array<struct<submission_status_date: string>>"""
ADVERSE_EVENT = """safetyreportid string, receivedate string, serious string,
  patient struct<drug: array<struct<medicinalproduct: string, drugindication: string>>,
    reaction: array<struct<reactionmeddrapt: string>>>"""
LETTER = """text string, application_number array<string>, file_name string, company_name string,
  letter_date string, letter_type string, letter_year string, approval_status string"""

_CHUNK = 1 << 20


class _Reader:
    """JSON values from a stream, one at a time; text that ends early or is damaged raises ValueError."""

    def __init__(self, stream):
        self.text, self.decoder = io.TextIOWrapper(stream, encoding="utf-8"), json.JSONDecoder()
        self.buffer, self.at, self.ended = "", 0, False

    def _fill(self) -> None:
        piece = self.text.read(max(_CHUNK, len(self.buffer)))
        self.buffer, self.at, self.ended = self.buffer[self.at:] + piece, 0, not piece

    def peek(self) -> str:
        """The next character that is not white space; empty at the end."""
        while True:
            while self.at < len(self.buffer) and self.buffer[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.buffer):
                return self.buffer[self.at]
            if self.ended:
                return ""
            self._fill()

    def take(self, *expected: str) -> str:
        found = self.peek()
        if not found or found not in expected:
            raise ValueError(f"expected {' or '.join(expected)}, found {found or 'the end'}")
        self.at += 1
        return found

    def value(self) -> str:
        """The text of the next value; a number is complete only when something follows it."""
        self.peek()
        while True:
            try:
                _, end = self.decoder.raw_decode(self.buffer, self.at)
                if end < len(self.buffer) or self.ended:
                    found, self.at = self.buffer[self.at:end], end
                    return found
            except ValueError:
                if self.ended:
                    raise
            self._fill()


def _array_items(stream, name: str) -> Iterator[str]:
    """JSON text of each element of the array `name` of the outermost object, decoding one element at a time.

    An array of that name deeper down is not meant. Damaged or cut text, or no such array, raises ValueError.
    """
    reader, found = _Reader(stream), False
    reader.take("{")
    closed = reader.peek() == "}"
    if closed:
        reader.take("}")
    while not closed:
        key = json.loads(reader.value())
        reader.take(":")
        if key == name and reader.peek() == "[":
            found = True
            reader.take("[")
            last = reader.peek() == "]"
            if last:
                reader.take("]")
            while not last:
                yield reader.value()
                last = reader.take(",", "]") == "]"
        else:
            reader.value()
        closed = reader.take(",", "}") == "}"
    if not found:
        raise ValueError(f"no array {name}")


@dataclass
class Landed:
    """What a reader found in raw files: every record with its file and, if it was refused, the reason.

    `rows` are the accepted records, `rejects` {file, at, raw, reason} the others, so that nothing is lost silently: the two
    add up to what was read.
    """

    parsed: DataFrame  # {file, at, raw, reason, r}

    @property
    def rows(self) -> DataFrame:
        return self.parsed.filter("reason is null").select("r.*")

    @property
    def rejects(self) -> DataFrame:
        return self.parsed.filter("reason is not null").select("file", "at", "raw", "reason")

    def observed(self, counters: Observation) -> DataFrame:
        """`rows`, with the numbers read, kept and rejected in `counters` as soon as an action has gone over them."""
        refused = F.col("reason").isNotNull()
        return self.parsed.observe(counters, F.count(F.lit(1)).alias("read"), F.count_if(~refused).alias("kept"), F.count_if(refused).alias(
            "rejected")).filter("reason is null").select("r.*")


def typed(records: DataFrame, raw: str, schema: str) -> Landed:
    """JSON records {file, at, <raw>, problem} read by `schema`; those of another shape are refused."""
    value = F.from_json(raw, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    names = [field.name for field in records.sparkSession.createDataFrame([], schema).schema]
    read = records.withColumn("_v", F.explode(F.array(value)))
    reason = F.coalesce("problem", F.when(F.col("_v").isNull() | F.col("_v._corrupt").isNotNull(), F.lit("does not fit the schema")))
    return Landed(read.select("file", "at", F.col(raw).alias("raw"), reason.alias("reason"), F.struct(*[F.col("_v")[n].alias(n) for n in names]).alias("r")))


def _unzip(array: str):
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("json", pa.string()), ("problem", pa.string())])

    def items(content) -> Iterator[str]:
        with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
            for member in archive.infolist():
                if not member.is_dir():
                    with archive.open(member) as stream:
                        yield from _array_items(stream, array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path: str, at: int, held: list[str]) -> pa.RecordBatch:
            n = len(held)
            return pa.record_batch([pa.array([path] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), pa.array(held, pa.string()),
                                    pa.nulls(n, pa.string())], schema=schema)

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, at = [], 0
                try:
                    for item in items(content):
                        held.append(item)
                        if len(held) == 1000:
                            yield rows(path, at, held)
                            held, at = [], at + 1000
                except (ValueError, zipfile.BadZipFile, zlib.error) as error:
                    yield rows(path, at, held)
                    held, at = [], at + len(held)
                    yield pa.record_batch([pa.array([path]), pa.array([at], pa.int64()), pa.nulls(1, pa.string()), pa.array([str(error)])], schema=schema)
                if held:
                    yield rows(path, at, held)
    return run


def read_bulk_zips(spark: SparkSession, path: str, schema: str, array: str = "results") -> Landed:
    """Elements of the `results` array of every member of every ZIP, one task per ZIP, typed by `schema`.

    An element of another shape is refused. Where a file is damaged its elements so far are kept and the rest is one reject with the
    reason. `at` counts the elements of a ZIP from 0.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return typed(files.mapInArrow(_unzip(array), "file string, at bigint, json string, problem string"), "json", schema)


def read_delimited(spark: SparkSession, path: str) -> Landed:
    """`~`-delimited latin-1 table with a header line. A line with more or fewer cells than the header is refused."""
    options = dict(sep="~", encoding="ISO-8859-1", header=True, quote="")
    names = spark.read.csv(path, **options).columns  # reads the header
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_corrupt", T.StringType())])
    parsed = spark.read.schema(schema).csv(path, columnNameOfCorruptRecord="_corrupt", enforceSchema=False, **options)
    # Parsed once for both channels; the parser also needs all columns to find lines of another width.
    lines = written(parsed.withColumn("_file", F.col("_metadata.file_path")), "delimited")
    reason = F.when(F.col("_corrupt").isNotNull(), "another number of cells than the header")
    return Landed(lines.select(F.col("_file").alias("file"), F.lit(None).cast("bigint").alias("at"), F.col("_corrupt").alias("raw"),
                               reason.alias("reason"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("r")))


def exclusivity_tables(products: DataFrame, patents: DataFrame, exclusivities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three delimited tables in the form the exclusivity operator takes."""
    key = [F.col("Appl_No").alias("appl_no"), F.col("Product_No").alias("product_no")]
    shaped = products.select(
        *key, F.col("Appl_Type").alias("appl_type"), F.trim("Trade_Name").alias("trade_name"),
        F.trim("Ingredient").alias("ingredient"), F.trim(F.coalesce("Applicant_Full_Name", "Applicant")).alias("applicant"),
        parse_date(F.col("Approval_Date")).alias("approval_date"))
    return (shaped, patents.select(*key, parse_date(F.col("Patent_Expire_Date_Text")).alias("expires")),
            exclusivities.select(*key, parse_date(F.col("Exclusivity_Date")).alias("expires")))


def release_month(path: Column) -> Column:
    """yyyy-mm from a file name that spells out a month and a year."""
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    month = F.regexp_extract(name, "(" + "|".join(m.lower() for m in MONTHS) + ")", 1)
    number = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), month)
    return F.when(number > 0, F.concat_ws("-", F.regexp_extract(name, "(20[0-9]{2})", 1), F.lpad(number.cast("string"), 2, "0")))


MONTHLY_FIELDS = {
    "BLA Number": "appl_no", "Proper Name": "ingredient", "Proprietary Name": "trade_name", "Applicant": "applicant",
    "Approval Date": "approval_date", "Exclusivity Expiration Date": "exclusivity",
    "Ref. Product Exclusivity Exp. Date": "ref_exclusivity", "Orphan Exclusivity Exp. Date": "orphan_exclusivity",
}


MONTHLY_NEEDS = ("BLA Number", "Proper Name")


def read_monthly_csv(spark: SparkSession, path: str, most_cells: int = 512) -> Landed:
    """Rows of monthly CSV files below their `N/R/U` header line, columns found by header name.

    The CSV parser reads them, so cells may hold commas, quotes and line breaks. The expiry is the latest of three dates. Refused are
    rows without number or proper name, rows of more than `most_cells` cells, files without a header line and files whose header
    lacks a needed column. Blank lines and what stands above the header are no rows.
    """
    names = [f"c{k}" for k in range(most_cells)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    raw = spark.read.schema(schema).csv(path, header=False, multiLine=True, quote='"', escape='"', columnNameOfCorruptRecord="_corrupt",
                                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cells = F.transform(F.array(*names), lambda c: F.trim(F.regexp_replace(c, "^\ufeff|[\r]$", "")))
    # One task reads a file from top to bottom, so ids rise with its rows. The parser keeps the text of rows of another width: short
    # ones are no fault, cells left out are null; of the others the cells are counted, quoted ones without what is in them.
    too_many = F.coalesce(F.regexp_count(F.regexp_replace("_corrupt", r'"(?:[^"]|"")*"', ""), F.lit(",")) >= most_cells, F.lit(False))
    lines = written(raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), cells.alias("cells"),
                               too_many.alias("too_many")), "monthly")
    is_header = F.upper(F.get("cells", F.lit(0))) == "N/R/U"
    head = lines.groupBy("file").agg(F.min(F.when(is_header, F.struct("at", "cells"))).alias("head"))
    below = lines.join(head.filter("head is not null"), "file").filter("at > head.at").filter(
        F.exists("cells", lambda c: F.coalesce(F.length(c), F.lit(0)) > 0))

    def named(header):
        at = F.array_position(F.col("head.cells"), F.lit(header)).cast("int")
        return F.when(at > 0, F.get("cells", at - 1))

    lacks = F.filter(F.array(*[F.when(F.array_position(F.col("head.cells"), F.lit(h)) == 0, F.lit(h)) for h in MONTHLY_NEEDS]), lambda h: h.isNotNull())
    rows = below.select("file", "at", "cells", "too_many", lacks.alias("lacks"), release_month(F.col("file")).alias("month"),
                        *[named(h).alias(c) for h, c in MONTHLY_FIELDS.items()])
    dates = [parse_date(F.col(c)) for c in ("exclusivity", "ref_exclusivity", "orphan_exclusivity")]
    filled = (F.length("appl_no") > 0) & (F.length("ingredient") > 0)
    reason = F.when(F.size("lacks") > 0, F.concat(F.lit("no column "), F.array_join("lacks", ", "))).when(
        F.col("too_many"), f"more than {most_cells} cells").when(~F.coalesce(filled, F.lit(False)), "no number or proper name")
    shaped = rows.select(
        "file", "at", F.array_join("cells", ",").alias("raw"), reason.alias("reason"), F.struct(
            "file", "month", "appl_no", "trade_name", "ingredient", "applicant", parse_date(F.col("approval_date")).alias("approval_date"),
            F.lit(None).cast("date").alias("patent_expiry"), F.greatest(*dates).alias("exclusivity_expiry"),
            F.greatest(*dates).alias("loe_estimate")).alias("r"))
    headless = head.filter("head is null").select(
        "file", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("raw"), F.lit("no N/R/U header line").alias("reason"),
        F.lit(None).cast(shaped.schema["r"].dataType).alias("r"))
    return Landed(shaped.unionByName(headless))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """JATS articles, split at the closing tag so that large files are read in parallel.

    Text inside inline tags is kept; articles without id, or without abstract and body, are dropped.
    """
    article = F.regexp_extract("value", r"(?s)(<article[ >].*)$", 1)
    raw = spark.read.text(path, lineSep="</article>").select(
        F.when(article != "", F.concat(article, F.lit("</article>"))).alias("x"))

    def text(path_expr):
        return F.xpath_string("x", F.lit(f"normalize-space(({path_expr})[1])"))

    ids = "//article-id[(@pub-id-type='pmc' or @pub-id-type='pmcid') and normalize-space()!='']"
    parsed = raw.select(
        pmc_id(text(ids)).alias("pmcid"), text("//article-title").alias("title"), text("//abstract").alias("abstract"),
        text("//body").alias("body"), text("//journal-title").alias("journal"), text("//pub-date/year").alias("pub_year"))
    return parsed.filter(F.col("pmcid").isNotNull() & ((F.col("abstract") != "") | (F.col("body") != ""))).select(
        "pmcid", F.when(F.col("title") != "", F.col("title")).otherwise("(no title)").alias("title"), "abstract", "body",
        F.when(F.col("journal") != "", F.col("journal")).otherwise("Unknown journal").alias("journal"),
        F.when(F.col("pub_year") != "", F.col("pub_year")).alias("pub_year"))


def read_feeds(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Entries with title and link of RSS files (one file per feed, named after it); with `limit` the first
    ones of each feed, counted after empty entries are left out.

    Files are split at the closing tag of entries, so a large feed is read by several tasks; `position` is the place of an entry in its
    feed, counted from 0.
    """
    pieces = spark.read.text(path, lineSep="</item>").select(
        F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("feed"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.regexp_extract("value", r"(?s)(<item\b.*)$", 1).alias("x"))
    parsed = pieces.filter("x <> ''").withColumn("x", F.concat("x", F.lit("</item>"))).select(
        "feed", "_block", "_id", F.trim(F.xpath_string("x", F.lit("item/title"))).alias("title"),
        flat_text(F.xpath_string("x", F.lit("item/description"))).alias("summary"),
        F.trim(F.xpath_string("x", F.lit("item/link"))).alias("link"), F.trim(F.xpath_string("x", F.lit("item/pubDate"))).alias("published"))
    # Ids rise within a block of a file.
    placed = parsed.withColumn("position", F.row_number().over(Window.partitionBy("feed").orderBy("_block", "_id")) - 1).drop("_block", "_id")
    filled = placed.filter((F.col("title") != "") & (F.col("link") != ""))
    if limit is not None:
        filled = top_k(filled, ["feed"], [F.asc("position")], limit).drop("rank")
    return filled.select(
        "feed", "position", "title", F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("title")).alias("text"), "link", "published")


def filing_headers(filings: DataFrame, accession: str = "accession", text: str = "text") -> DataFrame:
    """Filed date and company name from the header of a submission, up to its closing tag or the first document,
    and its public address. A submission without either mark is searched whole."""
    head = F.substring_index(F.substring_index(text, "</SEC-HEADER>", 1), "<DOCUMENT>", 1)
    filed = F.regexp_extract(head, r"FILED AS OF DATE:\s*(\d{8})", 1)
    name = F.trim(F.regexp_extract(head, r"COMPANY CONFORMED NAME:[ \t]*([^\r\n]+)", 1))
    return filings.select(
        accession, F.when(filed != "", F.concat_ws("-", F.substring(filed, 1, 4), F.substring(filed, 5, 2), F.substring(filed, 7, 2))).alias("filed_date"),
        F.when(name != "", name).alias("company_name"), filing_url(F.col(accession)).alias("source_url"))


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """{accession, text}: one landed file per filing, in a folder named after its accession number."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([0-9]{10}-[0-9]{2}-[0-9]{6})", 1).alias("accession"), F.col("value").alias("text"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "query string, expected_nct_ids array<string>, ground_truth struct<drug: string, condition: string>").json(path)
