"""Registry studies: paged JSON envelopes and their flat form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidencia.functions.codes import citation_url, phase_labels
from evidencia.functions.ids import RECORDS, uuid5
from evidencia.functions.records import filled, named_items, present, study_text

STUDY = """struct<protocolSection: struct<
  identificationModule: struct<nctId: string, briefTitle: string>,
  designModule: struct<phases: array<string>, studyType: string>,
  statusModule: struct<overallStatus: string, lastUpdatePostDateStruct: struct<date: string>,
    primaryCompletionDateStruct: struct<date: string, type: string>, completionDateStruct: struct<date: string>>,
  sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>,
  descriptionModule: struct<briefSummary: string>,
  conditionsModule: struct<conditions: array<string>>,
  armsInterventionsModule: struct<interventions: array<struct<type: string, name: string, otherNames: array<string>>>>>>"""
ENVELOPE = f"""source string, fetched_at_utc string, returned_count int,
  pages array<struct<totalCount: int, nextPageToken: string, studies: array<{STUDY}>>>"""


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENVELOPE).json(path, multiLine=True)


def flatten_pages(envelopes: DataFrame) -> DataFrame:
    """One row per study, in a `study` struct column."""
    return envelopes.select(F.explode("pages").alias("page")).select(F.explode("page.studies").alias("study"))


def normalize_studies(studies: DataFrame) -> DataFrame:
    """Flat records; studies without id or without a non-blank summary are dropped."""
    p = F.col("study.protocolSection")
    arms = p["armsInterventionsModule"]["interventions"]
    empty = F.array().cast("array<string>")
    flat = studies.select(
        filled(p["identificationModule"]["nctId"]).alias("nct_id"),
        F.coalesce(filled(p["identificationModule"]["briefTitle"]), F.lit("(no title)")).alias("title"),
        phase_labels(F.coalesce(p["designModule"]["phases"], empty)).alias("phases"),
        p["statusModule"]["overallStatus"].alias("status"),
        p["statusModule"]["lastUpdatePostDateStruct"]["date"].alias("last_update"),
        p["statusModule"]["primaryCompletionDateStruct"]["date"].alias("primary_completion"),
        p["statusModule"]["completionDateStruct"]["date"].alias("completion"),
        p["sponsorCollaboratorsModule"]["leadSponsor"]["name"].alias("sponsor"),
        F.coalesce(p["conditionsModule"]["conditions"], empty).alias("conditions"),
        named_items(F.coalesce(arms, F.array().cast(
            "array<struct<type:string,name:string,otherNames:array<string>>>"))).alias("interventions"),
        p["designModule"]["studyType"].alias("study_type"),
        F.trim(p["descriptionModule"]["briefSummary"]).alias("summary"),
    ).filter(F.col("nct_id").isNotNull() & (F.length("summary") > 0))
    return flat.select(
        uuid5(RECORDS, F.col("nct_id")).alias("id"), "*",
        F.transform("interventions", lambda i: i["name"]).alias("intervention_names"),
        study_text(F.col("conditions"), F.col("interventions"), F.col("study_type"), F.col("summary")).alias("document"),
        citation_url(F.col("nct_id")).alias("source_url"),
    )


def coverage(studies: DataFrame) -> DataFrame:
    """How many studies carry an id, a summary, conditions, interventions and a type."""
    p = F.col("study.protocolSection")
    has_id = filled(p["identificationModule"]["nctId"]).isNotNull()
    has_summary = F.coalesce(F.length(F.trim(p["descriptionModule"]["briefSummary"])), F.lit(0)) > 0
    usable = has_id & has_summary
    named = named_items(p["armsInterventionsModule"]["interventions"])
    return studies.agg(
        F.count_if(usable).alias("records"),
        F.count_if(has_id & ~has_summary).alias("skipped_no_summary"),
        F.count_if(usable & (F.size(present(p["conditionsModule"]["conditions"])) > 0)).alias("with_conditions"),
        F.count_if(usable & (F.size(named) > 0)).alias("with_interventions"),
        F.count_if(usable & filled(p["designModule"]["studyType"]).isNotNull()).alias("with_study_type"),
    )
