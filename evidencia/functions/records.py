"""Shaping of nested registry, approval and adverse-event records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MISSING = "Not specified"


def filled(text: Column) -> Column:
    """NULL for a blank text."""
    return F.when(F.length(F.trim(text)) > 0, text)


def named_items(items: Column) -> Column:
    """Keep named {type, name} entries, trimmed; a missing type becomes UNKNOWN."""
    kept = F.filter(items, lambda i: F.length(F.trim(i["name"])) > 0)
    return F.transform(kept, lambda i: F.struct(
        F.trim(F.coalesce(F.when(i["type"] != "", i["type"]), F.lit("UNKNOWN"))).alias("type"),
        F.trim(i["name"]).alias("name")))


def drug_names(items: Column) -> Column:
    """Trimmed names of the DRUG entries."""
    drugs = F.filter(items, lambda i: (i["type"] == "DRUG") & (F.length(F.trim(i["name"])) > 0))
    return F.transform(drugs, lambda i: F.trim(i["name"]))


def labelled(pairs: list[tuple[str, Column]], missing: str = MISSING) -> Column:
    """`Label: value` lines with a default for missing or blank values."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.when(value != "", value), F.lit(missing)))
             for label, value in pairs]
    return F.concat_ws("\n", *lines)


def listed(values: Column) -> Column:
    return F.array_join(values, ", ")


def typed_list(items: Column) -> Column:
    return listed(F.transform(items, lambda i: F.concat(i["type"], F.lit(": "), i["name"])))


def study_text(conditions: Column, items: Column, study_type: Column, summary: Column) -> Column:
    """The text of a study that is embedded and searched."""
    return F.concat_ws("\n", labelled([
        ("Conditions", listed(conditions)), ("Interventions", typed_list(items)), ("Study Type", study_type),
    ]), F.concat(F.lit("Summary: "), summary))


def present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(present(values)))


# Which fields of each corpus make up its lexical text. A corpus not listed is searched densely only.
LEXICAL_FIELDS = {
    "trials": ["nct_id", "title", "sponsor", "conditions", "interventions", "study_type", "summary"],
    "literature": ["pmcid", "title", "journal", "text"],
    "letters": ["application_numbers", "company_name", "letter_type", "letter_date", "text"],
}


def lexical_text(corpus: str, columns: dict[str, Column]) -> Column | None:
    """The lexical text of a corpus, or None if it has no lexical index."""
    fields = LEXICAL_FIELDS.get(corpus)
    if fields is None:
        return None
    return F.concat_ws("\n", *[F.when(columns[f] != "", columns[f]) for f in fields if f in columns])
