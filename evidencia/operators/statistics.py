"""Registry statistics: a library of statements over the tables of a trial registry.

Tables: studies {nct_id, overall_status, phase, enrollment, start_date}, sponsors {nct_id, name}, conditions {nct_id, name},
interventions {nct_id, name}, facilities {nct_id, facility, country}; a study has one sponsor row per lead sponsor and any number of the
others. Values are bound to named parameters, never pasted into the text, and names are matched as literal parts of a name, so `%` and `_`
in them mean themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ESCAPE = "!"
TOP = 50

STATEMENTS = {
    "top_sponsors": f"""
select p.name as sponsor, count(*) as studies, count(distinct s.phase) as phases
from {{studies}} s join {{sponsors}} p on p.nct_id = s.nct_id
where :condition is null or s.nct_id in (select nct_id from {{conditions}} where lower(name) like :condition escape '{ESCAPE}')
group by p.name order by studies desc, sponsor limit :top""",
    "phase_year": f"""
select phase, cast(extract(year from start_date) as bigint) as started, count(*) as studies
from {{studies}} s
where :condition is null or nct_id in (select nct_id from {{conditions}} where lower(name) like :condition escape '{ESCAPE}')
group by phase, cast(extract(year from start_date) as bigint)""",
    "average_enrollment": """
select overall_status as status, count(*) as studies,
  floor(cast(sum(cast(enrollment as decimal(18,2))) as double) / count(enrollment) * 1e2 + 5e-1) / 1e2 as avg_enrollment
from {studies} where :phase is null or phase = :phase group by overall_status""",
    "country_counts": """
select country, count(distinct facility) as facilities, count(*) as study_sites
from {facilities} where :country is null or lower(country) = lower(:country) group by country""",
    "intervention_studies": f"""
select i.name as intervention, count(distinct i.nct_id) as studies
from {{interventions}} i where lower(i.name) like :name escape '{ESCAPE}'
group by i.name order by studies desc, intervention limit :top""",
}
# The parameters of each statement with their defaults; a condition or name is a part of a name.
DEFAULTS = {
    "top_sponsors": {"condition": None, "top": TOP}, "phase_year": {"condition": None}, "average_enrollment": {"phase": None},
    "country_counts": {"country": None}, "intervention_studies": {"name": "", "top": TOP},
}
PARTS = ("condition", "name")


def part_of(text: str) -> str:
    """A LIKE pattern for names that contain `text`, ignoring case."""
    escaped = "".join(ESCAPE + c if c in ("%", "_", ESCAPE) else c for c in text.lower())
    return f"%{escaped}%"


def statistic(statement: str, tables: dict[str, DataFrame], /, **values) -> DataFrame:
    """A statement of the library over `tables`. An unknown statement or parameter is refused."""
    if statement not in STATEMENTS:
        raise ValueError(f"no statement {statement}; there are {', '.join(sorted(STATEMENTS))}")
    unknown = set(values) - set(DEFAULTS[statement])
    if unknown:
        raise ValueError(f"{statement} has no parameter {', '.join(sorted(unknown))}")
    bound = {**DEFAULTS[statement], **values}
    used = {t: df for t, df in tables.items() if "{" + t + "}" in STATEMENTS[statement]}
    spark = next(iter(used.values())).sparkSession
    return spark.sql(STATEMENTS[statement], {k: part_of(v) if k in PARTS and v is not None else v for k, v in bound.items()}, **used)
