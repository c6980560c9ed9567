"""URL rules as a sort-merge range join.

A host is written label by label from its end, each label closed by a mark: `a.example.net` becomes
`net|example|a|`. A rule for a host and all its subdomains is then an interval of such keys, from its
own key up to the key with the highest byte behind it, and intervals are nested or apart. Hosts and
interval ends are sorted together; the stack of open rules at a host is what the last interval end
before it has left: an opening end leaves its own rule on top of the rules it is nested in, a closing
end leaves the rules around it. So one `last value` along the order is the sweep.

The order is cut into ranges that are swept apart; what is open at the start of a range is what the
nearest range with an interval end before it has left. Only distinct hosts are sorted, so a host of any
number of pages is one row there, and gets its stack back through a join that broadcasts hot hosts.

Null urls and urls without `://` have an empty host and an empty path; no rule fits them and they are
allowed. A rule whose host is null or empty fits nothing; repeated rules count once; repeated pages are
judged alike. Of the rules that fit, the longest (host and path together) wins, then the longer host, then
`block`. Other columns of the pages pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evidencia.llm.keyed import join_by_key
from evidencia.session import table
from evidencia.sources.store import written

MARK = "\x01"
HIGHEST = b"\xff"  # above every byte of UTF-8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), MARK), F.lit(MARK)), "UTF-8")


def stacks(rules: DataFrame) -> DataFrame:
    """rules {host, path, verdict} -> {key, stack}: each rule host with its own rules and all rules it is nested in."""
    own = rules.filter(F.length("host") > 0).distinct().groupBy("host").agg(
        F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    labels = F.split("host", r"\.")
    around = own.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(
        F.slice(labels, F.size(labels) - k + 1, k), "."))).alias("outer"))
    return around.join(own.select(F.col("host").alias("outer"), "own"), "outer").groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("stack")).select(host_key(F.col("host")).alias("key"), "host", "stack")


def sweep(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts {host, ...} with `stack`, the rules whose interval holds the host; null where there is none."""
    held = stacks(rules)
    outside = held.select(F.col("host").alias("_host"), F.explode("stack").alias("_rule"), "stack")
    left = outside.groupBy("_host").agg(F.collect_list(F.when(F.col("_rule.host") != F.col("_host"), F.col("_rule"))).alias("rest"))
    opens = held.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.col("stack").alias("leaves"))
    closes = held.join(left, held["host"] == left["_host"]).select(
        F.concat("key", F.lit(HIGHEST)).alias("key"), F.lit(2).alias("kind"), F.lit(None).cast("string").alias("host"),
        F.col("rest").alias("leaves"))
    asked = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host",
                         F.lit(None).cast(held.schema["stack"].dataType).alias("leaves"))
    line = written(asked.unionByName(opens).unionByName(closes).repartitionByRange("key", "kind").withColumn(
        "range", F.spark_partition_id()), "sweep")
    along = Window.partitionBy("range").orderBy("key", "kind")
    swept = line.withColumn("stack", F.last("leaves", ignorenulls=True).over(along))
    ends = line.filter("kind <> 1").groupBy("range").agg(F.max_by("leaves", F.struct("key", "kind")).alias("leaves"))
    ranges = line.select("range").distinct().join(ends, "range", "left")
    carried = ranges.select("range", F.last("leaves", ignorenulls=True).over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    # One row per range: as many as the shuffle has partitions.
    return swept.filter("kind = 1").join(F.broadcast(carried), "range").select(
        "host", F.coalesce("stack", "carried").alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict; columns of these names are replaced."""
    result = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in result]
    parts = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = parts.groupBy("host").agg(F.count(F.lit(1)).alias("copies"))
    open_rules = sweep(hosts.filter("host <> ''"), rules)
    facts = hosts.join(open_rules, "host", "left")
    best = F.array_max(F.transform(
        F.filter(F.coalesce("stack", F.array().cast(facts.schema["stack"].dataType)), lambda r: F.startswith(F.col("path"), r["path"])),
        lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("inner"),
                           r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    return join_by_key(parts, facts, "host", "copies").withColumn("_best", best).select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_best")["rule"].alias("rule"),
        F.coalesce(F.col("_best")["verdict"], F.lit("allow")).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLE_SQL = rf"""
with rules(rule_host, rule_path, decision) as (values {_RULES}),
parts as (
  select row_number() over () as id, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
fits as (
  select id, rule_host || rule_path as rule, decision,
    row_number() over (partition by id order by length(rule_host || rule_path) desc, length(rule_host) desc, decision desc) as place
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(decision, 'allow') as verdict
from parts left join (select * from fits where place = 1) using (id)"""
