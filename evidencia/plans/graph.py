"""Graph, entity resolution and mention queries: orders are trials, part names drugs, brands concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencia.functions.tokens import WORD_PATTERN, matches
from evidencia.operators import exclusivity, graph, matching
from evidencia.plans.registry import Tables, query
from evidencia.sizing import spread

UNRESOLVED = "p_type = 'PROMO'"
OCCURRENCES = f"""
occ as (select 'NCT' || l_orderkey as trial, p_name as drug, case when not ({UNRESOLVED}) then p_brand end as concept, p_partkey as version
        from lineitem join part on p_partkey = l_partkey),
mapped as (select drug, arg_max(concept, version) as concept from occ where concept is not null group by drug),
edges as (select distinct trial, drug from occ)"""


def occurrences(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("drug"),
                          F.when(~F.expr(UNRESOLVED), F.col("p_brand")).alias("concept"))
    return t.lineitem.select("l_orderkey", "l_partkey").join(parts, "l_partkey").select(
        F.concat(F.lit("NCT"), F.col("l_orderkey").cast("string")).alias("trial"), "drug", "concept",
        F.col("l_partkey").alias("version"))


def drug_graph(t: Tables) -> graph.Graph:
    return graph.build_graph(occurrences(t), "version")


def synonyms(t: Tables) -> DataFrame:
    """Brand names of a concept: the types its parts are sold as."""
    return t.part.select(F.col("p_brand").alias("concept"), F.concat(F.lit("Trade "), "p_type").alias("brand")).distinct()


def entities(t: Tables) -> DataFrame:
    """Nouns of part names, concepts, trade names and some unknown names."""
    noun = t.part.select(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("entity"))
    concept = t.part.select(F.col("p_brand").alias("entity"))
    trade = t.part.select(F.concat(F.lit("trade "), F.lower("p_type")).alias("entity"))
    return noun.union(concept).union(trade).union(t.nation.select("n_name")).distinct()


LOOKUP = f"""
{OCCURRENCES},
syn as (select distinct p_brand as concept, 'Trade ' || p_type as brand from part),
ent as (select upper(split_part(p_name, ' ', 2)) as entity from part union select p_brand from part
        union select 'trade ' || lower(p_type) from part union select n_name from nation),
pairs as (select d.drug, m.concept from (select distinct drug from occ) d left join mapped m on m.drug = d.drug),
matched as (select distinct entity, drug, pairs.concept from ent, pairs
  where contains(lower(drug), lower(entity)) or lower(coalesce(concept, '')) = lower(entity)
     or exists (select 1 from syn where syn.concept = pairs.concept and lower(brand) = lower(entity))),
lookup as (select * from (select entity, trial, drug, concept, row_number() over (partition by entity order by trial, drug) as rank
  from matched join edges using (drug)) where rank <= 60)"""


@query(f"with {OCCURRENCES} select 'INVESTIGATES' as edge, trial as src, drug as dst from edges union all select 'MAPPED_TO', drug, concept from mapped")
def kg_edges(t: Tables) -> DataFrame:
    return graph.edge_list(drug_graph(t))


@query(f"""with {OCCURRENCES}
select 'trials' as what, count(distinct trial) as n from occ union all select 'drugs', count(distinct drug) from occ
union all select 'concepts', count(distinct concept) from mapped union all select 'investigates', count(*) from edges
union all select 'mapped', count(*) from mapped union all select 'occurrences', count(*) from occ""")
def kg_counts(t: Tables) -> DataFrame:
    return graph.graph_counts(drug_graph(t))


@query(f"with {LOOKUP} select entity, trial, drug, concept, rank::bigint as rank from lookup")
def entity_lookup(t: Tables) -> DataFrame:
    return graph.entity_lookup(drug_graph(t), synonyms(t), entities(t)).select(
        "entity", "trial", "drug", "concept", F.col("rank").cast("bigint").alias("rank"))


@query("""
select distinct name, p_partkey from (select p_name as name from part union select p_type from part) n
join part on lower(name) = lower(p_name) or lower(name) = lower(p_type)""")
def or_link(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_name").alias("name")).union(t.part.select("p_type")).distinct()
    return graph.link_by_either(nodes, "name", t.part, "p_partkey", "p_name", "p_type")


@query("select concept, array_to_string(list_sort(list(distinct brand)), '|') as brand_names from (select p_brand as concept, 'Trade ' || p_type as brand from part) group by concept")
def concept_synonyms(t: Tables) -> DataFrame:
    concepts = t.part.select(F.col("p_brand").alias("concept"))
    return graph.concept_synonyms(concepts, synonyms(t)).withColumn("brand_names", F.array_join("brand_names", "|"))


def misspelt(t: Tables) -> DataFrame:
    """Part names with one character dropped, or one repeated."""
    at = (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    cut = F.concat(F.substr("p_name", F.lit(1), at - 1), F.substr(F.col("p_name"), at + 1))
    twice = F.concat(F.substr("p_name", F.lit(1), at), F.substr(F.col("p_name"), at))
    return t.part.select(F.when(F.col("p_partkey") % 2 == 0, cut).otherwise(twice).alias("raw"))


GRAMS = "list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)))"
RESOLVED = f"""
raw as (select distinct case when p_partkey % 2 = 0 then substr(p_name, 1, pos - 1) || substr(p_name, pos + 1)
    else substr(p_name, 1, pos) || substr(p_name, pos) end as raw from (select *, (p_partkey % length(p_name) + 1)::int as pos from part)),
a as (select raw, {GRAMS} as g from (select raw, '^' || lower(trim(raw)) || '$' as x from raw)),
b as (select entry, {GRAMS} as g from (select p_name as entry, '^' || lower(trim(p_name)) || '$' as x from (select distinct p_name from part))),
s as (select raw, entry, floor(2.0::double * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) * 1000000.0 + 0.5) / 1000000.0 as score from a, b),
resolved as (select raw, entry, score from (select *, row_number() over (partition by raw order by score desc, entry) as rn from s where score >= 0.75) where rn = 1)"""


@query(f"with {RESOLVED} select raw, entry, score from resolved")
def resolve_names(t: Tables) -> DataFrame:
    dictionary = t.part.select(F.col("p_name").alias("entry"))
    return matching.resolve_names(misspelt(t), "raw", dictionary, "entry")


@query(f"with {RESOLVED} select count(*) as resolved, true as recall_reached, 0::bigint as wrong from resolved")
def resolve_names_lsh(t: Tables) -> DataFrame:
    """MinHash banding against the exact form: how many names resolve, whether 0.9 of them get the same entry, and how many get an
    entry below the threshold or one better than the best."""
    raw, dictionary = misspelt(t), t.part.select(F.col("p_name").alias("entry"))
    exact = matching.resolve_names(raw, "raw", dictionary, "entry")
    found = matching.resolve_names(raw, "raw", dictionary, "entry", lsh=True)
    both = exact.join(found.select("raw", F.col("entry").alias("other"), F.col("score").alias("other_score")), "raw", "full")
    same = F.count_if(F.col("entry") == F.col("other"))
    return both.agg(F.count("entry").alias("resolved"), (same >= 0.9 * F.count("entry")).alias("recall_reached"),
                    F.count_if(F.col("entry").isNull() | (F.col("other_score") > F.col("score"))).alias("wrong"))


SHINGLES = r"""list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))"""
MENTIONS = rf"""
names as (select item_id, unnest({SHINGLES}) as entry from (select item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from benchmark)),
found as (select doc_id, entry from (select doc_id, unnest({SHINGLES}) as entry from (
   select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from documents)) where entry in (select entry from names))"""


def item_names(t: Tables) -> DataFrame:
    """Three-word names of each benchmark item."""
    words = t.benchmark.select("item_id", matches(F.col("text"), WORD_PATTERN).alias("w"))
    return words.select("item_id", F.explode(matching.shingles(F.col("w"), [3])).alias("entry"))


def name_mentions(t: Tables) -> DataFrame:
    docs = spread(t.documents.select("doc_id", "text"))
    return matching.mentions(docs, "doc_id", "text", item_names(t), "entry", [3])


@query(f"with {MENTIONS} select doc_id, entry, 1.0::double as score from found")
def mention_edges(t: Tables) -> DataFrame:
    return name_mentions(t)


@query(f"with {MENTIONS} select item_id, doc_id, count(*) as matches from names join found using (entry) group by all")
def evidence_attach(t: Tables) -> DataFrame:
    return graph.attach_evidence(item_names(t), name_mentions(t), "entry", "item_id", "doc_id")


@query("""
with d as (select distinct case when p_partkey % 2 = 0 then upper(p_name) else p_name || ' ' end as drug,
  case when p_size > 48 then p_type else 'Other / Unspecified Mechanism' end as mechanism from part)
select drug, mechanism from d where mechanism <> 'Other / Unspecified Mechanism'
  or lower(trim(drug)) not in (select lower(trim(drug)) from d where mechanism <> 'Other / Unspecified Mechanism')""")
def drop_reclassified(t: Tables) -> DataFrame:
    other = "Other / Unspecified Mechanism"
    drugs = t.part.select(
        F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" "))).alias("drug"),
        F.when(F.col("p_size") > 48, F.col("p_type")).otherwise(other).alias("mechanism")).distinct()
    return graph.drop_reclassified(drugs, other)


LOE = """
pat as (select l_partkey, max(l_shipdate::date) as patent_expiry from lineitem where l_returnflag = 'R' group by 1),
exc as (select l_partkey, max(l_shipdate::date) as exclusivity_expiry from lineitem where l_returnflag <> 'R' and l_quantity > 45 group by 1),
loe as (select p_partkey, p_name, p_type, patent_expiry, exclusivity_expiry,
    greatest(patent_expiry, exclusivity_expiry) as loe_estimate
  from part left join pat on pat.l_partkey = p_partkey left join exc on exc.l_partkey = p_partkey where p_type <> 'PROMO')"""


def products(t: Tables) -> DataFrame:
    product = t.part.select("p_partkey", "p_name", "p_type",
                            F.when(F.col("p_type") == "PROMO", "A").otherwise("N").alias("appl_type"))
    dated = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_quantity",
                              F.to_date("l_shipdate").alias("expires"))
    return exclusivity.loe_estimate(product, dated.filter("l_returnflag = 'R'"),
                                    dated.filter("l_returnflag <> 'R' and l_quantity > 45"), ["p_partkey"])


@query(f"with {LOE} select * from loe")
def loe_estimate(t: Tables) -> DataFrame:
    return products(t).drop("appl_type")


@query(f"""with {LOE}, asked as (select distinct split_part(p_name, ' ', 1) as name from part union select lower(substr(p_type, 1, 4)) from part)
select name, p_partkey, loe_estimate, rank::bigint as rank from (select name, p_partkey, loe_estimate,
  row_number() over (partition by name order by loe_estimate desc nulls first, p_partkey) as rank
  from asked, loe where contains(lower(p_name), lower(name)) or contains(lower(p_type), lower(name))) where rank <= 25""")
def loe_lookup(t: Tables) -> DataFrame:
    asked = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).union(
        t.part.select(F.lower(F.substring("p_type", 1, 4)))).distinct()
    found = exclusivity.loe_lookup(products(t), "p_partkey", ["p_name", "p_type"], asked, "name")
    return found.select("name", "p_partkey", "loe_estimate", F.col("rank").cast("bigint").alias("rank"))
