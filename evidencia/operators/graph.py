"""The drug graph as node and edge tables, and lookups over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from evidencia.operators.matching import contains_join
from evidencia.operators.ranking import top_k

LOOKUP_LIMIT = 60


@dataclass
class Graph:
    """trials{trial, ...}, drugs{drug}, concepts{concept}, investigates{trial, drug}, mapped{drug, concept}."""

    trials: DataFrame
    drugs: DataFrame
    concepts: DataFrame
    investigates: DataFrame
    mapped: DataFrame
    occurrences: DataFrame


def build_graph(occurrences: DataFrame, version: str) -> Graph:
    """occurrences {trial, drug, concept or null, <version>}: one row per intervention as landed.

    Nodes and edges are distinct; a drug's concept is the one of its latest resolved occurrence.
    """
    resolved = occurrences.filter(F.col("concept").isNotNull())
    mapped = resolved.groupBy("drug").agg(F.max_by("concept", version).alias("concept"))
    return Graph(
        trials=occurrences.select("trial").distinct(),
        drugs=occurrences.select("drug").distinct(),
        concepts=mapped.select("concept").distinct(),
        investigates=occurrences.select("trial", "drug").distinct(),
        mapped=mapped,
        occurrences=occurrences,
    )


def edge_list(graph: Graph) -> DataFrame:
    """All edges in one table {edge, src, dst}."""
    a = graph.investigates.select(F.lit("INVESTIGATES").alias("edge"), F.col("trial").alias("src"), F.col("drug").alias("dst"))
    b = graph.mapped.select(F.lit("MAPPED_TO").alias("edge"), F.col("drug").alias("src"), F.col("concept").alias("dst"))
    return a.unionByName(b)


def graph_counts(graph: Graph) -> DataFrame:
    """True node and edge counts beside the number of occurrences processed."""
    parts = [("trials", graph.trials), ("drugs", graph.drugs), ("concepts", graph.concepts),
             ("investigates", graph.investigates), ("mapped", graph.mapped), ("occurrences", graph.occurrences)]
    counted = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        counted = one if counted is None else counted.unionByName(one)
    return counted


def concept_synonyms(concepts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Sorted distinct brand names once per distinct concept; concepts without any keep an empty list."""
    named = synonyms.select("concept", "brand").distinct().groupBy("concept").agg(
        F.array_sort(F.collect_list("brand")).alias("brand_names"))
    return concepts.select("concept").distinct().join(named, "concept", "left").withColumn(
        "brand_names", F.coalesce("brand_names", F.array().cast("array<string>")))


def canonical_drug(drugs: DataFrame, drug: str, synonyms: DataFrame) -> DataFrame:
    """Replace a brand by its concept, so brand and generic count as one drug."""
    names = synonyms.groupBy(F.lower("brand").alias("_brand")).agg(F.min("concept").alias("_concept"))
    return drugs.join(names, F.lower(F.trim(drug)) == F.col("_brand"), "left").withColumn(
        drug, F.coalesce("_concept", F.col(drug))).drop("_brand", "_concept")


def matched_drugs(graph: Graph, synonyms: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, drug, concept) by substring of the drug name, by concept name or by brand name.

    The concept is outer-joined before any test, so drugs without a concept stay findable.
    """
    pairs = graph.drugs.join(graph.mapped, "drug", "left")
    low = entities.select("entity").distinct().withColumn("_e", F.lower("entity"))
    by_name = contains_join(graph.drugs, "drug", entities, "entity").join(pairs, "drug")
    by_concept = pairs.join(low, F.lower("concept") == F.col("_e"))
    branded = pairs.join(synonyms.select("concept", F.lower("brand").alias("_e")).distinct(), "concept")
    by_brand = branded.join(low, "_e")
    columns = ["entity", "drug", "concept"]
    return by_name.select(columns).unionByName(by_concept.select(columns)).unionByName(by_brand.select(columns)).distinct()


def entity_lookup(graph: Graph, synonyms: DataFrame, entities: DataFrame, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Trials of every entity, in id order, at most `limit` (trial, matched drug) rows per entity."""
    # an entity can only reach the first `limit` trials of each of its drugs: cut before the join
    first = top_k(graph.investigates, ["drug"], [F.asc("trial")], limit, "_rank").drop("_rank")
    rows = matched_drugs(graph, synonyms, entities).join(first, "drug")
    return top_k(rows, ["entity"], [F.asc("trial"), F.asc("drug")], limit).withColumn("origin", F.lit("knowledge_graph"))


def link_by_either(nodes: DataFrame, name: str, products: DataFrame, product: str, first: str, second: str) -> DataFrame:
    """Distinct (name, product) edges where the name equals one column or the other, ignoring case.

    An OR of equalities would run as a nested loop; a union of two equi-joins does not.
    """
    low = nodes.select(name).distinct().withColumn("_low", F.lower(name))
    edges = [
        low.join(products.select(product, F.lower(c).alias("_low")), "_low").select(name, product)
        for c in (first, second)
    ]
    return edges[0].unionByName(edges[1]).distinct()


def drop_reclassified(drugs: DataFrame, other: str) -> DataFrame:
    """{drug, mechanism, ...}: rows under `other` go when the drug has a real class elsewhere."""
    real = drugs.filter(F.col("mechanism") != other).select(F.lower(F.trim("drug")).alias("_name")).distinct()
    named = drugs.withColumn("_name", F.lower(F.trim("drug")))
    kept = named.filter(F.col("mechanism") == other).join(real, "_name", "left_anti")
    return named.filter(F.col("mechanism") != other).unionByName(kept).drop("_name")


def attach_evidence(trial_names: DataFrame, found: DataFrame, name: str, trial: str, doc_id: str) -> DataFrame:
    """(trial, document, matches): documents that mention any of a trial's intervention names."""
    return trial_names.select(trial, name).distinct().join(found.select(doc_id, name).distinct(), name).groupBy(
        trial, doc_id).agg(F.count(F.lit(1)).alias("matches"))
