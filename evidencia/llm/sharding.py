"""Shards by extendible hashing.

Documents are hashed to `BITS` bits. A bucket is a prefix of those bits; a bucket over the byte limit is
split on its next bit and the others stay as they are, so shards end at different depths. The sizes are
summed for prefixes of a depth that follows the total (with map-side partial sums), all shallower levels
come from these sums, and only what is still over the limit goes on to deeper prefixes. The directory has
a row per shard; documents meet it by their prefix.

Documents with the same hash cannot be told apart by bits. If together they exceed the limit, their shard
gets numbered overflow pages of as many documents as surely fit. A single document over the limit
has a shard or page for itself.

Null and empty texts have 0 bytes; null ids hash like an empty id; repeated rows get the same prefix; an
empty table gives an empty result. Other columns of the input are not looked at; `write_shards` writes them with their
row. Rows equal in id are told apart by their place in the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencia.llm.keyed import join_by_key, ranked
from evidencia.session import table
from evidencia.sources.store import written

BITS = 48
LIMIT_BYTES = 16 << 20
QUERY_LIMIT = 256 << 10  # of the registered query: small enough that every table of documents splits
SLACK_BITS = 4  # levels below the average depth that are summed at once
STEP_BITS = 8  # levels added where that was not deep enough


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, BITS - depth)


def levels(cells: DataFrame, low: int, high: int) -> DataFrame:
    """cells {cell, bytes, docs, least, most} at depth `high` -> the nodes of depths `low` to `high` with the
    same sums, and `full`: over the limit although it holds different hashes."""
    depths = F.sequence(F.lit(low), F.lit(high))
    return cells.select("*", F.explode(depths).alias("depth")).groupBy(
        "depth", F.expr(f"shiftright(cell, {high} - depth)").alias("node")).agg(
        F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("least").alias("least"), F.max("most").alias("most"))


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """rows {bits, n_bytes} -> for each depth that was summed, the shards found there as
    {cell, copies, depth, bytes, most_bytes, docs, same}: each cell of that depth with the shard it belongs to."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit)))) + SLACK_BITS)
    pending, found = rows, []
    while True:
        cells = pending.groupBy(prefix(F.col("bits"), high).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("bits").alias("least"),
            F.max("bits").alias("most"))
        nodes = written(levels(written(cells, "cells"), low, high).withColumn(
            "full", (F.col("bytes") > limit) & (F.col("least") < F.col("most"))), "nodes")
        # A shard is a node that fits under a parent that does not; at the top level every node that fits.
        parents = nodes.filter("full").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
        below = nodes.filter("not full").withColumn("parent", F.shiftright("node", 1))
        shards = below.join(parents, ["depth", "parent"], "left_semi").unionByName(below.filter(F.col("depth") == low))
        width = F.expr(f"shiftleft(1L, {high} - depth)")
        first = F.expr(f"shiftleft(node, {high} - depth)")
        reach = shards.select("depth", "bytes", "docs", (F.col("least") == F.col("most")).alias("same"),
                              F.explode(F.sequence(first, first + width - 1)).alias("cell"))
        copies = nodes.filter(F.col("depth") == high).select(F.col("node").alias("cell"), F.col("docs").alias("copies"))
        found.append((high, written(copies.join(reach, "cell"), "directory")))
        open_nodes = nodes.filter("full").filter(F.col("depth") == high).select("node")
        if high == BITS or not open_nodes.take(1):
            return found
        pending = written(pending.withColumn("node", prefix(F.col("bits"), high)).join(open_nodes, "node", "left_semi").drop("node"), "pending")
        low, high = high + 1, min(BITS, high + STEP_BITS)


def sharded(docs: DataFrame, limit: int = LIMIT_BYTES, keep: bool = False) -> DataFrame:
    """docs {doc_id, text, ...} -> {doc_id, n_bytes, depth, shard (its bits), page, shard_bytes (all pages)}; with `keep` also
    `doc`, the whole row, which then moves with them."""
    whole_row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep else []
    rows = written(docs.select("doc_id", *whole_row, hash_bits(F.col("doc_id")).alias("bits"), F.coalesce(
        F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")), "hashed")
    placed, pending = None, rows
    shards = directory(rows, limit)
    for depth, facts in shards:
        keyed = pending.withColumn("cell", prefix(F.col("bits"), depth))
        met = join_by_key(keyed, facts, "cell", "copies").drop("cell")
        done = met.filter(F.col("depth").isNotNull())
        placed = done if placed is None else placed.unionByName(done)
        pending = met.filter(F.col("depth").isNull()).select(*rows.columns)
    crowded = F.col("same") & (F.col("bytes") > limit) & (F.col("docs") > 1)
    whole = placed.filter(~crowded).withColumn("page", F.lit(0).cast("bigint"))
    if any(facts.filter(crowded).take(1) for _, facts in shards):
        whole = whole.unionByName(overflow(placed.filter(crowded), limit))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr(f"lpad(bin(shiftright(bits, {BITS} - depth)), depth, '0')"))
    return whole.select("doc_id", "n_bytes", "depth", bits.alias("shard"), "page", F.col("bytes").alias("shard_bytes"),
                        *(["doc"] if keep else []))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Every row of docs {doc_id, text, ...}, as column `doc`, below `path` in the folder shard=<bits>/page=<n> that `sharded` gives it; the
    shard of a table that never splits is `all`. Rows of a page meet in one task, which holds at most the limit or one text."""
    placed = sharded(docs, limit, keep=True).withColumn("shard", F.when(F.col("shard") == "", "all").otherwise(F.concat(F.lit("b"), "shard")))
    placed.select("doc", "shard", "page").repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)


def overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of shards that bits cannot split, with `page`: as many documents a page as fit if all were as
    long as the longest."""
    numbered = written(rows.withColumn("at", F.monotonically_increasing_id()), "overflow")
    fits = numbered.groupBy("bits").agg(F.count(F.lit(1)).alias("copies"), F.greatest(
        F.lit(1), F.floor(F.lit(limit) / F.max("n_bytes"))).alias("fits"))
    placed = ranked(numbered, "bits", [F.asc("at")], F.col("at"))
    return join_by_key(placed, fits, "bits", "copies").withColumn(
        "page", F.floor(F.col("rank") / F.col("fits")).cast("bigint")).select(*rows.columns, "page")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_LIMIT)


ORACLE_SQL = f"""
with rows as (
  select doc_id, octet_length(encode(coalesce(text, '')))::bigint as n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {BITS // 4}))::bigint as bits
  from documents),
nodes as (
  select depth, bits >> ({BITS} - depth) as node, sum(n_bytes) as bytes, min(bits) = max(bits) as same
  from rows, (select unnest(range(0, {BITS + 1})) as depth) d group by all),
placed as (
  select doc_id, n_bytes, bits, min(depth) as depth, max_by(bytes, -depth) as bytes
  from rows join nodes on node = bits >> ({BITS} - depth) where bytes <= {QUERY_LIMIT} or same group by doc_id, n_bytes, bits)
select doc_id, n_bytes, depth::integer as depth, case when depth = 0 then '' else lpad(bin(bits >> ({BITS} - depth)), depth::integer, '0') end as shard,
  0::bigint as page, bytes::bigint as shard_bytes from placed"""
