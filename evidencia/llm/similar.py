"""Near duplicates by a size-aware heavy-light join on word shingles.

Two documents link if their sets of shingles overlap in three quarters of their union. Linked sets of n
and m shingles share at least three quarters of the larger one, so in any common order of the shingles

* each has one of the shared ones among its first n - ceil(3n/4) + 1 (its prefix), and
* two of the shared ones among its first n - ceil(3n/4) + 2.

Small sets enumerate the pairs (the subsets of fixed size 2) of the longer prefix and meet other small sets
that have the same pair: selective, but quadratic in the size. Large sets scan the inverted lists of the
shingles in their prefix, in which small sets stand too as far as their size can link to a large one. Where small
ends is chosen by cost, from how many sets there are of each size and how long lists are.

A key that is the first one shared leaves room for no more shared shingles than come behind it in either set, which
rules out most pairs by their places in the list alone.

The common order puts frequent shingles last. Their frequencies are added up over all documents from
what repeats within each batch of documents, which finds every shingle that is frequent at scale; the
order decides about speed only, never about results. Keys that stay frequent, as in large groups of near
copies, are spread over tasks instead of listed in one, so no task holds an unbounded list.

Documents with equal sets are one class from the start. The members of each list are compared with two of them,
not with each other: the one whose set has the key nearest to its front, which in a group of near copies is the text
they were made from, and one more. What that links is contracted to components, and only lists that still touch several
components are compared further. Where that would be many comparisons for each of their entries, their members outside the
largest component first try members of it, one each round, until a round links nothing; what is then still open is compared in
full, all members outside the largest component of the list with all members of other components. So groups of copies cost
a few times as many comparisons as they have members, and no link between components is missed. A sketch of each set first
rules out pairs that cannot overlap enough. Comparisons of the others read the texts of both sides again, grouped by one side
and salted if that side has many partners.

A text without words, null or empty, has an empty set and links with nothing. Repeated rows are in one class. Null
ids take part and are ignored where the smallest id is sought. An empty table gives an empty result. Sets
are named by 64-bit digests and shingles compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidencia.llm.components import components
from evidencia.llm.keyed import join_by_key
from evidencia.llm.shingles import Shingler, digest, mix
from evidencia.session import ship_package, table
from evidencia.sources.store import written

MAX_SMALL = 24  # sizes up to here may be small
SIZES = 64  # set sizes counted one by one for the choice
FREQUENT = 500_000  # shingles whose frequency the order knows, the most frequent first
FREQUENT_FROM = 3
HOT_FROM = 64  # keys estimated at least this frequent are spread, not listed in one bucket
COMPARISON = 100.0  # what a comparison costs in keys
GROUPS = 256  # counters of a sketch
BROADCAST_IDS = 200_000  # documents fetched by broadcast, about 40 bytes each; more are fetched by a shuffle join
BUCKET_KEYS = 500_000  # list entries per bucket
SLICE_ROWS = 2_000  # documents whose sets are held at a time
SALT_PARTNERS = 500  # comparisons of one side per task share
TURNS = 8  # rounds with pivots at most
ROUND_FROM = 16  # comparisons in full for each entry of an open list, from which a round with pivots comes before

_PAIR = np.uint64(0xD6E8FEB86659FD93)


def overlap(n: int) -> int:
    """How many shingles a linked partner shares at least with a set of n."""
    return (3 * n + 3) // 4


def prefix(n: int, k: int) -> int:
    return min(n, n - overlap(n) + k)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= 75 * (len(a) + len(b) - shared)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_ROWS."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def sketch(found: np.ndarray) -> bytes:
    """How many shingles fall into each of GROUPS groups, at most 255. The sum of differences of two sketches is
    at most the number of shingles that only one of the sets has."""
    counts = np.bincount((found & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def small_limit(counts: dict[int, int], larger: int, list_cost: float) -> int:
    """The size up to which sets enumerate pairs. counts: sets of each size up to SIZES; larger: all others'
    prefix entries; list_cost: what an inverted list entry costs, an enumerated pair costs 1."""
    def cost(limit: int) -> float:
        pairs = sum(n * prefix(s, 2) * (prefix(s, 2) - 1) / 2 for s, n in counts.items() if 2 <= s <= limit)
        entries = sum(n * prefix(s, 1) for s, n in counts.items() if s >= overlap(limit + 1))
        return pairs + (entries + larger) * list_cost

    return min(range(MAX_SMALL + 1), key=lambda limit: (cost(limit), limit))


def profiled(docs: DataFrame) -> DataFrame:
    """docs {doc_id, mark, text} -> {doc_id, mark, n, node, sketch} per document, and {shingle, times} rows (n null) for what
    repeats within a batch, equal sets counted once."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in sliced(batches):
            sizes, nodes, sketches, seen, every = [], [], [], set(), []
            for found in shingler.sets(batch.column(2).cast(pa.binary()).to_pylist()):
                sizes.append(len(found))
                nodes.append(digest(found) if len(found) else None)
                sketches.append(sketch(found))
                if len(found) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    every.append(found)
            shingle, times = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64),) * 2
            again = times > 1
            k, none = int(again.sum()), batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch.column(0), pa.nulls(k, batch.column(0).type)]),
                pa.concat_arrays([batch.column(1), pa.nulls(k, pa.int64())]),
                pa.array([*sizes, *[None] * k], pa.int64()), pa.array([*nodes, *[None] * k], pa.int64()),
                pa.array([*sketches, *[None] * k], pa.binary()),
                pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(shingle[again].view(np.int64), pa.int64())]),
                pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(times[again].astype(np.int64), pa.int64())]),
            ], ["doc_id", "mark", "n", "node", "sketch", "shingle", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "mark", "text").mapInArrow(
        run, f"doc_id {kind}, mark bigint, n bigint, node bigint, sketch binary, shingle bigint, times bigint")


def posted(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], small: int, buckets: int) -> DataFrame:
    """The keys of every set, packed by bucket: {bucket, spread, keys, owners, rests, nodes, sizes}; owners point into nodes
    and sizes, and `spread` says that a key's entries lie in several buckets."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    both = overlap(small + 1)

    def keys_of(found: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of one set, how frequent each is estimated to be, and the most shingles that can still be
        shared if it is the first key shared."""
        if times.any():
            order = np.lexsort((found, times))
            found, times = found[order], times[order]
        n, keys, often, rest = len(found), [], [], []
        if n >= both:
            keys.append(found[:prefix(n, 1)])
            often.append(times[:prefix(n, 1)])
            rest.append(n - np.arange(prefix(n, 1)))
        if 2 <= n <= small:
            first, second = np.array(list(combinations(range(prefix(n, 2)), 2))).T
            keys.append(mix(found[np.minimum(first, second)] * _PAIR + mix(found[np.maximum(first, second)])))
            often.append(np.minimum(times[first], times[second]))
            rest.append(n - second + 1)
        return tuple(map(np.concatenate, (keys, often, rest))) if keys else (found[:0], times[:0], times[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        known, counts = shared.value
        for batch in sliced(batches):
            nodes, sizes, keys, owners, often, rests = [], [], [], [], [], []
            seen = set()
            for found in shingler.sets(batch.column(0).cast(pa.binary()).to_pylist()):
                node = digest(found) if len(found) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                times = np.where(known[at] == found, counts[at], 0) if len(known) else np.zeros(len(found), np.int64)
                own, many, rest = keys_of(found, times)
                keys.append(own), often.append(many), rests.append(rest)
                owners.append(np.full(len(own), len(nodes), np.uint32))
                nodes.append(node), sizes.append(len(found))
            if not nodes:
                continue
            key, many, owner, rest = np.concatenate(keys), np.concatenate(often), np.concatenate(owners), np.concatenate(rests)
            node, size = np.array(nodes, np.int64), np.array(sizes, np.int64)
            # A frequent key would fill one bucket: its entries are dealt by key and set over buckets of their own.
            bucket = np.where(many >= HOT_FROM, np.uint64(buckets) + mix(key ^ mix(node[owner].view(np.uint64))) % np.uint64(buckets),
                              key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, owner, bucket, rest = key[order], owner[order], bucket[order], rest[order].astype(np.uint32)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for begin, end in zip(cuts, [*cuts[1:], len(bucket)]):
                used, local = np.unique(owner[begin:end], return_inverse=True)
                rows.append((int(bucket[begin]), bool(bucket[begin] >= buckets), key[begin:end].tobytes(), local.astype(np.uint32).tobytes(),
                             rest[begin:end].tobytes(), node[used].tobytes(), size[used].astype(np.uint32).tobytes()))
            columns = list(zip(*rows)) or [[]] * 7
            types = [pa.int64(), pa.bool_(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["bucket", "spread", "keys", "owners", "rests", "nodes", "sizes"])

    return docs.select("text").mapInArrow(run, "bucket bigint, spread boolean, keys binary, owners binary, rests binary, nodes binary, sizes binary")


def met(batch: pa.Table) -> pa.Table:
    """The entries {key, node, n, rest} of one bucket whose key several sets have and that may link by it; of keys with
    the same entries one is enough. Of spread keys all entries."""
    keys, nodes, sizes, rests = [], [], [], []
    columns = [batch.column(c) for c in ("keys", "owners", "rests", "nodes", "sizes")]
    for k in range(batch.num_rows):
        key, owner, rest, node, size = (np.frombuffer(c[k].as_buffer(), t) for c, t in zip(
            columns, (np.uint64, np.uint32, np.uint32, np.int64, np.uint32)))
        keys.append(key), nodes.append(node[owner]), sizes.append(size[owner]), rests.append(rest)
    key, node, size, rest = (np.concatenate(x) for x in (keys, nodes, sizes, rests))
    size, rest = size.astype(np.int64), rest.astype(np.int64)
    order = np.lexsort((node, key))
    key, node, size, rest = key[order], node[order], size[order], rest[order]
    stays = np.ones(len(key), bool)
    stays[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, size, rest = key[stays], node[stays], size[stays], rest[stays]
    if not batch.column("spread")[0].as_py():
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(begin, len(key)))
        names = np.add.reduceat(mix(mix(node.view(np.uint64)) + rest.astype(np.uint64)), begin)
        near = np.maximum.reduceat(7 * rest >= 6 * size, begin)
        several = np.flatnonzero((length > 1) & near)
        _, once = np.unique(np.stack([names[several], length[several].astype(np.uint64)], 1), axis=0, return_index=True)
        chosen = np.zeros(len(begin), bool)
        chosen[several[once]] = True
        stays = np.repeat(chosen, length)
        key, node, size, rest = key[stays], node[stays], size[stays], rest[stays]
    return pa.table({"key": pa.array(key.view(np.int64)), "node": pa.array(node), "n": pa.array(size), "rest": pa.array(rest)})


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs {a, b} whose sketches {node, n, sketch} leave room for enough overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS).astype(np.int16)
                           for c in ("left", "right"))
            total = batch.column("total").to_numpy()
            shared = (total - np.abs(left - right).sum(1)) // 2
            yield batch.select(["a", "b"]).filter(pa.array(100 * shared >= 75 * (total - shared)))

    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("left"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), "left", "right").mapInArrow(
        run, "a bigint, b bigint")


def fetched(rows: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The text of one document for each node of the pairs: {node, text}."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(classes.join(nodes, "node", "left_semi").select(
        "node", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    found = rows.join(side, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    return written(found.select("node", "text"), "texts").dropDuplicates(["node"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs {a, b} of nodes that link. texts {node, text} has one row per node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, centre, mine = Shingler(), None, None
        for batch in sliced(batches):
            a, b = [], []
            sets = shingler.sets(batch.column("text").cast(pa.binary()).to_pylist())
            for side, node, found in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), sets):
                if node is None:  # the centre comes before its partners
                    centre, mine = side, found
                elif centre == side and linked(found, mine):
                    a.append(node), b.append(side)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    many = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("copies")), "centres").withColumn(
        "shares", F.ceil(F.col("copies") / SALT_PARTNERS))
    spread = join_by_key(pairs, many, "b", "copies").withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")))
    partners = spread.join(texts.select(F.col("node").alias("a"), "text"), "a").select("b", "share", "a", "text")
    centres = many.join(texts.select(F.col("node").alias("b"), "text"), "b").select(
        "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), F.lit(None).cast("bigint").alias("a"), "text")
    ship_package(pairs.sparkSession)
    return partners.unionByName(centres).repartition("b", "share").sortWithinPartitions(
        "b", "share", F.asc_nulls_first("a")).mapInArrow(run, "a bigint, b bigint")


def room(n, rest, other_n, other_rest):
    """May two entries of a list belong to linked sets that share this key first? They need 3/7 of both sizes."""
    return F.least(rest, other_rest) * 7 >= (F.col(n) + F.col(other_n)) * 3


# Of two entries with room one is near its set's front: of two that are not, each would have to be of the smaller set.
NEAR = "7 * rest >= 6 * n"


def candidates(lists: DataFrame) -> DataFrame:
    """lists {key, node, n, rest} -> pairs {a, b} of each member with two near members: the one whose set has this key nearest
    to its front, and the one of the smallest name. In a group of near copies the first is the text that the others were
    made from, as shingles of their own stand in front of the shared ones in all others."""
    entry = F.struct("node", "n", "rest")
    ends = lists.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.when(F.expr(NEAR), entry)).alias("low"),
                                    F.max_by(entry, F.when(F.expr(NEAR), F.struct(F.col("rest") / F.col("n"), "node"))).alias(
                                        "front")).filter("copies > 1 and low is not null")
    with_ends = join_by_key(lists, ends, "key", "copies").filter(F.col("low").isNotNull())
    return with_ends.select("node", "n", "rest", F.explode(F.array("low", "front")).alias("end")).select("node", "n", "rest", F.col("end.node").alias("other"),
                     F.col("end.n").alias("other_n"), F.col("end.rest").alias("other_rest")).filter(
        (F.col("node") != F.col("other")) & room("n", "rest", "other_n", "other_rest")).select(
        F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def still_open(lists: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Entries of the lists that touch several components {node, label} and have a near member, with {label, near, copies, outside} and
    the `main` label of the list, its component with most members there, and a `pivot` of that one, another one each turn."""
    # A node has as many entries as its set has keys, so no label is hot here.
    entries = lists.select("key", "node", "n", "rest")
    marked = written(entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("near", F.expr(NEAR)), "marked")
    place = F.xxhash64("node", F.lit(turn))
    parts = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("part"), F.max("near").alias("near"), F.min_by(
        F.struct("node", "n", "rest", "near"), F.struct(~F.col("near"), place)).alias("pivot"))
    several = written(parts.groupBy("key").agg(
        F.sum("part").alias("copies"), F.count(F.lit(1)).alias("parts"), F.max("near").alias("any_near"),
        F.max_by(F.struct("label", "pivot", "part"), F.struct("part", "label")).alias("top")).filter("parts > 1 and any_near").select(
        "key", "copies", F.col("copies").alias("_copies"), (F.col("copies") - F.col("top.part")).alias("outside"),
        F.col("top.label").alias("main"), F.col("top.pivot").alias("pivot")), "several")
    return written(join_by_key(marked, several, "key", "copies").filter(F.col("main").isNotNull()).withColumnRenamed(
        "_copies", "copies"), "open")


def with_pivots(members: DataFrame) -> DataFrame:
    """Pairs {a, b} of the members outside the largest component of a list with that component's pivot."""
    other = F.col("pivot")
    return members.filter("label <> main and (near or pivot.near)").select(
        "node", "n", "rest", other["node"].alias("other"), other["n"].alias("other_n"), other["rest"].alias("other_rest")).filter(
        room("n", "rest", "other_n", "other_rest")).select(
        F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def crossing(members: DataFrame) -> DataFrame:
    """Pairs {a, b} with room within a list and between components, for the lists of `still_open`.

    One side is outside the largest component of its list; near entries meet all members, others the near members. Long lists are cut
    into shares.
    """
    shares = F.ceil(F.col("copies") / SALT_PARTNERS)
    inside = members.withColumn("share", F.pmod(F.xxhash64("node"), shares))
    outside = members.filter(F.col("label") != F.col("main")).select(
        "key", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("share"), F.col("node").alias("other"),
        F.col("n").alias("other_n"), F.col("rest").alias("other_rest"), F.col("label").alias("other_label"), F.col("near").alias("other_near"))
    apart = (F.col("label") != F.col("other_label")) & room("n", "rest", "other_n", "other_rest")
    met_near = inside.join(outside.filter("other_near"), ["key", "share"]).filter(apart)
    met_far = inside.filter("near").join(outside.filter("not other_near"), ["key", "share"]).filter(apart)
    return met_near.unionByName(met_far).select(
        F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def worth_a_round(members: DataFrame) -> bool:
    """Would comparing the open lists in full cost many comparisons for each entry? Either way no link is lost."""
    entries, pairs = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("outside"), F.lit(0))).first()
    return pairs > ROUND_FROM * entries


def contracted(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Components {node, label} after the links {a, b}: those found so far are nodes of a smaller graph."""
    name = labels.select("node", "label")
    over = components(more.join(name.toDF("a", "at"), "a", "left").join(name.toDF("b", "bt"), "b", "left").select(
        F.coalesce("at", "a").alias("a"), F.coalesce("bt", "b").alias("b")))
    new = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return written(labels.unionByName(new).join(over.toDF("label", "top"), "label", "left").select(
        "node", F.coalesce("top", "label").alias("label")), "labels")


def grouped(docs: DataFrame) -> DataFrame:
    """docs {doc_id, text, ...} -> {doc_id, mark, n_shingles, component_id, group}; mark is a hash of the text, group
    names the component (null without words), also where ids are null or repeat."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    profile = written(profiled(rows), "profile")
    sets = profile.filter("n is not null").select("doc_id", "mark", "n", "node")
    often = profile.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    # At most FREQUENT rows of two numbers reach the driver; they order the keys and nothing else.
    top = often.filter(F.col("times") >= FREQUENT_FROM).orderBy(F.desc("times"), "shingle").limit(FREQUENT).toPandas()
    order = np.argsort(top["shingle"].to_numpy(np.int64).view(np.uint64))
    frequent = (top["shingle"].to_numpy(np.int64).view(np.uint64)[order], top["times"].to_numpy(np.int64)[order])
    whole = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > SIZES, F.col("n") - F.ceil(
        F.col("n") * 0.75) + 1)), F.lit(0))).first()
    counts = {r[0]: r[1] for r in sets.filter(F.col("n").between(1, SIZES)).groupBy("n").count().collect()}
    repeats = profile.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    small = small_limit(counts, whole[1], 1 + COMPARISON * repeats / max(1, whole[0]))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole[0] // 3 // BUCKET_KEYS)

    keyed = posted(rows, frequent, small, buckets)
    lists = written(keyed.groupBy("bucket").applyInArrow(met, "key bigint, node bigint, n bigint, rest bigint"), "lists")
    classes = written(sets.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "mark")).alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    # One document stands for each class that shares a key; equal sets have equal sketches.
    firsts = classes.join(lists.select("node").distinct(), "node", "left_semi").select("node", "first.*")
    sketches = written(profile.filter("node is not null").select("doc_id", "mark", "node", "n", "sketch").join(
        firsts.toDF("_node", "_id", "_mark"), (F.col("node") == F.col("_node")) & (F.col("mark") == F.col("_mark")) & F.col(
            "doc_id").eqNullSafe(F.col("_id"))).select("node", "n", "sketch").dropDuplicates(["node"]), "sketches")

    def links_of(pairs: DataFrame, name: str) -> DataFrame:
        near = written(possible(pairs, sketches), f"{name}-pairs")
        return written(compared(near, fetched(rows, near, classes)), name)

    labels = components(links_of(candidates(lists), "links"))
    # Members outside the largest component of a list try one of its members after the other, as long as that links more.
    members = still_open(lists, labels, 0)
    for turn in range(1, TURNS):
        if not worth_a_round(members):
            break
        more = links_of(with_pivots(members), "pivot-links")
        if not more.take(1):
            break
        labels = contracted(labels, more)
        members = still_open(members, labels, turn)
    more = links_of(crossing(members), "crossing-links")
    if more.take(1):
        labels = contracted(labels, more)
    labelled = written(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    smallest = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("copies"), F.min("first_id").alias("component_id"))
    facts = join_by_key(labelled.withColumnRenamed("copies", "rows"), smallest, "label", "copies").select(
        "node", F.col("rows").alias("copies"), "component_id", F.col("label").alias("group"))
    placed = join_by_key(sets, facts, "node", "copies")
    return placed.select("doc_id", "mark", F.col("n").alias("n_shingles"),
                         F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group: of the rows with the group's smallest id one, and all rows without words. Columns stay."""
    found = written(grouped(docs), "groups")
    # Rows of one id may differ in text, and null ids cannot be told apart: the smallest mark decides.
    stays = found.filter("n_shingles > 0").groupBy("group").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("known"), F.min(
        F.struct("doc_id", "mark")).alias("any")).select(F.coalesce("known", "any").alias("keep")).select("keep.*")
    none = found.filter("n_shingles = 0").select("doc_id", "mark").distinct()
    wanted = stays.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.lit(True).alias("_one")).unionByName(
        none.select("doc_id", "mark", F.lit(False)).toDF("_id", "_mark", "_one"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = packed.withColumn("_text", F.xxhash64(F.coalesce(F.col("doc.text"), F.lit(""))))
    kept = rows.join(wanted.hint("shuffle_hash"), F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_mark")))
    if found.groupBy("doc_id", "mark").count().filter("count > 1").take(1):
        once = kept.filter("_one").dropDuplicates(["_id", "_mark"])
        kept = once.unionByName(kept.filter("not _one"))
    return kept.select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
grams as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i + 4], ' ') else array_to_string(w, ' ') end as gram
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from words where len(w) > 0) x),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from grams a join grams b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on reach.b = links.a)
select documents.doc_id, coalesce(n, 0)::bigint as n_shingles, (select min(b) from reach where reach.a = documents.doc_id) as component_id
from documents left join sizes using (doc_id)"""
