"""Joins and ranks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_SHARE = 1000  # a key is hot if it holds more than one row in this many, so there are fewer hot keys than this
RANK_SLICE = 2_000  # rows that one task ranks at a time


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, copies: str) -> DataFrame:
    """Left join of `rows` with `facts` {key, copies, ...}, where facts has each key once and `copies`
    says how many of the rows have it (at least 1).

    A key that holds more than a `HOT_SHARE`th of all rows gets its facts by broadcast: fewer than
    `HOT_SHARE` keys can be that frequent, whatever the size of the table. All other keys are too
    rare to burden one task and meet in an ordinary shuffle join.
    """
    total = facts.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    is_hot = F.col(copies) * HOT_SHARE > F.lit(total)
    values = [c for c in facts.columns if c not in (key, copies)]
    hot = facts.filter(is_hot).select(key, F.struct(*values).alias("_hot"))
    cold = facts.filter(~is_hot).select(key, F.struct(*values).alias("_cold"))
    seen = rows.join(F.broadcast(hot), key, "left")
    # Hot rows need no partner any more: a null key spreads them by chance over the shuffle's tasks.
    light = seen.filter(F.col("_hot").isNull()).join(cold, key, "left").select(*rows.columns, F.col("_cold").alias("_fact"))
    heavy = seen.filter(F.col("_hot").isNotNull()).select(*rows.columns, F.col("_hot").alias("_fact"))
    return heavy.unionByName(light).select(*rows.columns, *[F.col("_fact")[v].alias(v) for v in values])


def ranked(rows: DataFrame, key: str, order: list[Column], spread: Column, name: str = "rank") -> DataFrame:
    """`rows` with `name`, a number from 0 without gaps within each key.

    Each key is cut into slices by the hash of `spread`; slices are ranked on their own and start where
    the slices before them end, so a key of any size is ranked by many tasks. The number of slices
    follows the number of rows. Rows equal in `spread` and `order` may swap ranks, nothing else can.
    """
    slices = max(1, rows.count() // RANK_SLICE + 1)
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(slices)))
    sizes = cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order)) - 1
    return cut.withColumn("_inside", inside).join(starts, [key, "_slice"]).withColumn(
        name, F.col("_start") + F.col("_inside")).drop("_slice", "_inside", "_start")
