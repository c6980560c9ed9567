"""Size checks that decide between a broadcast and a salted shuffle join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
SALTS = 32
ROWS_PER_TASK = 500_000  # short rows that one task sorts and counts


def measure(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[int, int]:
    """(rows, bytes) of `df`, counted on the data itself and no further than `rows` + 1 rows."""
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = (
        df.limit(rows + 1).select(width.alias("w"))
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    )
    return n, total


def is_small(df: DataFrame, copies: int = 1) -> bool:
    """May `df`, repeated `copies` times, be broadcast?"""
    n, total = measure(df)
    return n * copies <= BROADCAST_ROWS and total * copies <= BROADCAST_BYTES


def join_small(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner",
               spread: Column | None = None, small: bool | None = None) -> DataFrame:
    """Join `big` to `side`; broadcast `side` when measured small, else a salted shuffle join.

    In the shuffle form every key of `big` is spread over `SALTS` tasks by the hash of `spread`
    and `side` is repeated once per salt, so a key that holds a third of `big` is still split.
    `how` may be inner, left, left_semi or left_anti.
    """
    if small is None:
        small = is_small(side)
    if small:
        return big.join(F.broadcast(side), on, how)
    key = spread if spread is not None else F.monotonically_increasing_id()
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than there are cores (few or unsplit files).

    Inputs with enough partitions, the normal case on a cluster, pass through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def parts_for(df: DataFrame, weight: Column, per_task: int) -> int:
    """How many tasks hold `df` with about `per_task` of the summed `weight` each, and no fewer than there are cores."""
    total = df.agg(F.coalesce(F.sum(weight.cast("bigint")), F.lit(0).cast("bigint"))).first()[0]
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // per_task))
