"""Ordered computations over groups of any size.

A plain window would pull a whole group into one task. Here every group is cut into slices along
its order (a day, a block of ids, ...): windows run inside (group, slice), one summary row per slice
carries totals or the last row over to the next slice. `slice_by` must not decrease along `order`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(df: DataFrame, group: list[str], order: list[str], slice_by: Column, value: Column,
                out: str, total: str | None = None) -> DataFrame:
    """Sum of `value` over the group up to and including each row; optionally the group's total."""
    sliced = df.withColumn("_slice", slice_by).withColumn("_value", value)
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    slices = sliced.groupBy(*group, "_slice").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        F.sum("_sum").over(Window.partitionBy(*group)).alias("_total"))
    joined = sliced.withColumn("_inside", F.sum("_value").over(inside)).join(
        carried, _same(sliced, carried, group), "inner")
    result = joined.withColumn(out, F.col("_before") + F.col("_inside"))
    if total:
        result = result.withColumn(total, F.col("_total"))
    return result.select(*df.columns, out, *([total] if total else []))


def previous_row(df: DataFrame, group: list[str], order: list[str], slice_by: Column,
                 columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Values of the preceding row of the group (NULL for the first row)."""
    sliced = df.withColumn("_slice", slice_by)
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    row = F.struct(*columns)
    slices = sliced.groupBy(*group, "_slice").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    carried = slices.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_s"),
        F.lag("_last").over(Window.partitionBy(*group).orderBy("_slice")).alias("_carried"))
    joined = (
        sliced.withColumn("_local", F.lag(row).over(inside))
        .join(carried, _same(sliced, carried, group), "inner")
        .withColumn("_prev", F.coalesce("_local", "_carried"))
    )
    return joined.select(*df.columns, *[F.col(f"_prev.{c}").alias(prefix + c) for c in columns])


def _same(rows: DataFrame, carried: DataFrame, group: list[str]) -> Column:
    on = F.col("_slice").eqNullSafe(F.col("_s"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return on


def runs(df: DataFrame, group: list[str], order: list[str], slice_by: Column, key: str,
         out: str = "run_no") -> DataFrame:
    """Number the runs of equal consecutive `key` values in each group, from 1."""
    stepped = previous_row(df, group, order, slice_by, [key])
    changed = F.when(F.col(f"prev_{key}").eqNullSafe(F.col(key)), 0).otherwise(1)
    return running_sum(stepped, group, order, slice_by, changed, out).drop(f"prev_{key}")


def gaps(df: DataFrame, group: list[str], time: str, order: list[str], slice_by: Column,
         seconds: float) -> DataFrame:
    """Stretches without a row that last longer than `seconds`."""
    stepped = previous_row(df, group, order, slice_by, [time])
    width = F.timestamp_diff("MICROSECOND", F.col(f"prev_{time}"), F.col(time)) / 1e6
    return stepped.withColumn("seconds", width).filter(F.col("seconds") > seconds).select(
        *group, F.col(f"prev_{time}").alias("gap_start"), F.col(time).alias("gap_end"), "seconds")
