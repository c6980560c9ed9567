"""Rounding that gives the same double in every engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: plain IEEE steps, no decimal detour."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def as_money(value: Column) -> Column:
    """Exact two-digit decimal, so that sums do not depend on the order of rows."""
    return value.cast("decimal(18,2)")
