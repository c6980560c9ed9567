"""Local names inside column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once.

    A column used inside a lambda is evaluated again for every element; bound this way it is a
    variable, which keeps index arithmetic over arrays linear.
    """
    return F.get(F.transform(F.array(value), body), 0)
