"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times.

    A column added with withColumn gives no such promise: the optimizer may push a filter below it
    and paste its expression in at every mention.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
