"""Data tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def expect_not_null(df: DataFrame, relation: str, columns: Sequence[str]) -> DataFrame:
    """(relation, column, failures) for each column, counted in one pass over the relation."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "failures").select(
        F.lit(relation).alias("relation"), "column", "failures"
    )


def failing_tests(results: DataFrame) -> DataFrame:
    return results.filter(F.col("failures") > 0)
