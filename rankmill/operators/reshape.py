"""Wide to long and back. Pivots always get their value list, so no extra job looks for it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankmill.functions.numbers import share_value
from rankmill.operators.groups import mean, ratio


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per id and column; NULL values are kept."""
    return df.unpivot(list(ids), list(columns), name, value)


def relabel(df: DataFrame, column: str, labels: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(labels), subset=[column])


def year_label_columns(columns: Sequence[str]) -> list[str]:
    """Columns such as ``2015/16``, oldest first."""
    return sorted((c for c in columns if "/" in c and c[:4].isdigit()), key=lambda c: int(c[:4]))


def melt_years(df: DataFrame, ids: Sequence[str], name: str = "year", value: str = "value") -> DataFrame:
    """Long form of the school-year columns, numbers parsed, rows without a number dropped."""
    long = melt(df, ids, year_label_columns(df.columns), name, value)
    return long.withColumn(value, share_value(value)).filter(F.col(value).isNotNull())


def pivot(
    df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], aggregate: Column, fill: float | None = None
) -> DataFrame:
    """Wide form of one aggregate; values that do not occur become empty (or filled) columns."""
    out = df.groupBy(*index).pivot(column, list(values)).agg(aggregate)
    return out if fill is None else out.na.fill(fill, subset=list(values))


def mean_over_time(
    df: DataFrame,
    year: str,
    value: str,
    member: str | None = None,
    members: Sequence[str] = (),
    digits: int | None = 10,
) -> DataFrame:
    """Mean per year, or per year and member with one column per member."""
    known = df.na.drop(subset=[c for c in (year, value, member) if c])
    if member is None:
        return known.groupBy(year).agg(mean(value, digits).alias(value)).orderBy(year)
    return pivot(known, [year], member, members, mean(value, digits)).orderBy(year)


def pivoted_share(
    df: DataFrame, index: Sequence[str], column: str, part: str, rest: str, amount: str
) -> DataFrame:
    """Sums of two column values side by side, their total and the part's share of it (0 if empty)."""
    known = df.na.drop(subset=[*index, column])
    wide = pivot(known, index, column, [part, rest], F.sum(amount), fill=0)
    return wide.withColumn("total", F.col(part) + F.col(rest)).withColumn(
        "share", F.when(F.col("total") > 0, ratio(part, "total")).otherwise(F.lit(0.0))
    )
