"""Parameterised selection: optional filters, option lists, top and bottom rows, column choice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rankmill.functions.text import is_blank, strip, zero_fill

ALL = "All"


def means_all(value: Any) -> bool:
    """None and "all" in any case select everything; an empty text is an ordinary value."""
    return value is None or str(value).strip().lower() == "all"


def optional_filters(df: DataFrame, wanted: Mapping[str, Any]) -> DataFrame:
    """Keep rows equal to each wanted value; "All" or None does not filter."""
    for column, value in wanted.items():
        if not means_all(value):
            df = df.filter(F.col(column) == F.lit(value))
    return df


def safe_filter(df: DataFrame, column: str | None, value: Any) -> DataFrame:
    """Equality filter that is skipped for an unknown column, None or exactly "All"."""
    if column and column in df.columns and value not in (None, ALL):
        return df.filter(F.col(column) == F.lit(value))
    return df


def year_filter(df: DataFrame, column: str, value: Any, bad: str = "all") -> DataFrame:
    """Filter on a year given as text or number. A bad value means all rows, or none (``bad="none"``)."""
    if means_all(value):
        return df
    try:
        return df.filter(F.col(column) == int(value))
    except (TypeError, ValueError):
        return df if bad == "all" else df.filter(F.lit(False))


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Sorted distinct non-NULL values as column ``v``; all of them unless a limit is asked for."""
    out = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull()).distinct().orderBy("v")
    return out if limit is None else out.limit(limit)


def option_list(
    df: DataFrame, column: str, without: Sequence[str] = (), where: Mapping[str, Any] | None = None, label: str = ALL
) -> DataFrame:
    """Label first, then the sorted distinct values, as (position group, option).

    ``without`` leaves out values (case and outer blanks ignored), ``where`` restricts the rows
    the values come from, as for a list that depends on another choice.
    """
    values = optional_filters(df, where or {}).select(F.col(column).alias("option")).filter(F.col("option").isNotNull())
    if without:
        text = F.lower(strip(F.col("option").cast("string")))
        values = values.filter(~text.isin([w.lower() for w in without]))
    values = values.distinct().select(F.lit(1).alias("position"), F.col("option").cast("string").alias("option"))
    first = df.sparkSession.range(1).select(F.lit(0).alias("position"), F.lit(label).alias("option"))
    return first.unionByName(values).orderBy("position", "option")


def top_rows(df: DataFrame, measure: str, n: int, tie_break: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """The n rows with the largest (or smallest) measure; rows without one are left out."""
    order = F.col(measure).desc() if largest else F.col(measure).asc()
    return df.filter(F.col(measure).isNotNull()).orderBy(order, *tie_break).limit(n)


def top_and_bottom(df: DataFrame, measure: str, n: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """Top and bottom n rows, marked in ``side``, in display order: top ascending, bottom descending."""
    top = top_rows(df, measure, n, tie_break).withColumn("side", F.lit("top"))
    bottom = top_rows(df, measure, n, tie_break, largest=False).withColumn("side", F.lit("bottom"))
    shown = F.when(F.col("side") == "top", F.col(measure)).otherwise(-F.col(measure))
    return top.unionByName(bottom).orderBy(F.col("side").desc(), shown, *tie_break)


def rows_of_top_keys(df: DataFrame, key: str, amount: str, n: int) -> DataFrame:
    """Rows of the n keys with the largest summed amount; a NULL key never qualifies."""
    sums = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(amount).alias("_sum"))
    top = sums.orderBy(F.col("_sum").desc_nulls_last(), key).limit(n).select(key)
    return df.join(top, key, "left_semi")


def positioned(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in order with their place in ``position``, from 1. For bounded results only: one task orders them."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint")).orderBy("position")


def lookup(df: DataFrame, column: str, code: Any, width: int) -> DataFrame:
    """Rows whose zero-filled code equals the zero-filled argument."""
    return df.filter(zero_fill(column, width) == str(code).zfill(width))


def numeric_rows(df: DataFrame, column: str, parse: Any) -> DataFrame:
    """Replace a text column by its number and drop rows where there is none."""
    return df.withColumn(column, parse(F.col(column))).filter(F.col(column).isNotNull())


def not_missing(df: DataFrame, columns: Sequence[str], empty_too: bool = False) -> DataFrame:
    """Rows where all columns are present and, if asked, not blank."""
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
        if empty_too:
            df = df.filter(~is_blank(column))
    return df


def pick_column(columns: Sequence[str], candidates: Sequence[str], how: str = "caseless") -> str | None:
    """First candidate that names a column (``exact``, ``caseless``), or the first column whose
    name contains any candidate (``hint``)."""
    if how == "hint":
        return next((c for c in columns if any(h in c.lower() for h in candidates)), None)
    if how == "exact":
        return next((c for c in candidates if c in columns), None)
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def pick_numeric_column(df: DataFrame, preferred: Sequence[str] = ()) -> str | None:
    """The preferred column if it is numeric, else the first numeric one."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    choice = pick_column(df.columns, preferred)
    if choice in numeric:
        return choice
    return numeric[0] if numeric else None
