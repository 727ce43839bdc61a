"""Change over time: previous available year, trend labels, last points, last change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankmill.operators.joins import join_per_key


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_previous(
    df: DataFrame,
    series: Sequence[str],
    year: str,
    previous: Mapping[str, str],
    one_row_per_year: bool = False,
    strict_year: bool = False,
) -> DataFrame:
    """Add {new column: value of the source column in the series' previous available year}.

    With ``one_row_per_year`` the caller states that (series, year) is unique, so a series has no
    more rows than there are years and one window does. Otherwise a series may hold any number of
    rows: each of its years is first reduced to one row (the largest), combining on the map side,
    the window runs over those, and the result is joined back. ``strict_year`` blanks a previous
    value that is older than one year.
    """
    order = Window.partitionBy(*series).orderBy(F.col(year).asc_nulls_last())

    def lagged(source: Column) -> Column:
        value = F.lag(source).over(order)
        if strict_year:
            return F.when(F.lag(year).over(order) == F.col(year) - 1, value)
        return value

    if one_row_per_year:
        return df.withColumns({new: lagged(F.col(source)) for new, source in previous.items()})
    sources = list(dict.fromkeys(previous.values()))
    yearly = df.groupBy(*series, year).agg(F.max(F.struct(*sources)).alias("_row"))
    lags = yearly.select(*series, year, *[lagged(F.col("_row")[s]).alias(new) for new, s in previous.items()])
    return join_per_key(df, lags, [*series, year], null_matches=True)


def trend_label(current: Column | str, previous: Column | str, step: float = 2) -> Column:
    change = _col(current) - _col(previous)
    return (
        F.when(_col(previous).isNull(), "No previous year")
        .when(change >= step, "Improving")
        .when(change <= -step, "Declining")
        .otherwise("Stable")
    )


def before_latest(df: DataFrame, year: str) -> DataFrame:
    """Rows older than the latest year of the frame."""
    return df.filter(F.col(year) < df.agg(F.max(year)).scalar())


def at_latest(df: DataFrame, year: str) -> DataFrame:
    """Rows of the latest year of the frame."""
    return df.filter(F.col(year) == df.agg(F.max(year)).scalar())


def last_points(df: DataFrame, series: str, year: str, value: str) -> DataFrame:
    """Each series' own last year and the value there."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(series).agg(F.max(year).alias(year), F.max_by(value, year).alias(value))


def last_change(df: DataFrame, year: str, value: str, digits: int | None = 10) -> DataFrame:
    """Change of the mean between the two last years of one series; no row when there is one year."""
    yearly = df.filter(F.col(value).isNotNull()).groupBy(year).agg(F.avg(value).alias("_mean"))
    two = yearly.orderBy(F.col(year).desc()).limit(2)
    if digits is not None:
        two = two.withColumn("_mean", F.round("_mean", digits))
    out = two.agg(
        F.min(year).alias("year_prev"),
        F.max(year).alias("year_last"),
        (F.max_by("_mean", year) - F.min_by("_mean", year)).alias("delta"),
        F.count(F.lit(1)).alias("_years"),
    )
    if digits is not None:
        out = out.withColumn("delta", F.round("delta", digits))
    direction = F.when(F.col("delta") < 0, "decreased").otherwise("increased")
    return out.filter("_years = 2").drop("_years").withColumn("direction", direction)
