"""Group measures: shares of a total, weighted means, roll-up rows, gaps between two groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankmill.functions.numbers import round_half
from rankmill.operators.joins import join_per_key


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as a double, 0 when the whole is 0."""
    whole = _col(whole)
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        _col(part).cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    )


def share_of_total(
    df: DataFrame, by: Sequence[str], amount: str, total: str = "n_total", share: str = "share"
) -> DataFrame:
    """Add the group's total and each row's share of it; rows with a NULL group key are dropped.

    Totals are aggregated (combining on the map side) and joined back rather than summed in a
    window, which would bring all rows of a group into one task.
    """
    totals = df.groupBy(*by).agg(F.sum(amount).alias(total))
    return join_per_key(df, totals, by).withColumn(share, ratio(amount, total))


def recomputed_share(
    df: DataFrame, key: str, amount: str, total: str = "total_students", share: str = "share"
) -> DataFrame:
    """Share of the key's total over the rows at hand; NULL when the total is 0 or missing."""
    totals = df.groupBy(key).agg(F.sum(amount).alias(total))
    return join_per_key(df, totals, [key], "left").withColumn(
        share, F.col(amount).cast("double") / F.nullif(F.col(total).cast("double"), F.lit(0.0))
    )


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: mean weighted over the rows that have a value, NULL when they weigh nothing."""
    value, weight = _col(value), _col(weight)
    weighed = F.sum(F.when(value.isNotNull(), weight)).cast("double")
    return F.sum(value * weight) / F.nullif(weighed, F.lit(0.0))


def mean(value: Column | str, digits: int | None = 10) -> Column:
    """Aggregate: mean, rounded by default.

    The order in which a cluster adds doubles changes their last bits; rounding keeps equal means
    equal, so that a rank taken on them is the same in every run.
    """
    out = F.avg(_col(value))
    return out if digits is None else F.round(out, digits)


def gap(first: Column | str, second: Column | str) -> Column:
    """first - second, NULL when either is missing."""
    return _col(first) - _col(second)


def with_rollup_rows(
    df: DataFrame,
    keys: Sequence[str],
    member: str,
    means: Sequence[str],
    derived: Mapping[str, Column] = {},
    label: str = "ALL",
    digits: int | None = 10,
) -> DataFrame:
    """Rows plus, per key, one row whose member is ``label`` and whose measures are plain means.

    ``derived`` columns are computed from the (rounded) means on the roll-up rows and from the
    row's own measures on the others.
    """
    rolled = df.groupBy(*keys).agg(*[mean(c, digits).alias(c) for c in means]).withColumn(member, F.lit(label))
    columns = [*keys, member, *means]
    return df.select(*columns).unionByName(rolled.select(*columns)).withColumns(dict(derived))


def gap_fairness(gap_abs: Column | str, group_max: Column | str) -> Column:
    """100 for no gap down to 0 for the group's largest gap, one decimal."""
    relative = _col(gap_abs) / F.nullif(_col(group_max), F.lit(0.0))
    return round_half(F.lit(100.0) * (F.lit(1.0) - relative), 1)


def fairness_label(gap_abs: Column | str, balanced: float = 1, moderate: float = 3) -> Column:
    """A missing gap counts as high."""
    g = _col(gap_abs)
    return F.when(g <= balanced, "Balanced").when(g <= moderate, "Moderate gap").otherwise("High gap")
