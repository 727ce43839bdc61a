"""The parameterised queries behind the dashboard pages, maps and the pass-rate story."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F

from rankmill.functions.text import school_year_start, strip, zero_fill
from rankmill.operators.geo import in_box, join_values, simplify
from rankmill.operators.groups import mean, recomputed_share
from rankmill.operators.lattice import Lattice
from rankmill.operators.reshape import melt, melt_years, pivot, pivoted_share, relabel, year_label_columns
from rankmill.operators.select import (
    means_all,
    optional_filters,
    positioned,
    rows_of_top_keys,
    top_and_bottom,
    year_filter,
)
from rankmill.operators.trend import at_latest, last_change

# ---- Fixed values: labels, the two providers, default number of rows ----

GENDER_LABELS = {"betygpoang_flickor": "Girls", "betygpoang_pojkar": "Boys"}
PROVIDER_LABELS = {"Enskild": "Independent", "Kommunal": "Municipal"}
PUBLIC, INDEPENDENT = "Kommunal", "Enskild"
TOP_N = 10


def trend_series(
    trend: DataFrame,
    lan: Any = None,
    kommun: Any = None,
    huvudman: Any = None,
    subject: Any = None,
    metric: str = "score",
    digits: int | None = 10,
) -> DataFrame:
    """Mean score per year and series, without the latest year of the selection.

    The series are subjects (the roll-up among them) while all subjects are selected, else
    providers; a provider filter only applies in the first case.
    """
    series = "subject" if means_all(subject) else "huvudman_typ"
    provider = huvudman if means_all(subject) else None
    rows = optional_filters(
        trend, {"lan": lan, "kommun": kommun, "huvudman_typ": provider, "subject": subject}
    ).filter(F.col(metric).isNotNull() & F.col("year").isNotNull() & F.col(series).isNotNull())
    return _without_latest_year(rows.groupBy("year", series).agg(mean(metric, digits).alias(metric)), series)


def _without_latest_year(means: DataFrame, series: str) -> DataFrame:
    """Ordered means per year and series; the window sees one row per year and series only, so the mart is read once."""
    latest = F.max("year").over(Window.partitionBy())
    rows = means.withColumn("_latest", latest).filter(F.col("year") < F.col("_latest")).drop("_latest")
    return rows.withColumnRenamed(series, "series").orderBy("year", "series")


def trend_series_from(
    lattice: Lattice, lan: Any = None, kommun: Any = None, huvudman: Any = None, subject: Any = None, metric: str = "score", digits: int | None = 10
) -> DataFrame:
    """``trend_series`` answered from a lattice over year, lan, kommun, huvudman_typ and subject; the mart is not read."""
    series = "subject" if means_all(subject) else "huvudman_typ"
    chosen = {"lan": lan, "kommun": kommun, "huvudman_typ": huvudman if means_all(subject) else None, "subject": subject}
    chosen = {c: v for c, v in chosen.items() if not means_all(v)}
    rows = lattice.rows(["year", series, *chosen])
    rows = optional_filters(rows, chosen).filter(F.col("year").isNotNull() & F.col(series).isNotNull())
    means = lattice.means(rows, ["year", series], [metric], digits).filter(F.col(metric).isNotNull())
    return _without_latest_year(means, series)


def top_gaps(
    fairness: DataFrame,
    year: Any = None,
    lan: Any = None,
    huvudman: Any = None,
    subject: Any = None,
    top_n: int = TOP_N,
    digits: int | None = 10,
) -> DataFrame:
    """Municipalities with the widest gap between the girls' and the boys' mean, widest first."""
    rows = optional_filters(
        year_filter(fairness, "year", year), {"lan": lan, "huvudman_typ": huvudman, "subject": subject}
    )
    means = (
        rows.filter(F.col("kommun").isNotNull())
        .groupBy("kommun")
        .agg(*[mean(c, digits).alias(c) for c in GENDER_LABELS])
    )
    return (
        means.withColumn("gap_abs", F.abs(F.col("betygpoang_flickor") - F.col("betygpoang_pojkar")))
        .orderBy(F.col("gap_abs").desc_nulls_last(), "kommun")
        .limit(top_n)
    )


def top_gaps_long(gaps: DataFrame) -> DataFrame:
    """The same, one row per municipality and gender; narrowest gap first, as bars are drawn upwards.

    ``position`` states the order.
    """
    long = melt(gaps, ["kommun", "gap_abs"], list(GENDER_LABELS), "Group", "Average grade points")
    return positioned(relabel(long, "Group", GENDER_LABELS), F.col("gap_abs").asc_nulls_first(), F.col("kommun").desc(), F.col("Group").desc())


def _providers(choice: DataFrame, lan: Any, providers: Sequence[str]) -> DataFrame:
    rows = optional_filters(choice, {"lan": lan})
    return rows.filter(F.col("huvudman_typ").isin(list(providers)) & F.col("n_students").isNotNull())


def provider_shares(
    choice: DataFrame,
    year: Any = None,
    lan: Any = None,
    top_n: int = TOP_N,
    providers: Sequence[str] = (PUBLIC, INDEPENDENT),
    fill_shares: bool = False,
) -> DataFrame:
    """Rows of the largest municipalities (one year; a bad year gives no rows).

    With ``fill_shares``, for marts whose shares may be missing, a missing share is the row's part of
    its municipality's pupils among these rows.
    """
    rows = rows_of_top_keys(
        _providers(year_filter(choice, "year", year, bad="none"), lan, providers), "kommun", "n_students", top_n
    )
    if not fill_shares:
        return rows
    given = rows if "share" in rows.columns else rows.withColumn("share", F.lit(None).cast("double"))
    filled = recomputed_share(given.withColumnRenamed("share", "_given"), "kommun", "n_students")
    return filled.withColumn("share", F.coalesce("_given", "share")).select(*given.columns)


def ordered_by_share(
    rows: DataFrame, providers: Sequence[str] = (PUBLIC, INDEPENDENT), by: str = INDEPENDENT, digits: int | None = 10
) -> DataFrame:
    """(kommun, one mean share per provider, position), municipalities with the largest share of ``by`` first."""
    wide = pivot(rows.na.drop(subset=["kommun"]), ["kommun"], "huvudman_typ", providers, mean("share", digits), fill=0)
    return positioned(wide, F.col(by).desc(), "kommun")


def share_axis(rows: DataFrame, headroom: float = 1.15) -> DataFrame:
    """Upper end of the share axis: the largest share and some headroom."""
    return rows.agg((F.max("share") * headroom).alias("axis_max"))


def independent_share_over_time(
    choice: DataFrame,
    lan: Any = None,
    top_n: int = TOP_N,
    providers: Sequence[str] = (PUBLIC, INDEPENDENT),
) -> DataFrame:
    """Per year and municipality: pupils of both providers, total and the independent share."""
    public, independent = providers
    rows = rows_of_top_keys(_providers(choice, lan, providers), "kommun", "n_students", top_n)
    return pivoted_share(rows, ["year", "kommun"], "huvudman_typ", independent, public, "n_students").orderBy(
        "year", "kommun"
    )


def eligibility_rows(mart: DataFrame) -> DataFrame:
    return mart.select("kon", "program", "behorighet_pct").orderBy("program", "kon")


def budget_rows(budget: DataFrame, year: int | None = None) -> DataFrame:
    """(kommun_kod, kommun, totalt_per_elev) of a year, default the latest; code zero-filled."""
    rows = at_latest(budget, "lasar_start") if year is None else budget.filter(F.col("lasar_start") == int(year))
    return rows.select(zero_fill("kommun_kod", 4).alias("kommun_kod"), "kommun", "totalt_per_elev")


def budget_map(budget: DataFrame, features: DataFrame, year: int | None = None, tolerance: float = 0.01) -> DataFrame:
    """Every feature in the box, simplified, with its municipality's costs."""
    values = budget_rows(budget, year).select("kommun_kod", "totalt_per_elev")
    return join_values(simplify(in_box(features), tolerance), values, "kommun_kod")


def budget_extremes(budget: DataFrame, year: int | None = None, n: int = TOP_N) -> DataFrame:
    rows = budget_rows(budget, year).withColumn("totalt_per_elev", F.col("totalt_per_elev").try_cast("double"))
    return top_and_bottom(rows, "totalt_per_elev", n, ["kommun"])


def ranking_map(ranked: DataFrame, year: int, metric: str = "score_0_100") -> DataFrame:
    """One metric of a year for the map, one row per municipality, provider and subject."""
    if metric not in ("score_0_100", "avg_total", "avg_gap_f_minus_m"):
        raise ValueError(f"unknown metric {metric}")
    return ranked.filter(F.col("lasar_start") == int(year)).select("kommun_kod", "kommun", metric)


def pass_rates(
    wide: DataFrame, owner: str, subject: str, owners: Sequence[str] = (PUBLIC, INDEPENDENT)
) -> DataFrame:
    """(owner, subject, year, value) of a file with one column per school year."""
    return melt_years(wide.filter(F.col(owner).isin(list(owners))), [owner, subject])


def pass_rate_trend(
    long: DataFrame, owner: str, owners: Sequence[str] = (PUBLIC, INDEPENDENT), digits: int | None = 10
) -> DataFrame:
    """Unweighted mean per school year, one column per provider."""
    return pivot(long, ["year"], owner, owners, mean("value", digits)).orderBy(school_year_start("year"))


def pass_rate_by_subject(
    wide: DataFrame,
    owner: str,
    subject: str,
    owners: Sequence[str] = (PUBLIC, INDEPENDENT),
    latest: str | None = None,
    digits: int | None = 10,
) -> DataFrame:
    """Mean per subject in one school-year column of a wide file, by default the newest; best public subject first.

    ``position`` states the order. A newest year without any number gives no rows.
    """
    labels = year_label_columns(wide.columns)
    if not labels:
        raise ValueError("no school-year column")
    rows = pass_rates(wide, owner, subject, owners).filter(F.col("year") == (latest or labels[-1]))
    means = pivot(rows.filter(F.col(subject).isNotNull()), [subject], owner, owners, mean("value", digits))
    return positioned(means.na.drop(how="all", subset=list(owners)), F.col(owners[0]).desc_nulls_last(), subject)


def pass_rate_change(
    long: DataFrame, owner: str, subject: str, one_owner: str, one_subject: str, digits: int | None = 10
) -> DataFrame:
    """Change between the last two school years of one provider and subject."""
    rows = long.filter((strip(subject) == one_subject) & (F.col(owner) == one_owner))
    return last_change(rows.withColumn("year", school_year_start("year")), "year", "value", digits)
