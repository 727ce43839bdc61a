"""KPI marts over the typed relations, and a registry that builds any of them from raw lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rankmill.functions.numbers import count_value, round_half
from rankmill.functions.text import normal_category, normal_year, pad_code
from rankmill.operators.groups import (
    fairness_label,
    gap,
    gap_fairness,
    mean,
    share_of_total,
    weighted_mean,
    with_rollup_rows,
)
from rankmill.operators.lines import with_url
from rankmill.operators.quality import expect_not_null
from rankmill.operators.rank import latest_per_key, percent_score, performance_bucket, with_ranks
from rankmill.operators.select import not_missing
from rankmill.operators.trend import trend_label, with_previous
from rankmill.plans import families

# ---- Fixed values: labels ----

PROVIDER_NEEDLES = {"enskild": "Enskild", "kommunal": "Kommunal", "samtliga": "Samtliga"}
PROGRAMS = {
    "behorig_yrkes": "Yrkesprogram",
    "behorig_estet": "Estetiskt",
    "behorig_eko_hum_sam": "Eko/Hum/Sam",
    "behorig_nat_tek": "Natur/Teknik",
}
GROUP_KEYS = ["year", "subject", "huvudman_typ"]


def test_results(tests: DataFrame) -> DataFrame:
    """Typed test results with the gap girls - boys."""
    measured = tests.withColumn("betygspoang_gap_f_minus_m", gap("betygspoang_flickor", "betygspoang_pojkar"))
    return measured.select(
        "lasar_start", *families.ID_COLUMNS, "amne", *families.TEST_COLUMNS, "betygspoang_gap_f_minus_m", "source_file"
    )


def choice(tests: DataFrame, digits: int | None = 10) -> DataFrame:
    """Percentile score, bucket and ranks per year, subject (and ALL) and provider."""
    keys = ["year", "kommun", "lan", "huvudman_typ"]
    points = ["betygspoang_totalt", "betygpoang_flickor", "betygpoang_pojkar"]
    base = not_missing(tests, ["kommun", "lan", "huvudman_typ", "amne", "betygspoang_totalt"]).select(
        normal_year("lasar_start").alias("year"),
        *keys[1:],
        F.col("amne").alias("subject"),
        "betygspoang_totalt",
        F.col("betygspoang_flickor").alias("betygpoang_flickor"),
        F.col("betygspoang_pojkar").alias("betygpoang_pojkar"),
    )
    grain = with_rollup_rows(
        base, keys, "subject", points, {"betygpoang_gap_f_minus_m": gap(points[1], points[2])}, digits=digits
    )
    return scored(grain, "betygspoang_totalt").select(
        "kommun",
        "lan",
        *GROUP_KEYS,
        "score",
        "performance_bucket",
        "rank_sweden",
        "rank_lan",
        *points,
        "betygpoang_gap_f_minus_m",
    )


def scored(grain: DataFrame, value: str, by: Sequence[str] = GROUP_KEYS, region: str = "lan") -> DataFrame:
    """Score 0-100, its bucket, and dense ranks (1 = highest) in the country and the region."""
    ranked = with_ranks(
        grain,
        value,
        [
            (by, {"_cume": "cume_dist", "rank_sweden": "dense_rank_desc"}),
            ([*by, region], {"rank_lan": "dense_rank_desc"}),
        ],
    )
    return (
        ranked.withColumn("score", percent_score("_cume"))
        .drop("_cume")
        .withColumn("performance_bucket", performance_bucket("score"))
    )


def fairness(choice_mart: DataFrame, by: Sequence[str] = GROUP_KEYS, region: str = "lan") -> DataFrame:
    """Gap size, score against the group's largest gap, ranks (1 = smallest gap), label."""
    gaps = choice_mart.drop("performance_bucket").withColumn("gap_abs", F.abs("betygpoang_gap_f_minus_m"))
    ranked = with_ranks(
        gaps,
        "gap_abs",
        [
            (by, {"_widest": "max", "fairness_rank_sweden": "dense_rank"}),
            ([*by, region], {"fairness_rank_lan": "dense_rank"}),
        ],
    )
    return ranked.withColumns(
        {"fairness_score": gap_fairness("gap_abs", "_widest"), "fairness_label": fairness_label("gap_abs")}
    ).drop("_widest")


def trend(choice_mart: DataFrame, one_row_per_year: bool = False, strict_year: bool = False) -> DataFrame:
    """Score and ranks against the previous available year; a positive rank change is better."""
    previous = {f"{c}_prev_year": c for c in ("score", "rank_sweden", "rank_lan")}
    lagged = with_previous(
        choice_mart, ["kommun", "subject", "huvudman_typ"], "year", previous, one_row_per_year, strict_year
    )
    return lagged.withColumns(
        {
            "score_change_yoy": F.col("score") - F.col("score_prev_year"),
            "rank_sweden_change_yoy": F.col("rank_sweden_prev_year") - F.col("rank_sweden"),
            "rank_lan_change_yoy": F.col("rank_lan_prev_year") - F.col("rank_lan"),
            "trend_label": trend_label("score", "score_prev_year"),
        }
    )


def ranked_municipalities(tests: DataFrame, digits: int | None = 10) -> DataFrame:
    """Mean points per municipality, ranked in the country and the county."""
    by = ["lasar_start", "huvudman_typ", "amne"]
    points = {"total": "betygspoang_totalt", "flickor": "betygspoang_flickor", "pojkar": "betygspoang_pojkar"}
    measured = tests.filter(F.col("betygspoang_totalt").isNotNull())
    means = measured.groupBy("lasar_start", "lan", "lan_kod", "huvudman_typ", "amne", "kommun", "kommun_kod").agg(
        *[mean(column, digits).alias(f"avg_{name}") for name, column in points.items()],
        mean(gap(points["flickor"], points["pojkar"]), digits).alias("avg_gap_f_minus_m"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return placed(means, by)


def placed(means: DataFrame, by: Sequence[str], region: str = "lan_kod", value: str = "avg_total") -> DataFrame:
    """Rank (1 = highest), group size and percent rank in the country and the region, score 0-100."""
    ranked = with_ranks(
        means,
        value,
        [
            (by, {"rank_in_sweden": "dense_rank_desc", "n_kommun_sweden": "count", "pct_in_sweden": "percent_rank"}),
            ([*by, region], {"rank_in_lan": "dense_rank_desc", "n_kommun_in_lan": "count", "pct_in_lan": "percent_rank"}),
        ],
    )
    return ranked.withColumn("score_0_100", round_half(F.col("pct_in_sweden") * 100, 1))


def school_choice(pupils: DataFrame) -> DataFrame:
    """Pupils per municipality and provider, and the provider's share. Reads the untyped relation."""
    rows = not_missing(pupils, ["kommun", "lan", "huvudman_typ", "elever_totalt_1_9"]).select(
        normal_year("lasar_start").alias("year"),
        "kommun",
        "lan",
        normal_category("huvudman_typ", PROVIDER_NEEDLES).alias("huvudman_typ"),
        count_value(F.col("elever_totalt_1_9").cast("string"), "bigint", nbsp=False).alias("n_students"),
    )
    counted = rows.filter(F.col("huvudman_typ").isin("Kommunal", "Enskild") & (F.col("n_students") >= 0))
    return share_of_total(counted, ["year", "kommun", "lan"], "n_students")


def budget(costs: DataFrame) -> DataFrame:
    """Costs per pupil, one row per municipality, year and provider: the newest file's."""
    rows = costs.select(
        F.col("year_start").alias("lasar_start"),
        "kommun",
        pad_code("kommunkod", 4).alias("kommun_kod"),
        "lan",
        "lan_kod",
        "huvudman_typ",
        *families.COST_COUNTS,
        "source_file",
    ).filter(F.col("totalt_per_elev").isNotNull())
    ties = [c for c in rows.columns if c not in ("kommun_kod", "lasar_start", "huvudman_typ", "source_file")]
    return latest_per_key(rows, ["kommun_kod", "lasar_start", "huvudman_typ"], ["source_file"], ties)


def latest_budget(budget_mart: DataFrame) -> DataFrame:
    return latest_per_key(budget_mart, ["kommun_kod", "huvudman_typ"], ["lasar_start"], keep="rn")


def eligibility_by_gender(eligible: DataFrame) -> DataFrame:
    """Share eligible per programme, girls and boys, weighted by pupils."""
    rows = eligible.filter(F.col("kon").isin("Flickor", "Pojkar") & (F.col("huvudman_typ") == "Samtliga"))
    return weighted_long(rows, "kon", PROGRAMS, "antal_elever", "program", "behorighet_pct")


def weighted_long(
    df: DataFrame, group: str, measures: dict[str, str], weight: str, name: str, value: str, digits: int | None = 10
) -> DataFrame:
    """Weighted mean of each measure per group, one row per group and measure label."""
    means = {label: weighted_mean(measure, weight) for measure, label in measures.items()}
    if digits is not None:
        means = {label: F.round(m, digits) for label, m in means.items()}
    wide = df.groupBy(group).agg(*[m.alias(label) for label, m in means.items()])
    return wide.unpivot([group], [f"`{label}`" for label in means], name, value)


# ---- Registry ----


@dataclass(frozen=True)
class Relation:
    """A named relation: what it reads, how it is made, whether it is worth keeping as a table.

    ``partition`` is the column the table is laid out by, so that a query on one value reads no more.
    """

    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    table: bool = True
    not_null: tuple[str, ...] = ()
    partition: str | None = None


def _lines(raw: DataFrame) -> DataFrame:
    return raw.select("raw_line", "source_file")


RELATIONS: dict[str, Relation] = {
    "stg_raw_data": Relation(("raw_data",), _lines, False, ("raw_line", "source_file")),
    "stg_antal_elever_per_arskurs": Relation(("stg_raw_data",), families.PUPILS.parse, False),
    "stg_antal_elever_per_arskurs_typed": Relation(("stg_antal_elever_per_arskurs",), families.typed_pupils, False),
    "stg_kostnader_per_kommun": Relation(("stg_raw_data",), families.COSTS.parse, False),
    "stg_kostnader_per_kommun_typed": Relation(("stg_kostnader_per_kommun",), families.typed_costs, False),
    "stg_nationella_prov_ak9": Relation(("stg_raw_data",), families.TESTS.parse, False),
    # Three marts read it, two of them twice: parse the text once.
    "stg_nationella_prov_ak9_typed": Relation(("stg_nationella_prov_ak9",), families.typed_tests),
    "stg_personalstatistik": Relation(("stg_raw_data",), families.STAFF.parse, False),
    "stg_personalstatistik_typed": Relation(("stg_personalstatistik",), families.typed_staff, False),
    "int_behorighet_2024_25_lines": Relation(("raw_data",), families.eligible_lines),
    "stg_behorighet_2024_25": Relation(("int_behorighet_2024_25_lines",), families.typed_eligible, False),
    "mart_nationella_prov_ak9": Relation(("stg_nationella_prov_ak9_typed",), test_results, partition="lasar_start"),
    "mart_ranked_kommun_ak9": Relation(("stg_nationella_prov_ak9_typed",), ranked_municipalities, partition="lasar_start"),
    "mart_parent_choice_ak9": Relation(("stg_nationella_prov_ak9_typed",), choice, partition="year"),
    "mart_parent_fairness_ak9": Relation(("mart_parent_choice_ak9",), fairness, partition="year"),
    "mart_parent_trend_ak9": Relation(("mart_parent_choice_ak9",), trend, partition="year"),
    "mart_parent_choice_ak1_9": Relation(("stg_antal_elever_per_arskurs",), school_choice, partition="year"),
    "mart_budget_per_elev_kommun": Relation(("stg_kostnader_per_kommun_typed",), budget, partition="lasar_start"),
    "mart_budget_per_elev_kommun_latest": Relation(("mart_budget_per_elev_kommun",), latest_budget),
    "mart_behorighet_national_gender_2024_25": Relation(("stg_behorighet_2024_25",), eligibility_by_gender),
    "slv_cleaned_data": Relation(("stg_raw_data",), with_url, True, ("source_file", "statistik_text")),
    "mart_overview": Relation(("slv_cleaned_data",), lambda df: df, True, ("statistik_text",)),
}


def build(
    raw_data: DataFrame, names: Sequence[str] | None = None, store: str | None = None
) -> dict[str, DataFrame]:
    """The named relations (default: all) and what they need, made from raw lines.

    Without a store nothing runs but the counting jobs of the ranked marts, whose counts are
    checkpointed. With one, relations marked as tables are written there as parquet and read back,
    so each is computed once however many others read it.
    """
    made = {"raw_data": raw_data}

    def get(name: str) -> DataFrame:
        if name not in made:
            relation = RELATIONS[name]
            df = relation.make(*[get(i) for i in relation.inputs])
            if store is not None and relation.table:
                df = _stored(df, f"{store}/{name}", relation.partition)
            made[name] = df
        return made[name]

    return {name: get(name) for name in (names or RELATIONS)}


def _stored(df: DataFrame, path: str, partition: str | None) -> DataFrame:
    """Write and read back. Rebalancing gives each partition value few files, and a large one several tasks."""
    if partition is None:
        df.write.mode("overwrite").parquet(path)
    else:
        df.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def data_tests(relations: dict[str, DataFrame]) -> DataFrame | None:
    """Results of the not-NULL tests of the relations at hand as (relation, column, failures)."""
    out = None
    for name, df in relations.items():
        columns = RELATIONS[name].not_null if name in RELATIONS else ()
        if columns:
            result = expect_not_null(df, name, columns)
            out = result if out is None else out.unionByName(result)
    return out
