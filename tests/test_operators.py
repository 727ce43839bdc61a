import duckdb
import pytest
from pyspark.sql import functions as F

from rankmill.functions.numbers import share_value
from rankmill.operators import groups, quality, reshape, select, trend
from rankmill.operators.rank import with_ranks


@pytest.fixture(scope="module")
def pupils(spark):
    return spark.createDataFrame(
        [
            (2023, "Ale", "V", "Kommunal", 30), (2023, "Ale", "V", "Enskild", 10),
            (2023, "Bo", "V", "Kommunal", 0), (2023, "Bo", "V", "Enskild", 0),
            (2024, "Ale", "V", "Kommunal", 50), (2024, None, "V", "Kommunal", 7), (2024, "Cy", "S", "Enskild", 40),
        ],
        "year int, kommun string, lan string, huvudman_typ string, n_students long",
    )


def test_share_of_total(pupils):
    got = {(r.year, r.kommun, r.huvudman_typ): (r.n_total, r.share) for r in groups.share_of_total(pupils, ["year", "kommun", "lan"], "n_students").collect()}
    assert got[2023, "Ale", "Enskild"] == (40, 0.25)
    assert got[2023, "Bo", "Enskild"] == (0, 0.0)
    assert len(got) == 6  # the row without a municipality joins nothing


def test_shares_sum_to_one(pupils):
    sums = groups.share_of_total(pupils, ["year", "kommun", "lan"], "n_students").groupBy("year", "kommun").agg(
        F.sum("share").alias("s"), F.max("n_total").alias("t")
    )
    assert all(abs(r.s - (1 if r.t else 0)) < 1e-12 for r in sums.collect())


def test_recomputed_share(pupils):
    got = {(r.year, r.kommun, r.huvudman_typ): r.share for r in groups.recomputed_share(pupils, "kommun", "n_students").collect()}
    assert got[2023, "Ale", "Enskild"] == 10 / 90
    assert got[2023, "Bo", "Kommunal"] is None and got[2024, None, "Kommunal"] is None


def test_weighted_mean(spark):
    df = spark.createDataFrame([("a", 10.0, 1), ("a", None, 100), ("a", 20.0, 3), ("b", None, 5), ("c", 1.0, 0)], "g string, x double, w int")
    got = {r.g: r.m for r in df.groupBy("g").agg(groups.weighted_mean("x", "w").alias("m")).collect()}
    assert got == {"a": 17.5, "b": None, "c": None}


def test_rollup_rows(spark, rows):
    df = spark.createDataFrame([("k", "Eng", 10.0, None), ("k", "Mat", 20.0, 4.0), ("k", "Mat", 20.0, 4.0)], "k string, s string, f double, m double")
    got = rows(groups.with_rollup_rows(df, ["k"], "s", ["f", "m"], {"gap": groups.gap("f", "m")}))
    all_row = (round(50 / 3, 10), round(50 / 3, 10) - 4.0, "k", 4.0, "ALL")
    assert got == sorted([(10.0, None, "k", None, "Eng"), (20.0, 16.0, "k", 4.0, "Mat"), (20.0, 16.0, "k", 4.0, "Mat"), all_row], key=repr)


def test_fairness_formulas(spark):
    df = spark.createDataFrame([(0.0, 4.0), (1.0, 4.0), (3.0, 4.0), (4.0, 4.0), (None, 4.0), (0.0, 0.0)], "g double, m double")
    got = [tuple(r) for r in df.select(groups.gap_fairness("g", "m"), groups.fairness_label("g")).collect()]
    assert got == [
        (100.0, "Balanced"), (75.0, "Balanced"), (25.0, "Moderate gap"), (0.0, "High gap"), (None, "High gap"), (None, "Balanced"),
    ]


SERIES = [("a", 2018, 50.0), ("a", 2019, 52.0), ("a", 2022, 49.9), ("a", 2023, 50.0), ("b", 2019, 1.0), (None, 2018, 3.0), (None, 2019, 4.0)]


@pytest.mark.parametrize("unique", [True, False])
def test_previous_available_year(spark, unique):
    df = spark.createDataFrame(SERIES, "s string, y int, v double")
    got = trend.with_previous(df, ["s"], "y", {"prev": "v"}, one_row_per_year=unique)
    labels = {(r.s, r.y): (r.prev, r.label) for r in got.withColumn("label", trend.trend_label("v", "prev")).collect()}
    assert labels == {
        ("a", 2018): (None, "No previous year"), ("a", 2019): (50.0, "Improving"), ("a", 2022): (52.0, "Declining"),
        ("a", 2023): (49.9, "Stable"), ("b", 2019): (None, "No previous year"),
        (None, 2018): (None, "No previous year"), (None, 2019): (3.0, "Stable"),
    }
    strict = trend.with_previous(df, ["s"], "y", {"prev": "v"}, one_row_per_year=unique, strict_year=True)
    assert {r.y: r.prev for r in strict.filter("s = 'a'").collect()} == {2018: None, 2019: 50.0, 2022: None, 2023: 49.9}


def test_previous_year_with_repeated_years(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 9), ("a", 2, 4), ("a", 2, 3)], "s string, y int, v int")
    assert rows(trend.with_previous(df, ["s"], "y", {"prev": "v"})) == sorted(
        [(None, "a", 5, 1), (None, "a", 9, 1), (9, "a", 4, 2), (9, "a", 3, 2)], key=repr
    )


def test_latest_and_last(spark, rows):
    df = spark.createDataFrame(SERIES, "s string, y int, v double").filter("s is not null")
    assert rows(trend.at_latest(df, "y")) == [("a", 50.0, 2023)]
    assert trend.before_latest(df, "y").count() == 4
    assert rows(trend.last_points(df, "s", "y", "v")) == [("a", 50.0, 2023), ("b", 1.0, 2019)]
    one = df.filter("s = 'a'")
    assert [tuple(r) for r in trend.last_change(one, "y", "v").collect()] == [(2022, 2023, 0.1, "increased")]
    assert trend.last_change(df.filter("s = 'b'"), "y", "v").count() == 0


def test_optional_filters(pupils):
    assert select.optional_filters(pupils, {"year": "All", "lan": None, "kommun": "ALL"}).count() == 7
    assert select.optional_filters(pupils, {"year": 2023, "kommun": "Ale"}).count() == 2
    assert select.optional_filters(pupils, {"kommun": ""}).count() == 0
    assert select.safe_filter(pupils, "none", "x").count() == select.safe_filter(pupils, "lan", "All").count() == 7
    assert select.safe_filter(pupils, "lan", "S").count() == 1
    assert select.year_filter(pupils, "year", "2023").count() == 4
    assert select.year_filter(pupils, "year", "x").count() == 7
    assert select.year_filter(pupils, "year", "x", bad="none").count() == 0


def test_options(pupils):
    def options(*args, **kwargs):
        return [r.option for r in select.option_list(pupils, *args, **kwargs).collect()]

    assert options("kommun") == ["All", "Ale", "Bo", "Cy"]
    assert options("kommun", where={"lan": "S"}) == ["All", "Cy"]
    assert options("huvudman_typ", without=["ENSKILD"]) == ["All", "Kommunal"]
    assert options("year") == ["All", "2023", "2024"]
    assert [r.v for r in select.distinct_values(pupils, "kommun", 2).collect()] == ["Ale", "Bo"]


def test_top_rows(pupils):
    got = select.top_and_bottom(pupils, "n_students", 2, ["kommun", "huvudman_typ"]).collect()
    assert [(r.side, r.n_students) for r in got] == [("top", 40), ("top", 50), ("bottom", 0), ("bottom", 0)]
    top = select.rows_of_top_keys(pupils, "kommun", "n_students", 2)
    assert {r.kommun for r in top.collect()} == {"Ale", "Cy"} and top.count() == 4
    assert "TakeOrderedAndProject" in select.top_rows(pupils, "n_students", 2)._jdf.queryExecution().executedPlan().toString()


def test_lookup_and_missing(spark):
    df = spark.createDataFrame([("114", "x"), ("0114", ""), ("1140", None)], "code string, v string")
    assert select.lookup(df, "code", 114, 4).count() == 2
    assert select.not_missing(df, ["v"]).count() == 2 and select.not_missing(df, ["v"], empty_too=True).count() == 1


def test_numeric_rows(spark, rows):
    df = spark.createDataFrame([("a", "1,5"), ("b", "x"), ("c", None)], "k string, v string")
    assert rows(select.numeric_rows(df, "v", share_value)) == [("a", 1.5)]


def test_column_choice(spark):
    columns = ["Kommun", "Läsår", "id"]
    assert select.pick_column(columns, ["kommun"]) == "Kommun"
    assert select.pick_column(columns, ["kommun", "id"], "exact") == "id"
    assert select.pick_column(columns, ["år", "year"], "hint") == "Läsår"
    assert select.pick_column(columns, ["x"]) is None
    df = spark.sql("select 'a' as s, 1 as n, 2.0D as d")
    assert select.pick_numeric_column(df) == "n" and select.pick_numeric_column(df, ["D"]) == "d"
    assert select.pick_numeric_column(df, ["s"]) == "n" and select.pick_numeric_column(df.select("s")) is None


def test_reshape(spark, pupils, rows):
    assert reshape.year_label_columns(["x", "2016/17", "a/b", "2015/16"]) == ["2015/16", "2016/17"]
    wide = spark.createDataFrame([("K", "Eng", "90,5", ".."), ("E", "Eng", None, "80")], ["t", "s", "2015/16", "2016/17"])
    assert rows(reshape.melt_years(wide, ["t", "s"])) == [("Eng", "E", 80.0, "2016/17"), ("Eng", "K", 90.5, "2015/16")]
    back = reshape.pivot(reshape.melt(wide, ["t", "s"], ["2015/16", "2016/17"], "y", "v"), ["t", "s"], "y", ["2015/16", "2016/17"], F.first("v"))
    assert rows(back) == rows(wide)
    share = {(r.year, r.kommun): (r.total, r.share) for r in reshape.pivoted_share(pupils, ["year", "kommun"], "huvudman_typ", "Enskild", "Kommunal", "n_students").collect()}
    assert share == {(2023, "Ale"): (40, 0.25), (2023, "Bo"): (0, 0.0), (2024, "Ale"): (50, 0.0), (2024, "Cy"): (40, 1.0)}
    means = [tuple(r) for r in reshape.mean_over_time(pupils, "year", "n_students").collect()]
    assert means == [(2023, 10.0), (2024, round(97 / 3, 10))]
    by_type = [tuple(r) for r in reshape.mean_over_time(pupils, "year", "n_students", "huvudman_typ", ["Kommunal", "Enskild", "X"]).collect()]
    assert by_type == [(2023, 15.0, 5.0, None), (2024, 28.5, 40.0, None)]


def test_expect_not_null(pupils):
    result = quality.expect_not_null(pupils, "pupils", ["kommun", "year"])
    assert sorted(tuple(r) for r in result.collect()) == [("pupils", "kommun", 1), ("pupils", "year", 0)]
    assert [r.column for r in quality.failing_tests(result).collect()] == ["kommun"]


HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50000",
}


@pytest.mark.parametrize("operator", [
    lambda df: groups.share_of_total(df, ["k"], "n"),
    lambda df: groups.recomputed_share(df, "k", "n"),
    lambda df: trend.with_previous(df, ["k"], "y", {"prev": "n"}),
    lambda df: with_ranks(df, "v", [(["k"], {"c": "cume_dist"})]),
])
def test_hot_keys_are_split(spark, operator):
    """A third of the rows share one key and half of those one value: the join splits them."""
    before = {c: spark.conf.get(c) for c in HOT}
    for c, v in HOT.items():
        spark.conf.set(c, v)
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 997)
        value = F.when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise((F.col("id") % 9973).cast("double"))
        df = spark.range(0, 200_000, 1, 16).select("id", key.alias("k"), (F.col("id") % 3).alias("y"), F.lit(1).alias("n"), value.alias("v"))
        out = operator(df)
        assert len(out.collect()) == 200_000
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_fairness_rounds_as_sql(spark):
    """Gaps of whole units against a widest one of 6,000: halves of a tenth of a point among the scores."""
    df = spark.range(6001).select("id", groups.gap_fairness(F.col("id").cast("double"), F.lit(6000.0)).alias("s"))
    want = duckdb.sql("select round(100.0 * (1.0e0 - cast(i as double) / 6000.0e0), 1) from range(6001) t(i) order by i").fetchall()
    assert [r.s for r in df.orderBy("id").collect()] == [w for (w,) in want]
