"""Every registered query against its SQL, and the plans that matter at scale."""

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, compare
from rankmill.plans import marts
from workload.oracle import statements
from workload.queries import QUERIES

# The text queries have tests of their own.
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and {"score", "rank_sweden", "rank_lan", "performance_bucket"} <= set(df.columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(statements()) and set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    verdict, _, _ = compare(spark, con, sf_dir, name)
    assert verdict.startswith("ok"), verdict


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    q = driver.queries()
    scan = plan(q["weighted_mean_by_group"](spark, sf_dir))
    assert "In(l_returnflag, [A,R])" in scan and "l_shipdate" not in scan
    assert "props" not in plan(q["lines_count_by_source"](spark, sf_dir))


def test_no_cross_joins_and_no_full_row_windows(spark, sf_dir):
    for name in ("share_of_total", "share_recomputed", "topn_semijoin", "trend_series", "option_list", "gap_topn"):
        text = plan(driver.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    assert "Window" not in plan(driver.queries()["share_of_total"](spark, sf_dir))


def test_latest_rows_are_limited_before_the_shuffle(spark, sf_dir):
    for name in ("dedup_latest_source", "latest_per_key"):
        assert plan(driver.queries()[name](spark, sf_dir)).count("WindowGroupLimit") == 2


def jobs_of(spark, build):
    """Jobs that start while a plan is built."""
    group = f"building-{id(build)}"
    spark.sparkContext.setJobGroup(group, "building")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_plans_of_parsers_run_no_jobs(spark, sf_dir):
    # one job for the footer of each of the four table reads
    assert jobs_of(spark, lambda: QUERIES["parse_results_lines"](spark, sf_dir)) <= 4


def test_distinct_values_are_all_there(spark, sf_dir):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert "Limit" not in plan(QUERIES["distinct_values"](spark, sf_dir)) and QUERIES["distinct_values"](spark, sf_dir).count() == suppliers


def test_marts_without_ranks_build_lazily(spark):
    raw = spark.createDataFrame([("a;b", "x 2024.csv")], "raw_line string, source_file string")
    names = ["mart_parent_choice_ak1_9", "mart_budget_per_elev_kommun_latest", "mart_behorighet_national_gender_2024_25"]
    assert jobs_of(spark, lambda: marts.build(raw, names)) == 0
