import duckdb
import pytest
from pyspark.sql import Window, functions as F

from rankmill.operators.rank import latest_per_key, percent_score, performance_bucket, with_ranks

# Two hot spots: group 0 holds most rows, and one value of it most of those.
DATA = [(i, 0 if i % 3 else i % 7, None if i % 11 == 0 else float((i * 7919) % 83 if i % 2 else 5), i % 4) for i in range(1500)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(DATA, "id int, g int, v double, s int").withColumn(
        "g", F.when(F.col("g") == 3, None).otherwise(F.col("g"))
    )


def plain(frame):
    asc = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_last())
    desc = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
    sub = Window.partitionBy("g", "s").orderBy(F.col("v").asc_nulls_last())
    return frame.withColumns(
        {
            "cd": F.cume_dist().over(asc),
            "pr": F.percent_rank().over(asc),
            "rk": F.rank().over(asc).cast("bigint"),
            "da": F.dense_rank().over(asc).cast("bigint"),
            "dd": F.dense_rank().over(desc).cast("bigint"),
            "n": F.count("*").over(Window.partitionBy("g")),
            "top": F.max("v").over(Window.partitionBy("g")),
            "ds": F.dense_rank().over(sub).cast("bigint"),
            "ns": F.count("*").over(Window.partitionBy("g", "s")),
        }
    )


SCOPES = [
    (["g"], {"cd": "cume_dist", "pr": "percent_rank", "rk": "rank", "da": "dense_rank", "dd": "dense_rank_desc", "n": "count", "top": "max"}),
    (["g", "s"], {"ds": "dense_rank", "ns": "count"}),
]


@pytest.mark.parametrize("partitions", [None, 1, 5, 64])
def test_split_groups_rank_like_windows(frame, rows, partitions):
    ranked = with_ranks(frame, "v", SCOPES, partitions=partitions)
    assert ranked.count() == frame.count()
    assert rows(ranked) == rows(plain(frame))


def test_empty_and_single(spark, rows):
    empty = spark.sql("select 1 as g, 2.0D as v where false")
    assert with_ranks(empty, "v", [(["g"], {"c": "cume_dist"})]).count() == 0
    one = spark.sql("select 1 as g, 2.0D as v")
    assert rows(with_ranks(one, "v", [(["g"], {"c": "cume_dist", "p": "percent_rank"})])) == [(1.0, 1, 0.0, 2.0)]


def test_only_parts_of_groups_are_sorted(frame):
    plan = with_ranks(frame, "v", SCOPES)._jdf.queryExecution().executedPlan().toString()
    sorted_rows = [line for line in plan.splitlines() if "Window [" in line and "sum(_n" in line]
    assert sorted_rows and all("[_group" in line and "_part#" in line for line in sorted_rows)


def test_bucket_uses_rounded_score(spark):
    got = spark.createDataFrame([(0.8995,), (0.8994,), (0.5,), (0.4994,)], "c double").select(
        performance_bucket(percent_score("c")).alias("b")
    )
    assert [r.b for r in got.collect()] == ["Top 10%", "Middle", "Middle", "Bottom 50%"]


def test_scores_round_as_sql(spark):
    """Places in groups of up to 6,000 rows, halves of a tenth of a per cent among them."""
    for n in (16, 1000, 2000, 5973, 6000):
        got = spark.range(1, n + 1).select("id", percent_score(F.col("id").cast("double") / n).alias("s")).orderBy("id").collect()
        want = duckdb.sql(f"select round(100.0 * (cast(i as double) / {n}), 1) from range(1, {n + 1}) t(i) order by i").fetchall()
        assert [r.s for r in got] == [w for (w,) in want]


def test_latest_per_key(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), ("b", 5, "w"), ("a", 2, "c")], "k string, y int, s string")
    assert rows(latest_per_key(df, ["k"], ["y"], ["s"])) == [("a", "c", 2), ("b", "w", 5)]
    assert latest_per_key(df, ["k"], ["y"], ["s"], keep="rn").filter("rn = 1").count() == 2
    assert "WindowGroupLimit" in latest_per_key(df, ["k"], ["y"])._jdf.queryExecution().executedPlan().toString()
