import itertools
import random

import pytest
from pyspark.sql import functions as F

from rankmill.operators import lattice
from rankmill.plans import dashboards

SCHEMA = "year int, lan string, kommun string, huvudman_typ string, subject string, score double"


@pytest.fixture(scope="module")
def mart(spark):
    rng = random.Random(5)
    pick = lambda *of: rng.choice(of)
    rows = [
        (pick(2018, 2019, 2022, None), pick("L1", "L2", None), pick("K1", "K2", "K3"), pick("Kommunal", "Enskild", None), pick("ALL", "S1", "S2"), pick(None, 10.0, 20.5, 33.3))
        for _ in range(400)
    ] + [(2024, "L1", "K1", "Kommunal", "S1", None)]  # the latest year has no score
    return spark.createDataFrame(rows, SCHEMA)


LEVELS = [["year", "lan", "kommun", "huvudman_typ", "subject"], ["year", "lan", "subject"], ["year", "huvudman_typ", "subject"], ["year", "subject"]]


@pytest.mark.parametrize("path", [None, "lattice"])
def test_answers_equal_direct_means(spark, mart, tmp_path, path):
    made = lattice.build(mart, LEVELS, ["score"], path and str(tmp_path / path))
    direct = lambda **chosen: dashboards.trend_series(mart, **chosen)
    for lan, huvudman, subject in itertools.product([None, "L1"], ["All", "Enskild"], [None, "S2"]):
        chosen = {"lan": lan, "huvudman": huvudman, "subject": subject}
        assert dashboards.trend_series_from(made, **chosen).collect() == direct(**chosen).collect(), chosen


def test_the_smallest_level_answers(mart):
    made = lattice.build(mart, LEVELS, ["score"])
    dims = lambda *d: made.levels[made.level_of(d)]
    assert dims("year") == dims("subject", "year") == {"year", "subject"}
    assert dims("lan") == {"year", "lan", "subject"}
    assert dims("lan", "huvudman_typ") == set(LEVELS[0])
    rows = made.rows(["year", "subject"])
    want = mart.groupBy("year", "subject").agg(F.sum("score").alias("score_sum"), F.count("score").alias("score_n"))
    key = lambda r: (str(r.year), r.subject)
    got = sorted(((key(r), r.score_n, round(r.score_sum or 0, 6)) for r in rows.collect()))
    assert got == sorted(((key(r), r.score_n, round(r.score_sum or 0, 6)) for r in want.collect()))
    with pytest.raises(ValueError, match="no level has"):
        made.level_of(["provider"])


def test_only_one_level_is_read(spark, mart, tmp_path):
    made = lattice.build(mart, LEVELS, ["score"], str(tmp_path / "levels"))
    plan = made.rows(["year", "subject"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_level" in plan
