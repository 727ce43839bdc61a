import duckdb
import pytest
from hypothesis import HealthCheck, example, given, settings, strategies as st
from pyspark.sql import functions as F

from rankmill.functions import numbers, text

TOKENS = [
    "2.5", "3.5", "-2.5", "2.49", "1e3", "1.25e1", "1e-1", "5.", ".5", "1_000", "1__0", "_1", " 12 ", "+5",
    "2147483648", "12d", "12f", "", ". ", "e5", "1.5e", "2,5", "12\t", "- 5", "--5", "1_0.5", "1.2.3",
    "2147483647.4", "2147483647.5", "1e10", "007", "-0", "1E3", "+.5", "+", "TRUE", "12.5 kr", "~100", "..",
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def sql_cast(values, kind):
    con = duckdb.connect()
    return [con.execute(f"select try_cast(? as {kind})", [v]).fetchall()[0][0] for v in values]


@pytest.mark.parametrize("kind,expr", [
    ("integer", lambda: numbers.lenient_int("c")),
    ("bigint", lambda: numbers.lenient_int("c", "bigint")),
    ("double", lambda: numbers.lenient_double("c")),
])
def test_lenient_numbers_agree_with_sql(spark, kind, expr):
    assert column(spark, TOKENS, expr()) == sql_cast(TOKENS, kind)


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789.,+-_ ~d", max_size=8), min_size=40, max_size=60))
@example(["+5", "-5", "+", "-"])
def test_lenient_numbers_agree_on_any_text(spark, values):
    values = [v.replace("+-", "-") for v in values]  # the SQL cast to double skips one plus sign before a minus
    assert column(spark, values, numbers.lenient_int("c")) == sql_cast(values, "integer")
    assert column(spark, values, numbers.lenient_double("c")) == sql_cast(values, "double")


def test_cleaning(spark):
    assert column(spark, ["97,5", "3 877", "..", None, "12.5"], numbers.share_value("c")) == [97.5, None, None, None, 12.5]
    assert column(spark, ["3 877", "1 234", "..", "12.5"], numbers.count_value("c")) == [3877, 1234, None, 13]
    assert column(spark, ["3 877", "1 234"], numbers.count_value("c", nbsp=False)) == [3877, None]
    assert column(spark, ["~100", "..", "95,2", "."], numbers.marked_share("c")) == [100.0, None, 95.2, None]
    assert column(spark, [". .", "1 000"], numbers.marked_count("c")) == [None, 1000]


def test_strict_cleaning(spark):
    good = ["~100", "..", ".", "", "95,5", None]
    assert column(spark, good, numbers.strict_share("c")) == [100.0, None, None, None, 95.5, None]
    assert column(spark, ["1 234", "1 2", "..", " . ", ""], numbers.strict_count("c")) == [1234, 12, None, None, None]
    for bad in ("n/a", "~99"):
        with pytest.raises(Exception, match="not a number"):
            column(spark, [bad], numbers.strict_share("c"))


def test_fields(spark):
    lines = ["a;b;c", "a", "", "a;;c"]
    assert column(spark, lines, text.field("c", 2)) == ["b", None, None, ""]
    assert column(spark, lines, text.field("c", 1)) == ["a", "a", "", "a"]
    assert column(spark, [" a ; b ;", "x"], text.trimmed_field("c", 2)) == ["b", ""]
    assert column(spark, ["a|b"], text.field("c", 2, "|")) == ["b"]


def test_blank_and_strip(spark):
    odd = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    values = [odd, "", f"{odd}x{odd}", " ", "​"]
    assert column(spark, values, text.is_blank("c")) == [not v.strip() for v in values]
    assert column(spark, values, text.strip("c")) == [v.strip() for v in values]
    con = duckdb.connect()
    want = [con.execute("select trim(?)", [v]).fetchall()[0][0] for v in ["\t a ", " a "]]
    assert column(spark, ["\t a ", " a "], text.trim_spaces("c")) == want


def test_codes(spark):
    codes = ["7", "114", "12345", "-7", "+1", ""]
    assert column(spark, codes, text.zero_fill("c", 4)) == [c.zfill(4) for c in codes]
    assert column(spark, codes[:3], text.pad_code("c", 4)) == ["0007", "0114", "1234"]
    assert column(spark, ["SE 01-80"], text.only_digits("c")) == ["0180"]


def test_years_categories_urls(spark):
    assert column(spark, ["results 2024 Kommun.csv", "x20251.csv", "none"], text.year_in_name("c")) == [2024, 2025, None]
    years = spark.createDataFrame([(2024,), (20242025,), (1899,), (19,)], "y int")
    assert [r[0] for r in years.select(text.normal_year("y")).collect()] == [2024, 2024, 1899, 19]
    needles = {"enskild": "Enskild", "kommunal": "Kommunal", "samtliga": "Samtliga"}
    values = ["Kommunal och ENSKILD", "kommunal", "Samtliga huvudmän", "Annat"]
    assert column(spark, values, text.normal_category("c", needles)) == ["Enskild", "Kommunal", "Samtliga", "Annat"]
    urls = ["se https://www.x.se/a?b=1; slut", '"http://y.se"', "ftp://z", None]
    assert column(spark, urls, text.first_url("c")) == ["https://www.x.se/a?b=1", "http://y.se", None, None]
    assert column(spark, ["2015/16", "x", ""], text.school_year_start("c")) == [2015, -1, -1]


def test_like_any(spark):
    assert column(spark, ["abc", "xbc"], text.like_any("c", ["a%", "q%"])) == [True, False]
    assert column(spark, ["abc"], text.like_any("c", [])) == [False]
