"""The registered queries: each runs library operators over relations derived from whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankmill.functions import numbers, text
from rankmill.operators import geo, groups, lattice, lines as line_ops, quality, rank, reshape, select, trend as trend_ops
from rankmill.operators.lines import LineFamily
from rankmill.plans import dashboards, marts
from rankmill.session import stored
from rankmill.sources import geo as geo_source, lines as line_source, sniff, tables
from rankmill.sources.features import feature_objects
from rankmill.sources.records import join_quoted_lines
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Cents run into the millions; four digits are far above the noise of adding doubles.
DIGITS = 4
HEADERS = ["Kommun;%", "Valt år:%", "Statistik%"]
FIELDS = ["kommun", "kommun_kod", "lan", "lan_kod", "huvudman_typ", "amne", "andel", "antal"]
RESULTS = LineFamily(
    prefix="results",
    boilerplate=HEADERS,
    year="lasar_start",
    columns=FIELDS,
    domain={"amne": [f"S{i}" for i in range(1, 7)]},
)
TRIMMED = LineFamily(boilerplate=HEADERS, columns=[*FIELDS, "saknas"], trimmed=True)
PROVIDERS = ("O", "F")


def _document_lines(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    """A text column as the lines of one file per row: (source_file, at, raw_line)."""
    rows = views.table(spark, sf_dir, name).select(F.col(key).cast("string").alias("source_file"), F.split(text, "\n").alias("lines"))
    parts = rows.select("source_file", F.posexplode("lines").alias("row", "raw_line"))
    return parts.select("source_file", F.struct(F.lit(0).alias("block"), "row").alias("at"), "raw_line")


def _document_files(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return views.table(spark, sf_dir, name).select(F.col(key).cast("string").alias("source_file"))


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


# ---- Raw lines ----


@register
def lines_count_by_source(spark, sf_dir):
    return line_ops.count_by_file(views.lines(spark, sf_dir))


@register
def lines_count_matching(spark, sf_dir):
    return line_ops.count_by_file(views.lines(spark, sf_dir), ["%src1%", "%c7"])


@register
def lines_nonblank(spark, sf_dir):
    return views.lines(spark, sf_dir).filter(~text.is_blank("raw_line"))


@register
def distinct_lines(spark, sf_dir):
    return views.lines(spark, sf_dir).distinct()


@register
def drop_boilerplate(spark, sf_dir):
    return line_ops.drop_boilerplate(views.raw(spark, sf_dir), HEADERS)


@register
def extract_url(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    return line_ops.with_url(
        pages.select(
            F.concat(F.col("html"), F.lit(" ("), F.col("url"), F.lit(");")).alias("raw_line"),
            F.col("page_id").cast("string").alias("source_file"),
        )
    )


@register
def latest_load_only(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    return line_source.latest_load(
        orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("string").alias("load_id"))
    )


@register
def sniff_delimiter(spark, sf_dir):
    facts = sniff.sniff(_document_lines(spark, sf_dir, "documents", "doc_id", "text"))
    return facts.select(F.col("source_file").cast("bigint").alias("doc_id"), "sep", "start", "n_seps")


@register
def read_sniffed(spark, sf_dir):
    rows = sniff.table_rows(_document_lines(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select(
        F.col("source_file").cast("bigint").alias("doc_id"),
        F.col("at.row").alias("ln"),
        F.col("header_line").alias("header"),
        F.size("header").alias("n_names"),
        "raw_line",
        F.size("fields").alias("n_fields"),
    )


@register
def quoted_records(spark, sf_dir):
    """Each document a file of numbered records: three lines of its text in one quoted field, blocks cut anywhere."""
    text = views.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    bodies = F.transform(F.sequence(F.lit(0), ((F.size("lines") - 1) / 3).cast("int")), lambda i: F.array_join(F.slice("lines", i * 3 + 1, F.lit(3)), "\n"))
    records = F.transform(bodies, lambda b, i: F.concat(i.cast("string"), F.lit(';"'), F.replace(b, F.lit('"'), F.lit('""')), F.lit('"')))
    parts = text.select("doc_id", F.posexplode(F.split(F.array_join(records, "\n"), "\n")).alias("row", "raw_line"))
    at = F.struct((F.col("row") / 7).cast("int").alias("block"), "row").alias("at")
    found = join_quoted_lines(parts.select(F.col("doc_id").cast("string").alias("source_file"), at, "raw_line"))
    fields = found.select("source_file", sniff.split_by(F.col("raw_line"), F.lit(";")).alias("fields"))
    return fields.select(
        F.col("source_file").cast("bigint").alias("doc_id"),
        F.size("fields").alias("n_fields"),
        F.col("fields")[0].cast("bigint").alias("record"),
        F.col("fields")[1].alias("body"),
    )


@register
def file_load_status(spark, sf_dir):
    status = sniff.load_status(
        _document_lines(spark, sf_dir, "pages", "page_id", "html"), _document_files(spark, sf_dir, "pages", "page_id")
    )
    return status.withColumn("page_id", F.col("source_file").cast("bigint")).drop("source_file")


@register
def file_status_counts(spark, sf_dir):
    lines = _document_lines(spark, sf_dir, "documents", "doc_id", "text")
    return sniff.status_counts(sniff.load_status(lines, _document_files(spark, sf_dir, "documents", "doc_id")))


# ---- Parsing and cleaning ----


@register
def parse_results_lines(spark, sf_dir):
    parsed = RESULTS.parse(views.raw(spark, sf_dir))
    return parsed.withColumns({"andel": numbers.marked_share("andel"), "antal": numbers.marked_count("antal")})


@register
def parse_split_part(spark, sf_dir):
    return TRIMMED.parse(views.raw(spark, sf_dir))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RESULTS.parse(views.raw(spark, sf_dir)).select("lasar_start", "kommun_kod", "huvudman_typ", "amne", "andel", "antal")


def _with(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    keys = ["lasar_start", "kommun_kod", "huvudman_typ", "amne"]
    return _fields(spark, sf_dir).select(*keys, *[c.alias(n) for n, c in columns.items()])


@register
def clean_decimal_comma(spark, sf_dir):
    return _with(spark, sf_dir, andel=numbers.share_value("andel"))


@register
def clean_thousands(spark, sf_dir):
    decimal = numbers.lenient_int(numbers.comma_to_point("andel"))
    return _with(spark, sf_dir, antal=numbers.count_value("antal"), andel_heltal=decimal)


@register
def clean_sentinels(spark, sf_dir):
    return _with(spark, sf_dir, andel=numbers.marked_share("andel"), antal=numbers.marked_count("antal"))


@register
def clean_sentinels_strict(spark, sf_dir):
    return _with(spark, sf_dir, andel=numbers.strict_share("andel"))


@register
def clean_count_nbsp(spark, sf_dir):
    return _with(spark, sf_dir, antal=numbers.strict_count(F.replace("antal", F.lit(" "), F.lit(numbers.NBSP))))


@register
def normalize_year(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    label = F.when(F.col("o_orderkey") % 3 == 0, year * 10000 + year + 1).otherwise(year)
    return orders.select("o_orderkey", text.normal_year(label).alias("year"))


@register
def normalize_category(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer")
    needles = {"auto": "Car", "build": "House", "mach": "Works"}
    return customers.select("c_custkey", text.normal_category("c_mktsegment", needles).alias("category"))


@register
def pad_code(spark, sf_dir):
    customers = views.table(spark, sf_dir, "customer")
    return customers.select(
        "c_custkey", text.pad_code("c_custkey", 3).alias("padded"), text.zero_fill("c_custkey", 3).alias("filled")
    )


@register
def gender_gap(spark, sf_dir):
    return views.results(spark, sf_dir).select(
        "year", "kommun", "huvudman_typ", "subject", "f", "m", groups.gap("f", "m").alias("gap_f_minus_m")
    )


# ---- Ranks, fairness, trend ----


def _choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.choice(views.tests(spark, sf_dir), DIGITS)


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Results are grouped by year, so a series has one row per year.
    return marts.trend(_choice(spark, sf_dir), one_row_per_year=True)


@register
def percentile_score(spark, sf_dir):
    return _choice(spark, sf_dir)


@register
def rank_marts(spark, sf_dir):
    return marts.ranked_municipalities(views.tests(spark, sf_dir, "coarse"), DIGITS)


@register
def rollup_all(spark, sf_dir):
    return groups.with_rollup_rows(
        views.results(spark, sf_dir),
        ["year", "kommun", "lan", "huvudman_typ"],
        "subject",
        ["total", "f", "m"],
        {"gap": groups.gap("f", "m")},
        digits=DIGITS,
    )


@register
def fairness(spark, sf_dir):
    # the ranks read their input twice, and the scores were ranked themselves
    return marts.fairness(_choice(spark, sf_dir))


@register
def yoy_trend(spark, sf_dir):
    return _trend(spark, sf_dir)


@register
def previous_year_any_rows(spark, sf_dir):
    """Previous year's values where a series may have any number of rows per year."""
    orders = views.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    )
    return trend_ops.with_previous(orders, ["o_custkey"], "year", {"cents_prev_year": "cents"})


# ---- Shares and means ----


@register
def share_of_total(spark, sf_dir):
    return groups.share_of_total(views.share(spark, sf_dir), ["year", "kommun", "lan"], "n_students")


@register
def share_recomputed(spark, sf_dir):
    return groups.recomputed_share(views.share(spark, sf_dir), "kommun", "n_students")


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = {c: F.round(F.col(f"l_{c}") * 100).cast("bigint") for c in ("discount", "tax")}
    return views.table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("kon"),
        "l_returnflag",
        F.col("l_quantity").cast("bigint").alias("antal"),
        *[F.nullif(p, F.lit(0).cast("bigint")).alias(c) for c, p in percent.items()],
    )


@register
def weighted_mean_by_group(spark, sf_dir):
    rows = _weighed(spark, sf_dir).filter(F.col("l_returnflag").isin("A", "R"))
    return rows.groupBy("kon").agg(
        F.round(groups.weighted_mean("discount", "antal"), 10).alias("discount"),
        F.round(groups.weighted_mean("tax", "antal"), 10).alias("tax"),
    )


@register
def weighted_mean_long(spark, sf_dir):
    labels = {"discount": "Rabatt", "tax": "Moms/Skatt"}
    return dashboards.eligibility_rows(
        marts.weighted_long(_weighed(spark, sf_dir), "kon", labels, "antal", "program", "behorighet_pct")
    )


# ---- Latest rows ----


@register
def dedup_latest_source(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    rows = orders.select("o_custkey", "year", "o_orderpriority", "o_orderdate", "o_orderkey")
    return rank.latest_per_key(rows, ["o_custkey", "year"], ["o_orderdate"], ["o_orderkey"])


@register
def latest_per_key(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return rank.latest_per_key(orders, ["o_custkey", "o_orderstatus"], ["o_orderdate"], ["o_orderkey"], keep="rn")


# ---- Selection ----


@register
def table_head(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey").limit(25)


@register
def loaded_table(spark, sf_dir):
    views.table(spark, sf_dir, "supplier").createOrReplaceTempView("kept_supplier")
    return tables.load_table(spark, "kept_supplier").select("s_suppkey", "s_name")


@register
def parameter_query(spark, sf_dir):
    sql = "select o_orderkey, o_orderstatus from {orders} where o_orderstatus = :status and o_orderkey >= :least"
    return tables.query(spark, sql, {"status": "F", "least": 100}, orders=views.table(spark, sf_dir, "orders"))


@register
def optional_filters(spark, sf_dir):
    rows = views.results(spark, sf_dir).select("year", "kommun", "lan", "huvudman_typ", "subject", "n", "cents")
    return select.optional_filters(
        rows, {"year": 1997, "lan": "All", "kommun": None, "huvudman_typ": "N", "subject": "ALL"}
    )


@register
def option_list(spark, sf_dir):
    return select.option_list(views.results(spark, sf_dir), "subject", without=["s7"])


@register
def option_list_dependent(spark, sf_dir):
    return select.option_list(views.results(spark, sf_dir), "kommun", where={"lan": "NATION_7"})


@register
def distinct_values(spark, sf_dir):
    return select.distinct_values(views.results(spark, sf_dir), "kommun")


@register
def latest_year_rows(spark, sf_dir):
    return trend_ops.at_latest(views.share(spark, sf_dir), "year")


@register
def top_bottom_n(spark, sf_dir):
    return select.top_and_bottom(
        trend_ops.at_latest(views.share(spark, sf_dir), "year"), "n_students", 10, ["kommun", "huvudman_typ"]
    )


@register
def metric_by_year(spark, sf_dir):
    tests = views.tests(spark, sf_dir, "coarse").filter(F.col("lasar_start") == 1998)
    return dashboards.ranking_map(marts.ranked_municipalities(tests, DIGITS), 1998, "avg_total")


@register
def point_lookup(spark, sf_dir):
    rows = views.results(spark, sf_dir).select("kommun_kod", "kommun", "year", "huvudman_typ", "subject", "n")
    return select.lookup(rows, "kommun_kod", 7, 6)


# ---- Dashboard queries ----


@register
def trend_series(spark, sf_dir):
    # here and below: the series are read twice, for their latest year and for the rest
    return dashboards.trend_series(_trend(spark, sf_dir), lan="All", digits=DIGITS)


@register
def trend_series_by_provider(spark, sf_dir):
    return dashboards.trend_series(_trend(spark, sf_dir), subject="S2", huvudman="N", digits=DIGITS)


@register
def trend_series_lattice(spark, sf_dir):
    """The same answer from sums and counts by sets of dimensions."""
    levels = [["year", "lan", "kommun", "huvudman_typ", "subject"], ["year", "lan", "huvudman_typ", "subject"], ["year", "huvudman_typ", "subject"], ["year", "subject"]]
    sums = lattice.build(_choice(spark, sf_dir), levels, ["score"])
    return dashboards.trend_series_from(sums, subject="S2", huvudman="N", digits=DIGITS)


@register
def series_last_point(spark, sf_dir):
    return trend_ops.at_latest(stored(dashboards.trend_series(_trend(spark, sf_dir), digits=DIGITS)), "year")


@register
def series_own_last_point(spark, sf_dir):
    rows = views.share(spark, sf_dir).groupBy("kommun", "year").agg(F.sum("n_students").alias("n_students"))
    return trend_ops.last_points(rows, "kommun", "year", "n_students")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.results(spark, sf_dir).withColumnsRenamed({"f": "betygpoang_flickor", "m": "betygpoang_pojkar"})


@register
def gap_topn(spark, sf_dir):
    return dashboards.top_gaps(_gaps(spark, sf_dir), year="1997", digits=DIGITS)


@register
def gap_long(spark, sf_dir):
    return dashboards.top_gaps_long(dashboards.top_gaps(_gaps(spark, sf_dir), year="not a year", digits=DIGITS))


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.share_of_total(views.share(spark, sf_dir), ["year", "kommun", "lan"], "n_students")


@register
def topn_semijoin(spark, sf_dir):
    return dashboards.provider_shares(_shares(spark, sf_dir), year="1997", providers=PROVIDERS)


@register
def order_by_pivot_share(spark, sf_dir):
    rows = dashboards.provider_shares(_shares(spark, sf_dir), year=1998, providers=PROVIDERS)
    return dashboards.ordered_by_share(rows, PROVIDERS, "F")


@register
def axis_range(spark, sf_dir):
    return dashboards.share_axis(dashboards.provider_shares(_shares(spark, sf_dir), year=1997, providers=PROVIDERS))


@register
def share_trend(spark, sf_dir):
    return dashboards.independent_share_over_time(views.share(spark, sf_dir), providers=PROVIDERS)


@register
def shares_filled(spark, sf_dir):
    """Where the mart has no share, the part of the municipality's pupils."""
    shares = _shares(spark, sf_dir).withColumn("share", F.when(F.col("n_students") % 3 != 0, F.col("share")))
    return dashboards.provider_shares(shares, year=1997, providers=PROVIDERS, fill_shares=True)


@register
def school_choice(spark, sf_dir):
    """The mart over untyped rows, some of them with a negative, missing or unreadable number of pupils."""
    n = F.col("n_students")
    text = F.when(n % 7 == 0, "-5").when(n % 11 == 0, None).when(n % 13 == 0, "..").otherwise(n.cast("string"))
    pupils = views.share(spark, sf_dir).select(
        F.col("year").cast("string").alias("lasar_start"),
        "kommun",
        "lan",
        F.when(F.col("huvudman_typ") == "O", "Kommunal huvudman").otherwise("enskild").alias("huvudman_typ"),
        text.alias("elever_totalt_1_9"),
    )
    return marts.school_choice(pupils)


@register
def gap_topn_fairness(spark, sf_dir):
    mart = marts.fairness(_choice(spark, sf_dir))
    return dashboards.top_gaps(mart, year=1997, digits=DIGITS)


@register
def trend_any_rows(spark, sf_dir):
    """The mart without the knowledge that a series has one row per year."""
    return marts.trend(_choice(spark, sf_dir))


# ---- Budget ----


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").select(
        text.zero_fill("o_custkey", 4).alias("kommun_kod"),
        F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("kommun"),
        F.year("o_orderdate").alias("lasar_start"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("totalt_per_elev"),
        "o_orderkey",
    )


def _yearly_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.latest_per_key(_budget(spark, sf_dir), ["kommun_kod", "lasar_start"], ["totalt_per_elev"], ["o_orderkey"])
    return rows.drop("o_orderkey")


@register
def budget_rows(spark, sf_dir):
    return dashboards.budget_rows(_yearly_budget(spark, sf_dir))


@register
def budget_map(spark, sf_dir):
    features = geo.municipality_features(views.squares(spark, sf_dir)).select("kommun_kod", "geometry")
    return dashboards.budget_map(_yearly_budget(spark, sf_dir), features, 1997).select("kommun_kod", "totalt_per_elev")


@register
def budget_extremes(spark, sf_dir):
    return dashboards.budget_extremes(_yearly_budget(spark, sf_dir), 1996)


# ---- Wide files ----


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.pass_rates(views.wide(spark, sf_dir), "huvudman_typ", "subject", ("A", "N"))


@register
def melt_years(spark, sf_dir):
    return reshape.melt_years(views.wide(spark, sf_dir), ["kommun", "huvudman_typ", "subject"])


@register
def passrate_trend(spark, sf_dir):
    return dashboards.pass_rate_trend(_rates(spark, sf_dir), "huvudman_typ", ("A", "N"))


@register
def passrate_by_subject(spark, sf_dir):
    return dashboards.pass_rate_by_subject(views.wide(spark, sf_dir), "huvudman_typ", "subject", ("A", "N"))


@register
def delta_last_two_years(spark, sf_dir):
    return dashboards.pass_rate_change(_rates(spark, sf_dir), "huvudman_typ", "subject", "N", "S2")


@register
def mean_over_time(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), "l_returnflag", F.col("l_quantity").alias("value")
    )
    return reshape.mean_over_time(rows, "year", "value", "l_returnflag", ("A", "N", "R"))


# ---- Map features ----


@register
def geo_codes(spark, sf_dir):
    return geo.municipality_features(views.squares(spark, sf_dir)).drop("geometry")


@register
def geo_bbox_filter(spark, sf_dir):
    return geo.in_box(geo.municipality_features(views.squares(spark, sf_dir))).select("kommun_kod")


@register
def geo_join_values(spark, sf_dir):
    features = geo.municipality_features(views.squares(spark, sf_dir)).select("kommun", "kommun_kod")
    orders = views.table(spark, sf_dir, "orders")
    values = orders.groupBy(text.zero_fill("o_custkey", 4).alias("kommun_kod")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    )
    return geo.join_values(features, values, "kommun_kod")


@register
def geo_feature_json(spark, sf_dir):
    return geo_source.feature_json(geo.municipality_features(views.squares(spark, sf_dir)))


@register
def geo_simplify(spark, sf_dir):
    """Squares with points on, and within the tolerance of, their sides: the corners stay."""
    return geo_source.feature_json(geo.simplify(views.notched(spark, sf_dir), 0.01))


@register
def geo_simplify_borders(spark, sf_dir):
    thinned = geo.simplify_borders(views.cells(spark, sf_dir), 0.01)
    ring = F.col("geometry")[0][0]
    points = thinned.select("c_custkey", F.explode(F.slice(ring, F.lit(1), F.size(ring) - 1)).alias("p"))
    return points.select("c_custkey", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@register
def geo_collection(spark, sf_dir):
    """FeatureCollections of a hundred features each, read back from pieces; names hold braces and quotes."""
    squares = views.squares(spark, sf_dir).withColumn("key", F.expr("cast(substr(id, 3) as bigint)"))
    named = squares.select("key", "id", F.concat(F.trim("kom_namn"), F.lit(' {"}[\\')).alias("label"), "geometry")
    text = "feature"
    features = geo_source.feature_json(named, text).select(text, F.get_json_object(text, "$.properties.key").cast("bigint").alias("key"))
    listed = features.groupBy(F.expr("key div 100").alias("source_file")).agg(F.array_join(F.sort_array(F.collect_list(text)), ", ").alias("all"))
    whole = F.concat(F.lit('{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "{x}"}}, "features": ['), "all", F.lit("]}"))
    pieces = listed.select("source_file", F.posexplode(F.split(whole, r"\}")).alias("row", "piece"))
    at = F.struct(F.expr("row div 13").alias("block"), "row").alias("at")
    found = feature_objects(pieces.select("source_file", at, "piece"))
    parsed = geo_source.parse_features(found, ["id", "label"])
    return parsed.select("id", "label", geo.extent("geometry").alias("e")).select("id", "label", "e.*")


@register
def geo_reproject(spark, sf_dir):
    """Squares of five kilometres on the national grid, as lon/lat to seven decimals."""
    key = F.col("c_custkey")
    x, y = F.lit(300_000.0) + (key % 97) * 5000.0, F.lit(6_100_000.0) + (key % 301) * 5000.0
    ring = F.array(F.array(x, y), F.array(x + 5000.0, y), F.array(x + 5000.0, y + 5000.0), F.array(x, y))
    plane = views.table(spark, sf_dir, "customer").select("c_custkey", F.array(F.array(ring)).alias("geometry"))
    turned = geo.to_lon_lat(plane, 3006).select("c_custkey", "srid", F.posexplode(F.flatten(F.flatten("geometry"))).alias("corner", "p"))
    return turned.select("c_custkey", "srid", "corner", F.round(F.col("p")[0], 7).alias("lon"), F.round(F.col("p")[1], 7).alias("lat"))


@register
def geo_srid(spark, sf_dir):
    return geo.with_srid(views.squares(spark, sf_dir)).select("id", "srid")


# ---- Data tests ----


@register
def expect_not_null(spark, sf_dir):
    parsed = RESULTS.parse(views.raw(spark, sf_dir)).withColumn("andel", numbers.marked_share("andel"))
    return quality.expect_not_null(parsed, "results", ["kommun", "andel", "antal", "source_file"])
