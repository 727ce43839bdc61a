"""Relations in the shape of the school statistics, derived from the driver's tables.

Entity = supplier, county = nation, provider = return flag, subject = line number, year = ship
year, girls / boys = line status. Prices enter as whole cents, so sums and ranks are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(sums: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per supplier key with the supplier and its nation."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return sums.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year x kommun x provider x subject with whole mean cents, in all and per line status.

    Items are aggregated by supplier key, combining on the map side, before names are joined on.
    """
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    girls, boys = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag", "l_linenumber")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(cents).alias("cents"),
            F.sum(F.when(girls, cents)).alias("f_cents"),
            F.count_if(girls).alias("f_n"),
            F.sum(F.when(boys, cents)).alias("m_cents"),
            F.count_if(boys).alias("m_n"),
        )
    )

    def mean_of(total: str, n: str) -> Column:
        # Whole cents, so that sums of them are exact in any order.
        count = F.nullif(F.col(n), F.lit(0).cast("bigint"))
        return (F.col(total) - F.col(total) % count).cast("double") / count

    return _named(sums, spark, sf_dir).select(
        "year",
        F.col("s_name").alias("kommun"),
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("kommun_kod"),
        F.col("n_name").alias("lan"),
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("lan_kod"),
        F.col("l_returnflag").alias("huvudman_typ"),
        F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("subject"),
        "n",
        "cents",
        mean_of("cents", "n").alias("total"),
        mean_of("f_cents", "f_n").alias("f"),
        mean_of("m_cents", "m_n").alias("m"),
    )


def tests(spark: SparkSession, sf_dir: str, subject: str = "subject") -> DataFrame:
    """Results under the column names of typed test results."""
    coarse = F.when(F.col("subject") <= "S3", "low").otherwise("high")
    return results(spark, sf_dir).select(
        F.col("year").alias("lasar_start"),
        "kommun",
        "kommun_kod",
        "lan",
        "lan_kod",
        "huvudman_typ",
        (coarse if subject == "coarse" else F.col("subject")).alias("amne"),
        F.col("total").alias("betygspoang_totalt"),
        F.col("f").alias("betygspoang_flickor"),
        F.col("m").alias("betygspoang_pojkar"),
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as raw lines with sentinels, decimal commas and spaced thousands, plus header and
    preamble lines."""
    cents, n = F.col("cents"), F.col("n")

    def text(c: Column) -> Column:
        return c.cast("bigint").cast("string")

    mark = (
        F.when(n < 2, "..")
        .when(n % 5 == 0, "~100")
        .otherwise(F.concat(text(F.floor(cents / 10) % 100), F.lit(","), text(cents % 10)))
    )
    spaced = F.concat(
        text(F.floor(cents / 100000)), F.lit(" "), F.lpad(text(F.floor(cents / 100) % 1000), 3, "0")
    )
    lines = results(spark, sf_dir).select(
        F.concat_ws(";", "kommun", "kommun_kod", "lan", "lan_kod", "huvudman_typ", "subject", mark, spaced).alias("raw_line"),
        F.concat(F.lit("results "), F.col("year").cast("string"), F.lit(" Kommun.csv")).alias("source_file"),
    )
    names = table(spark, sf_dir, "supplier").select("s_name")
    headers = names.select(
        F.concat(F.lit("Kommun;Kommun-kod;"), "s_name").alias("raw_line"), F.lit("results 1995 Kommun.csv").alias("source_file")
    )
    preamble = names.select(
        F.concat(F.lit("Valt år: "), "s_name").alias("raw_line"), F.lit("other 1996.csv").alias("source_file")
    )
    return lines.unionByName(headers).unionByName(preamble)


def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year x kommun x two providers with whole pupils."""
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_linestatus").alias("huvudman_typ"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n_students"))
    )
    return _named(sums, spark, sf_dir).select(
        "year", F.col("s_name").alias("kommun"), F.col("n_name").alias("lan"), "huvudman_typ", "n_students"
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text column per school year, per kommun, provider and subject."""
    n, cents = F.sum("n"), F.sum("cents")
    cell = F.when(n % 7 == 0, "..").otherwise(
        F.concat((n % 100).cast("string"), F.lit(","), (cents % 10).cast("string"))
    )
    cells = (
        results(spark, sf_dir)
        .groupBy("kommun", "huvudman_typ", "subject", "year")
        .agg(cell.alias("v"))
    )
    years = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
    columns = [F.max(F.when(F.col("year") == y, F.col("v"))).alias(f"{y}/{(y + 1) % 100:02d}") for y in years]
    return cells.groupBy("kommun", "huvudman_typ", "subject").agg(*columns)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    return table(spark, sf_dir, "documents").select(
        F.explode(F.split("text", "\n")).alias("raw_line"), F.col("source").alias("source_file")
    )


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half-degree square per customer, on a grid of quarter degrees."""
    key = F.col("c_custkey")
    x0 = F.lit(9.0) + (key % 67).cast("double") * 0.25
    y0 = F.lit(54.0) + (key % 71).cast("double") * 0.25
    x1, y1 = x0 + 0.5, y0 + 0.5
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("SE"), key.cast("string")).alias("id"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")).alias("kom_namn"),
        F.col("c_nationkey").cast("string").alias("lan_code"),
        F.array(F.array(ring)).alias("geometry"),
    )


def notched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squares with three more points on each side, none of them farther from it than 1/128."""
    key = F.col("c_custkey")
    x0 = F.lit(9.0) + (key % 67).cast("double") * 0.25
    y0 = F.lit(54.0) + (key % 71).cast("double") * 0.25
    corners = [(x0, y0), (x0 + 0.5, y0), (x0 + 0.5, y0 + 0.5), (x0, y0 + 0.5)]
    points = []
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        points.append(F.array(ax, ay))
        for part, off in ((0.25, 0.0), (0.5, 1 / 128), (0.75, -1 / 256)):
            # the side's normal is its direction turned by a right angle; sides are half a degree long
            points.append(F.array(ax + (bx - ax) * part - (by - ay) * 2 * off, ay + (by - ay) * part + (bx - ax) * 2 * off))
    return table(spark, sf_dir, "customer").select(
        zero_code(key).alias("kommun_kod"), F.array(F.array(F.array(*points, points[0]))).alias("geometry")
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a grid, 30 in a row, one per customer; each side belongs to both neighbours.

    A side has a bulge of 1/16 in its middle, or three points no farther from it than 1/128.
    """
    key = F.col("c_custkey")

    def at(column: Column, row: Column) -> tuple[Column, Column]:
        return F.lit(9.0) + column.cast("double") * 0.25, F.lit(54.0) + row.cast("double") * 0.25

    def inner(i: Column, j: Column, across: bool) -> Column:
        x, y = at(i, j)

        def point(part: float, off: float) -> Column:
            return F.array(x + part * 0.25, y + off) if across else F.array(x + off, y + part * 0.25)

        bulge = (i * 7 + j * 3 + int(across)) % 5 == 0
        return F.when(bulge, F.array(point(0.5, 1 / 16))).otherwise(F.array(point(0.25, 0.0), point(0.5, 1 / 128), point(0.75, -1 / 256)))

    i, j = key % 30, F.expr("c_custkey div 30")
    corner = lambda a, b: F.array(F.array(*at(a, b)))
    ring = F.concat(
        corner(i, j), inner(i, j, True), corner(i + 1, j), inner(i + 1, j, False), corner(i + 1, j + 1),
        F.reverse(inner(i, j + 1, True)), corner(i, j + 1), F.reverse(inner(i, j, False)), corner(i, j),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", F.array(F.array(ring)).alias("geometry"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed 48-gon with an uneven edge per customer."""
    key = F.col("c_custkey")

    def point(i: Column) -> Column:
        angle = (i % 48).cast("double") * 0.1308996938995747
        reach = F.lit(0.3) + ((key * 31 + (i % 48) * 17) % 13).cast("double") * 0.002
        x0, y0 = F.lit(9.0) + (key % 67).cast("double") * 0.25, F.lit(54.0) + (key % 71).cast("double") * 0.25
        return F.array(x0 + reach * F.cos(angle), y0 + reach * F.sin(angle))

    ring = F.transform(F.sequence(F.lit(0), F.lit(48)), point)
    return table(spark, sf_dir, "customer").select(
        zero_code(key).alias("kommun_kod"), F.array(F.array(ring)).alias("geometry")
    )


def zero_code(key: Column) -> Column:
    return F.lpad(key.cast("string"), 8, "0")
