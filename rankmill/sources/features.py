"""Features of a FeatureCollection read by many tasks.

The file is read as text that ends at closing braces instead of line ends, so it splits into blocks like any text.
Which braces and brackets count depends on whether a string is open, and how deep a piece lies on all before it:
both are prefix sums over the file, taken per block and then over the blocks (``running_before``). An object
that begins at depth two inside one array is a feature; its pieces are put together, those of one block
where they lie, and only features that cross a block's border are shuffled once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankmill.functions.text import file_name

FILE, BLOCK = "source_file", "_block"
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_TO_BRACE = r'(?s)^(?:[^"{]++|' + _STRING + r")*+\{"


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, at, piece) of JSON files cut behind each closing brace, which is left out."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.option("lineSep", "}").text(path).select(file_name().alias(FILE), at.alias("at"), F.col("value").alias("piece"))


def running_before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over all earlier rows of the file; rows have ``_block`` and ``at``."""
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(FILE, BLOCK).agg(F.sum(value).alias("_n"))
    sums = sums.select(FILE, BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(FILE, BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))
    return rows.join(sums, [FILE, BLOCK]).withColumn(name, before).drop("_base")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _outside(piece: str, in_string: int) -> Column:
    """Parts of a piece outside strings, if its start is (1) or is not (0) inside one."""
    parts = F.split(F.regexp_replace(piece, r"(?s)\\.", ""), '"')
    return F.array_join(F.filter(parts, lambda _, i: i % 2 == in_string), "")


def feature_objects(pieces: DataFrame) -> DataFrame:
    """(source_file, at, feature): the JSON text of each feature, with the place of its first piece."""
    quotes = _count(F.regexp_replace("piece", r"(?s)\\.", ""), '"')
    rows = pieces.select(FILE, "at", "piece", F.col("at.block").alias(BLOCK), (quotes % 2).alias("_odd"))
    rows = running_before(rows, "_odd", "_quotes").withColumn("_inside", F.col("_quotes") % 2)
    outside = F.when(F.col("_inside") == 1, _outside("piece", 1)).otherwise(_outside("piece", 0))
    rows = rows.withColumn("_outside", outside)
    rows = rows.withColumns({"_opened": _count(F.col("_outside"), "{"), "_arrays": _count(F.col("_outside"), "[") - _count(F.col("_outside"), "]")}).drop("_outside")
    # the brace behind a piece closes something unless it is part of a string
    closed = ((F.col("_inside") + F.col("_odd")) % 2 == 0).cast("int")
    rows = rows.withColumn("_deeper", F.col("_opened") - closed)
    rows = running_before(running_before(rows, "_deeper", "_depth"), "_arrays", "_in_arrays")

    starts = (F.col("_depth") <= 1) & (F.col("_depth") + F.col("_opened") >= 2)
    text = F.when(F.col("_inside") == 1, F.regexp_replace("piece", r'(?s)^(?:[^"\\]++|\\.)*+"', "")).otherwise(F.col("piece"))
    once = F.regexp_replace(text, _TO_BRACE, "{")
    # at depth 0 the first brace opens the document, so the object begins at the next one
    twice = F.concat(F.lit("{"), F.regexp_replace(F.substring(once, 2, 2**31 - 1), _TO_BRACE, ""))
    own = F.when(F.col("_depth") == 1, once).otherwise(twice)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(own))
    bare = F.regexp_replace(head, _STRING, "")
    listed = F.col("_in_arrays") + _count(bare, "[") - _count(bare, "]") == 1
    rows = rows.withColumns(
        {"_start": starts.cast("int"), "_feature": starts & listed, "_text": F.when(starts, own).otherwise(F.col("piece"))}
    )
    rows = running_before(rows, "_start", "_number").withColumn("_number", F.col("_number") + F.col("_start"))
    inside = rows.filter((F.col("_start") == 1) | (F.col("_depth") >= 2))

    facts = [F.bool_or("_feature").alias("_feature"), F.bool_or(F.col("_depth") + F.col("_deeper") <= 1).alias("_ends")]
    part = F.struct("at", F.concat("_text", F.lit("}")).alias("text"))
    joined = inside.groupBy(FILE, BLOCK, "_number").agg(F.array_sort(F.collect_list(part)).alias("_parts"), *facts)
    whole = F.col("_feature") & F.col("_ends")
    crossing = joined.filter(~whole).groupBy(FILE, "_number").agg(F.array_sort(F.flatten(F.collect_list("_parts"))).alias("_parts"), F.bool_or("_feature").alias("_feature"))
    done = joined.filter(whole).select(FILE, "_parts").union(crossing.filter("_feature").select(FILE, "_parts"))
    return done.select(FILE, F.col("_parts")[0]["at"].alias("at"), F.array_join(F.col("_parts.text"), "").alias("feature"))
