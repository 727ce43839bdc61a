"""Records of delimited files whose quoted fields hold line ends, joined from lines.

A line begins a record if the quotes before it in its file pair up. That is a prefix sum over the whole
file, taken in two steps: the quotes of each block of the file are counted where the lines lie, the
running parity goes over the blocks only, and then each block is cut by itself. So one huge file splits like
any other. Blocks without a line that opens or closes a quoted field, most of them as a rule, are not shuffled;
of the others only the lines of records that span lines are grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rankmill.operators.joins import join_per_key


def join_quoted_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (source_file, at, raw_line, ...) with those of one record joined by a line feed.

    A record has the place, and the other columns, of its first line. Every quote counts, as in files whose fields are
    quoted whole. In a file whose quotes don't pair up each line stays a record.
    """
    others = [c for c in lines.columns if c not in ("source_file", "at", "raw_line")]
    quotes = F.length("raw_line") - F.length(F.replace("raw_line", F.lit('"'), F.lit("")))
    marked = lines.withColumns({"_odd": F.coalesce(quotes % 2, F.lit(0)), "_block": F.col("at.block")})

    parities = marked.groupBy("source_file", "_block").agg(F.sum("_odd").alias("_n"))
    file = Window.partitionBy("source_file")
    earlier = file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parities = parities.select(
        "source_file",
        "_block",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) % 2).alias("_open"),
        ((F.sum("_n").over(file) % 2 == 0) & ((F.col("_n") > 0) | (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) % 2 == 1))).alias("_cut"),
    )
    placed = join_per_key(marked, parities, ["source_file", "_block"])
    plain = placed.filter(~F.col("_cut")).select(*lines.columns)

    within = Window.partitionBy("source_file", "_block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mixed = placed.filter("_cut").withColumn("_before", F.sum("_odd").over(within) - F.col("_odd") + F.col("_open"))
    mixed = mixed.withColumn("_starts", (F.col("_before") % 2 == 0).cast("int"))
    starts = mixed.groupBy("source_file", "_block").agg(F.sum("_starts").alias("_n"))
    starts = starts.select("source_file", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_records"))
    mixed = join_per_key(mixed.withColumn("_own", F.sum("_starts").over(within)), starts, ["source_file", "_block"])

    alone = (F.col("_starts") == 1) & (F.col("_odd") == 0)
    first = lambda c: F.min_by(c, "at").alias(c)
    parts = F.array_sort(F.collect_list(F.struct("at", "raw_line")))
    spanning = mixed.filter(~alone).groupBy("source_file", (F.col("_records") + F.col("_own")).alias("_record"))
    joined = spanning.agg(parts.alias("_parts"), *map(first, others)).select(
        "source_file", F.col("_parts")[0]["at"].alias("at"), F.array_join(F.col("_parts.raw_line"), "\n").alias("raw_line"), *others
    )
    return plain.unionByName(mixed.filter(alone).select(*lines.columns)).unionByName(joined.select(*lines.columns))
