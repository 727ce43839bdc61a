"""Delimited files of unknown layout: encoding, separator, header line, table part.

Files are read as lines, so a big file is spread over tasks like any other. Only facts about a
file (encoding, separator, header) are aggregated to one row per file and joined back.

A line's place in its file is known only while the file is scanned, so the scanned lines are stored
with it, by columns: all later steps then agree on which line is the header.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankmill.functions.bind import let
from rankmill.functions.text import file_name, is_blank
from rankmill.operators.joins import join_per_key
from rankmill.session import stored
from rankmill.sources.records import join_quoted_lines

# Candidate separators, first wins ties; encodings in the order they are tried.
SEPARATORS = [";", ",", "\t", "|"]
UTF8, CP1252, REPLACED = "utf-8-sig", "cp1252", "utf-8(replace)"

HEAD_LINES = 60
BLOCK_GROUPS = 256

_CP1252_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
_CP1252_FROM = "".join(chr(b) for b in _CP1252_BYTES)
_CP1252_TO = "".join(bytes([b]).decode("cp1252") for b in _CP1252_BYTES)
_NOT_CP1252 = "".join(chr(b) for b in range(0x80, 0xA0) if b not in _CP1252_BYTES)


def _latin1(c: Column) -> Column:
    return F.decode(c.cast("binary"), "ISO-8859-1")


def decode_cp1252(c: Column) -> Column:
    """Text of cp1252 bytes: Latin-1 but for the characters between 0x80 and 0x9F."""
    return F.translate(_latin1(c), _CP1252_FROM, _CP1252_TO)


def read_numbered_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(source_file, at, raw_line, encoding) for every line; ``at`` orders the lines of a file.

    A file is UTF-8 if all its lines are, else cp1252 if all its bytes are, else UTF-8 with
    invalid bytes replaced.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = stored(
        spark.read.option("pathGlobFilter", glob)
        .text(path)
        .select("value", file_name().alias("source_file"), at.alias("at"))
    )
    encodings = lines.groupBy("source_file").agg(
        F.when(F.every(F.is_valid_utf8("value")), UTF8)
        .when(F.every(~_latin1(F.col("value")).rlike(f"[{_NOT_CP1252}]")), CP1252)
        .otherwise(REPLACED)
        .alias("encoding")
    )
    text = F.when(F.col("encoding") == CP1252, decode_cp1252(F.col("value"))).otherwise(F.make_valid_utf8("value"))
    return join_per_key(lines, encodings, ["source_file"]).select(
        "source_file", "at", text.alias("raw_line"), "encoding"
    )


def _occurrences(text: Column, sep: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))


def _head(lines: DataFrame, head_lines: int) -> DataFrame:
    """The first lines of each file with their number ``ln``, from 0.

    Each row_number filter becomes a group limit, so a task passes on no more than ``head_lines``
    lines of a group. Groups of blocks come first: the blocks of one huge file are then not all
    compared in one task.
    """
    order = Window.partitionBy("source_file", "_blocks").orderBy("at")
    few = lines.withColumn("_blocks", F.pmod(F.xxhash64("at.block"), F.lit(BLOCK_GROUPS)))
    few = few.withColumn("ln", F.row_number().over(order)).filter(F.col("ln") <= head_lines).drop("ln", "_blocks")
    first = few.withColumn("ln", F.row_number().over(Window.partitionBy("source_file").orderBy("at")))
    return first.filter(F.col("ln") <= head_lines).select(
        "source_file", "raw_line", "at", (F.col("ln") - 1).alias("ln")
    )


def sniff(lines: DataFrame, head_lines: int = HEAD_LINES) -> DataFrame:
    """(source_file, sep, start, n_seps, header, header_at) per file.

    Over the first lines, the separator with the most occurrences in one line wins; the first line
    with that many is the header; ``start`` lines precede it.
    """
    head = _head(lines, head_lines)
    best = head.groupBy("source_file").agg(
        *[
            F.max(
                F.struct(
                    _occurrences(F.col("raw_line"), sep).alias("n"),
                    (-F.col("ln")).alias("first"),
                    F.lit(-i).alias("rank"),
                    F.lit(sep).alias("sep"),
                    "raw_line",
                    "at",
                )
            ).alias(f"s{i}")
            for i, sep in enumerate(SEPARATORS)
        ]
    )
    # Most occurrences first, then the earlier separator; the line is settled per separator above.
    ordered = [
        F.struct(F.col(f"s{i}.n").alias("n"), F.col(f"s{i}.rank").alias("rank"), F.col(f"s{i}").alias("s"))
        for i in range(len(SEPARATORS))
    ]
    return best.select("source_file", F.greatest(*ordered).alias("b")).select(
        "source_file",
        F.col("b.s.sep").alias("sep"),
        (-F.col("b.s.first")).alias("start"),
        F.col("b.n").alias("n_seps"),
        F.col("b.s.raw_line").alias("header"),
        F.col("b.s.at").alias("header_at"),
    )


def _split(line: Column, sep: Column) -> Column:
    """Split under the separator in a column, with one fixed pattern per candidate."""
    out = None
    for s in SEPARATORS:
        fields = F.split(line, re.escape(s))
        out = F.when(sep == s, fields) if out is None else out.when(sep == s, fields)
    return out


def split_by(line: Column, sep: Column) -> Column:
    """Fields of a line under the separator in a column; pairs of quotes may enclose separators."""

    def hidden(parts: Column) -> Column:
        def hide(part: Column, i: Column) -> Column:
            enclosed = (i % 2 == 1) & (i < F.size(parts) - 1)
            return F.when(enclosed, F.replace(part, sep, F.lit("\x01"))).otherwise(part)

        return F.array_join(F.transform(parts, hide), '"')

    def show(f: Column) -> Column:
        inner = F.when(f.rlike('^"(?s).*"$'), F.substr(f, F.lit(2), F.length(f) - 2)).otherwise(f)
        return F.replace(F.replace(inner, F.lit('""'), F.lit('"')), F.lit("\x01"), sep)

    quoted = let(let(F.split(line, '"'), hidden), lambda text: F.transform(_split(text, sep), show))
    return F.when(line.contains('"'), quoted).otherwise(_split(line, sep))


def table_rows(lines: DataFrame, sniffed: DataFrame | None = None, head_lines: int = HEAD_LINES) -> DataFrame:
    """(source_file, at, raw_line, header_line, header, fields): the data lines after each file's header, both as text and split."""
    facts = (sniffed if sniffed is not None else sniff(lines, head_lines)).select(
        "source_file", "sep", "header", "header_at"
    )
    body = join_per_key(lines, facts, ["source_file"]).filter(
        (F.col("at") > F.col("header_at")) & ~is_blank("raw_line")
    )
    return body.select(
        "source_file",
        "at",
        "raw_line",
        F.col("header").alias("header_line"),
        split_by(F.col("header"), F.col("sep")).alias("header"),
        split_by(F.col("raw_line"), F.col("sep")).alias("fields"),
    )


def read_sniffed(
    spark: SparkSession, path: str, glob: str = "*.csv", head_lines: int = HEAD_LINES, quoted_line_ends: bool = True
) -> DataFrame:
    """Files of one layout as a table of text columns named by their header.

    Quoted fields may hold line ends, given as line feeds, unless ``quoted_line_ends`` is false.

    Only the distinct layouts (two at most) come to the driver, to name the columns. Repeated
    names get a suffix, empty ones a number.
    """
    lines = read_numbered_lines(spark, path, glob)
    if quoted_line_ends:
        lines = stored(join_quoted_lines(lines))
    facts = sniff(lines, head_lines)
    header = split_by(F.col("header"), F.col("sep"))
    layouts = facts.select("sep", header.alias("names")).distinct().limit(2).collect()
    if len(layouts) != 1:
        raise ValueError(f"expected one layout, found {len(layouts)} or more")
    names: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(layouts[0].names):
        name = name or f"Unnamed: {i}"
        seen[name] = seen.get(name, -1) + 1
        names.append(name if seen[name] == 0 else f"{name}.{seen[name]}")
    rows = table_rows(lines, facts)
    columns = [F.nullif(F.get("fields", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return rows.select(*columns)


def list_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(source_file) of the matching files of a folder, from its listing: scans pass over empty files."""
    context = spark.sparkContext
    pattern = context._jvm.org.apache.hadoop.fs.Path(path, glob)
    found = pattern.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(pattern)
    names = [(entry.getPath().getName(),) for entry in found or [] if entry.isFile()]
    return spark.createDataFrame(names, "source_file string")


def load_status(lines: DataFrame, files: DataFrame | None = None, head_lines: int = HEAD_LINES) -> DataFrame:
    """(source_file, status, reason, n_rows), one row per file.

    A file fails when it has no text, or a data line wider than the header. Files without lines are
    known only from ``files``.
    """
    facts = sniff(lines, head_lines).select("source_file", "sep", "header_at", "n_seps")
    text = ~is_blank("raw_line")
    data = (F.col("at") > F.col("header_at")) & text
    width = F.size(split_by(F.col("raw_line"), F.col("sep")))
    out = join_per_key(lines, facts, ["source_file"]).groupBy("source_file").agg(
        F.bool_or(text).alias("has_text"), F.count_if(data).alias("n_rows"), F.max(F.when(data, width)).alias("widest"), F.first("n_seps").alias("n_seps")
    )
    if files is not None:
        out = join_per_key(files.select("source_file"), out, ["source_file"], "left")
    empty = ~F.coalesce("has_text", F.lit(False))
    wide = F.coalesce(F.col("widest"), F.lit(0)) > F.col("n_seps") + 1
    return out.select(
        "source_file",
        F.when(empty | wide, "failed").otherwise("ok").alias("status"),
        F.when(empty, "empty").when(wide, "too_many_fields").alias("reason"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"))
