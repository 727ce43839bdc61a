"""Repeated lines over all documents, with DataFrame functions only.

Each line's key (white space stripped at both ends, A-Z as a-z) is hashed to 128 bits; only hashes,
document and place move. They are range-partitioned by hash and sorted inside the partitions by hash,
document and place, so each hash's lines stream by with the document that keeps them first. Lines of
later documents are dropped where enough documents hold the key. What is dropped comes back as bits,
one 64-bit word for each 64 lines, and only words with a dropped line are kept: a compressed keep
bitmap for each document. Text moves once at most, to meet its bitmap.

A range of hashes that holds far more lines than others would be a task of its own. Such hot ranges
are found by counting (``CELLS`` numbers reach the driver), and their keys are settled by
aggregates that combine before they are shuffled, instead of by the sorted stream.

Defined results: a missing or empty text is one empty line. Rows that repeat a key are one document;
rows without key are together one document, the smallest. Of rows that repeat key and text each
keeps and loses the same lines. An empty table gives an empty result. Columns of ``docs`` stay as
they are, but for those of the names stated.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rankmill.llm.common import SPACES, stored
from rankmill.llm.rows import IDENTITY, identity
from rankmill.operators.joins import join_per_key

LEAST_CHARS, LEAST_DOCS = 20, 3
CELL_BITS = 12
CELLS = 1 << CELL_BITS  # ranges of hashes that are counted
HOT, HOT_ROWS = 4, 64  # a hot range has more than so many times the mean, and more than so many lines


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def _hashed_lines(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    keys = F.transform(lines(F.col(text)), line_key)
    placed = docs.select(F.col(key).alias("doc"), *identity(key, text), F.posexplode(keys).alias("pos", "line"))
    hashes = [F.xxhash64(F.lit(i), "line").alias(h) for i, h in enumerate(("h1", "h2"))]
    return placed.filter(F.length("line") >= least_chars).select("doc", *IDENTITY, "pos", *hashes)


def _hot_cells(rows: DataFrame, cell: Column, hot_rows: int) -> list[int]:
    counts = {r.cell: r["count"] for r in rows.groupBy(cell.alias("cell")).count().collect()}
    limit = max(hot_rows, HOT * sum(counts.values()) / CELLS)
    return sorted(c for c, n in counts.items() if n > limit)


def _streamed(rows: DataFrame, least_docs: int) -> DataFrame:
    """Dropped lines of ranges of hashes: the first document of each hash's stream keeps its lines."""
    same = Window.partitionBy("h1", "h2").orderBy(F.desc_nulls_last("doc"), "pos")
    numbered = rows.repartitionByRange("h1", "h2").withColumn("d", F.dense_rank().over(same.orderBy(F.desc_nulls_last("doc"))))
    whole = Window.partitionBy("h1", "h2").orderBy(F.desc_nulls_last("doc")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return numbered.withColumn("n", F.max("d").over(whole)).filter((F.col("n") >= least_docs) & (F.col("d") > 1)).select(*IDENTITY, "pos")


def _aggregated(rows: DataFrame, least_docs: int) -> DataFrame:
    """The same for hot ranges."""
    per_doc = rows.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    crowded = per_doc.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= least_docs)
    found = join_per_key(rows, crowded, ["h1", "h2"])
    return found.filter(~F.col("doc").eqNullSafe(F.col("last"))).select(*IDENTITY, "pos")


def keep_bitmaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row for each key and text that loses lines: __t1, __t2 (its name) and __keep.

    __keep lists (word, bits) for the words of 64 lines in which a line is dropped; a set bit is a
    line that stays. All other words are full.
    """
    rows = stored(_hashed_lines(docs, key, text, least_chars))
    cell = F.shiftrightunsigned("h1", 64 - CELL_BITS)
    hot = _hot_cells(rows, cell, hot_rows)
    dropped = _streamed(rows.filter(~cell.isin(hot)), least_docs)
    if hot:
        dropped = dropped.union(_aggregated(rows.filter(cell.isin(hot)), least_docs))
    words = dropped.groupBy(*IDENTITY, F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("gone"))
    kept = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy(*IDENTITY).agg(F.array_sort(F.collect_list(kept)).alias("__keep"))


def _all_words(keep: Column) -> Column:
    """Every word from the first on up to the last that is listed, the full ones filled in."""
    gap = lambda before, after: F.array_repeat(F.lit(-1).cast("long"), after - before - 1)
    start = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"])
    return F.flatten(F.transform(keep, lambda w, i: F.concat(gap(start(i), w["word"]), F.array(w["bits"]))))


def kept_lines(text: Column, keep: Column) -> Column:
    """Lines of ``text`` whose bit is set; a missing bitmap keeps all."""
    picked = F.transform(
        F.array(F.struct(lines(text).alias("lines"), _all_words(keep).alias("words"))),
        lambda x: F.filter(
            x["lines"], lambda line, i: F.coalesce(F.call_function("getbit", F.get(x["words"], F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))), F.lit(1)) == 1
        ),
    )
    return F.when(keep.isNull(), lines(text)).otherwise(F.get(picked, F.lit(0)))


def without_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines (missing texts become empty), n_lines (before dropping) and n_dropped."""
    keeps = keep_bitmaps(docs, key, text, least_chars, least_docs, hot_rows)
    joined = join_per_key(docs.select("*", *identity(key, text)), stored(keeps), IDENTITY, "left")
    left = joined.select("*", F.size(lines(F.col(text))).alias("__n"), kept_lines(F.col(text), F.col("__keep")).alias("__left"))
    out = {text: F.array_join("__left", "\n"), "n_lines": F.col("__n").cast("long"), "n_dropped": (F.col("__n") - F.size("__left")).cast("long")}
    return left.select(*[F.col(c) for c in docs.columns if c not in out], *[c.alias(n) for n, c in out.items()])
