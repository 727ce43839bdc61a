"""Shards of near equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of text, hash of key): copies of a text lie together, and a text with very
many copies can still be divided between shards. The splitters are searched by histograms: exact
bytes are counted in 256 bins between candidate boundaries, the bins that hold a splitter are probed
again at their next eight bits, until each splitter is within ``tolerance`` of its target or a single
row or key is left. Only counts reach the driver, at most 256 for each splitter and round. The rows
are then exchanged once, by shard and cell; ``slot`` adds a row's place in its cell to the rows of
the cells before it, so no task holds a shard.

Defined results: a missing text counts as empty; size is its UTF-8 bytes plus 1. A row without key is
ordered as if its key were one further value. Rows repeating text and key get places of their own in
one shard. An empty table gives an empty result. Columns of ``docs`` stay; the five new ones replace
columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rankmill.llm.common import stored

SHARDS, TOLERANCE, CELL_ROWS = 16, 0.001, 4096
DIGIT, LEVELS = 8, 16  # bits of a digit; digits of the 128-bit order
SIGN = -(1 << 63)
HIGH, LOW = "__high", "__low"


def _digit(level: int) -> Column:
    word = F.col(HIGH if level < LEVELS // 2 else LOW)
    shift = 64 - DIGIT * (level % (LEVELS // 2) + 1)
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(255))


def _unsigned(n: int) -> int:
    return n % (1 << 64)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _same_prefix(level: int, prefix: int) -> Column:
    """Rows whose first ``level`` digits are ``prefix``."""
    half = LEVELS // 2
    first, second = min(level, half), max(level - half, 0)
    bits = prefix >> DIGIT * second
    out = F.lit(True)
    if first:
        out = F.shiftrightunsigned(HIGH, 64 - DIGIT * first) == F.lit(_signed(bits) if first == half else bits)
    if second:
        rest = prefix % (1 << DIGIT * second)
        out &= F.shiftrightunsigned(LOW, 64 - DIGIT * second) == F.lit(_signed(rest) if second == half else rest)
    return out


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """Boundaries of the 128-bit order of ``rows`` (__high, __low, size); a row at or beyond one lies above it.

    Both words are read as unsigned. ``tolerance`` is a part of the mean shard. A boundary past the
    largest possible key has nothing above it and is left out.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    found: dict[int, int] = {}
    # per splitter: digits known so far, their value, bytes below
    open_ = {k: (0, 0, 0) for k in range(1, shards)}
    while open_ and total:
        probes = sorted({(level, prefix) for level, prefix, _ in open_.values()})
        histogram = _histogram(rows, probes)
        for k, (level, prefix, below) in list(open_.items()):
            target = total * k / shards
            for digit, size, n, low, high in histogram[level, prefix]:
                if below + size >= target:
                    break
                below += size
            shared = LEVELS if low == high else LEVELS - ((low ^ high).bit_length() + DIGIT - 1) // DIGIT
            if size <= allowed or n == 1 or low == high:
                # the nearer side of the bin: all of its rows above, or all below
                found[k] = low if target - below <= below + size - target else high + 1
                del open_[k]
            else:  # on to the first digit in which the bin's rows differ
                shared = max(shared, level + 1)
                open_[k] = (shared, low >> DIGIT * (LEVELS - shared), below)
    return sorted(b for b in found.values() if b < 1 << 128)


def _histogram(rows: DataFrame, probes: list[tuple[int, int]]) -> dict:
    """Per probe, in order: digit, bytes, rows, smallest and largest key of each bin that has rows."""
    key = F.struct(F.col(HIGH).bitwiseXOR(F.lit(SIGN)).alias("high"), F.col(LOW).bitwiseXOR(F.lit(SIGN)).alias("low"))
    probe = F.coalesce(*[F.when(_same_prefix(level, prefix), F.struct(F.lit(i).alias("probe"), _digit(level).alias("digit"))) for i, (level, prefix) in enumerate(probes)])
    counted = (
        rows.select(probe.alias("bin"), "size", key.alias("key"))
        .filter("bin is not null")
        .groupBy("bin.probe", "bin.digit")
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    )
    out: dict = {p: [] for p in probes}
    whole = lambda k: (_unsigned(k.high ^ SIGN) << 64) + _unsigned(k.low ^ SIGN)
    for r in sorted(counted.collect(), key=lambda r: (r.probe, r.digit)):
        out[probes[r.probe]].append((r.digit, r.size, r.n, whole(r.low), whole(r.high)))
    return out


def _at_or_above(bound: int) -> Column:
    """Compares as unsigned: the sign bits are flipped on both sides."""
    high, low = (F.lit(_signed(x) ^ SIGN) for x in divmod(bound, 1 << 64))
    mine, rest = F.col(HIGH).bitwiseXOR(F.lit(SIGN)), F.col(LOW).bitwiseXOR(F.lit(SIGN))
    return (mine > high) | ((mine == high) & (rest >= low))


def histogram_shards(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``docs`` with size, text_crc32, law (``bytes``), shard and slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    added = {
        "size": F.octet_length(body).cast("long") + 1,
        "text_crc32": F.crc32(body),
        "law": F.lit("bytes"),
        HIGH: F.xxhash64(body),
        LOW: F.xxhash64(F.col(key)),
    }
    counted = stored(docs.select(*[added[c].alias(c) for c in ("size", HIGH, LOW)]))
    shard = sum([_at_or_above(b).cast("int") for b in splitters(counted, shards, tolerance)], F.lit(0))
    cells = max(1, -(-counted.count() // (shards * cell_rows)))
    cell = F.pmod(F.xxhash64(F.col(LOW)), F.lit(cells))
    sizes = counted.groupBy(shard.alias("__shard"), cell.alias("__cell")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__shard", "__cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    rows = docs.withColumns(added).withColumns({"shard": shard, "__cell": cell})
    within = Window.partitionBy("shard", "__cell").orderBy(HIGH, LOW)
    placed = rows.withColumn("slot", F.row_number().over(within).cast("long") - 1).withColumnRenamed("__cell", "__own")
    joined = placed.join(before, (F.col("shard") == F.col("__shard")) & (F.col("__own") == F.col("__cell")))
    return joined.withColumn("slot", F.col("slot") + F.col("__before")).drop(HIGH, LOW, "__own", "__shard", "__cell", "__before")
