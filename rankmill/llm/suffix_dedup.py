"""Removal of repeated byte strings with suffix arrays by induced sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also begins elsewhere. All strings of that
length can't be sorted at scale, so equal ones are first brought to one shard: each such window is
filed under its anchor, the 64-byte gram in it with the smallest hash, leftmost first, which equal
windows share. Neighbouring windows mostly share their anchor, so a text falls into segments of
some 270 bytes. Only segments whose anchor occurs again matter. Of these, equal ones are counted
with map-side combine (a segment that occurs twice is repeated whole, and moves once), and anchors with
different segments are dealt to shards. A shard's segments are put behind one another, a suffix
array is induced, and the permuted common prefixes tell which windows begin twice.

An anchor with more than ``CROWD`` different segments would fill its shard; its windows are instead
compared by 128 bits of hash, counted with map-side combine and spread over all tasks. The result
is the same.

Defined results: a missing text counts as empty; texts shorter than ``LENGTH`` stay whole. Rows are
told apart by key and text, so rows that repeat both, with or without a key, repeat each other's
text and lose it alike. Strings are judged on the input. An empty table gives an empty result. Other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankmill.llm.common import arrow_rows, stored, tidy
from rankmill.llm.shingles import _mix, raw_texts
from rankmill.llm.suffixes import shared_starts, suffix_array

LENGTH, GRAM = 200, 64
CROWD = 4096  # different segments of one anchor that a shard takes
SHARD = 1 << 19  # bytes sorted at once; a last anchor's segments may go beyond
_STEP = 1 << 16  # windows looked at together
BATCH_ROWS = 1024  # texts or segments handed to Python at once
_BASE = 0x9E3779B97F4A7C13


class _Anchors:
    """Segments of a text: (first window, last window, hash of the anchor)."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        n = _STEP + length + 1
        self.powers, self.inverses = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        for table in (self.powers, self.inverses):
            table[0] = 1
            np.cumprod(table, out=table)

    def gram_hashes(self, raw: np.ndarray, gram: int) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
        return _mix((sums[gram:] - sums[:-gram]) * self.inverses[: len(raw) - gram + 1])

    def segments(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(raw) - self.length + 1, _STEP):
            part = raw[at : at + _STEP + self.length - 1]
            hashes = self.gram_hashes(part, self.gram)
            width = self.length - self.gram + 1
            places = np.uint64(1 << 18)
            keyed = hashes // places * places + np.arange(len(hashes), dtype=np.uint64)
            where = (_sliding_minimum(keyed, width) % places).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            last = np.append(first[1:], len(where)) - 1
            yield first + at, last + at, hashes[where[first]].view(np.int64)


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, from minima of blocks read forwards and backwards."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _batch(columns: dict[str, list[np.ndarray]], types: dict[str, np.dtype]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(parts) if parts else np.empty(0, types[c])) for c, parts in columns.items()})


def _filed(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) to (k1, k2, first, last, anchor)."""
    anchors, types = _Anchors(length, gram), {"k1": np.int64, "k2": np.int64, "first": np.int64, "last": np.int64, "anchor": np.int64}
    for batch in batches:
        out, held = {c: [] for c in types}, 0
        for k1, k2, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
            for first, last, anchor in anchors.segments(raw):
                for c, part in (("k1", np.full(len(first), k1)), ("k2", np.full(len(first), k2)), ("first", first), ("last", last), ("anchor", anchor)):
                    out[c].append(part)
                held += len(first)
            if held > 100_000:
                yield _batch(out, types)
                out, held = {c: [] for c in types}, 0
        yield _batch(out, types)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, segments, text) to (k1, k2, first, anchor, segment)."""
    for batch in batches:
        for i, (found, raw) in enumerate(zip(batch.column(2), raw_texts(batch.column(3)), strict=True)):
            fields = found.values
            first, last, anchor = (fields.field(c).to_numpy() for c in ("first", "last", "anchor"))
            n = len(first)
            parts = [raw[a : b + length].tobytes() for a, b in zip(first, last, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, i))), batch.column(1).take(pa.array(np.full(n, i))), pa.array(first), pa.array(anchor), pa.array(parts, pa.binary())], ["k1", "k2", "first", "anchor", "segment"])


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


INTERVALS = "anchor long, d1 long, d2 long, starts array<long>, stops array<long>"


def _intervals(batch: pa.RecordBatch, masks: list[np.ndarray]) -> pa.RecordBatch:
    runs = [_runs(m) for m in masks]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in ("anchor", "d1", "d2")), pa.array([a for a, _ in runs], pa.list_(pa.int64())), pa.array([b for _, b in runs], pa.list_(pa.int64()))],
        ["anchor", "d1", "d2", "starts", "stops"],
    )


def _sorted_shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Whole anchors, ordered, to the intervals of windows of each segment that begin twice."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        segments = [np.frombuffer(s.as_buffer(), np.uint8) for s in batch.column("segment")]
        # symbols: 0 ends all, 1 ends a segment, bytes follow
        joined = np.zeros(sum(map(len, segments)) + len(segments) + 1, np.int64)
        starts, at = [], 0
        for s in segments:
            starts.append(at)
            joined[at : at + len(s)] = s
            joined[at : at + len(s)] += 2
            joined[at + len(s)] = 1
            at += len(s) + 1
        again = shared_starts(joined, suffix_array(joined), length)
        # what reaches behind a segment's end begins within its last bytes and is no window
        return _intervals(batch, [again[a : a + len(s) - length + 1] for a, s in zip(starts, segments, strict=True)])

    held, size, last = [], 0, None
    for batch in batches:
        anchors = batch.column("anchor").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), len(anchors)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if size >= SHARD and anchors[a] != last:
                yield solve(held)
                held, size = [], 0
            part = batch.slice(a, b - a)
            held.append(part)
            size += sum(len(s.as_buffer()) for s in part.column("segment"))
            last = anchors[a]
    if held:
        yield solve(held)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Two hashes of each window of a segment."""
    anchors = _Anchors(length, length)
    for batch in batches:
        for i, s in enumerate(batch.column("segment")):
            raw = np.frombuffer(s.as_buffer(), np.uint8)
            # the second hash reads the bytes backwards
            one, two = anchors.gram_hashes(raw, length), anchors.gram_hashes(np.ascontiguousarray(raw[::-1]), length)[::-1]
            row = [batch.column(c).take(pa.array(np.full(len(one), i))) for c in ("anchor", "d1", "d2")]
            yield pa.RecordBatch.from_arrays([*row, pa.array(np.arange(len(one))), pa.array(one.view(np.int64)), pa.array(np.ascontiguousarray(two).view(np.int64))], ["anchor", "d1", "d2", "at", "w1", "w2"])


def _crowded(segments: DataFrame, length: int) -> DataFrame:
    """Intervals for the segments of crowded anchors, from counts of their windows."""
    windows = stored(segments.select("anchor", "d1", "d2", "segment").mapInArrow(tidy(lambda b: _windows(b, length)), "anchor long, d1 long, d2 long, at long, w1 long, w2 long"))
    twice = windows.groupBy(F.col("w1").alias("__w1"), F.col("w2").alias("__w2")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = windows.join(twice, F.col("w1").eqNullSafe(F.col("__w1")) & F.col("w2").eqNullSafe(F.col("__w2")), "left_semi")
    # each window is an interval of its own; they are merged with the others in the text
    return again.groupBy("anchor", "d1", "d2").agg(F.sort_array(F.collect_list("at")).alias("starts")).select("anchor", "d1", "d2", "starts", F.col("starts").alias("stops"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, spans): for each row (k1, k2, text) that has some, the byte spans that repeated strings cover."""
    filed = docs.mapInArrow(tidy(lambda b: _filed(b, length, gram)), "k1 long, k2 long, first long, last long, anchor long")
    filed = stored(filed)
    again = filed.groupBy(F.col("anchor").alias("__anchor")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = filed.join(again, F.col("anchor").eqNullSafe(F.col("__anchor")), "left_semi")
    # rows that repeat key and text have the same segments: they are cut once for each such row
    per_text = marked.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last", "anchor")).alias("segments"))
    cut = docs.join(per_text, ["k1", "k2"]).select("k1", "k2", "segments", "text")
    cut = cut.mapInArrow(tidy(lambda b: _cut(b, length)), "k1 long, k2 long, first long, anchor long, segment binary")
    cut = stored(cut.withColumns({"d1": F.xxhash64("segment"), "d2": F.xxhash64(F.lit(1), "segment"), "windows": F.octet_length("segment") - length}))
    name = ["anchor", "d1", "d2"]
    counted = cut.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows"))
    whole = counted.filter("n > 1").select(*name, F.array(F.lit(0).cast("long")).alias("starts"), F.array(F.col("windows").cast("long")).alias("stops"))
    kinds = stored(counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).filter("different > 1"))
    kinds = kinds.withColumnRenamed("anchor", "__anchor")
    # null-safe, so that both sides are shuffled for this join alone and a hot anchor's rows can be split
    contested = cut.join(kinds, F.col("anchor").eqNullSafe(F.col("__anchor"))).groupBy("different", *name)
    different = stored(contested.agg(F.first("segment").alias("segment")))
    few = different.filter(F.col("different") <= crowd).repartition("anchor").sortWithinPartitions("anchor")
    sorted_ = few.select(*name, "segment").mapInArrow(tidy(lambda b: _sorted_shards(b, length)), INTERVALS)
    found = stored(whole.unionByName(sorted_.filter(F.size("starts") > 0)).unionByName(_crowded(different.filter(F.col("different") > crowd), length)))
    renamed = found.withColumnsRenamed({c: f"__{c}" for c in name})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in name]
    placed = cut.select("k1", "k2", "first", *name).join(renamed, same[0] & same[1] & same[2])
    spans = F.transform(F.arrays_zip("starts", "stops"), lambda i: F.struct((F.col("first") + i["starts"]).alias("start"), (F.col("first") + i["stops"] + length).alias("end")))
    return placed.select("k1", "k2", F.explode(spans).alias("span")).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def _without(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """(key, spans, text) to the merged spans and what is left of the text."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            starts, ends, kept, sizes = [], [], [], []
            for found, raw in zip(part.column(1), raw_texts(part.column(2)), strict=True):
                sizes.append(len(raw))
                merged: list[list[int]] = []
                if found.is_valid:
                    a, b = (found.values.field(c).to_numpy() for c in ("start", "end"))
                    order = np.argsort(a, kind="stable")
                    reach = np.maximum.accumulate(b[order])
                    heads = np.concatenate([[True], a[order][1:] > reach[:-1]])
                    merged = [a[order][heads].tolist(), reach[np.append(np.flatnonzero(heads)[1:] - 1, len(a) - 1)].tolist()]
                starts.append(merged[0] if merged else [])
                ends.append(merged[1] if merged else [])
                edges = [0, *(x for s, e in zip(starts[-1], ends[-1], strict=True) for x in (s, e)), len(raw)]
                kept.append(b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *lists, pa.array(kept, pa.binary())], [key, "n_bytes", "starts", "ends", "kept"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_bytes, starts and ends of the removed spans, kept (bytes)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # names a row by 128 bits; missing keys are told from others by the constants around them
    rows = docs.select(F.xxhash64(F.col(key), F.lit(0), body).alias("k1"), F.xxhash64(F.lit(1), body, F.col(key)).alias("k2"), F.col(key).alias("key"), body.alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        spans = repeated_spans(rows.select("k1", "k2", "text"), length, gram, crowd)
    joined = rows.join(spans, ["k1", "k2"], "left").select(F.col("key").alias(key), "spans", "text")
    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(tidy(lambda b: _without(b, key)), f"`{key}` {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary")
