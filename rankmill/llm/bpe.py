"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``CHUNK`` characters is cut into chunks that overlap. Each chunk is pre-tokenised
by itself, on any executor, and reports the ends of pre-tokens inside its overlaps. Neighbours are
stitched at the first place in their overlap where both end a pre-token: the pattern never looks
back, so from there on both would give the same pre-tokens. A chunk's ends are taken as the text's
own only if it is the first one, or has, before the overlap, a white space after another character,
which ends a pre-token in any reading; so a chunk that begins within a pre-token has found the
right rhythm. The pieces between stitches are encoded each by itself and their ids put in order. Where
an overlap gives no such place, as within a pre-token longer than it, the pieces on both sides are
joined before they are encoded. Decoding concatenates the bytes of the ids. Texts of one chunk are
encoded where they are read.

Defined results: a missing text counts as empty and has no ids. Rows are encoded each by itself,
also those that repeat a key or have none. An empty table gives an empty result. Columns of ``docs``
other than key and text play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from rankmill.llm.common import stored, tidy

CHUNK, OVERLAP = 65_536, 1_024  # characters
LOOKAHEAD = 2  # characters beyond its end that can change a pre-token
SLICE = 64  # texts handed back together


class Encoding:
    """Ranks and pattern; the library's own tables are made on first use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern, self._made, self._tokens = ranks, pattern, None, None

    def made(self):
        if self._made is None:
            import regex
            import tiktoken

            own = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
            self._made = own, regex.compile(self.pattern)
        return self._made

    def decode(self, ids: list[int]) -> bytes:
        if self._tokens is None:
            self._tokens = {i: token for token, i in self.ranks.items()}
        return b"".join(map(self._tokens.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        own, pattern = self.made()
        if len(text) <= CHUNK:
            return own.encode_ordinary(text)
        # joined pieces: a run of spaces of some million characters is too deep for the library's own splitting
        return [i for m in pattern.finditer(text) for i in own._encode_single_piece(m.group().encode())]

    def ends(self, part: str, low: int, high: int, last: bool) -> list[int]:
        """Ends of pre-tokens in [low, high), without those that what follows the chunk could change."""
        most = len(part) if last else len(part) - LOOKAHEAD
        return [e for m in self.made()[1].finditer(part) if low <= (e := m.end()) < high and e <= most]


def load_encoding(path: str, pattern: str) -> Encoding:
    """The rank file is read once, on the driver; a vocabulary's size is fixed."""
    with open(path, "rb") as lines:
        return Encoding({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def _shared(docs: DataFrame, encoding: Encoding):
    """A broadcast of plain values: tasks make the encoding of them, for executors may lack this package."""
    return docs.sparkSession.sparkContext.broadcast((encoding.ranks, encoding.pattern))


def _overlapping_chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, no, last, part); ``row`` names a row of the table, for keys can repeat or be missing."""
    step = chunk - overlap
    most = F.ceil((F.length("text") - overlap) / step).cast("int") - 1
    rows = long.select(F.monotonically_increasing_id().alias("row"), "key", "text", most.alias("most"))
    parts = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("no"))
    return parts.select("row", "key", "no", (F.col("no") == F.col("most")).alias("last"), F.substring("text", F.col("no") * step + 1, F.lit(chunk)).alias("part"))


def _stitched(chunks: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """(row, piece, text): pieces of the long texts that can be encoded by themselves."""
    step = chunk - overlap

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoding, settled = Encoding(*shared.value), regex.compile(r"\S\s")
        for batch in batches:
            row, no, last, part = (c.to_pylist() for c in batch.columns)
            first = [encoding.ends(p, 0, overlap, e) if n else [] for n, e, p in zip(no, last, part, strict=True)]
            final = [[] if e else [x - step for x in encoding.ends(p, step, chunk, e)] for e, p in zip(last, part, strict=True)]
            sure = [n == 0 or settled.search(p, 0, step) is not None for n, p in zip(no, part, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(no, pa.int32()), pa.array(first, pa.list_(pa.int32())), pa.array(final, pa.list_(pa.int32())), pa.array(sure)], ["row", "no", "first", "final", "sure"])

    chunks = chunks.repartition("row", "no")  # the chunks of one text go to many tasks
    ends = chunks.select("row", "no", "last", "part").mapInArrow(tidy(boundaries), "row long, no int, first array<int>, final array<int>, sure boolean")
    order = Window.partitionBy("row").orderBy("no")
    meeting = F.when(F.col("sure"), F.array_min(F.array_intersect("final", F.lead("first").over(order))))
    stops = ends.select("row", "no", meeting.alias("stop")).select(
        "row", "no", "stop", F.lag("stop").over(order).alias("start"), F.count("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("piece")
    )
    begin = F.when(F.col("no") == 0, 0).otherwise(F.coalesce("start", F.lit(overlap)))
    end = F.coalesce(F.col("stop") + step, F.lit(chunk))
    slices = chunks.join(stops, ["row", "no"]).select("row", "piece", "no", F.substring("part", begin + 1, end - begin).alias("slice"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "slice"))), lambda s: s["slice"]), "")
    return slices.groupBy("row", "piece").agg(whole.alias("text"))


def _each_text(docs: DataFrame, encoding: Encoding, key: str, text: str, chunk: int, overlap: int, result: str, made, types: list, join) -> DataFrame:
    """``key`` and the columns ``result`` that ``made`` (encoding, text) gives for each text, or for each of its pieces, whose parts ``join`` then joins."""
    shared = _shared(docs, encoding)
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    names = [c.split()[0] for c in result.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoding(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                columns = zip(*(made(own, t) for t in part.column(part.num_columns - 1).to_pylist()), strict=True)
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], [*part.schema.names[:-1], *names])

    short = narrow.filter(F.length("text") <= chunk).mapInArrow(tidy(whole), f"key {kind}, {result}")
    chunks = stored(_overlapping_chunks(narrow.filter(F.length("text") > chunk), chunk, overlap))
    pieces = _stitched(chunks, shared, chunk, overlap).mapInArrow(tidy(whole), f"row long, piece long, {result}")
    parts = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", *names))).alias("parts"))
    joined = parts.select("row", *[join(F.col(f"parts.{n}")).alias(n) for n in names])
    long = chunks.filter("no = 0").select("row", "key").join(joined, "row").select("key", *names)
    return short.union(long).withColumnRenamed("key", key)


def encode(docs: DataFrame, encoding: Encoding, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``ids``."""
    return _each_text(docs, encoding, key, text, chunk, overlap, "ids array<int>", lambda own, t: (own.encode(t),), [pa.list_(pa.int32())], F.flatten)


def _packed(own: Encoding, text: str) -> tuple[bytes, bytes]:
    ids = own.encode(text)
    return np.array(ids, "<u4").tobytes(), own.decode(ids)


def round_trip(docs: DataFrame, encoding: Encoding, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key``, ids_bytes (ids as little-endian unsigned 32-bit integers) and decoded (their bytes) of each row.

    One Python step encodes, packs and decodes, so a core runs one worker with one vocabulary, and ids never pass as arrays.
    """
    join = lambda parts: F.unhex(F.array_join(F.transform(parts, F.hex), ""))
    return _each_text(docs, encoding, key, text, chunk, overlap, "ids_bytes binary, decoded binary", _packed, [pa.binary(), pa.binary()], join)


def decode(encoded: DataFrame, encoding: Encoding, key: str = "doc_id") -> DataFrame:
    """``key``, ids_bytes and decoded, as ``round_trip`` gives them, of rows with ``ids``."""
    shared = _shared(encoded, encoding)
    kind = encoded.schema[key].dataType.simpleString()

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoding(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                ids = part.column(1).to_pylist()
                packed = [np.array(i, "<u4").tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array([own.decode(i) for i in ids], pa.binary())], [key, "ids_bytes", "decoded"])

    return encoded.select(key, "ids").mapInArrow(tidy(bytes_of), f"`{key}` {kind}, ids_bytes binary, decoded binary")
