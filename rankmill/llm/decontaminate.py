"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in a plain form: lower case, ASCII signs as spaces, runs of white space as one
space. A test item of n characters may occur with up to n // ``PER_ERROR`` edits anywhere in a text.
It is split into one piece more than that, so an occurrence holds at least one piece unchanged. An
automaton finds all exact piece hits in one pass over a text; each hit fixes where the item would
lie, and there Myers' bit-parallel algorithm takes the edit distance, first of the small parts around the
piece, which have smaller budgets of their own, at last of the whole item.

Items are taken in blocks of bounded size, each broadcast for one pass over the texts, so a benchmark
of any size works. Texts are read whole, where they lie; nothing is shuffled.

Defined results: of an item's occurrences in a text the nearest, then earliest, is returned. Items
without text are never found, repeated items are found once for each key and text, items without key
once for each text that no item with a key has, under a missing key. Missing
and empty texts hold nothing; rows that repeat a key are searched each by itself. Empty tables give
an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankmill.llm.common import tidy

PER_ERROR = 10  # characters for each edit allowed
BLOCK_BYTES = 4_000_000  # plain text of the items of one block

_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
_BLANK = bytes.maketrans(_SIGNS, b" " * len(_SIGNS))


def plain(text: str | None) -> str:
    return b" ".join((text or "").lower().encode().translate(_BLANK).split()).decode()


def budget(item: str, per_error: int = PER_ERROR) -> int:
    return len(item) // per_error


Part = tuple[int, int, int]  # start, end, edits allowed


def pieces(start: int, end: int, errors: int, above: tuple[Part, ...] = ()) -> Iterator[tuple[int, int, tuple[Part, ...]]]:
    """``errors`` + 1 pieces that make up a part, as (start, end, the parts around it from the smallest on).

    A part with e edits is halved into parts with d and e - 1 - d: were both exceeded, there would be
    more than e. So in each occurrence some piece is whole, and all parts around it keep to their edits.
    """
    if not errors:
        yield start, end, above
        return
    above = ((start, end, errors), *above)
    left = (errors - 1) // 2
    cut = start + (end - start) * (left + 1) // (errors + 1)
    yield from pieces(start, cut, left, above)
    yield from pieces(cut, end, errors - 1 - left, above)


def nearest(item: str, window: str) -> tuple[int, int]:
    """Smallest edit distance of the item to any part of the window, and the first end of such a part."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for at, c in enumerate(window, 1):
        same = masks.get(c, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(across | plus)), plus & across
        score += 1 if up & top else -1 if down & top else 0
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds the items of one block."""

    def __init__(self, items: list[tuple[int | None, str]], per_error: int = PER_ERROR) -> None:
        import ahocorasick

        self.items = [(key, text, budget(text, per_error)) for key, text in items]
        places: dict[str, list[tuple[int, int, tuple[Part, ...]]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for start, end, around in pieces(0, len(text), errors):
                places.setdefault(text[start:end], []).append((n, start, around or ((0, len(text), 0),)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, body: str) -> list[tuple[int | None, int, int, int]]:
        """(item key, distance, start, end) of each item's nearest occurrence in a plain text."""
        if self.empty or not body:
            return []
        tried, best = set(), {}
        for last, (length, where) in self.automaton.iter(body):
            for n, at, around in where:
                begin = last + 1 - length - at  # where the item would start without edits before the piece
                if (n, begin) in tried:
                    continue
                text = self.items[n][1]
                for start, end, errors in around:
                    low = max(0, begin + start - errors)
                    window = body[low : max(0, begin + end + errors)]
                    distance, stop = nearest(text[start:end], window)
                    if distance > errors:
                        break
                else:  # the last part around a piece is the whole item
                    tried.add((n, begin))
                    first = low + stop - nearest(text[::-1], window[:stop][::-1])[1]
                    best[n] = min(best.get(n, (distance, first, low + stop)), (distance, first, low + stop))
        return [(self.items[n][0], *found) for n, found in sorted(best.items())]


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """Items in plain form, streamed from the cluster a block at a time."""
    some = items.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").distinct()
    keyed = some.filter("key is not null")
    block, size = [], 0
    for row in keyed.union(some.filter("key is null").join(keyed, "text", "left_anti").select("key", "text")).toLocalIterator():
        if body := plain(row.text):
            if block and size + len(body) > most:
                yield block
                block, size = [], 0
            block.append((row.key, body))
            size += len(body)
    if block:
        yield sorted(block, key=lambda item: (item[0] is None, item if item[0] is not None else item[1:]))


FOUND = "item_id long, distance long, start long, end long"


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", per_error: int = PER_ERROR) -> DataFrame:
    """One row for each document and item found in it: ``key``, item_id, distance, start, end (places in the plain text)."""
    narrow = docs.select(key, text)
    kind = narrow.schema[key].dataType.simpleString()

    def search(block: list[tuple[int | None, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, per_error)
            for batch in batches:
                rows = [(k, *hit) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for hit in matcher.find(plain(t))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [batch.schema.field(0).type, *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "item_id", "distance", "start", "end"])

        return narrow.mapInArrow(tidy(found), f"`{key}` {kind}, {FOUND}")

    parts = [search(block) for block in blocks(items, item_key, item_text)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], f"`{key}` {kind}, {FOUND}")


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", per_error: int = PER_ERROR) -> DataFrame:
    """Rows of ``docs`` that hold no item, all columns."""
    at = docs.columns.index(text)

    def clean(shared):
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, per_error)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(plain(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        return kept

    for block in blocks(items, item_key, item_text):
        docs = docs.mapInArrow(tidy(clean(docs.sparkSession.sparkContext.broadcast(block))), docs.schema)
    return docs
