"""Alignment of two tokenizers over a corpus, with a fast path for tokens both have.

Each text is encoded by A (byte-level BPE) and by B (pieces with byte fallback). Offsets where tokens of both
end cut them into groups, and tokens whose byte ranges overlap are linked. How many documents hold a
pair of ids linked is counted over the whole corpus, and each document is told what its links weigh.

An array made from the vocabularies gives for each A id the B id of the same bytes. Those pairs, most of
all one-to-one groups, are counted in a vector as long as A's vocabulary. Only the other pairs, out of irregular
groups, are shuffled, and not once per document: documents are dealt into blocks of bounded text, a block
counts its pairs before the shuffle, and gets each pair's total back once.

No token of either tokenizer spans a space behind a character that is no white space, so texts are cut there
and the segments, mostly words, are aligned by themselves; a task remembers what it has aligned.

Defined results: missing and empty texts have no tokens, nor have texts that either tokenizer does not give
back byte by byte; their numbers are 0 and their groups are ''. Rows are documents of their own, also those that repeat
a key or have none. An empty table gives an empty result. Columns other than key and text play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rankmill.llm.common import arrow_rows, stored, tidy
from rankmill.operators.joins import join_per_key

BLOCK_BYTES = 4_000_000  # text of the documents that share a block; one longer text is a block of its own
BATCH_ROWS, BATCH_CHARS = 256, 1_000_000  # texts aligned together; one longer text is by itself
JOINED = 64  # segments encoded as one text
KNOWN, KNOWN_CHARS = 300_000, 40  # segments a task remembers, and how long they may be
MARK = "▁"  # a space in a piece of B
SPACE_AFTER_WORD = re.compile(r"(?<=\S)(?= )")

ALIGNED = "key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary, exact binary, exact_times binary, block long"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are written as themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = byte_level()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(byte.get(c, 63) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        # the later id wins: whole pieces come after the single bytes of the fallback
        by_bytes = {t: i for i, t in enumerate(self.b_bytes) if t and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([by_bytes.get(t, -1) for t in self.a_bytes], np.int64)
        self.lone_space = self.b.piece_to_id(MARK)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # an id as text, with what follows it inside its group or at its end
        self.written = [f"{i}{sign}" for own, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for sign in signs for i in range(len(own))]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def segments(self, texts: list[str]) -> list[list[str]]:
        return [SPACE_AFTER_WORD.split(" " + t) if t else [] for t in texts]

    def encode_new(self, segments: list[list[str]]) -> list[str]:
        """Encodes the segments met for the first time: packed ids of A and B, None where bytes differ. Returns them."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list(set(chain.from_iterable(segments)).difference(self.known))
        new.sort(key=lambda s: s[-1].isspace())  # those end a text; white space behind them could run into them
        words = sum(not s[-1].isspace() for s in new)
        joined = ["".join(new[i : min(i + JOINED, words)]) for i in range(0, words, JOINED)] + new[words:]
        a = np.array(list(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(joined, add_special_tokens=False))), np.int32)
        b = np.array(list(chain.from_iterable(self._pieces(new))), np.int32)
        raw, ends = "".join(new).encode(), np.cumsum([len(s.encode()) for s in new])
        cut_a, cut_b = self._cut(a, self.a_bytes, self.a_sizes, raw, ends), self._cut(b, self.b_bytes, self.b_sizes, raw, ends)
        if cut_a is None or cut_b is None:  # some text is not given back: each segment is looked at by itself
            self.known |= {s: self._alone(s) for s in new}
        else:
            self.known |= {s: own for s, own in zip(new, zip(cut_a, cut_b), strict=True)}
        return new

    def _pieces(self, segments: list[str]) -> list[list[int]]:
        """B adds the space before a segment itself, but to an empty text."""
        return [p or [self.lone_space] for p in self.b.encode([s[1:] for s in segments], num_threads=1)]

    @staticmethod
    def _cut(ids: np.ndarray, own: list[bytes], sizes: np.ndarray, raw: bytes, ends: np.ndarray) -> list[bytes] | None:
        """Packed ids of each segment, if the tokens make up the bytes and one ends with each segment."""
        if b"".join(map(own.__getitem__, ids.tolist())) != raw:
            return None
        token_ends = np.cumsum(sizes[ids])
        upto = np.searchsorted(token_ends, ends)
        if (token_ends[upto] != ends).any():
            return None
        packed, at = ids.tobytes(), [0, *(4 * (upto + 1)).tolist()]
        return [packed[i:j] for i, j in zip(at, at[1:])]

    def _alone(self, segment: str) -> tuple[bytes, bytes] | None:
        a, (b,), raw = self.a.encode(segment, add_special_tokens=False).ids, self._pieces([segment]), segment.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return array("i", a).tobytes(), array("i", b).tobytes()

    def documents(self, texts: list[str]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, n_links, groups, and distinct pairs with how often each is linked."""
        none = 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        segments = self.segments(texts)
        new = self.encode_new(segments)
        found = [list(map(self.known.__getitem__, own)) for own in segments]
        for s in new:
            if len(s) > KNOWN_CHARS:
                del self.known[s]
        whole = [bool(own) and None not in own for own in found]
        aligned = self._aligned([[b"".join(x) for x in zip(*own, strict=True)] for own, w in zip(found, whole, strict=True) if w])
        for w in whole:
            yield next(aligned) if w else none

    def _aligned(self, texts: list[list[bytes]]) -> Iterator[tuple]:
        """All texts, end to end, at once: between two ends next to each other lie one token of A and one of B, which are linked."""
        if not texts:
            return
        a, b = (np.frombuffer(b"".join(own), np.int32) for own in zip(*texts, strict=True))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        last_a, last_b = (np.cumsum([len(x) // 4 for x in own]) for own in zip(*texts, strict=True))  # tokens up to each text's end
        ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs
        ends = ends[np.diff(ends, prepend=0) > 0]
        pairs = a[np.searchsorted(ends_a, ends)].astype(np.int64) << 32 | b[np.searchsorted(ends_b, ends)]
        cuts = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]
        upto_a, upto_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1  # tokens up to each group's end
        # groups as text: the tokens of A, then of B, group by group, each by its place among the written ids
        place_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], upto_b[:-1]]), np.diff(upto_a, prepend=0))
        place_b = np.arange(len(b)) + np.repeat(upto_a, np.diff(upto_b, prepend=0))
        written = np.empty(len(a) + len(b), np.int64)
        ended_a, ended_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ended_a[upto_a - 1] = ended_b[upto_b - 1] = 1
        written[place_a] = a + ended_a * len(self.a_bytes)
        written[place_b] = b + 2 * len(self.a_bytes) + ended_b * len(self.b_bytes)
        at = 0, 0, 0, 0
        for n_a, n_b in zip(last_a.tolist(), last_b.tolist(), strict=True):
            end = ends_a[n_a - 1]
            to = n_a, n_b, int(np.searchsorted(cuts, end)) + 1, int(np.searchsorted(ends, end)) + 1
            groups = "".join(map(self.written.__getitem__, written[at[0] + at[1] : n_a + n_b].tolist()))[:-1]
            own = np.unique(pairs[at[3] : to[3]], return_counts=True)
            yield *(y - x for x, y in zip(at, to, strict=True)), groups, *own
            at = to


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at, chars = 0, 0
    for i, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
        if i > at and (i - at == BATCH_ROWS or chars + n > BATCH_CHARS):
            yield batch.slice(at, i - at)
            at, chars = i, 0
        chars += n
    if at < len(batch):
        yield batch.slice(at)


def _rows(docs: DataFrame, a_json: str, b_model: bytes, key: str, text: str, digest: bool) -> DataFrame:
    """Each document aligned; its pairs apart from those of the identity map, and the block it belongs to."""
    shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = ALIGNED.format(kind=narrow.schema["key"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, held = Aligner(*shared.value), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in _parts(batch):
                texts, rows = part.column(1).to_pylist(), []
                for t, (*numbers, groups, pairs, times) in zip(texts, aligner.documents(texts), strict=True):
                    exact = aligner.same[pairs >> 32] == pairs & 0xFFFFFFFF
                    if digest and groups:
                        groups = hashlib.sha256(groups.encode()).hexdigest()
                    if held and held + len(t) > BLOCK_BYTES:
                        block, held = block + 1, 0
                    held += len(t)
                    own = (pairs[~exact], times[~exact].astype(np.int32), (pairs[exact] >> 32).astype(np.int32), times[exact].astype(np.int32))
                    rows.append((*numbers, groups, *(x.tobytes() for x in own), block))
                types = [*[pa.int64()] * 4, pa.string(), *[pa.binary()] * 4, pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True))], names)

    return narrow.mapInArrow(tidy(aligned), schema)


def _block_counts(rows: DataFrame, size: int) -> DataFrame:
    """(block, pair, n): documents of a block that hold a pair; of the identity map, documents of a task by A id, without block."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, block, held = np.zeros(size, np.int64), None, []

        def out(block: int | None, pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block] * len(pairs), pa.int64()), pa.array(pairs), pa.array(n)], ["block", "pair", "n"])

        def closed() -> pa.RecordBatch:
            return out(block, *(x.astype(np.int64) for x in np.unique(np.frombuffer(b"".join(held), np.int64), return_counts=True)))

        for batch in batches:
            for b, pairs, ids in zip(batch.column("block").to_pylist(), batch.column("pairs"), batch.column("exact"), strict=True):
                if b != block:
                    if held:
                        yield closed()
                    block, held = b, []
                held.append(pairs.as_py())
                exact[np.frombuffer(ids.as_buffer(), np.int32)] += 1  # ids are distinct in a document
        if held:
            yield closed()
        found = np.flatnonzero(exact)
        yield out(None, found, exact[found])

    return rows.select("block", "pairs", "exact").mapInArrow(tidy(counted), "block long, pair long, n long")


def _vector(rows: list, size: int) -> np.ndarray:
    """Numbers by A id; at most one row for each of its ids comes to the driver."""
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.a] = r.n
    return out


class Alignment:
    """Documents of a corpus aligned, with the corpus-wide counts of linked pairs."""

    def __init__(self, docs: DataFrame, a_json: str, b_model: bytes, key: str = "doc_id", text: str = "text", digest: bool = False) -> None:
        self.key, self.vocabulary = key, len(Aligner(a_json, b_model).a_bytes)
        with arrow_rows(docs.sparkSession, 1024):
            self.rows = stored(_rows(docs, a_json, b_model, key, text, digest))
            self.counted = stored(_block_counts(self.rows, self.vocabulary))
        shuffled = self.counted.filter("block is not null")
        self.pairs = stored(shuffled.groupBy("pair").agg(F.sum("n").alias("docs")))
        exact = self.counted.filter("block is null").groupBy(F.col("pair").alias("a")).agg(F.sum("n").alias("n"))
        most = self.pairs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("n"))
        self.exact = _vector(exact.collect(), self.vocabulary)
        self.best = np.maximum(self.exact, _vector(most.collect(), self.vocabulary))
        self.same = Aligner(a_json, b_model).same

    def pair_counts(self) -> DataFrame:
        """(a, b, docs): how many documents hold two ids linked."""
        spark = self.rows.sparkSession
        found = np.flatnonzero(self.exact)
        exact = spark.createDataFrame(list(zip(found.tolist(), self.same[found].tolist(), self.exact[found].tolist(), strict=True)), "a long, b long, docs long")
        return self.pairs.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "docs").union(exact)

    def documents(self) -> DataFrame:
        """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each document.

        n_best: links whose pair no other pair of their A id exceeds in documents; count_sum: documents summed over links.
        """
        rows, key = self.rows, self.key
        kind = rows.schema["key"].dataType.simpleString()
        shared = rows.sparkSession.sparkContext.broadcast((self.exact, self.best))
        answers = join_per_key(self.counted.filter("block is not null").select("block", "pair"), self.pairs, ["pair"])

        def weighed(own: pa.Table, told: pa.Table) -> pa.Table:
            exact, best = shared.value
            pairs, docs = (told.column(c).to_numpy() for c in ("pair", "docs"))
            order = np.argsort(pairs)
            pairs, docs = pairs[order], docs[order]
            n_best, total = [], []
            for p, t, e, s in zip(*(own.column(c).to_pylist() for c in ("pairs", "times", "exact", "exact_times")), strict=True):
                p, t, e, s = np.frombuffer(p, np.int64), np.frombuffer(t, np.int32), np.frombuffer(e, np.int32), np.frombuffer(s, np.int32)
                ids = np.concatenate([p >> 32, e])
                n = np.concatenate([docs[np.searchsorted(pairs, p)] if len(p) else p, exact[e]])
                times = np.concatenate([t, s]).astype(np.int64)
                n_best.append(int(times[n == best[ids]].sum()))
                total.append(int((n * times).sum()))
            columns = {c: own.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links")}
            columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups": own.column("groups")}
            return pa.table(columns)

        schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
        return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weighed, schema).withColumnRenamed("key", key)
