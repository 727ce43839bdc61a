"""Toxicity by compression distance: two zstandard dictionaries, word windows, calibrated thresholds.

Both dictionaries begin with the common words of ordinary text; the toxic one goes on with words that
toxic training texts hold far more often than ordinary ones (log-likelihood ratio). A window is one
word in lower case, each character written with its two neighbours so that short words weigh enough
for the compressor. Its length under the ordinary dictionary and under the toxic one is compared:
for each ordinary length, the thresholds on the toxic length carry weights, the log ratio of the parts of
toxic and ordinary training texts with such a window. A text's score is a logistic function of its
three highest window weights.

The model is fitted on at most ``SAMPLE`` labelled texts of each class, chosen by a hash of their key;
near copies among them are counted once. Every text is scored, whole, where it is read; the model
(under 200 kB) is broadcast.

Defined results: missing, empty and wordless texts score as texts without any toxic window. Rows are
scored each by itself, repeated keys included; labels of unknown documents and missing labels are not
used. Without labelled texts of both classes every score is the share of toxic ones (0 without any).
An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankmill.llm.common import tidy

SAMPLE = 3000  # labelled texts of each class
FRONT, TAIL = 65_536, 16_384  # bytes of the common part and of the toxic part
COMMON_WORDS = 4000
LEVEL = 12
LEAST_PART, LEAST_TEXTS, LEAST_RATIO, LEAST_EVIDENCE = 0.005, 3, 6.0, 20.0
TOP = 3
CACHE = 100_000  # words whose weight a task remembers

_SIGNS = bytes(c for c in range(128) if not chr(c).isalpha())
_BLANK = bytes.maketrans(_SIGNS, b" " * len(_SIGNS))


def words(text: bytes) -> list[bytes]:
    return text.translate(_BLANK).lower().split()


def expanded(word: bytes) -> bytes:
    """Each byte with its neighbours."""
    wide = b"  " + word + b"  "
    return b"".join(wide[i : i + 3] for i in range(len(wide) - 2))


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "big")


def _apart(texts: list[bytes], index: dict[bytes, int]) -> list[np.ndarray]:
    """Numbers of the distinct words of each text, as ``index`` gives them; without texts that share half
    of their eight smallest word hashes with an earlier one."""
    seen: dict[int, int] = {}
    out = []
    for text in texts:
        own = sorted(set(words(text)))
        sketch = sorted(map(_hash, own))[:8]
        shared = Counter(seen[h] for h in sketch if h in seen)
        if shared and 2 * max(shared.values()) >= len(sketch):
            continue
        for h in sketch:
            seen.setdefault(h, len(out))
        out.append(np.array([index.setdefault(w, len(index)) for w in own], np.int32))
    return out


def _evidence(k: int, n: int, other_k: int, other_n: int) -> float:
    """Log-likelihood ratio of two parts, k of n and other_k of other_n."""

    def like(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (k + other_k) / (n + other_n)
    return 2 * (like(k, n, k / n) + like(other_k, other_n, other_k / other_n) - like(k, n, p) - like(other_k, other_n, p))


class Compressors:
    """Lengths of a window under both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        import zstandard

        self.both = []
        for content in (ordinary, toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))

    def lengths(self, word: bytes) -> tuple[int, int]:
        window = expanded(word)
        return tuple(len(c.compress(window)) for c in self.both)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: dict[tuple[int, int], float]
    intercept: float
    slope: float

    def scores(self, texts: Iterator[bytes]) -> Iterator[float]:
        compressors, known = Compressors(self.ordinary, self.toxic) if self.weights else None, {}
        for text in texts:
            found = []
            for word in set(words(text)) if self.weights else ():
                weight = known.get(word)
                if weight is None:
                    if len(known) >= CACHE:
                        known.clear()
                    weight = known[word] = self.weights.get(compressors.lengths(word), 0.0)
                if weight:
                    found.append(weight)
            x = sum(sorted(found)[-TOP:])
            yield 1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * x))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a small ridge on the slope for separable classes."""
    beta, design = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
    ridge = np.diag([1e-6, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    if not toxic or not ordinary:
        return Model(b"", b"", {}, 500.0 if toxic else -500.0, 0.0)
    index: dict[bytes, int] = {}
    bad, good = _apart(toxic, index), _apart(ordinary, index)
    vocabulary, a, b = list(index), len(bad), len(good)
    if not index:
        return Model(b"", b"", {}, math.log(a / b), 0.0)
    in_bad, in_good = (np.bincount(np.concatenate(texts), minlength=len(index)).tolist() for texts in (bad, good))
    telling = {
        w: _evidence(k, a, other, b)
        for w, k, other in zip(vocabulary, in_bad, in_good, strict=True)
        if k >= max(LEAST_TEXTS, LEAST_PART * a) and k * b >= LEAST_RATIO * other * a
    }
    telling = sorted((w for w, e in telling.items() if e >= LEAST_EVIDENCE), key=lambda w: (telling[w], w))
    common = sorted((w for w, k in zip(vocabulary, in_good, strict=True) if k), key=lambda w: (in_good[index[w]], w))[-COMMON_WORDS:]
    front = b"".join(map(expanded, common))[-FRONT:] or bytes(8)
    tail = b"".join(map(expanded, telling))[-TAIL:]
    compressors = Compressors(front, front + tail)
    cells: dict[tuple[int, int], int] = {}
    cell = np.array([cells.setdefault(compressors.lengths(w), len(cells)) for w in vocabulary], np.int32)
    with_bad, with_good = (np.bincount(np.concatenate([np.unique(cell[own]) for own in texts]), minlength=len(cells)).tolist() for texts in (bad, good))
    ratio = {c: math.log((with_bad[i] + 0.5) / (a + 1) * (b + 1) / (with_good[i] + 0.5)) for c, i in cells.items() if c[1] < c[0]}
    model = Model(front, front + tail, {c: r for c, r in ratio.items() if r > 0}, 0.0, 0.0)
    weight = np.array([model.weights.get(c, 0.0) for c in cells])[cell]
    x = np.array([np.sort(weight[own])[-TOP:].sum() for own in (*bad, *good)])
    model.intercept, model.slope = _logistic(x, np.array([1.0] * a + [0.0] * b))
    return model


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled texts of each class that are not held out."""
    usable = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(~held_out(F.col("key")) & F.col("label").isin(0, 1))
    picked = []
    for value in (1, 0):  # the keys are picked first, so that only their texts move
        keys = usable.filter(F.col("label") == value).distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
        texts = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).cast("binary").alias("text")).join(keys, "key")
        picked.append([bytes(r.text) for r in sorted(texts.select("key", "text").collect(), key=lambda r: (r.key, r.text))])
    return fit(*picked)


def _shared(docs: DataFrame, model: Model):
    """A broadcast of plain values: tasks make the model of them, for executors may lack this package."""
    return docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic, model.weights, model.intercept, model.slope))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``score``, from 0 to 1."""
    shared = _shared(docs, model)
    narrow = docs.select(key, F.col(text).cast("binary").alias("text"))
    kind = narrow.schema[key].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _in_step(batches, Model(*shared.value)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [key, "score"])

    return narrow.mapInArrow(tidy(scored), f"`{key}` {kind}, score double")


def _in_step(batches: Iterator[pa.RecordBatch], model: Model, at: int = 1) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
    """Batches with the scores of column ``at``; one model, and what it remembers of words, for the whole task."""
    queue: list[pa.RecordBatch] = []

    def texts() -> Iterator[bytes]:
        for batch in batches:
            queue.append(batch)
            for value in batch.column(at):
                text = value.as_py() or b""
                yield text.encode() if isinstance(text, str) else text

    scores = model.scores(texts())
    for first in scores:
        batch = queue.pop()
        yield batch, [first, *(next(scores) for _ in range(len(batch) - 1))]


def without_toxic(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, all columns; nothing is shuffled."""
    shared = _shared(docs, model)
    at = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _in_step(batches, Model(*shared.value), at):
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(tidy(kept), docs.schema)
