"""Near duplicates by MinHash with sequential Bayesian verification.

Texts are sets of five-word shingles. Texts with the same set form a class and are represented by
one of them, so copies are never compared. Signatures of 128 minima are cut into 32 bands of 4; a
pair at similarity 0.75 shares no band with probability 5e-6, a pair at 0.85 with 6e-11. Candidates
are compared 32 minima at a time: under a uniform prior, the posterior after m matches of n is
Beta(m + 1, n - m + 1), and a pair goes as soon as the probability that it reaches the threshold is
below ``MISS``. Survivors are compared on their whole shingle sets.

A bucket's members are not paired with each other. In the buckets of one band, then of more bands,
they are compared with one member; the links found are contracted to components after each turn, and
later turns compare only members of different components. The last step takes the buckets that still
hold several components. Pairs at the threshold share a shingle among the rarest quarter of each
one's set, so each member's rarest shingles are its buckets now: what crowds hold in common plays no
part, and what is outside a bucket's largest component is compared with each member of another one. No link
between components is lost, for every candidate pair either lies within one component or is compared;
sizes that can't reach the threshold are left out before.

Defined results: a missing or empty text has no shingles and is linked with nothing; a text of fewer
words is one shingle. A row without key has no component and is kept. Rows that repeat a key are
compared each by its own text, and a repeated key joins what its rows are linked with. An empty table
gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from rankmill.llm.common import arrow_rows, stored, tidy
from rankmill.llm.components import components
from rankmill.llm.rows import IDENTITY, chosen, identity, without_marked
from rankmill.llm.shingles import MinHasher, Shingler, digest, raw_texts
from rankmill.operators.joins import join_per_key

SIMILARITY = 75  # per cent
BANDS, ROWS, BATCH = 32, 4, 32
MISS = 1e-7  # probability at which a candidate is given up
BATCH_ROWS = 512  # rows handed to Python at once; a row can hold two shingle sets
TURNS = (1, 4, BANDS)  # bands in whose buckets each turn compares all members with one of them

FEATURES = "key long, __t1 long, __t2 long, n_shingles long, digest binary, signature binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, hasher = Shingler(), MinHasher(BANDS * ROWS)
    for batch in batches:
        sets = [shingler.hashes(raw) for raw in raw_texts(batch.column(3))]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) for s in sets], pa.binary()),
                pa.array([hasher.signature(s).tobytes() for s in sets], pa.binary()),
            ],
            ["key", "__t1", "__t2", "n_shingles", "digest", "signature"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for i, raw in enumerate(raw_texts(batch.column(1))):  # row by row: sets are larger than their texts
            hashes = shingler.hashes(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([digest(hashes)], pa.binary()), pa.array([hashes.tobytes()], pa.binary())], ["first", "digest", "hashes"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, hashes in zip(batch.column("node").to_pylist(), batch.column("hashes"), strict=True):
            own = np.frombuffer(hashes.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(own)], ["node", "bucket"])


def least_matches(n: int, similarity: float, miss: float) -> int:
    """Fewest matches of ``n`` at which the posterior probability of reaching ``similarity`` is ``miss`` or more."""
    below = 0.0
    for m in range(n + 1):  # P(Beta(m + 1, n - m + 1) >= s) = P(Binomial(n + 1, s) <= m)
        below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    need = {n: least_matches(n, SIMILARITY / 100, MISS) for n in range(BATCH, BANDS * ROWS + 1, BATCH)}
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("signature_a", "signature_b"))
        left, matches = np.arange(len(a)), np.zeros(len(a), int)
        for n, least in need.items():  # each batch is compared for the pairs that are left
            matches[left] += (a[left, n - BATCH : n] == b[left, n - BATCH : n]).sum(axis=1)
            left = left[matches[left] >= least]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in ("a", "b")], ["a", "b"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True)):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= SIMILARITY * (len(x) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def _with_both(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(facts.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


class _Links:
    """Candidate pairs to verified links, and the components they make so far."""

    def __init__(self, facts: DataFrame, sets: DataFrame) -> None:
        self.facts, self.sets, self.links, self.labels = facts, sets, None, None

    def add(self, pairs: DataFrame) -> None:
        pairs = pairs.distinct()
        survivors = _with_both(pairs, self.facts, "signature").mapInArrow(tidy(_survivors), "a long, b long")
        found = stored(_with_both(survivors, self.sets, "hashes").mapInArrow(tidy(_similar), "a long, b long"))
        self.links = found if self.links is None else self.links.union(found)
        self.labels = components(self.links)

    def join(self, links: DataFrame) -> None:
        """Takes links that need no verification."""
        links = stored(links)
        if not links.isEmpty():
            self.labels = components(self.links.union(links))

    def labelled(self, members: DataFrame) -> DataFrame:
        if self.labels is None:
            return members.withColumn("label", F.col("node"))
        labels = self.labels.withColumnRenamed("node", "__node")
        joined = members.join(labels, F.col("node").eqNullSafe(F.col("__node")), "left")
        return joined.select(*members.columns, F.coalesce("component", "node").alias("label"))


def _pair(members: DataFrame, other: DataFrame, more=None) -> DataFrame:
    """Pairs (a < b) of members and the ``other`` ones of their bucket that may still be linked."""
    n, m = F.col("n"), F.col("other_n")
    possible = (F.col("node") != F.col("other")) & (F.col("label") != F.col("other_label")) & (100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m))
    # null-safe, so that both sides are shuffled for this join alone and a hot bucket's members can be split
    other = other.withColumnRenamed("bucket", "__bucket")
    found = members.join(other, F.col("bucket").eqNullSafe(F.col("__bucket"))).filter(possible if more is None else possible & more)
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _star(members: DataFrame, turn: int) -> DataFrame:
    """Each bucket's members with one of them, another one in each turn."""
    # originals tend to have smaller keys than their copies, and lie in the middle of them
    order = F.col("first") if turn == 0 else F.xxhash64("first", F.lit(turn))
    first = F.struct(order.alias("order"), "node", "n", "label")
    one = members.groupBy("bucket").agg(F.min(first).alias("one"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    return _pair(members, one.select("bucket", F.col("one.node").alias("other"), F.col("one.n").alias("other_n"), F.col("one.label").alias("other_label")))


def _rest(members: DataFrame) -> DataFrame:
    """All pairs of different components that share a rare shingle early enough to be similar.

    A bucket's members outside its largest component are joined with every member. With a shared
    shingle at places i and j of the sets in order of rarity, and none before it, the sets share at
    most 1 + min(n - i, m - j) shingles.
    """
    sizes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    outside = join_per_key(members, largest.select("bucket", F.col("top.label").alias("top")), ["bucket"]).filter("label != top")
    other = outside.select("bucket", *[F.col(c).alias(to) for c, to in (("node", "other"), ("n", "other_n"), ("label", "other_label"), ("place", "other_place"))])
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    return _pair(members, other, (100 + SIMILARITY) * most >= SIMILARITY * (F.col("n") + F.col("other_n")))


def _rarest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of buckets with several components, once for each of their rarest shingles that another one holds."""
    mixed = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select(F.col("bucket").alias("__bucket"))
    left = stored(members.join(mixed, F.col("bucket").eqNullSafe(F.col("__bucket")), "left_semi").select("node", "n", "label").distinct())
    held = stored(sets.join(left.select("node"), "node", "left_semi").mapInArrow(tidy(_shingles), "node long, bucket long"))
    counts = held.groupBy(F.col("bucket").alias("__bucket")).agg(F.count(F.lit(1)).alias("holders"))
    counted = held.join(counts, F.col("bucket").eqNullSafe(F.col("__bucket"))).drop("__bucket").join(left, "node")
    place = F.row_number().over(Window.partitionBy("node").orderBy("holders", "bucket"))
    need = F.ceil(F.col("n") * SIMILARITY / 100)
    return counted.withColumn("place", place).filter((F.col("place") <= F.col("n") - need + 1) & (F.col("holders") > 1)).select("bucket", "node", "n", "label", "place")


def _classes(docs: DataFrame, key: str, text: str, join_keys: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with their digest, and of each digest the number of its component (group) and its smallest key (label).

    With ``join_keys`` the classes of rows that repeat a key are linked too.
    """
    narrow = docs.select(F.col(key).cast("long").alias("key"), *identity(key, text), F.col(text).alias("text"))
    rows = stored(narrow.mapInArrow(tidy(_features), FEATURES))
    named = rows.filter("n_shingles > 0 and key is not null")
    classes = named.groupBy("digest").agg(F.min("key").alias("first"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    facts = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", i * ROWS * 4 + 1, ROWS * 4)) for i in range(BANDS)])
    banded = facts.select("node", "first", "n", F.posexplode(keys).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select(F.col("bucket").alias("__bucket"))
    members = stored(banded.join(shared, F.col("bucket").eqNullSafe(F.col("__bucket"))).select("band", "bucket", "node", "first", "n"))
    # the sets of those that share a bucket; of known size, so that Catalyst may broadcast the names
    wanted = stored(members.select("node").distinct().join(facts.select("node", "first", "digest"), "node"))
    texts = narrow.select("key", "text").join(wanted.select(F.col("first").alias("key")), "key", "left_semi")
    sets = texts.mapInArrow(tidy(_sets), "first long, digest binary, hashes binary")
    sets = stored(sets.join(wanted, ["first", "digest"]).dropDuplicates(["node"]).select("node", "hashes"))
    links = _Links(facts, sets)
    for turn, bands in enumerate(TURNS):
        links.add(_star(links.labelled(members.filter(F.col("band") < bands)), turn))
    links.add(_rest(stored(_rarest(stored(links.labelled(members)), sets))))
    if join_keys:
        links.join(_of_one_key(named, facts))
    ends = links.labelled(facts.select("digest", "node", "first"))
    least = ends.groupBy("label").agg(F.min("first").alias("least"))
    return rows, join_per_key(ends, least, ["label"]).select(F.col("digest").alias("__digest"), F.col("label").alias("group"), F.col("least").alias("label"))


def _of_one_key(named: DataFrame, facts: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that repeat a key with other words."""
    repeated = named.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low != high")
    rows = named.select("key", "digest").join(repeated.select("key", "low"), "key").distinct()
    nodes = facts.select("digest", "node")
    low = nodes.select(F.col("digest").alias("low"), F.col("node").alias("a"))
    return rows.join(nodes.withColumnRenamed("node", "b"), "digest").join(low, "low").filter("a != b").select("a", "b")


def _with_labels(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with ``component``: that of their digest, else their own key; none without key."""
    joined = rows.join(ends, F.col("digest").eqNullSafe(F.col("__digest")), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "key")).otherwise(F.col("key"))
    return joined.withColumn("component", F.when(F.col("key").isNotNull(), component))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id, kept. ``key`` is an integer."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        found = _with_labels(*_classes(docs, key, text, join_keys=True))
    component = F.col("component")
    return found.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are kept, all columns: of texts linked with each other the one with the smallest key.

    Each row is a document of its own here: repeated keys do not link their texts, and of rows that repeat
    key and text one stays. Rows without key or without words stay.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        rows, ends = _classes(docs, key, text, join_keys=False)
        found = rows.filter("n_shingles > 0 and key is not null").select("key", *IDENTITY, "digest")
        labelled = found.join(ends, F.col("digest").eqNullSafe(F.col("__digest"))).select("key", *IDENTITY, "group")
        marks = stored(chosen(labelled, "group", F.min(F.struct("key", *IDENTITY))))
    return without_marked(docs, marks, key, text)
