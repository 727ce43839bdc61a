"""Merkle manifest of a dataset by bitmap ranks, with DataFrame functions only.

Every row is a leaf, the hash of its fields. A leaf's place among its group's leaves, in order of
keys, is found without sorting them: the keys of a group are merged into a compressed bitmap, whose
boxes of 4,096 keys list only the 64-bit words that hold a key, each with the number of rows before
it; a directory of counts gives the rows before each box. A key's rank is then the rows before its
box and its word, and the set bits below its own. The directory is a tree: no window over it sees
more than ``CHILDREN`` children of one box of boxes, whatever the keys are like.

With its place known, each leaf goes to a slot of a block of up to ``BLOCK`` neighbours. A block climbs
several levels at once inside its slot array; the tops of the blocks are the next round's leaves. On
the way back each block hands its own path down to its slots, so a leaf's proof is put
together from blocks only. The groups' roots, in order of the groups, make one more tree of the same kind.

Defined results: missing fields count as ``-``. Rows of a group that repeat a key are ordered by their leaf; rows without key
count as the smallest 64-bit number. Rows that repeat every field are leaves of their own and
interchangeable. A group's name may be missing and comes first then. An empty table gives
an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rankmill.llm.common import stored
from rankmill.operators.joins import join_per_key
from rankmill.operators.rank import with_ranks

FAN = 2
BLOCK = 64  # slots of a block, at most
CHILDREN = 12  # bits: boxes that one box of the directory has below it
SMALLEST = -(1 << 63)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each ``-`` if missing, else its UTF-8 byte count, ``:`` and its value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


# ranks -----------------------------------------------------------------------


def _below(bits: Column, place: Column) -> Column:
    """Set bits of ``bits`` under ``place``."""
    return F.bit_count(bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), place))))


def _boxes(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Compressed bitmaps: ``by``, box, n, mask (words present) and words (bits, n, rows before in the box)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    words = rows.groupBy(*by, F.shiftright(key, 6).alias("high")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))
    slot = F.col("high").bitwiseAND(F.lit(63)).cast("int").alias("slot")
    present = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot"))
    placed = words.select(*by, F.shiftright("high", 6).alias("box"), slot, "bits", "n")
    boxes = placed.groupBy(*by, "box").agg(F.sum("n").alias("n"), F.bit_or(present).alias("mask"), F.array_sort(F.collect_list(F.struct("slot", "bits", "n"))).alias("held"))
    before = lambda i: F.aggregate(F.slice("held", F.lit(1), i), F.lit(0).cast("long"), lambda s, w: s + w["n"])
    words = F.transform("held", lambda w, i: F.struct(w["bits"].alias("bits"), w["n"].alias("n"), before(i).alias("before")))
    return boxes.select(*by, "box", "n", "mask", words.alias("words"))


def _directory(boxes: DataFrame, by: Sequence[str], children: int) -> DataFrame:
    """``by``, box, rows before the box in its group, rows of the group."""
    low, high = boxes.agg(F.min("box"), F.max("box")).first()
    levels, shift = [boxes.select(*by, "box", "n")], 0
    while low is not None and (high >> shift) - (low >> shift) >= 1 << children:
        shift += children
        up = levels[-1].groupBy(*by, F.shiftright("box", children).alias("box")).agg(F.sum("n").alias("n"))
        levels.append(stored(up))
    group = Window.partitionBy(*by)
    earlier = lambda w: F.coalesce(F.sum("n").over(w.orderBy("box").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = levels[-1].select(*by, "box", earlier(group).alias("rows_before"), F.sum("n").over(group).alias("total"))
    for level in reversed(levels[:-1]):
        above = out.withColumnsRenamed({"box": "parent", "rows_before": "parent_before"})
        within = level.withColumn("parent", F.shiftright("box", children))
        within = within.withColumn("own_before", earlier(Window.partitionBy(*by, "parent")))
        joined = join_per_key(within, above, [*by, "parent"], null_matches=True)
        out = joined.select(*by, "box", (F.col("parent_before") + F.col("own_before")).alias("rows_before"), "total")
    return out


def with_place(rows: DataFrame, by: Sequence[str], keys: Sequence[str], children: int = CHILDREN) -> DataFrame:
    """``rows`` with pos (place in its group in order of ``keys``, from 0) and total (rows of the group).

    ``keys`` are 64-bit numbers; a later one orders only what earlier ones leave tied, the last must be unique.
    """
    key, *more = keys
    columns = rows.columns
    boxes = stored(_boxes(rows, by, key))
    index = join_per_key(boxes, _directory(boxes, by, children), [*by, "box"], null_matches=True)
    found = join_per_key(rows.withColumn("box", F.shiftright(key, 12)), stored(index).drop("n"), [*by, "box"], null_matches=True)
    slot = F.shiftright(key, 6).bitwiseAND(F.lit(63)).cast("int")
    word = F.get("words", _below(F.col("mask"), slot))
    found = found.select(*columns, "total", F.col("rows_before"), word.alias("word"))
    at = F.col("rows_before") + F.col("word.before")
    own = _below(F.col("word.bits"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    found = stored(found.select(*columns, "total", at.alias("at"), own.alias("own"), (F.col("word.n") > F.bit_count("word.bits")).alias("crowded")))
    clear = found.filter("not crowded").select(*columns, "total", (F.col("at") + F.col("own")).alias("pos"))
    crowd = found.filter("crowded")
    if not more or crowd.isEmpty():
        return clear
    # words in which some key has several rows: counted by key, at most 64 of them in a word
    counts = crowd.groupBy(*by, key).agg(F.count(F.lit(1)).alias("same"))
    word_rows = Window.partitionBy(*by, F.shiftright(key, 6)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("skipped", F.coalesce(F.sum("same").over(word_rows), F.lit(0)))
    crowd = join_per_key(crowd, counts, [*by, key], null_matches=True)
    crowd = stored(crowd.select(*columns, "total", (F.col("at") + F.col("skipped")).alias("pos"), "same"))
    all_, first = f"__all_{key}", f"__first_{key}"  # ties within ties have their own
    tied = crowd.filter("same > 1").drop("same").withColumnsRenamed({"total": all_, "pos": first})
    tied = with_place(tied, [*by, key], more, children)
    tied = tied.select(*columns, F.col(all_).alias("total"), (F.col(first) + F.col("pos")).alias("pos"))
    return clear.unionByName(crowd.filter("same = 1").drop("same")).unionByName(tied)


# trees -----------------------------------------------------------------------


def _parents(nodes: Column, fan: int) -> Column:
    runs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / fan).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fan + 1, F.lit(fan)), "")))


def _climb(fan: int) -> int:
    levels = 1
    while fan ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


class _Tree:
    """The trees of all groups at once. ``nodes``: ``by``, n (nodes of the group), pos, digest and what else a leaf carries."""

    def __init__(self, nodes: DataFrame, by: Sequence[str], largest: int, fan: int) -> None:
        self.by, self.fan, self.levels = list(by), fan, _climb(fan)
        self.width = fan**self.levels
        self.blocks: list[DataFrame] = []
        self.tops: list[DataFrame] = []
        while True:
            slot = F.struct("pos", *[c for c in nodes.columns if c not in (*by, "n", "pos")])
            blocks = nodes.groupBy(*by, "n", F.expr(f"pos div {self.width}").alias("block")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
            blocks = stored(blocks)
            after = F.expr(f"(n + {self.width - 1}) div {self.width}")
            tops = self._with_ladder(blocks).select(*by, after.alias("n"), F.col("block").alias("pos"), F.get(F.element_at("ladder", -1), F.lit(0)).alias("digest"))
            self.blocks.append(blocks)
            self.tops.append(stored(tops))
            largest = -(-largest // self.width)
            if largest <= 1:
                break
            nodes = self.tops[-1].filter("n > 1")

    def _with_ladder(self, blocks: DataFrame) -> DataFrame:
        """depth: levels the block climbs; ladder: its nodes on each level, from the slots on."""
        depth = F.lit(self.levels)
        for d in reversed(range(self.levels)):
            depth = F.when(F.col("n") <= self.fan**d, d).otherwise(depth)
        steps = F.slice(F.array(*map(F.lit, range(self.levels))), F.lit(1), depth)
        first = F.array(F.transform("slots", lambda s: s["digest"]))
        ladder = F.aggregate(steps, first, lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1), self.fan))))
        return blocks.select("*", steps.alias("steps"), ladder.alias("ladder"))

    def roots(self) -> DataFrame:
        """``by`` and digest of each group's root."""
        return reduce(DataFrame.unionByName, [t.filter("n = 1").select(*self.by, "digest") for t in self.tops])

    def leaves(self, above: DataFrame) -> DataFrame:
        """The leaves with their columns, path and what ``above`` (by, path, ...) says of their group."""
        others = [c for c in above.columns if c not in (*self.by, "path")]
        out = None
        for blocks, tops in zip(reversed(self.blocks), reversed(self.tops), strict=True):
            ended = tops.filter("n = 1").select(*self.by, "pos")
            ended = join_per_key(ended, above, self.by, null_matches=True)
            upper = ended if out is None else ended.unionByName(out.select(*self.by, "pos", "path", *others))
            upper = upper.withColumnRenamed("pos", "block")
            joined = join_per_key(self._with_ladder(blocks), upper, [*self.by, "block"], null_matches=True)
            slots = joined.select(*self.by, *others, "steps", "ladder", "path", F.posexplode("slots").alias("at", "slot"))
            own = F.transform("steps", lambda d: self._siblings(F.get("ladder", d), F.col("at"), d))
            out = slots.select(*self.by, *others, "slot.*", F.concat(own, "path").alias("path"))
        return out

    def _siblings(self, nodes: Column, at: Column, level: Column) -> Column:
        """Digests to the left and to the right of the node above slot ``at`` in its run."""
        place = at
        for d in range(1, self.levels):
            place = F.when(level == d, F.call_function("div", at, F.lit(self.fan**d))).otherwise(place)
        place = place.cast("int")
        before = F.pmod(place, F.lit(self.fan))
        joined = lambda start, n: F.array_join(F.slice(nodes, start, n), "")
        return F.struct(joined(place - before + 1, before).alias("left"), joined(place + 2, F.lit(self.fan - 1) - before).alias("right"))


NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    key: str = "doc_id",
    group: str = "lang",
    carried: Mapping[str, Column] | None = None,
    fan: int = FAN,
    children: int = CHILDREN,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``group``, position, leaf, subroot, root, proof, and ``carried`` columns.

    ``proof`` lists for each level the digests to the left and to the right of the leaf's ancestor in its
    run; ``folded`` computes the root from it. ``key`` is an integer. Hashes are lowercase hex.
    """
    carried = dict(carried or {})
    names = {f"c{i}": c for i, c in enumerate(carried.values())}
    rows = docs.select(F.col(group).cast("string").alias("g"), F.col(key).alias("k"), leaf([F.col(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in names.items()])
    order = F.coalesce(F.col("k").cast("long"), F.lit(SMALLEST))
    leading = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    rows = stored(rows.select("*", order.alias("k1"), leading.alias("k2"), F.monotonically_increasing_id().alias("k3")))
    placed = with_place(rows, ["g"], ["k1", "k2", "k3"], children).drop("k1", "k2", "k3").withColumnRenamed("total", "n")
    largest = placed.agg(F.max("n")).first()[0] or 0
    tree = _Tree(placed, ["g"], largest, fan)
    above = _groups_above(stored(tree.roots()), fan)
    out = tree.leaves(above)
    return out.select(
        F.col("k").alias(key),
        F.col("g").alias(group),
        F.col("pos").alias("position"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.col("path").alias("proof"),
        *[F.col(n).alias(name) for n, name in zip(names, carried, strict=True)],
    )


def _groups_above(roots: DataFrame, fan: int) -> DataFrame:
    """g, subroot, root and the path from the group's root to the root of all; the missing group comes first."""
    named = roots.withColumn("name", F.coalesce(F.concat(F.lit("1"), "g"), F.lit("0")))
    ranked = with_ranks(named, "name", [([], {"place": "rank", "n": "count"})])
    nodes = ranked.select(F.lit(0).alias("all"), "n", (F.col("place") - 1).alias("pos"), "digest", "g")
    tree = _Tree(nodes, ["all"], roots.count(), fan)
    root = tree.roots().select("all", F.expr(NO_PATH).alias("path"), F.col("digest").alias("root"))  # one row
    return stored(tree.leaves(root).select("g", F.col("digest").alias("subroot"), "root", "path"))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))
