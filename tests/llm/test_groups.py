"""Exact and near duplicates, repeated strings and shards against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.llm import exact_dedup, near_dedup, shards, suffix_dedup, suffixes
from rankmill.llm.components import components
from tests.llm.helpers import SPACES, counted, documents, exact_groups, near_groups, shingle_set, texts, without_repeats, words


@pytest.mark.parametrize("limits", [(384, 4096), (3, 20)])
def test_exact_groups(spark, limits):
    got = exact_dedup.exact_duplicates(documents(spark), least=limits[0], most=limits[1])
    assert counted(got.collect()) == exact_groups(texts())


def test_chunks_make_up_the_text(spark):
    rows = spark.createDataFrame([(t or "",) for _, t in texts()], "t string")
    cut = rows.select("t", exact_dedup.chunks(F.col("t"), 5, 40).alias("c")).collect()
    assert all("".join(r.c) == r.t and all(len(c) <= 40 for c in r.c) for r in cut)


def test_shared_identifiers_are_drawn_anew(spark):
    def weak(chunk, draw):
        return [F.lit(7).cast("long"), F.lit(7).cast("long")] if draw == 0 else exact_dedup.identifier(chunk, draw)

    assert exact_dedup.verified_draw(documents(spark), "text", 5, 40, weak) == 1
    got = exact_dedup.exact_duplicates(documents(spark), least=5, most=40, identify=weak)
    assert counted(got.collect()) == exact_groups(texts())


def test_no_documents(spark):
    none = documents(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert suffix_dedup.without_repeats(none).count() == 0
    assert shards.histogram_shards(none).count() == 0


def repeated_keys():
    x, y, z = (words(i, 40) for i in (31, 32, 33))
    return [(0, x), (1, x), (1, y), (1, y), (2, z + " "), (2, z), (3, z), (4, y + " end"), (5, "x y"), (5, "x y"), (6, None), (6, ""), (None, z), (None, "only here"), (None, "only here")]


def exact_left(rows):
    """One row of each group: the longest original, then the smallest key, a missing one last."""
    best = {}
    for i, t in rows:
        body = re.sub(SPACES, "", t or "")
        best[body] = min(best.get(body, (0, True, 0, "")), (-len(t or ""), i is None, i or 0, t or ""))
    return Counter((None if none else i, t) for _, none, i, t in best.values())


def near_left(rows):
    """One row of each component of rows; rows without key or words stay."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for x, (i, _) in enumerate(rows):
        for y in range(x):
            if None not in (i, rows[y][0]) and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                label = [label[y] if n == label[x] else n for n in label]
    out, best = Counter(), {}
    for (i, t), s, n in zip(rows, sets, label):
        if i is None or not s:
            out[(i, t or "")] += 1
        else:
            best[n] = min(best.get(n, (i, t)), (i, t))
    return out + Counter(best.values())


def test_filters_lose_no_text(spark):
    rows = texts() + repeated_keys()
    docs = documents(spark, rows)
    for kept, want in ((exact_dedup.without_duplicates(docs), exact_left(rows)), (near_dedup.without_near_duplicates(docs), near_left(rows))):
        assert kept.columns == docs.columns
        got = Counter((r.doc_id, r.text or "") for r in kept.collect())
        plain = lambda counts: Counter({(i, re.sub(SPACES, "", t)): n for (i, t), n in counts.items()})  # noqa: E731 - ties
        assert plain(got) == plain(want)


def near_texts():
    rows = texts()
    draw = random.Random(8)
    base = words(9, 60).split(" ")
    for i in range(40):  # a crowd around one text, from near to far
        own = list(base)
        for _ in range(draw.randint(0, 6)):
            own[draw.randrange(len(own))] = f"w{draw.randint(0, 9)}"
        rows.append((100 + i, " ".join(own)))
    chain = words(10, 100).split(" ")
    for i in range(12):  # each is near its neighbours only
        chain = chain[4:] + [f"c{i}{j}" for j in range(4)]
        rows.append((200 - i, " ".join(chain)))
    return rows


def test_near_groups(spark):
    rows = near_texts() + repeated_keys()
    got = near_dedup.near_duplicates(documents(spark, rows))
    assert counted(got.select("doc_id", "n_shingles", "component_id").collect()) == near_groups(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())


def test_posterior_bound():
    need = [near_dedup.least_matches(n, 0.75, 1e-7) for n in (32, 64, 96, 128)]
    assert need == sorted(need) and all(n * 0.3 < m < n * 0.75 for n, m in zip((32, 64, 96, 128), need))
    assert near_dedup.least_matches(4, 0.0, 0.5) == 0


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in list(parent)}


@pytest.mark.parametrize("crowd", [512, 3])
def test_repeated_strings(spark, crowd):
    draw = random.Random(4)
    some = lambda n: "".join(draw.choice("abcdefg ") for _ in range(n))
    parts = [some(60) for _ in range(4)]
    rows = [(i, t) for i, t in texts() if len(t or "") < 2000] + [(3, parts[0] + some(50) + parts[0]), (None, parts[1]), (30, "a" * 300), (31, "ab" * 90)]
    rows += [(40 + i, some(draw.randint(0, 60)) + draw.choice(parts)[draw.randint(0, 20) :] + some(draw.randint(0, 30)) + draw.choice(parts)) for i in range(50)]
    got = suffix_dedup.without_repeats(documents(spark, rows), length=20, gram=8, crowd=crowd).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.starts), bytes(r.kept)) for r in got) == without_repeats(rows, 20)


def test_long_texts_are_cut_alike(spark):
    long = words(11, 30_000, of=5000)  # more windows than are looked at together
    rows = [(1, long), (2, "start:" + long[70_000:140_000]), (3, words(12, 100))]
    got = {r.doc_id: r.n_bytes - len(r.kept) for r in suffix_dedup.without_repeats(documents(spark, rows)).collect()}
    assert got == {1: 70_000, 2: 70_000, 3: 0}


def test_suffix_arrays():
    draw = random.Random(5)
    for _ in range(400):
        text = [draw.randint(1, draw.choice([1, 2, 3, 26])) for _ in range(draw.randint(1, 60))] + [0]
        want = sorted(range(len(text)), key=lambda i: text[i:])
        order = suffixes.suffix_array(np.array(text))
        assert order.tolist() == want
        assert suffixes.suffix_array(np.array(text), sparse=9.0).tolist() == want  # all by moving bucket parts
        n = draw.randint(1, 5)
        seen = [tuple(text[i : i + n]) for i in range(len(text))]
        assert suffixes.shared_starts(np.array(text), order, n).tolist() == [len(s) == n and seen.count(s) > 1 for s in seen]


@pytest.mark.parametrize("cell_rows", [4096, 4])
def test_shards(spark, cell_rows):
    rows = texts() + [(300 + i, words(20, 40)) for i in range(120)] + [(600 + i, words(i, 30)) for i in range(200)]
    docs = documents(spark, rows)
    got = shards.histogram_shards(docs, cell_rows=cell_rows)
    assert set(docs.columns) <= set(got.columns) and not [c for c in got.columns if c.startswith("__")]
    found = got.collect()
    assert counted((r.doc_id, r.text, r.size) for r in found) == counted((i, t, len((t or "").encode()) + 1) for i, t in rows)
    for shard in range(16):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shards_are_even_with_a_hot_text(spark):
    rows = [(i, "the same text " * 5) for i in range(1500)] + [(5000 + i, words(i, 10 + i % 30)) for i in range(3000)]
    sizes = shards.histogram_shards(documents(spark, rows)).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    mean = sum(r.n for r in sizes) / 16
    assert len(sizes) == 16 and all(abs(r.n - mean) < 0.02 * mean for r in sizes)


@pytest.mark.parametrize("copies", [0, 400])
def test_splitters_against_all_rows_in_order(spark, copies):
    """Sorted by (hash of text, hash of key) as unsigned, shards follow one another, and each border lies where its share of bytes is full."""
    rows = [(i, words(i, 1 + i % 60)) for i in range(900)] + [(2000 + i, words(77, 30)) for i in range(copies)] + [(3000 + i, None) for i in range(5)]
    got = shards.histogram_shards(documents(spark, rows), tolerance=0.01)
    order = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("high"), F.xxhash64("doc_id").alias("low")]
    found = sorted((r.high % 2**64, r.low % 2**64, r.shard, r.size, r.text or "") for r in got.select("shard", "size", "text", *order).collect())
    assert [r[2] for r in found] == sorted(r[2] for r in found)
    ends = np.cumsum([r[3] for r in found])
    total, largest = ends[-1], max(r[3] for r in found)
    for k in range(1, 16):
        below = sum(r[3] for r in found if r[2] < k)
        assert abs(below - total * k / 16) <= max(0.01 * total / 16, largest)
    placed = {}
    for *_, shard, _, text in found:
        placed.setdefault(text, set()).add(shard)
    split = [t for t, own in placed.items() if len(own) > 1]
    assert set(split) <= {words(77, 30)} and (copies > 0) == bool(split)  # only copies that fill more than a shard are divided
    assert all(own == set(range(min(own), max(own) + 1)) for own in placed.values())
