"""The Merkle manifest and its ranks against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankmill.llm import manifest
from tests.llm.helpers import documents, texts

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def climb(nodes, fan):
    """Root of the nodes, and for each of them the digests on the left and on the right of its ancestors."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            first = at // fan * fan
            run = nodes[first : first + fan]
            paths[i].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        nodes = [digest("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        places = [at // fan for at in places]
    return nodes[0], paths


def brute(rows, fan=2):
    groups = defaultdict(list)
    for r in rows:
        key = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
        groups[r["lang"]].append((key, leaf(r), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda x: x[:2]) for g in names}
    below = {g: climb([x[1] for x in ordered[g]], fan) for g in names}
    root, above = climb([below[g][0] for g in names], fan) if names else (None, [])
    out = Counter()
    for i, g in enumerate(names):
        for at, ((_, own, key), path) in enumerate(zip(ordered[g], below[g][1])):
            out[(key, g, at, own, below[g][0], root, tuple(path + above[i]))] += 1
    return out


def made(df, fan=2, **more):
    got = manifest.manifest(df, FIELDS, fan=fan, **more).collect()
    return Counter((r.doc_id, r.lang, r.position, r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.proof)) for r in got)


def some_rows(seed, n, langs, keys):
    draw = random.Random(seed)
    return [
        {
            "doc_id": draw.choice([None, draw.randint(*keys), draw.randint(*keys)]),
            "text": draw.choice([None, "", "é" * draw.randint(0, 5), f"text {draw.random()}"]),
            "lang": draw.choice(langs),
            "source": draw.choice([None, "src1", "källa"]),
            "n_chars": draw.choice([None, 3, 12345]),
        }
        for _ in range(n)
    ]


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, pos int, box string, digest string, subroot int"
    return spark.createDataFrame([(*[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")], 1, "b", "d", 2) for r in rows], schema)


@pytest.mark.parametrize(
    "n, langs, keys, fan, children",
    [
        (300, ["en", None, "de", "z", "é"], (0, 100), 2, 12),  # many repeated keys
        (150, ["en"], (-(1 << 63), (1 << 63) - 1), 2, 3),  # keys far apart: a deep directory
        (9, list("abcdefghi"), (1, 9), 3, 12),
    ],
)
def test_manifest_matches_brute_force(spark, n, langs, keys, fan, children):
    rows = some_rows(n, n, langs, keys)
    rows += rows[:5]  # rows that repeat every field
    assert made(frame(spark, rows), fan, children=children) == brute(rows, fan)


def test_awkward_documents(spark):
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": "src0", "n_chars": 0} for i, t in texts()]
    assert made(documents(spark)) == brute(rows)
    assert manifest.manifest(documents(spark, []), FIELDS).count() == 0


def test_proofs_fold_to_the_root_only_from_their_own_leaf(spark):
    rows = some_rows(3, 90, ["en", "fr"], (0, 1 << 40))
    changed = manifest.leaf([F.lit(1) if f == "n_chars" else F.col(f) for f in FIELDS])
    proven = manifest.manifest(frame(spark, rows), FIELDS, carried={"changed": changed})
    own, other = (F.sum((manifest.folded(F.col(c), F.col("proof")) == F.col("root")).cast("int")) for c in ("leaf", "changed"))
    assert tuple(proven.agg(own, other).first()) == (90, 0)
    found = {r.proof_sha256 for r in proven.select(manifest.proof_digest(F.col("proof")).alias("proof_sha256")).collect()}
    assert found == {digest("".join(a + b for a, b in path)) for *_, path in brute(rows)}


def test_ranks_read_bitmaps_not_order(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011 - 5000).alias("k"), F.lit("g").alias("g"))
    placed = manifest.with_place(rows, ["g"], ["k"])
    assert placed.filter("total != 20000").count() == 0
    assert [r.k for r in placed.orderBy("pos").collect()] == sorted(r.k for r in rows.collect())
    assert sorted(r.pos for r in placed.collect()) == list(range(20_000))
