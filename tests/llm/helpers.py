"""Texts with the awkward cases in them, and brute-force versions of what the operators return."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SPACES = "[\x20\x09-\x0D]"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, slot int, label string, key string"


def words(seed, n, of=60):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeimnorst") for _ in range(draw.randint(2, 8))) for _ in range(of)]
    return " ".join(draw.choice(vocabulary) for _ in range(n))


def texts():
    base = words(1, 80)
    edited = base.split(" ")
    edited[40] = "other"
    return [
        (1, base),
        (2, " ".join(edited)),
        (3, base.upper()),
        (4, base.replace(" ", "\n\t ")),
        (5, base + " "),
        (6, None),
        (7, ""),
        (8, " \t\r\n"),
        (9, "few words here"),
        (10, "FEW  words\nhere"),
        (11, "x"),
        (12, "a" * 30_000),
        (13, words(2, 6000)),
        (14, words(2, 5990) + " end"),
        (15, words(3, 50)),
        (15, words(3, 50)),
        (16, words(4, 50)),
        (None, base),
        (None, "no key at all in this row of the table"),
        (17, "é" * 300 + " Ünïcode 😀😀 " + words(5, 30)),
        (18, words(6, 80) + " " + base),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "src0", 0, 1, 2, "l", "k") for i, t in rows], SCHEMA)


def counted(rows):
    return Counter(tuple(r) for r in rows)


def exact_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACES, "", t or "")].append((i, len(t or "")))
    out = Counter()
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        for i, _ in members:
            out[(i, keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest())] += 1
    return out


def shingle_set(text):
    own = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(own) < 5:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4))


def near_groups(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


def without_repeats(rows, length):
    starts = Counter()
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, body in bodies:
        starts.update(body[p : p + length] for p in range(len(body) - length + 1))
    out = Counter()
    for i, body in bodies:
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if starts[body[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[(i, len(body), sum(gone), runs, bytes(c for c, g in zip(body, gone) if not g))] += 1
    return out


def edit_distance_within(item, text):
    """Smallest edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)
