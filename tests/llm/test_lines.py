"""Repeated lines against brute force."""

import re
from collections import Counter, defaultdict

import pytest

from rankmill.llm import line_dedup
from tests.llm.helpers import documents, texts


def key_of(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least_chars=20, least_docs=3):
    holders = defaultdict(set)
    rank = lambda i: -(1 << 64) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders[key_of(line)].add(rank(i))
    crowded = {k: max(h) for k, h in holders.items() if len(h) >= least_docs}
    out = Counter()
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if crowded.get(key_of(x), rank(i)) == rank(i)]
        out[(i, "\n".join(kept), len(own), len(own) - len(kept))] += 1
    return out


def line_texts():
    common = "Terms and conditions apply to all"
    rows = texts()
    rows += [(100 + i, f"own line number {i} of this text\n  {common.upper()}\t\n\nshort\nshort") for i in range(30)]
    rows += [(200 + i, "\n".join([f"{common}"] * 70 + ["pages " * 5 + str(j % 3) for j in range(90)])) for i in range(4)]
    rows += [(300, common), (300, common + "\nand one more text under this key"), (300, common), (None, common), (None, "x\n" + common)]
    rows += [(400 + i, "in two documents only, so it stays") for i in range(2)]
    rows += [(500 + i, "ÄÖÜ stays as it is: only ASCII letters are folded" if i % 2 else "äöü stays as it is: only ASCII letters are folded") for i in range(5)]
    rows += [(600, "\n" * 200), (601, "\x0b\x0c" + common + "\r\n" + common), (602, " " + common), (603, " " + common), (604, " " + common)]
    rows += [(700 + i, "19 characters here." + "😀" * (i % 2)) for i in range(8)]
    return rows


@pytest.mark.parametrize("hot_rows", [64, 1, 10**9])  # some, nearly all and no ranges settled by aggregates
def test_repeated_lines(spark, hot_rows):
    rows = line_texts()
    got = line_dedup.without_repeated_lines(documents(spark, rows), hot_rows=hot_rows)
    assert set(got.columns) == set(documents(spark, rows).columns) | {"n_lines", "n_dropped"}
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute(rows)


def test_other_limits(spark):
    rows = line_texts()
    got = line_dedup.without_repeated_lines(documents(spark, rows), least_chars=3, least_docs=2)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute(rows, 3, 2)


def test_bitmaps_list_only_words_with_dropped_lines(spark):
    rows = [(i, "\n" * 1000 + "the same line in every document" + "\n" * 1000) for i in range(3)] + [(9, "nothing lost here")]
    keeps = line_dedup.keep_bitmaps(documents(spark, rows)).collect()
    assert len(keeps) == 2
    assert all([w.word for w in r["__keep"]] == [1000 // 64] for r in keeps)
    assert all(bin(r["__keep"][0].bits & (1 << 64) - 1).count("1") == 63 for r in keeps)


def test_no_documents(spark):
    assert line_dedup.without_repeated_lines(documents(spark, [])).count() == 0
    assert line_dedup.without_repeated_lines(documents(spark, [(1, None)])).first().text == ""
