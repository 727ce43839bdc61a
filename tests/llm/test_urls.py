"""URL rules, curated and mined."""

import itertools
import random

import pytest

from rankmill.llm import url_rules


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, label string")


URLS = [
    (1, "https://A.Example.NET/en/1?x=/de/"),
    (2, "http://net/"),
    (3, "http://net"),
    (4, "http://example.com/de/2#top"),
    (5, "http://notexample.com/de/2"),
    (6, "http://w.org/fr/"),
    (7, None),
    (8, "no scheme"),
    (9, ""),
    (None, "ftp://x.net/a://b"),
    (10, "http://other.test?q=1"),
    (10, "http://other.test?q=1"),
]


def test_hosts_paths_and_curated_rules(spark):
    got = {(r.page_id, r.host, r.path, r.rule) for r in url_rules.filter_urls(pages(spark, URLS)).collect()}
    assert got == {
        (1, "a.example.net", "/en/1", "example.net/en/"),
        (2, "net", "/", "net/"),
        (3, "net", "", None),
        (4, "example.com", "/de/2", "example.com/de/"),
        (5, "notexample.com", "/de/2", None),
        (6, "w.org", "/fr/", "org/fr/"),
        (7, "", "", None),
        (8, "", "", None),
        (9, "", "", None),
        (None, "x.net", "/a://b", "net/"),
        (10, "other.test", "", None),
    }
    assert url_rules.filter_urls(pages(spark, URLS)).count() == len(URLS)
    assert url_rules.filter_urls(pages(spark, [])).count() == 0


def test_mined_rules_judge_other_urls(spark):
    rows = [(i, f"http://h{i % 7}.net/{'ads' if i % 2 else 'news'}/{i}") for i in range(60)]
    rows += [(100 + i, f"http://h{i % 7}.org/fr/news/{i}") for i in range(60)]
    rows += [(200, "http://new.test/ads/5"), (201, "http://new.test/fr/news/7"), (202, "http://new.test/plain")]
    got = {r.page_id: (r.verdict, r.rule) for r in url_rules.filter_urls(pages(spark, rows)).collect() if r.page_id >= 200}
    assert got == {200: ("block", None), 201: ("allow", None), 202: ("allow", None)}


def test_rules_have_no_better_part(spark):
    rows = [(["a", "b"], "block")] * 50 + [(["a", "c"], "block")] * 50 + [(["c", "d"], "allow")] * 50
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string")).collect()
    assert {(tuple(r.antecedent), r.label) for r in mined} == {(("a",), "block"), (("b",), "block"), (("d",), "allow")}


def enumerated(rows, support, confidence):
    """All combinations of tokens with their label counts, less those that have a part as good."""
    least = max(support, url_rules.LEAST_URLS / len(rows)) * len(rows)
    tokens = sorted({t for own, _ in rows for t in own})
    found = {}
    for n in range(1, len(tokens) + 1):
        for combination in itertools.combinations(tokens, n):
            labels = [label for own, label in rows if set(combination) <= set(own)]
            for label in set(labels):
                both = labels.count(label)
                if both >= least and both / len(labels) >= confidence:
                    found[combination, label] = both / len(labels)
    parts = lambda c: (p for n in range(1, len(c)) for p in itertools.combinations(c, n))
    return {(c, label): round(v, 9) for (c, label), v in found.items() if not any(found.get((p, label), -1) >= v for p in parts(c))}


@pytest.mark.parametrize("seed, confidence", [(1, 0.6), (2, 0.8)])
def test_mined_rules_equal_all_combinations_tried(spark, seed, confidence):
    draw = random.Random(seed)
    rows = []
    for _ in range(160):
        own = [t for t in "abcdef" if draw.random() < 0.45]
        block = ("a" in own and "b" in own) or ("c" in own and "e" not in own)
        rows.append((own, "block" if block != (draw.random() < 0.1) else "allow"))
    rows = [(own, label) for own, label in rows if own]
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.03, confidence).collect()
    assert {(tuple(r.antecedent), r.label): round(r.confidence, 9) for r in mined} == enumerated(rows, 0.03, confidence)
