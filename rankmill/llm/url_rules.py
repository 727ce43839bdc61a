"""URL filters from association rules.

Curated rules (host, path) judge what they fit, the longest first; the pages they judge, or any other
labelled URLs, are the labels from which FP-growth mines combinations of URL tokens (host labels, path
words, file endings, query names, scheme). A combination becomes a rule if it has the support and,
for one label, the confidence asked for, and no part of it does as well. Mined rules judge the other
URLs through an inverted index: each rule is posted under its rarest token, a URL's tokens are joined
with the postings, and the rules whose tokens are all present compete: the most confident, then the most
supported, then ``block``. A URL without a rule gets the default.

Defined results: a missing URL, or one without ``://``, has an empty host and path, no tokens, and gets
the default. Rows are judged each for itself, repeated keys and missing ones included. Without
labelled URLs nothing is mined. Empty tables give an empty result. Columns of ``pages`` other than
key and URL play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from rankmill.llm.common import stored

#: The contract's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE, DEFAULT = 0.01, 0.9, "allow"
LEAST_URLS = 5  # labelled URLs that a combination needs besides its support
LABEL = "verdict="

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _behind(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_behind(url), "^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(_behind(url), "^[^/?#]*([^?#]*)", 1)


def curated(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Rule (like ``net/``) and verdict of the longest rule that fits columns host and path; else NULL."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, below in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == at) | F.endswith("host", F.lit(f".{at}"))) & F.startswith("path", F.lit(below))
        rule, verdict = F.when(fits, at + below).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; numbers in a path count as one token."""
    behind = _behind(url)
    words = F.filter(F.split(path(url), "/"), lambda w: w != "")
    name = lambda kind: lambda w: F.concat(F.lit(f"{kind}:"), w)
    parts = [
        F.transform(F.filter(F.split(host(url), "\\."), lambda w: w != ""), name("host")),
        F.transform(F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "\\.[A-Za-z]+$", ""), "^[0-9]+$", "#")), name("path")),
        F.transform(F.regexp_extract_all(path(url), F.lit("\\.([A-Za-z]+)$"), F.lit(1)), name("ending")),
        F.transform(F.regexp_extract_all(behind, F.lit("[?&]([^=&#]+)"), F.lit(1)), name("query")),
        F.transform(F.regexp_extract_all(url, F.lit("^([A-Za-z]+)://"), F.lit(1)), name("scheme")),
    ]
    return F.when(behind != "", F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (rule, antecedent, label, confidence, support) from (tokens, label); combinations without a better part."""
    baskets = stored(labelled.filter("label is not null and size(tokens) > 0").select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "label"))).alias("items")))
    schema = "rule long, antecedent array<string>, label string, confidence double, support double"
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], schema)
    least = min(1.0, max(support, LEAST_URLS / baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(baskets)
    mined = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit(LABEL)) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit(LABEL))))
    mined = stored(
        mined.select(
            F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("label"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support")
        ).withColumn("rule", F.xxhash64("antecedent", "label"))
    )
    # a part of a combination is found among the rules that share one of its tokens
    parts = mined.select(F.col("rule").alias("part"), F.col("antecedent").alias("less"), F.col("label").alias("part_label"), F.col("confidence").alias("part_confidence"))
    whole = mined.select("rule", "antecedent", "label", "confidence", F.explode("antecedent").alias("token"))
    pairs = whole.join(parts.withColumn("token", F.col("less")[0]), "token").filter(
        "part != rule and part_label = label and part_confidence >= confidence and size(less) < size(antecedent) and size(array_except(less, antecedent)) = 0"
    )
    return mined.join(pairs.select("rule").distinct(), "rule", "left_anti").select("rule", "antecedent", "label", "confidence", "support")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Best mined label for each distinct token set of ``pages`` (tokens): (tokens, mined)."""
    sets = pages.select("tokens").filter("size(tokens) > 0").distinct()
    sets = stored(sets)
    token_counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = rules.select("*", F.explode("antecedent").alias("token")).join(token_counts, "token")
    rarest = posted.groupBy("rule", "antecedent", "label", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("key"))
    index = stored(rarest.withColumn("token", F.col("key.token")).drop("key"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (F.col("label") == "block").alias("blocks"), "label"))
    return hits.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.label").alias("mined"))


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: ``key``, host, path, rule, verdict, and ``mined``, the verdict of the mined rules."""
    seen = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    seen = seen.select("key", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
    rule, label = curated(rules)
    seen = stored(seen.select("*", rule.alias("rule"), label.alias("label")))
    mined = judge(seen.filter("label is null"), mine(seen.select("tokens", "label"), support, confidence))
    found = stored(mined.withColumnRenamed("tokens", "__tokens"))
    joined = seen.join(found, F.col("tokens").eqNullSafe(F.col("__tokens")) & F.col("label").isNull(), "left")
    return joined.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("label", "mined", F.lit(default)).alias("verdict"), "mined")
