"""Secret scans through a trigram inverted index, with DataFrame functions only.

For each rule a Boolean trigram query is derived from its regular expression: clauses that must all
hold, each a choice of trigram sets of which one must be whole in the text. The index holds postings
(trigram, key) for the trigrams the rules name, taken from the text in lower case. Postings are
intersected by counting, per document and choice, how many of its trigrams were posted; documents
that satisfy a rule's query are its candidates, and only on them is the expression run. A rule that
yields no mandatory trigram scans every text.

Defined results: a missing text counts as empty and has no secrets. Rows that repeat a key are
scanned each for itself; a row without key is matched through postings without key. An empty table
gives an empty result. Further columns of ``docs`` play no part. Long texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op, _parser  # the standard library's reading of a regular expression

from pyspark.sql import Column, DataFrame, functions as F

from rankmill.llm.common import stored

MAX_CHOICES = 64  # exact strings carried while a query is derived; beyond them the clause is closed


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three kinds are the contract's; the others are public token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE = ("assign", "access", "hex")

Clause = frozenset  # of choices, each a frozenset of trigrams


class _Query:
    """Derives the clauses: ``words`` holds every string the expression's last part can have matched."""

    def __init__(self) -> None:
        self.clauses: list[Clause] = []
        self.words = {""}

    def close(self) -> None:
        choices = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in self.words}
        if all(choices):  # a choice that needs more than another one adds nothing
            self.clauses.append(frozenset(c for c in choices if not any(other < c for other in choices)))
        self.words = {""}

    def extend(self, more: set[str] | None) -> None:
        if more is None or len(self.words) * len(more) > MAX_CHOICES:
            self.close()
        if more is not None and len(more) <= MAX_CHOICES:
            self.words = {a + b for a, b in product(self.words, more)}

    def read(self, parsed) -> None:
        for kind, value in parsed:
            if kind is op.MAX_REPEAT and value[0] >= 1 and value[1] > 1:
                self.read(value[2])  # once at least, then anything
                self.close()
            elif kind is op.SUBPATTERN and _strings([(kind, value)]) is None:
                self.read(value[3])
            else:
                self.extend(_strings([(kind, value)]))


def _strings(parsed) -> set[str] | None:
    """All strings a part can match, in lower case; None where they are too many."""
    out = {""}
    for kind, value in parsed:
        if kind is op.LITERAL:
            more = {chr(value).lower()}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            more = {chr(v).lower() for _, v in value}
        elif kind is op.BRANCH:
            parts = [_strings(p) for p in value[1]]
            more = None if None in parts else set().union(*parts)
        elif kind is op.SUBPATTERN:
            more = _strings(value[3])
        elif kind is op.MAX_REPEAT and tuple(value[:2]) == (0, 1):
            more = _strings(value[2])
            more = None if more is None else more | {""}
        else:
            return None
        if more is None or len(out) * len(more) > MAX_CHOICES:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every text with a match satisfies; none if the expression has no mandatory trigram."""
    query = _Query()
    query.read(_parser.parse(pattern))
    query.close()
    return query.clauses


def build_index(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, key): which texts, in lower case, hold which of the trigrams."""
    low = docs.select(F.col(key).alias("key"), F.lower(text).alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return low.select("key", F.explode(F.array_compact(held)).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): documents whose postings satisfy the query of one rule or more."""
    spark = index.sparkSession
    rows = [
        (rule.kind, c, a, len(choice), len(clauses), t)
        for rule in rules
        if (clauses := trigram_query(rule.pattern))
        for c, clause in enumerate(clauses)
        for a, choice in enumerate(sorted(map(sorted, clause)))
        for t in choice
    ]
    terms = spark.createDataFrame(rows, "kind string, clause int, choice int, need int, clauses int, trigram string")
    found = index.distinct().join(terms, "trigram").groupBy("key", "kind", "clauses", "clause", "choice", "need").agg(F.count(F.lit(1)).alias("n"))
    whole = found.filter("n = need").groupBy("key", "kind", "clauses").agg(F.countDistinct("clause").alias("n"))
    return whole.filter("n = clauses").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind, end, kind name) in code points; end exclusive, short matches left out."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), held.alias("held"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["whole"])
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), F.lit(rule.kind).alias("name"))
        return F.struct(end.alias("at"), F.when(F.length(part["held"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.rlike(text, pattern), walked).otherwise(none)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key`` and ``spans``, ordered by start, then kind as listed."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    wanted = sorted({t for clauses in queries.values() for clause in clauses for choice in clause for t in choice})
    # of known size once stored, so that Catalyst broadcasts the candidates where they are few
    found = stored(candidates(build_index(docs, wanted, key, text), rules).withColumnRenamed("key", "__key"))
    body = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    joined = body.join(found, F.col("key").eqNullSafe(F.col("__key")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")
    spans = []
    for i, rule in enumerate(rules):
        here = _spans(F.col("body"), rule, i)
        spans.append(F.when(F.array_contains("kinds", F.lit(rule.kind)), here).otherwise(none) if queries[rule.kind] else here)
    return joined.select(F.col("key").alias(key), F.array_sort(F.concat(*spans)).alias("spans"))
