"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is cut at places its content decides, so equal texts fall into equal chunks. Distinct chunks
are found by comparing their text in one grouping that combines on the map side, so each distinct
chunk moves once. A chunk's identifier is a pair of seeded hashes, verified to stand for that chunk
alone; should two distinct chunks share one, new seeds are drawn. A document's recipe is the ordered
list of its identifiers, so equal recipes mean equal texts: only recipes, a fiftieth of the text,
are shuffled to form groups. The documents themselves never move.

Defined results: a missing text counts as empty, and all empty texts form one group. Of equal texts
the longest original stays, then the smallest key; a row without key stays only if its whole group
has none. Rows that repeat a key and a text are one document seen twice: both count in the group's
size and have the same verdict; the filter keeps one of them. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankmill.llm.common import SPACES, stored
from rankmill.llm.rows import IDENTITY, chosen, identity, without_marked

#: A chunk ends after such letters, about every 150 characters of Latin text, within these limits.
BOUNDARY = "[a-h][i-p][q-z][a-h][i-z]"
MIN_CHARS, MAX_CHARS = 384, 4096
SEED_DRAWS = 8


def normalised(text: Column) -> Column:
    """Text without the six white-space characters; a missing text counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """Content-defined pieces whose concatenation is ``text``; none of an empty text.

    Cut from the left, each at the first boundary beyond ``least`` characters or at ``most``, so that
    a chunk depends only on the text from its own start.
    """
    pattern = f"(?s).{{{least},{most}}}?(?<={BOUNDARY})|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column, draw: int) -> list[Column]:
    """128 bits for a chunk; another function for each draw."""
    return [F.xxhash64(F.lit(2 * draw + i), chunk) for i in range(2)]


def verified_draw(docs: DataFrame, text: str, least: int, most: int, identify=identifier) -> int:
    """The first draw of seeds whose identifiers are one to one with the distinct chunks of all texts."""
    pieces = docs.select(F.explode(chunks(normalised(F.col(text)), least, most)).alias("chunk"))
    for draw in range(SEED_DRAWS):
        distinct = pieces.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
        named = distinct.select(F.array(*identify(F.col("chunk"), draw)).alias("id"))
        if named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return draw
    raise RuntimeError(f"chunks shared identifiers under {SEED_DRAWS} draws of seeds")


def _recipes(docs: DataFrame, key: str, text: str, least: int, most: int, identify) -> DataFrame:
    """(id, identity, chars, sha, recipe) of every row."""
    draw = verified_draw(docs, text, least, most, identify)
    body = docs.select(F.col(key).alias("id"), *identity(key, text), F.length(F.coalesce(text, F.lit(""))).alias("chars"), normalised(F.col(text)).alias("body"))
    cut = body.select("id", *IDENTITY, "chars", F.sha2("body", 256).alias("sha"), chunks(F.col("body"), least, most).alias("cut"))
    recipe = F.flatten(F.transform("cut", lambda c: F.array(*identify(c, draw))))
    return stored(cut.select("id", *IDENTITY, "chars", "sha", recipe.alias("recipe")))


def exact_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = MIN_CHARS,
    most: int = MAX_CHARS,
    identify=identifier,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, keep_id, group_size, kept, text_sha256. ``key`` is an integer."""
    rows = _recipes(docs, key, text, least, most, identify)
    # the complement turns the smallest key into the largest without overflow; NULL sorts below any number
    best = F.max(F.struct("chars", F.bitwise_not("id").alias("turned")))
    groups = rows.groupBy(F.col("recipe").alias("same")).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # null-safe, so that both sides are shuffled for this join alone and a hot group's rows can be split
    joined = rows.join(groups, F.col("recipe").eqNullSafe(F.col("same")))
    keep = F.bitwise_not("best.turned")
    return joined.select(
        F.col("id").alias(key),
        keep.alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """Rows of ``docs`` that stay, all columns: one of each group, whether keys repeat or are missing.

    Of rows with the same longest text and smallest key any one stays.
    """
    rows = _recipes(docs, key, text, least, most, identifier)
    best = F.max(F.struct("chars", F.bitwise_not("id").alias("turned"), *IDENTITY))
    return without_marked(docs, stored(chosen(rows, "recipe", best)), key, text)
