"""Rows named by what they hold, for tables whose keys repeat or are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankmill.operators.joins import join_per_key

IDENTITY = ("__t1", "__t2")


def identity(key: str, text: str) -> list[Column]:
    """128 bits that name a key with its text. Spark hashes skip what is missing, so its being missing is hashed too."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.lit(i), F.col(key).isNull(), F.col(key), F.col(text).isNull(), body).alias(c) for i, c in enumerate(IDENTITY)]


def chosen(rows: DataFrame, group: str, best: Column) -> DataFrame:
    """Marks (__t1, __t2, __all) for ``without_marked``: the ``best`` row of each ``group`` stays, once.

    ``rows`` has the identity and what ``best``, an aggregate of structs that end with the identity, reads. __all is true
    for rows that go and false for those of which one stays; rows without mark stay as they are.
    """
    groups = rows.groupBy(F.col(group).alias("__group")).agg(best.alias("__best"))
    joined = join_per_key(rows.withColumnRenamed(group, "__group"), groups, ["__group"])
    stays = (F.col("__best.__t1") == F.col("__t1")) & (F.col("__best.__t2") == F.col("__t2"))
    counted = joined.groupBy(*IDENTITY, (~stays).alias("__all")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("__all or n > 1").select(*IDENTITY, "__all")


def without_marked(docs: DataFrame, marks: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``docs`` less those marked. ``marks`` is a stored table with one row per identity."""
    named = docs.select("*", *identity(key, text))
    gone = marks.filter("__all").select(*[F.col(c).alias(f"{c}_gone") for c in IDENTITY])
    same = (F.col("__t1") == F.col("__t1_gone")) & (F.col("__t2") == F.col("__t2_gone"))
    left = named.join(gone, same, "left_anti")
    if marks.filter("not __all").isEmpty():
        return left.select(*docs.columns)
    repeated = join_per_key(left, marks.filter("not __all").withColumnRenamed("__all", "__once"), IDENTITY, "left")
    once = repeated.filter("__once is not null").dropDuplicates(list(IDENTITY))
    return repeated.filter("__once is null").unionByName(once).select(*docs.columns)
