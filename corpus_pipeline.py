"""A text corpus made ready for training: stages over the documents table, each stored before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Nothing that a stage rejects comes back, and nothing it has no reason to reject goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankmill.llm import bpe, decontaminate, toxicity
from rankmill.llm.common import small_batches, stored, table
from rankmill.llm.exact_dedup import without_duplicates
from rankmill.llm.near_dedup import without_near_duplicates
from rankmill.llm.queries import byte_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the labels are looked up among the stage's own documents."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens (ids as little-endian unsigned 32-bit integers) and text, as decoded from the ids."""
    small_batches(spark)
    both = bpe.round_trip(docs, byte_bpe())
    n = (F.octet_length("ids_bytes") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.col("ids_bytes").alias("tokens"), F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", to_tokens),
]

#: SQL can't express the toxicity model, edit matching and byte-pair merges; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
