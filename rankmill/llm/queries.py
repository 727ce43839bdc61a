"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankmill.llm import alignment, bpe, decontaminate, line_dedup, manifest, pseudonyms, secrets, shards, toxicity
from rankmill.llm.common import small_batches, table
from rankmill.llm.exact_dedup import exact_duplicates
from rankmill.llm.near_dedup import near_duplicates
from rankmill.llm.suffix_dedup import without_repeats
from rankmill.llm.url_rules import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))))


@registered
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["name"].isin(*secrets.BASE))
    kinds = F.transform("spans", lambda s: s["name"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@registered
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@registered
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@registered
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def byte_bpe() -> bpe.Encoding:
    return bpe.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@registered
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary has no tokens but those of its file."""
    small_batches(spark)
    both = bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe())
    n = (F.octet_length("ids_bytes") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@registered
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registered
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@registered
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


@registered
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a fixed key, so that runs can be compared; users pass a secret one."""
    done = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), b"not a secret")
    spans = F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return done.select("doc_id", F.size("pii_spans").cast("long").alias("n_found"), F.concat_ws(",", spans).alias("spans"), "text")


@registered
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh leaf, by its key's checksum, is checked as if n_chars had been tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = manifest.leaf([F.col(f).cast("decimal(20)") + 1 if f == "n_chars" else F.col(f) for f in fields])
    proven = manifest.manifest(table(spark, sf_dir, "documents"), fields, carried={"tampered": F.when(chosen, tampered)})
    folded = proven.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    proof = manifest.proof_digest(F.col("proof")).alias("proof_sha256")
    return folded.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@registered
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@registered
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        aligned = alignment.Alignment(table(spark, sf_dir, "documents"), a.read(), b.read(), digest=True)
    return aligned.documents().withColumnRenamed("groups", "groups_sha256")
