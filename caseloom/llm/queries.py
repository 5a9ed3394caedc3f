"""The operators of this package as registered queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import (fill_in_middle, hamming, hosts, mixing, packing, pii, resampling, secret_scan, simhash, sketches,
                          substrings, toxicity, window_packing)
from caseloom.llm.common import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    counts = [secret_scan.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window seen earlier covers, and a digest of the others."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return sketches.with_edits(table(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, and how many entities it had."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (pii.with_surrogates(docs, found_as="entities")
            .select("doc_id", "text", F.size("entities").alias("n_entities"),
                    F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest codes of every hundredth vector."""
    return hamming.search(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every document in the mixture of the sources."""
    return (mixing.mix(table(spark, sf_dir, "documents"))
            .select("doc_id", "source", "position", "weight", "block"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infilling form of every document, with digests of its layout and of the text rebuilt from it."""
    rows = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the texts of ``benchmark``."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in full sequences of 2048 ids."""
    return window_packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_secrets": op2_secrets,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_sketches": op4_sketches,
        "op5_surrogates": op5_surrogates,
        "op6_toxicity": op6_toxicity,
        "op7_url_filter": op7_url_filter,
        "op8_hamming_topk": op8_hamming_topk,
        "op9_packing": op9_packing,
        "op10_mixing": op10_mixing,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_resampling": op12_resampling,
        "op13_window_packing": op13_window_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": substrings.remove_repeats_sql(),
        "op7_url_filter": hosts.judge_sql(URL_RULES),
        "op8_hamming_topk": hamming.search_sql(),
        "op11_fill_in_middle": fill_in_middle.transform_sql(),
        "op12_resampling": resampling.resample_sql(),
    }
