"""The thin queries of this subpackage, for ``__spark_entry__.py``.

Each applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmetrics.llm import bpe, chat, decontaminate, licenses, manifest, minhash, phrases, quality, secrets, shards, suffixes, token_counts, urls
from segmetrics.llm.batches import text_batches
from segmetrics.llm.sql import ORACLE_SQL  # noqa: F401  (queries without an entry are held against brute force in tests/llm)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired_chats(table(spark, sf_dir, "conversations"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"), 40).drop("digest")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *[f"counts.{c}" for c in quality.COUNTS[:5]], "base_failed", "kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words_each=2, percent=80)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned_licenses(*licenses.document_files(table(spark, sf_dir, "documents")))


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified_manifest(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_chat_formatting,
        op3_decontamination,
        op4_sharding,
        op5_quality_rules,
        op6_secret_scan,
        op7_suffix_dedup,
        op8_minhash_dedup,
        op9_bpe,
        op10_license_scan,
        op11_url_filter,
        op12_merkle_manifest,
        op13_phrase_collocations,
    )
}
