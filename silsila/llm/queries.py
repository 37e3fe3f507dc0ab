"""The registered queries of this subpackage: thin uses of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hilbert, html_extract, langid, minhash, mixing, quality, sharding, suffix, toxicity
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24, store=sharding.map_store(spark))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), words=suffix.PASSAGE, report=True)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "band_low", "band_high")


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = minhash.Rule(shingle=3, percent=85, bands=24, rows=6)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), rule).select("doc_id", "n_shingles", "component_id", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.col("draws.shard").alias("shards"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_suffix_dedup, op3_quality_rules, op4_hilbert_neighbours, op5_html_extraction, op6_bpe, op7_minhash, op8_language_id, op9_toxicity, op10_mixing)
}
#: None of the ten is expressible in SQL as a whole: hashes, sketches, models and seeded draws. tests/llm uses brute force.
ORACLE_SQL: dict[str, str] = {}
