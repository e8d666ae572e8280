"""The driver's queries of this subpackage: thin calls of the operators."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, compaction, exact_dedup, jaccard_join, mixing, packing, quality, resampling, suffix_dedup, token_shards, toxicity, url_filter, whitening
from .common import read_table, shared_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_shards.write_token_shards(read_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, end_id=2)
    return token_shards.read_token_shards(shards)


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compaction.shard_documents(read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    return compaction.shard_contents(store)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_round_trip(read_table(spark, sf_dir, "documents"), RANKS)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages")).drop("pattern")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), WORD_VOCABULARY, end_id=1, limit=4096)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), percent=90, width=3).select("doc_id", "n_shingles", "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.write_ledger(read_table(spark, sf_dir, "documents"))
    book = quality.apply_policy(book, quality.POLICIES["base-1"], column="base_passed")
    book = quality.apply_policy(book, quality.POLICIES["clean-1"])
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return book.select("doc_id", *measures, (~F.col("base_passed")).alias("base_failed"), "kept", F.lit("clean-1").alias("policy"), "rules_version")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), length=100, digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), most=32)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=10, least_words=20)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.by_first_position(mixing.mix_sources(read_table(spark, sf_dir, "documents")))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


_ALL = (
    op1_exact_dedup, op2_token_shards, op3_compaction, op4_toxicity, op5_byte_bpe, op6_url_filter, op7_best_fit_packing, op8_jaccard_join, op9_quality_rules,
    op10_suffix_dedup, op11_whitening, op12_importance_resampling, op13_source_mixing,
)
QUERIES = {f.__name__: f for f in _ALL}
