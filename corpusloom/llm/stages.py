"""Pipeline stages: the operators as filters and rewrites of a documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard_join, packing, suffix_dedup, toxicity
from .common import col, fresh, materialise, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the network doesn't call toxic.  The score stays beside its row, so no join is needed.

    A null text is scored as an empty one; repeated rows fare alike; no column of ``docs`` may clash,
    and an empty table gives an empty one.
    """
    score = fresh("_score", docs.columns)
    scored = toxicity.score_rows(docs, read_table(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (A-Z lower-cased): that of the smallest doc_id, one of them if
    it repeats.  Rows travel whole through the sort.

    A null text is an empty one; a null doc_id stays only where its group has no other; no column of
    ``docs`` may clash, and an empty table gives an empty one.
    """
    return exact_dedup.distinct_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8: that of the smallest doc_id.

    Documents without words stay, repeated rows of one that stays give one row.  A null doc_id is the
    largest; no column of ``docs`` may clash, and an empty table gives an empty one.
    """
    parts = jaccard_join.jaccard_components(docs, percent=80, width=5)
    kept = parts.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("size"))
    kept = materialise(kept.where("not stays or (n > 1 and size > 0)"), "near-copies")
    key, own = fresh("_key", docs.columns), fresh("_own", docs.columns)
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(col(docs, "text").cast("string"), F.lit("")))).withColumn(own, col(docs, "doc_id").cast("long"))
    named = kept.select(F.col("doc_id").alias(own + "_"), F.col("text_hash").alias(key + "_"), "stays")
    same = rows[key].eqNullSafe(named[key + "_"]) & rows[own].eqNullSafe(named[own + "_"])
    rest = rows.join(named, same, "left_anti")
    several = named.where("stays")
    if not several.isEmpty():  # rows that repeat identifier and text
        rest = rest.union(rows.join(several, same, "left_semi").dropDuplicates([key, own]))
    return rest.drop(key, own)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 100 that start earlier; n_chars follows the text.

    Other columns travel with their row, as they are.  A character cut at an edge goes whole; a null
    text becomes an empty one; a null doc_id counts as the first; an empty table gives an empty one.
    """
    return suffix_dedup.cut_rows(docs, length=100, count_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens packed into sequences.

    A null text is an empty one; repeated rows are packed apart; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, limit=4096)
