"""Resolution of mentions, relations, events and arguments to identities.

``unresolved`` says what becomes of rows whose mention is known but has no
identity: ``drop`` them, ``keep_null``, or treat noise as a ``singleton`` cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canon import own_key
from .extract import key_of

MODES = ("drop", "keep_null", "singleton")


def _dimension(clusters: DataFrame, canon: DataFrame, key: str, found: str, mode: str) -> DataFrame:
    """key -> identity; every key of ``clusters`` is there, unresolved ones with null.

    Of several rows of ``canon`` for one cluster the last by its column ``seq`` counts.
    """
    if mode not in MODES:
        raise ValueError(f"unresolved must be one of {MODES}")
    at = own_key(F.col("cluster_id"), F.col(key)) if mode == "singleton" else F.col("cluster_id")
    value = F.max_by(found, "seq") if "seq" in canon.columns else F.max(found)  # without an order of rows, the largest
    last = canon.groupBy("cluster_id").agg(value.alias(found)).withColumnRenamed("cluster_id", "_cluster")
    return clusters.select(key, at.alias("_cluster")).join(last, "_cluster", "left").select(key, found)


def mention_to_entity(clusters: DataFrame, canon: DataFrame, mode: str = "drop") -> DataFrame:
    return _dimension(clusters, canon, "mention_id", "entity_id", mode)


def raw_to_type(clusters: DataFrame, types: DataFrame, key: str, mode: str = "drop") -> DataFrame:
    return _dimension(clusters, types, key, "type_id", mode)


def triples(relations: DataFrame, entity_of: DataFrame, type_of: DataFrame, mode: str = "drop") -> DataFrame:
    """subject, relation_type_id, object, doc_id, confidence, evidence."""
    side = lambda name: entity_of.select(F.col("mention_id").alias(f"_{name}"), F.col("entity_id").alias(f"{name}_id"))
    rows = relations.withColumns({"_s": key_of("id", "subject"), "_o": key_of("id", "object")})
    out = rows.join(side("s"), "_s").join(side("o"), "_o").join(type_of, "relation_id")
    if mode != "keep_null":
        out = out.where("s_id is not null and o_id is not null and type_id is not null")
    return out.select(F.col("s_id").alias("subject"), F.col("type_id").alias("relation_type_id"), F.col("o_id").alias("object"), F.col("id").alias("doc_id"), "confidence", "evidence")


def events_resolved(events: DataFrame, entity_of: DataFrame, type_of: DataFrame) -> DataFrame:
    """Typed events with the roles whose mention has an identity; an empty map where none has."""
    typed = events.join(type_of.where("type_id is not null"), "event_id")
    roles = typed.select("event_id", "id", F.explode("arguments").alias("role", "local")).withColumn("mention_id", key_of("id", "local"))
    known = roles.join(entity_of.where("entity_id is not null"), "mention_id").groupBy("event_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "entity_id")))).alias("arguments"))
    return typed.drop("arguments").join(known, "event_id", "left").select("event_id", F.col("type_id").alias("event_type_id"), F.col("id").alias("doc_id"), "trigger", F.coalesce("arguments", F.create_map().cast("map<string,string>")).alias("arguments"), "confidence")


def coverage(total: DataFrame, resolved: DataFrame, name: str) -> DataFrame:
    """n, n_resolved and the floor percentage, null where there is nothing."""
    a = total.agg(F.count(F.lit(1)).alias("n"))
    b = resolved.agg(F.count(F.lit(1)).alias("n_resolved"))
    return a.join(F.broadcast(b)).select(F.lit(name).alias("kind"), "n", "n_resolved", F.expr("try_divide(100 * n_resolved, n)").cast("long").alias("percent"))  # one row each


def link_arguments(arguments: DataFrame, mentions: DataFrame, entity_of: DataFrame) -> DataFrame:
    """claimant_id and target_id by (document, name in any case); of equal names the last mention's."""
    names = mentions.join(entity_of, "mention_id").groupBy("id", F.lower("name").alias("_name")).agg(F.max_by("entity_id", "seq").alias("_entity"))
    out = arguments
    for c in ("claimant", "target"):
        side = names.select(F.col("id").alias("_id"), F.col("_name").alias("_key"), F.col("_entity").alias(f"{c}_id"))
        out = out.join(side, (F.col("id") == F.col("_id")) & (F.lower(c) == F.col("_key")), "left").drop("_id", "_key")
    return out


def link_stats(linked: DataFrame) -> DataFrame:
    return linked.agg(F.count(F.lit(1)).alias("n"), F.count("claimant_id").alias("claimants"), F.count("target_id").alias("targets"), F.count_if(F.col("claimant_id").isNull()).alias("no_claimant"))
