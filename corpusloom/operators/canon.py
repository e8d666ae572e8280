"""Clusters of mentions, their summaries, and canonical identities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chat, flow


def cluster_by(df: DataFrame, key: str, group: Column, prefix: Column, least: int) -> DataFrame:
    """(key, cluster_id): groups of ``least`` or more rows; others are noise (null)."""
    named = df.select(key, group.alias("_group"), prefix.alias("_prefix"))
    sizes = named.groupBy("_group", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return named.join(sizes, ["_group", "_prefix"], "left").select(key, F.when(F.col("_n").isNotNull(), F.concat("_prefix", F.lit("__"), "_group")).alias("cluster_id"))


def mention_clusters(mentions: DataFrame) -> DataFrame:
    return cluster_by(mentions, "mention_id", F.lower("name"), F.concat(F.lit("ent_"), "type"), 2)


def relation_clusters(relations: DataFrame) -> DataFrame:
    return cluster_by(relations, "relation_id", F.col("relation"), F.lit("rel"), 3)


def event_clusters(events: DataFrame) -> DataFrame:
    return cluster_by(events, "event_id", F.col("event_type"), F.lit("evt"), 2)


def own_key(cluster: Column, key: Column) -> Column:
    """The cluster, or for noise a cluster of its own."""
    return F.coalesce(cluster, F.concat(F.lit("noise__"), key))


def first_seen(df: DataFrame, group: str, value: str, order: list[str], most: int | None = None) -> DataFrame:
    """(group, values): distinct values in the order first seen, the first ``most`` of them, which are cut before
    they are listed."""
    from pyspark.sql.window import Window

    seen = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(F.struct(*order)).alias("_at"))
    if most is not None:
        seen = seen.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_at", value))).where(F.col("_k") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_v")))), lambda x: x["_v"])
    return seen.groupBy(group).agg(listed.alias(f"{value}s"))


def first_rows(df: DataFrame, group: str, value: str, order: list[str], most: int) -> DataFrame:
    """(group, values): values of the first ``most`` rows, repeats and all.

    Each row's place among its document's rows is cut first, so a group's list stays short.
    """
    from pyspark.sql.window import Window

    near = df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= most)  # WindowGroupLimit prunes before the shuffle
    return near.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(value).alias("_v")))), lambda x: x["_v"]).alias(f"{value}s"))


def linking_input(mentions: DataFrame, clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """For each cluster or noise mention: type, names in order first seen, up to three bodies."""
    rows = clusters.join(mentions, "mention_id", "left").select(own_key(F.col("cluster_id"), F.col("mention_id")).alias("cluster_id"), "id", "seq", "type", "name")
    head = rows.groupBy("cluster_id").agg(F.min_by("type", F.struct("id", "seq")).alias("type"))
    bodies = first_rows(rows.select("cluster_id", "id", "seq"), "cluster_id", "id", ["id", "seq"], 3)
    placed = bodies.select("cluster_id", F.posexplode("ids").alias("k", "id")).join(articles.select("id", "body"), "id", "left")
    contexts = placed.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]).alias("contexts"))
    return head.join(first_seen(rows, "cluster_id", "name", ["id", "seq"]), "cluster_id").join(contexts, "cluster_id").select("cluster_id", "type", F.col("names").alias("mentions"), "contexts")


def canon_input(rows: DataFrame, clusters: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each cluster or noise row: the first five distinct values of each column."""
    named = clusters.join(rows, key, "left").withColumn("cluster_id", own_key(F.col("cluster_id"), F.col(key)))
    out = named.select("cluster_id").distinct()
    for c in columns:
        out = out.join(first_seen(named, "cluster_id", c, ["id", "local_id"], 5), "cluster_id", "left")
    return out


def identity(prefix: str, cluster: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(cluster), 1, 16))


def canonical_entities(mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """One identity for each cluster; those whose hash ends in 0 stand for rows that failed."""
    rows = clusters.join(mentions, "mention_id").select(own_key(F.col("cluster_id"), F.col("mention_id")).alias("cluster_id"), "name")
    best = rows.groupBy("cluster_id").agg(F.min(F.struct((-F.length("name")).alias("k"), "name"))["name"].alias("canonical"))
    return best.where(~F.endswith(F.md5("cluster_id"), F.lit("0"))).select("cluster_id", identity("ent_", F.col("cluster_id")).alias("entity_id"), "canonical", (F.length("canonical") % 2 == 0).alias("is_new"))


def canonical_types(rows: DataFrame, clusters: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    named = clusters.join(rows, key).select(own_key(F.col("cluster_id"), F.col(key)).alias("cluster_id"), F.col(text).alias("_text"))
    best = named.groupBy("cluster_id").agg(F.min("_text").alias("canonical"))
    return best.where(~F.endswith(F.md5("cluster_id"), F.lit("0"))).select("cluster_id", identity(prefix, F.col("cluster_id")).alias("type_id"), "canonical", F.concat(F.lit("type "), "canonical").alias("description"))


def lookup_kb(canonical: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``wikidata_id`` of entities that aren't new, by name; a left join on a keep-last gazetteer."""
    known = gazetteer.groupBy("name").agg(F.max("wikidata_id").alias("_found"))
    return canonical.join(known, F.lower("canonical") == F.lower("name"), "left").withColumn("wikidata_id", F.when(~F.col("is_new"), F.col("_found"))).drop("_found", "name")


def prompt(inputs: DataFrame) -> DataFrame:
    """The text a linker would be asked: names, type and the heads of contexts."""
    heads = F.array_join(F.transform("contexts", lambda c: F.substring(c, 1, 200)), "\n- ")
    return inputs.select("cluster_id", F.concat(F.lit("Type: "), "type", F.lit("\nNames: "), F.array_join("mentions", ", "), F.lit("\n- "), heads).alias("prompt"))


def _listing(title: str, values: str) -> Column:
    return F.concat(F.lit(f"{title}: "), F.array_join(values, " | "))


def link_prompt(inputs: DataFrame) -> DataFrame:
    """What ``chat.Linker`` asks; a null type is left empty."""
    heads = F.array_join(F.transform("contexts", lambda c: F.concat(F.lit("\n- "), F.substring(c, 1, 200))), "")
    return inputs.select("cluster_id", F.concat(F.lit("Type: "), F.coalesce("type", F.lit("")), F.lit("\n"), _listing("Names", "mentions"), F.lit("\nContexts:"), heads).alias("prompt"))


def relation_prompt(inputs: DataFrame) -> DataFrame:
    """What ``chat.RelationNamer`` asks: the expressions and where they were used."""
    uses = F.array_join(F.transform("evidences", lambda e: F.concat(F.lit("\n- "), e)), "")
    return inputs.select("cluster_id", F.concat(_listing("Expressions", "relations"), F.lit("\nUses:"), F.coalesce(uses, F.lit(""))).alias("prompt"))


def event_prompt(inputs: DataFrame) -> DataFrame:
    """What ``chat.EventNamer`` asks: the types and their triggers."""
    return inputs.select("cluster_id", F.concat(_listing("Types", "event_types"), F.lit("\n"), F.coalesce(_listing("Triggers", "triggers"), F.lit(""))).alias("prompt"))


def link_entities(prompts: DataFrame, provider: chat.Provider, gazetteer: DataFrame) -> DataFrame:
    """cluster_id, entity_id, canonical, wikidata_id (of entities that aren't new), is_new; failed clusters are left out."""
    named = flow.drop_failed(flow.run_backend(prompts, lambda: chat.Linker(provider), chat.Linker.schema, "cluster_id"))
    return lookup_kb(named.withColumn("entity_id", identity("ent_", F.col("cluster_id"))), gazetteer).select("cluster_id", "entity_id", "canonical", "wikidata_id", "is_new")


def name_types(prompts: DataFrame, make: Callable[[], chat.ChatRows], prefix: str) -> DataFrame:
    """cluster_id, type_id, canonical, description; failed clusters are left out."""
    named = flow.drop_failed(flow.run_backend(prompts, make, chat.RelationNamer.schema, "cluster_id"))
    return named.select("cluster_id", identity(prefix, F.col("cluster_id")).alias("type_id"), "canonical", "description")
