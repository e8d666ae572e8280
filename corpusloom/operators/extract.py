"""Nested extractions to flat tables, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.adapters import CONFIDENCE, ENTITY, ENTITY_TYPES, EVENT, FRAMES, RELATION

LISTS = {"entities": ENTITY, "relations": RELATION, "events": EVENT}
_TEXT = T.StringType()
ITEMS = LISTS | {
    "frames": T.StructType([T.StructField("frame", _TEXT), T.StructField("present", T.BooleanType()), T.StructField("evidence", _TEXT)]),
    "arguments": T.StructType([T.StructField(n, _TEXT) for n in ("sentence", "claimant", "argument_type", "target")]),
}


def parse(texts: DataFrame) -> DataFrame:
    """JSON columns as native arrays, read once; what isn't JSON becomes an empty array."""
    parsed = {c: F.coalesce(F.from_json(c, T.ArrayType(s)), F.array().cast(T.ArrayType(s))) for c, s in LISTS.items() if c in texts.columns}
    return texts.withColumns({c: F.filter(v, lambda x: x.isNotNull()) for c, v in parsed.items()})


def key_of(doc: str | Column, local: str | Column) -> Column:
    doc, local = (F.col(x) if isinstance(x, str) else x for x in (doc, local))
    return F.concat_ws("__", doc.cast("string"), local)


def mentions(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("id", F.posexplode("entities").alias("pos", "e"))
    return rows.select("id", F.col("e.id").alias("local_id"), key_of("id", "e.id").alias("mention_id"), F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.col("e.confidence").alias("confidence"), (F.col("pos") + 1).alias("seq"))


def relations(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("id", F.explode("relations").alias("r"))
    return rows.select(key_of("id", "r.id").alias("relation_id"), "id", F.col("r.id").alias("local_id"), *(F.col(f"r.{c}").alias(c) for c in ("subject", "object", "relation", "evidence", "confidence")))


def events(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("id", F.explode("events").alias("v"))
    return rows.select(key_of("id", "v.id").alias("event_id"), "id", F.col("v.id").alias("local_id"), F.col("v.type").alias("event_type"), F.col("v.trigger").alias("trigger"), F.col("v.arguments").alias("arguments"), F.col("v.confidence").alias("confidence"))


def arguments(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.inline("arguments"))


def validate(texts: DataFrame) -> DataFrame:
    """For each answer: error (null, ``malformed`` or ``invalid``) and the number of entities."""
    items = F.from_json("entities", T.ArrayType(ENTITY))
    bad = F.exists("items", lambda e: ~F.coalesce(e["type"].isin(*ENTITY_TYPES) & e["confidence"].isin(*CONFIDENCE) & e["name"].isNotNull(), F.lit(False)))
    return texts.select("id", items.alias("items")).select("id", F.when(F.col("items").isNull(), "malformed").when(bad, "invalid").alias("error"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_entities"))


def _sound(kind: str, x: Column) -> Column:
    """Does an item have all its fields, with values of the fixed sets where there are any?"""
    fields = LISTS[kind].names if kind in LISTS else {"frames": ["frame", "present", "evidence"], "arguments": ["sentence", "argument_type"]}[kind]
    ok = F.lit(True)
    for f in fields:
        ok = ok & x[f].isNotNull()
    if kind in LISTS:
        ok = ok & x["confidence"].isin(*CONFIDENCE)
    if kind == "entities":
        ok = ok & x["type"].isin(*ENTITY_TYPES)
    if kind == "frames":
        ok = ok & x["frame"].isin(*FRAMES)
    return F.coalesce(ok, F.lit(False))


def validate_lists(texts: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, kind, error, n) for each JSON column: ``malformed`` where it is no list, ``invalid`` where an
    item lacks a field or has a value outside its set, else null; ``n`` items.  A null text is malformed.
    """
    parsed = texts.select("id", *(F.from_json(k, T.ArrayType(ITEMS[k])).alias(k) for k in kinds))
    row = lambda k: F.struct(F.lit(k).alias("kind"), F.when(F.col(k).isNull(), "malformed").when(F.exists(k, lambda x: ~_sound(k, x)), "invalid").alias("error"), F.coalesce(F.size(k), F.lit(0)).cast("long").alias("n"))
    return parsed.select("id", F.inline(F.array(*map(row, kinds))))


def frames_wide(frames: DataFrame, names: tuple[str, ...] = FRAMES) -> DataFrame:
    """A row for each document: the last (by ``seq``) of each fixed frame, wide."""
    out = []
    for f in names:
        last = F.max_by(F.struct("present", "evidence"), F.when(F.col("frame") == f, F.col("seq")))
        out += [last["present"].alias(f"frame_{f}"), last["evidence"].alias(f"frame_{f}_evidence")]
    return frames.groupBy("id").agg(*out)
