"""Joins that put tables of mentions, vectors and labels side by side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions with name, type and confidence of their entity, by (id, local_id); an unknown one has nulls."""
    return mentions.join(entities.select("id", "local_id", "name", "type", "confidence"), ["id", "local_id"], "left")


def with_types(embeddings: DataFrame, mentions: DataFrame, key: str = "mention_id") -> DataFrame:
    """Embeddings with the type of their mention, null where it is unknown."""
    return embeddings.join(mentions.select(key, "type"), key, "left")


def with_vectors(docs: DataFrame, key: str, vectors: dict[str, DataFrame]) -> DataFrame:
    """Documents with one array column for each named table (key, vector); a missing vector is null."""
    out = docs
    for name, table in vectors.items():
        out = out.join(table.select(F.col(table.columns[0]).alias(key), F.col(table.columns[1]).alias(name)), key, "left")
    return out


def cut_points(df: DataFrame, order: list[Column | str], parts: int) -> list[Row]:
    """At most ``parts`` - 1 keys that cut ``df`` into ranges of about equal size in ``order``.

    They come from a sample of some 64 rows a range and are taken once, so every later
    job deals the rows alike.
    """
    keys = df.select(F.struct(*_named(order)).alias("_key"))
    share = min(1.0, 64 * parts / max(keys.count(), 1))
    ordered = keys.sample(share, 2024).agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    step = F.greatest(F.size("_keys") / parts, F.lit(1.0))
    picked = F.transform(F.sequence(F.lit(1), F.lit(max(parts - 1, 1))), lambda k: F.get("_keys", F.floor(k * step).cast("int")))
    return ordered.select(F.array_sort(F.array_distinct(F.filter(picked, lambda c: c.isNotNull())))).first()[0] if parts > 1 else []


def _named(order: list[Column | str]) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)]


def range_of(df: DataFrame, order: list[Column | str], cuts: list[Row]) -> Column:
    """The number of the range, from 0, that each row of ``df`` is in; nulls come first, as in a sort."""
    if not cuts:
        return F.lit(0)
    key = F.struct(*_named(order))
    kinds = [f.dataType for f in df.select(*_named(order)).schema]
    literal = lambda rows: F.array(*(F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(r, kinds)))) for r in rows))
    reached = lambda keys: F.size(F.filter(keys, lambda c: c <= key))
    width = math.isqrt(len(cuts) - 1) + 1  # first the stretch of cut points, then the place in it
    stretch = reached(literal(cuts[::width])) - 1
    return F.when(stretch < 0, 0).otherwise(stretch * width + reached(F.slice(literal(cuts), stretch * width + 1, width)))


def numbered(df: DataFrame, order: list[Column | str], place: str) -> DataFrame:
    """``place`` of each row, from 0, in ascending ``order``, nulls first; the order should be total.

    Cut points are taken once and a row's range is computed from its key, so counting
    and numbering see the same ranges.  Only the ranges' sizes come to the driver, and
    each range is numbered by itself, so no task sorts the whole table.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_range", range_of(df, order, cut_points(df, order, parts)))
    ranked = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for k in sorted(sizes):
        before += [F.lit(k), F.lit(total).cast("long")]
        total += sizes[k]
    offset = F.element_at(F.create_map(*before), F.col("_range")) if before else F.lit(0)
    return ranked.withColumn(place, (offset + F.col("_at")).cast("long")).drop("_range", "_at")


def by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the row of ``right`` at the same place; without one they are null."""
    values = numbered(right, right_order, "_place").select("_place", *columns)
    return numbered(left, left_order, "_place").join(values, "_place", "left").drop("_place")
