"""Mixing sources to target weights along a curriculum that changes over the training.

Every source has a weight, which sets its target (words to take), and a schedule:
its density over the progress 0 to 1.  The integral of the schedule, scaled to the
target, is the source's cumulative demand.  The documents of a source, in a seeded
order and in as many passes as the target needs, form a stream of words; where the
demand reaches a document's place in the stream, inverting it gives the document's
training position, and documents are range-sorted by position.

Only DataFrame functions are used.  Words are counted once and kept in the shared
folder.  Ranges of (source, order) are cut at sampled keys with the stored row number
as the last part, so neither a hot source nor a hot identifier fills a range, and
running sums come from the ranges' totals, of which there are as many as ranges and
sources.

Defined cases: a null text has no words; a null source is a source, the last; a null
doc_id is a document like others; repeated rows are documents of their own; a
document without words is never taken and has no position; an empty table gives an
empty result; no column of the input may clash, as only three are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.align import cut_points, range_of
from .common import col, materialise, partitions

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Schedules in the same order, repeating: (progress, density), linear in between.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: float = 100, most: int = 3) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size).

    Targets share ``percent`` of all words by weight.  None exceeds ``most`` times its
    source; what is above goes to the others by weight.  With the sources in order of
    limit / weight, the k first full and the rest sharing what is left, the level of
    that sharing is largest at the right k, so no loop is needed.
    """
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", (F.row_number().over(by_name) - 1).cast("int"))
    weighed = placed.withColumn("_w", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights))).withColumn("_most", F.col("source_size") * most)
    filling = Window.orderBy(F.col("_most") / F.col("_w"), "place")
    before = F.coalesce(F.sum("_most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(every) * F.lit(percent / 100)
    level = weighed.withColumn("_level", (whole - before) / rest)
    full = F.col("_most").cast("double")
    return level.select("source", "source_size", "place", F.least(full, F.max("_level").over(every) * F.col("_w")).alias("target"))


def progress(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The progress at which a schedule's integral reaches ``share`` of the whole."""
    pieces, reached = [], 0.0
    for (a, u), (b, v) in zip(schedule, schedule[1:]):
        pieces.append((a, u, (v - u) / (b - a), reached))
        reached += (u + v) / 2 * (b - a)
    at = share * F.lit(reached)
    out = None
    for a, u, slope, before in pieces:
        rest = F.greatest(at - before, F.lit(0.0))
        below = u + F.sqrt(F.greatest(F.lit(u * u) + 2 * slope * rest, F.lit(0.0)))
        here = a + F.when(below > 0, 2 * rest / below).otherwise(0.0)
        out = here if out is None else F.when(at >= before, here).otherwise(out)
    return out


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple[tuple[tuple[float, float], ...], ...] = SCHEDULES, percent: float = 100,
    most: int = 3, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target, taken, and ``uses``, one (pass, words, position) each time it is taken.

    A source's passes end at the word where its target, rounded, is reached, so the
    last document may be taken in part and a source's taken words are its target.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(col(docs, text_col).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col(docs, id_col).cast("string"), F.lit(""))))
    rows = materialise(
        docs.select(col(docs, id_col).alias("doc_id"), col(docs, source_col).cast("string").alias("source"), size.alias("size"), key.alias("_key"), F.monotonically_increasing_id().alias("_row")),
        "mix-sizes",
    )
    order = ["_key", "doc_id", "size", "_row"]
    dealt = rows.withColumn("_range", range_of(rows, ["source", *order], cut_points(rows, ["source", *order], partitions(spark))))
    totals = dealt.groupBy("_range", "source").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    targets = source_targets(totals.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, percent, most).withColumnRenamed("source", "_source")
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumnsRenamed({"source": "_source", "_range": "_own"})

    inside = Window.partitionBy("_range", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = summed.join(starts, (F.col("_range") == F.col("_own")) & F.col("source").eqNullSafe(F.col("_source")))
    demand = F.round("target").cast("long")
    kinds = F.col("place") % len(schedules)
    at = lambda share: reduce(lambda rest, k: F.when(kinds == k, progress(share, schedules[k])).otherwise(rest), range(1, len(schedules)), progress(share, schedules[0]))

    def use(k: int) -> Column:
        begin = F.lit(k) * F.col("source_size") + F.col("_start") + F.col("_before")
        words = F.least(F.greatest(demand - begin, F.lit(0)), F.col("size"))
        return F.struct(F.lit(k).alias("pass"), words.alias("words"), at(begin / F.greatest(demand, F.lit(1))).alias("position"))

    uses = F.filter(F.array(*map(use, range(most))), lambda u: u["words"] > 0)
    out = both.select("doc_id", "source", "size", "source_size", "target", uses.alias("uses"), "_row")
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "uses", "_row")


def by_first_position(mix: DataFrame) -> DataFrame:
    """The documents of ``mix_sources``, range-sorted by their first position; those not taken come last."""
    first = mix.withColumn("position", F.get("uses", F.lit(0))["position"])
    return first.orderBy(F.col("position").asc_nulls_last(), "doc_id", "_row").drop("_row")


def training_order(mix: DataFrame) -> DataFrame:
    """(position, doc_id, source, pass, words), range-sorted: every use of a document at its place in the training."""
    used = mix.select("doc_id", "source", "_row", F.inline("uses"))
    return used.orderBy("position", "doc_id", "pass", "_row").select("position", "doc_id", "source", "pass", "words")
