"""Dataflow: ranges for workers, resuming, merging, error rows, sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class RowBackend(Protocol):
    """A model or service behind a row operator: opened once a worker, then fed batches."""

    schema: str

    def open(self) -> None: ...

    def process(self, rows: pd.DataFrame) -> pd.DataFrame: ...


def run_backend(df: DataFrame, make: Callable[[], RowBackend], schema: str, key: str = "id") -> DataFrame:
    """Rows of ``df`` through a backend, with a column ``error`` for batches it fails on.

    A batch that fails is taken row by row, so one bad row spoils no other.  A backend
    that handles failures by itself gives the column ``error`` among its own.
    """

    def settled(out: pd.DataFrame) -> pd.DataFrame:
        return out if "error" in out.columns else out.assign(error=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        backend.open()
        for rows in batches:
            try:
                yield settled(backend.process(rows))
            except Exception:
                for k in range(len(rows)):
                    one = rows.iloc[k : k + 1]
                    try:
                        yield settled(backend.process(one))
                    except Exception as e:
                        yield pd.DataFrame({key: one[key], "error": [str(e)]})

    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            yield out.reindex(columns=[*names, "error"])

    return df.mapInPandas(aligned, f"{schema}, error string")


def worker_ranges(df: DataFrame, key: str, workers: int) -> DataFrame:
    """``worker`` of each row: contiguous ranges in order of a unique key, cut at floor(n * w / workers).

    Ranks come from per-range counts, so no task holds all rows.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 1000)).first()[0] if parts > 1 else []
    slot = F.lit(0)
    for c in sorted(set(cuts or [])):
        slot = slot + (F.col(key) > c).cast("int")
    dealt = df.withColumn("_slot", slot)
    sizes = {r["_slot"]: r["n"] for r in dealt.groupBy("_slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for s in sorted(sizes):
        before[s] = total
        total += sizes[s]
    offset = F.element_at(F.create_map(*[F.lit(x) for s, b in before.items() for x in (s, b)]), F.col("_slot")) if before else F.lit(0)
    rank = offset + F.row_number().over(Window.partitionBy("_slot").orderBy(key)) - 1
    worker = F.lit(0)
    for w in range(1, workers):
        worker = worker + (F.col("_rank") >= F.lit(total * w // workers)).cast("int")
    return dealt.withColumn("_rank", rank).withColumn("worker", worker).drop("_slot", "_rank")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not done yet; keys are compared as text."""
    keys = done.select(F.col(key).cast("string").alias("_done")).distinct()
    return todo.join(keys, F.col(key).cast("string") == F.col("_done"), "left_anti")


def keep_last(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """One row for each key: the last in ``order``.  An aggregate, so copies meet before the shuffle."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*orders)) if rest else F.lit(1)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def merge_parts(parts: list[DataFrame], key: str, order: str) -> DataFrame | None:
    """The parts of all workers as one table, the last row of each key; no parts give None."""
    if not parts:
        return None
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return keep_last(whole, key, order)


def drop_failed(df: DataFrame, error: str = "error") -> DataFrame:
    """Rows that didn't fail, without the error column: the policy that drops."""
    return df.where(F.col(error).isNull()).drop(error)


def sentinel(df: DataFrame, error: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that failed get the given values."""
    return df.withColumns({c: F.when(error, v).otherwise(F.col(c)) if c in df.columns else F.when(error, v) for c, v in values.items()})


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same in every run."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)
