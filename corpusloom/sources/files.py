"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """CSV with a header and quoted newlines; no text is taken for null but an empty cell."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', quote='"')


def read_parts(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """All files of a pattern, with ``_part`` to order them by."""
    return read_csv(spark, pattern, schema).withColumn("_part", F.col("_metadata.file_path"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"', quote='"')


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def save_json(value: object, path: str) -> None:
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")


class Config:
    """A tree of settings with dotted names."""

    def __init__(self, tree: dict):
        self.tree = tree

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        return cls(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})

    def get(self, name: str, default: object = None) -> object:
        at: object = self.tree
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at


def write_labels(labels: DataFrame, path: str, key: str) -> None:
    """Labelled rows only."""
    write_csv(labels.where(F.col("label").isNotNull()).select(key, "label"), path)


def edited(original: DataFrame, edits: DataFrame, key: str, column: str) -> DataFrame:
    """The original columns, with edits over the old text."""
    new = edits.select(key, F.col(column).alias("_new"))
    return original.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*original.columns)


def save_artefacts(folder: str, tables: dict[str, DataFrame], summary: dict) -> None:
    """An experiment's tables as Parquet and its summary as one JSON row."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
