"""Choosing columns by name, naming files, labels for reading."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """The columns whose names start with ``prefix``, in the table's order."""
    return [c for c in df.columns if c.startswith(prefix)]


def existing(df: DataFrame, wanted: list[str]) -> list[str]:
    """Those of ``wanted`` that the table has, in the order wanted."""
    return [c for c in wanted if c in df.columns]


def panel(df: DataFrame, line: str, most: int = 2) -> list[str]:
    """The first ``most`` valid names of a comma-separated line: what a reader wants to see beside a text."""
    return existing(df, [c.strip() for c in line.split(",") if c.strip()])[:most]


def select_quoted(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{n.replace('`', '``')}`") for n in names))


def beside(path: str, suffix: str, extension: str | None = None) -> str:
    """``path`` with ``suffix`` after its stem, and perhaps another extension: where labels of a file go."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}{suffix}{p.suffix if extension is None else extension}"))


def worker_path(path: str, worker: int) -> str:
    return beside(path, f"_worker{worker}")


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def badge(label: Column, names: dict[float, str], other: str, none: str) -> Column:
    """What a label is called: by its number, ``other`` for an unknown one, ``none`` for null."""
    out = F.when(label.isNull(), F.lit(none))
    for value, name in names.items():
        out = out.when(label == value, F.lit(name))
    return out.otherwise(F.lit(other))
