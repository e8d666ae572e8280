"""Quality rules kept as a bitmask ledger.

Each text is measured once.  Every rule is evaluated once on the measurements and
sets one bit of ``failed``; the ledger is written with the version of its rules.  A
policy is a versioned set of rules, so applying or changing one is a bitwise test on
the written ledger; ablations aggregate its masks, of which there are few, and never
read a text again.  A policy whose rules are newer than the ledger's is refused.

Defined cases: a null text has no words and fails ``few_words``; ratios over zero
words or lines don't fail; repeated rows are measured alike; an empty table gives
an empty ledger; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, tune

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = _UPPER + _UPPER.lower()
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
#: Words whose numbers a worker remembers between texts.
REMEMBERED = 300_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")


@dataclass(frozen=True)
class QualityRule:
    """Fails where ``fails``, an SQL condition on the measurements, holds."""

    bit: int
    name: str
    fails: str


#: The version of the rules below, kept with each row of a ledger; a bit is never given to another rule, so old
#: ledgers stay readable.
RULES_VERSION = 1
RULES = (
    QualityRule(0, "few_words", "n_words < 50"),
    QualityRule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    QualityRule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    QualityRule(3, "duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    QualityRule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    QualityRule(5, "shouting", "n_letters > 0 and 100 * n_upper > 60 * n_letters"),
    QualityRule(6, "exclaiming", "10 * n_marks > 3 * n_words"),
)
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject.
POLICIES = {
    "base-1": BASE,
    "clean-1": (*BASE, "symbols", "duplicate_lines", "word_length", "shouting", "exclaiming"),
}


def mask(names: tuple[str, ...], rules: tuple[QualityRule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_words(words: list[bytes], numbers: dict[bytes, int]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    w = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    base = int(w.max()) + 1
    first = w[:-2] * base + w[1:-1]
    if base > 2_000_000:  # three numbers would not fit in 63 bits
        first = np.unique(first, return_inverse=True)[1].astype(np.int64)
    _, at, count = np.unique(first * base + w[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure_text(text: str, numbers: dict[bytes, int]) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines: set[str] = set()
    dup = full = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            full += 1
            dup += line in lines
            lines.add(line)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = len(raw) - len(raw.translate(None, _PLAIN))
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        dup,
        repeated_words(words, numbers),
        full,
        upper,
        letters,
        text.count("!"),
    )


_NUMBERS = _Numbers()


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            if len(_NUMBERS) > REMEMBERED:
                _NUMBERS.clear()
            rows.append(measure_text(text or "", _NUMBERS))
        columns = list(zip(*rows)) if rows else [[]] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[b.schema.names[0], *MEASURES])


def ledger(docs: DataFrame, rules: tuple[QualityRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, the measurements, ``failed`` with a bit for each failed rule, and ``rules_version``.

    Lazy: ``write_ledger`` keeps it, so that policies and ablations read it instead of the texts.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(_measure, ", ".join([f"{id_col} long", *(f"{m} long" for m in MEASURES)]))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return out.withColumn("failed", failed).withColumn("rules_version", F.lit(RULES_VERSION))


def write_ledger(docs: DataFrame, path: str | None = None, rules: tuple[QualityRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of ``docs``, written to ``path`` (or for this run to the shared folder) and read back."""
    book = ledger(docs, rules, id_col, text_col)
    if path is None:
        return materialise(book, "ledger")
    book.write.mode("overwrite").parquet(path)
    return read_ledger(docs.sparkSession, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A written ledger; refused if its rules are newer than this code knows."""
    book = spark.read.parquet(path)
    if (book.agg(F.max("rules_version")).first()[0] or 0) > RULES_VERSION:
        raise ValueError("the ledger was written by newer rules")
    return book


def apply_policy(book: DataFrame, names: tuple[str, ...], rules: tuple[QualityRule, ...] = RULES, column: str = "kept") -> DataFrame:
    """Adds ``column``: no rule of the policy failed."""
    return book.withColumn(column, F.col("failed").bitwiseAND(F.lit(mask(names, rules)).cast("long")) == 0)


def ablation(book: DataFrame, names: tuple[str, ...], rules: tuple[QualityRule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that the policy keeps without it."""
    masks = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    whole = mask(names, rules)
    bits = {r.name: 1 << r.bit for r in rules}
    inside = F.col("failed").bitwiseAND(F.lit(whole))
    exprs = []
    for name in names:
        own, rest = bits[name], whole & ~bits[name]
        exprs.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.sum(F.when(inside.bitwiseAND(F.lit(own)) != 0, F.col("n")).otherwise(0)).alias("failing"),
                F.sum(F.when(inside == own, F.col("n")).otherwise(0)).alias("failing_alone"),
                F.sum(F.when(inside.bitwiseAND(F.lit(rest)) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
            )
        )
    return masks.agg(F.array(*exprs).alias("rows")).select(F.inline("rows"))
