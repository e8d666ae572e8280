"""Exact deduplication by a distributed content sort.

Sampled splitters cut the normalised bytes into ranges, Spark's external sort
puts the whole normalised texts of a range in order, so equal ones stand together,
and neighbours are compared in full.  A splitter is the leading bytes of a text,
then its digest and identifier, so a group of copies of any size is cut over as
many ranges as it needs.  Only groups that a splitter names can cross ranges;
their pieces meet again through one summary for each range.

Defined cases: a null text is the empty text; empty texts are equal to each
other; texts are equal when their bytes are after lower-casing A-Z; ties are
broken by the identifier; rows that repeat identifier and text are copies of
each other, of which one is kept; a null identifier stays null, comes after all
others and is kept only where a group has no other; an empty table gives an empty
result; other columns, whatever their names, neither matter nor clash.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import col, materialise, partitions, tune

#: Normalised bytes at the head of a splitter.
HEAD = 64
#: Sampled keys for each range, which bounds what the driver gets.
SAMPLES = 40

_KEYED = [("id", pa.int64()), ("text", pa.string()), ("digest", pa.binary()), ("slot", pa.int32())]
_KEYED_DDL = "id long, text string, digest binary, slot int"
_RUNS = pa.schema([("id", pa.int64()), ("digest", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("lead", pa.bool_()), ("part", pa.int32())])
_RUNS_DDL = "id long, digest binary, lo long, hi long, n long, lead boolean, part int"


def normalise(text: pa.Array) -> pa.Array:
    """Lower-case A-Z only; null counts as empty."""
    return pc.ascii_lower(pc.fill_null(text, ""))


def _keys(ids: list, text: pa.Array) -> list[tuple]:
    """What splitters compare: head, digest, whether there is no identifier, identifier."""
    raw = text.cast(pa.binary()).to_pylist()
    return [(x[:HEAD], hashlib.sha256(x).digest(), i is None, i or 0) for x, i in zip(raw, ids)]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = _keys(b.column(0).to_pylist(), normalise(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([k[c] for k in keys], pa.binary()) for c in (0, 1))], names=["id", "head", "digest"])


def capitals(text: str | None) -> bytes | None:
    """A bit for each byte of the text, set for A-Z: with the lower-cased text it gives the text back."""
    if text is None:
        return None
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.packbits((raw >= 65) & (raw <= 90)).tobytes()


def recapitalised(text: str, bits: bytes | None) -> str | None:
    if bits is None:
        return None
    raw = np.frombuffer(text.encode(), np.uint8)
    return (raw - 32 * np.unpackbits(np.frombuffer(bits, np.uint8), count=len(raw))).astype(np.uint8).tobytes().decode()


def _key(batches: Iterator[pa.RecordBatch], cuts: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = normalise(b.column(1))
        keys = _keys(b.column(0).to_pylist(), text)
        arrays = [b.column(0), text, pa.array([k[1] for k in keys], pa.binary()), pa.array([bisect.bisect_right(cuts, k) for k in keys], pa.int32())]
        names = [n for n, _ in _KEYED]
        if whole:
            arrays += [pa.array([capitals(t) for t in b.column(1).to_pylist()], pa.binary()), *b.columns[2:]]
            names += ["caps", *b.schema.names[2:]]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _runs(batches: Iterator[pa.RecordBatch], across: frozenset) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted range; ``part`` names the range for those that may cross it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    text, digest, ids = None, b"", []
    held: list[tuple] = []

    def close() -> None:
        known = [x for x in ids if x is not None]
        lo, hi = (min(known), max(known)) if known else (None, None)
        n, own = len(ids), part if digest in across else None
        held.extend((x, digest, lo, hi, n, not k or x != ids[k - 1], own) for k, x in enumerate(ids))

    def give() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _RUNS)], schema=_RUNS)
        held.clear()
        return out

    for b in batches:
        for x, t, d in zip(*(b.column(c).to_pylist() for c in ("id", "text", "digest"))):
            if t != text:
                if text is not None:
                    close()
                    if len(held) >= 5000:
                        yield give()
                text, digest, ids = t, d, []
            ids.append(x)
    if text is not None:
        close()
    if held:
        yield give()


def _leads(batches: Iterator[pa.RecordBatch], across: frozenset) -> Iterator[pa.RecordBatch]:
    """The first row of each run of equal neighbours, its text as it was; ``open`` is the digest of a run
    that may go on in another range."""
    text = None
    for b in batches:
        texts, digests, caps = (b.column(c).to_pylist() for c in ("text", "digest", "caps"))
        first = []
        for k, t in enumerate(texts):
            if t != text:
                first.append(k)
                text = t
        if first:
            own = b.take(pa.array(first))
            arrays = [own.column(0), pa.array([recapitalised(texts[k], caps[k]) for k in first], pa.string()), pa.array([digests[k] if digests[k] in across else None for k in first], pa.binary()), *own.columns[5:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "text", "open", *own.schema.names[5:]])


def splitters(rows: DataFrame, n: int) -> list[tuple]:
    """At most ``n - 1`` cut points from a bounded, seeded sample of the keys."""
    total = rows.count()
    if n < 2 or not total:
        return []
    share = min(1.0, n * SAMPLES / total)
    sample = rows.sample(False, share, 7).mapInArrow(_sampled, "id long, head binary, digest binary").limit(n * SAMPLES * 2)
    keys = sorted((bytes(r["head"]), bytes(r["digest"]), r["id"] is None, r["id"] or 0) for r in sample.collect())
    return [keys[i * len(keys) // n] for i in range(1, n)] if keys else []


def _type(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _sorted(rows: DataFrame, whole: bool) -> tuple[DataFrame, frozenset]:
    """Rows in ranges, each in the order of text and identifier, and the digests that may cross ranges."""
    n = partitions(rows.sparkSession)
    cuts = splitters(rows.select("id", "text"), n)
    keyed = rows.mapInArrow(partial(_key, cuts=cuts, whole=whole), StructType([*_type(_KEYED_DDL), *([*_type("caps binary"), *rows.schema.fields[2:]] if whole else [])]))
    ordered = keyed.repartitionById(n, F.col("slot")).sortWithinPartitions("text", F.col("id").asc_nulls_last())
    return ordered, frozenset(c[1] for c in cuts)


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its id, keep_id, group_size, kept and the digest of its normalised text.

    ``keep`` names the identifier that stays, ``smallest`` or ``largest``.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    tune(docs.sparkSession)
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text"))
    ordered, across = _sorted(rows, False)
    runs = materialise(ordered.mapInArrow(partial(_runs, across=across), _RUNS_DDL), "content-runs")
    # at most a row for each range and digest that a splitter names
    pieces = runs.where("part is not null").groupBy("digest", "part").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"))
    whole = pieces.groupBy("digest").agg(F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi"), F.sum("n").alias("all_n"))
    groups = runs.join(F.broadcast(whole), "digest", "left").select("id", "digest", "lead", *(F.coalesce(f"all_{c}", c).alias(c) for c in ("lo", "hi", "n")))
    stays = F.col("lo" if keep == "smallest" else "hi")
    return groups.select(
        F.col("id").alias(id_col), stays.alias("keep_id"), F.col("n").alias("group_size"), (F.col("lead") & F.col("id").eqNullSafe(stays)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that stay: of equal texts that of the smallest identifier."""
    tune(docs.sparkSession)
    other = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text"), *(col(docs, c).alias(f"c{k}") for k, c in enumerate(other)))
    ordered, across = _sorted(rows, True)
    leads = materialise(ordered.mapInArrow(partial(_leads, across=across), StructType([*_type("id long, text string, open binary"), *rows.schema.fields[2:]])), "content-leads")
    # of a run that goes on in other ranges, the piece of the smallest identifier; a row for each range at most
    pieces = leads.where("open is not null").groupBy("open").agg(F.min("id").alias("least"))
    kept = leads.join(F.broadcast(pieces), "open", "left").where(F.col("open").isNull() | F.col("id").eqNullSafe(F.col("least")))
    back = {id_col: F.col("id").cast(docs.schema[id_col].dataType), text_col: F.col("text").cast(docs.schema[text_col].dataType)} | {c: F.col(f"c{k}") for k, c in enumerate(other)}
    return kept.select(*(back[c].alias(c) for c in docs.columns))
