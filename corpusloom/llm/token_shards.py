"""Token ids as grammar-compressed binary shards (Re-Pair).

Texts are encoded in ascending identifier order and cut into shards.  In each
shard frequent pairs of neighbouring symbols are repeatedly replaced by new
nonterminals.  A shard stores its rules, the expansion length of every rule, the
remaining symbols and an index of documents; with the lengths, any range of ids
is decoded without touching the rest.

A shard is one self-contained binary value, kept in a table of shards, so it is
committed with the table and a retried task never leaves half of one.

Layout (little-endian): ``RPG1``; u32 first nonterminal, rules, symbols, symbol
width, documents; u64 ids; rules' left and right symbols (u32 each); expansion
lengths (u32 each); document identifiers (i64 each); document starts (u64 each);
symbols.

Defined cases: a null text is empty and still gets its end id; rows that repeat
an identifier follow each other, in the order of their texts; a null identifier
stays null and comes first; an empty table makes no shard; other columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, partitions, tune
from .encode import encoder

_MAGIC = b"RPG1"
#: Stands for a null identifier in a shard; it comes first.
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIIIIIQ")
#: Ids that close a shard.
SHARD_IDS = 1 << 19
#: Bytes of texts that are encoded together: each of their words is looked up once.
AT_ONCE = 8 << 20
#: Uses that pay for a rule.
MIN_USES = 6

_SHARD_DDL = "part int, shard int, base long, n_ids long, n_docs long, payload binary"
_SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())])


def compress(ids: np.ndarray, first: int, least: int = MIN_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and the rules' left and right sides; symbols from ``first`` on are rules.

    Rounds go on until no pair of neighbours is used ``least`` times.  A round counts pairs in hashed
    slots, exactly for one pair of each slot (another that shares its slot waits for a later round), and
    replaces all that are frequent.  A pair only grows rarer, so from the second round on just those that
    hold a new symbol, or wait, are counted.
    """
    seq, live = ids.astype(np.uint32), np.ones(max(0, len(ids) - 1), bool)
    lefts, rights, rules = [], [], 0
    while True:
        at = np.flatnonzero(live)
        if len(at) < least:
            break
        bits = max(10, min(18, len(at).bit_length()))  # slots that stay in a core's cache
        left, right = (seq[:-1], seq[1:]) if len(at) == len(live) else (seq[at], seq[at + 1])
        key = left.astype(np.uint64) << np.uint64(32) | right
        slot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)  # indexes as numpy takes them
        owner = np.zeros(1 << bits, np.uint64)
        owner[slot] = key
        mine = owner[slot] == key
        count = np.bincount(slot[mine], minlength=1 << bits)
        often = mine & (count >= least)[slot]
        live[at[mine & ~often]] = False
        place, slot = at[often], slot[often]
        if not len(place):
            continue
        # neighbouring places overlap: of each run of them take every other one
        fresh = np.ones(len(place), bool)
        fresh[1:] = np.diff(place) > 1
        run = np.maximum.accumulate(np.where(fresh, here := np.arange(len(place)), 0))
        odd = (here - run) & 1 == 0
        used = np.bincount(slot[odd], minlength=1 << bits)
        pays = (used >= 3)[slot]
        live[place[~pays]] = False
        odd &= pays
        place, slot = place[odd], slot[odd]
        if not len(place):
            continue
        number = np.zeros(1 << bits, np.uint32)
        made = np.flatnonzero(used >= 3)
        number[made] = np.arange(first + rules, first + rules + len(made))
        lefts.append((owner[made] >> np.uint64(32)).astype(np.int64))
        rights.append((owner[made] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        rules += len(made)
        seq[place] = number[slot]
        live[place] = True
        live[place[place > 0] - 1] = True
        stays = np.ones(len(seq), bool)
        stays[place + 1] = False
        seq = seq[stays]
        # a pair that lost its right side is now the one with the new symbol's right neighbour
        live = live[stays[:-1]][: len(seq) - 1]
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return seq, join(lefts), join(rights)


def lengths_of(lefts: np.ndarray, rights: np.ndarray, first: int) -> np.ndarray:
    """Expansion length of every rule."""
    out = np.zeros(len(lefts), np.int64)
    while len(out) and not out.all():  # one pass for each level of nesting
        size = lambda s: np.where(s < first, 1, out[np.maximum(s - first, 0)])
        a, b = size(lefts), size(rights)
        out = np.where((a > 0) & (b > 0), a + b, out)
    return out


class Grammar:
    """Expansions of all rules end to end, so symbols expand in one step."""

    def __init__(self, lefts: np.ndarray, rights: np.ndarray, first: int, lengths: np.ndarray | None = None):
        self.first = first
        self.lengths = lengths_of(lefts, rights, first) if lengths is None else lengths
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.zeros(int(self.lengths.sum()), np.uint32)
        level = np.zeros(len(lefts), np.int64)
        while True:  # a pass for each nesting
            want = level.copy()
            for side in (lefts, rights):
                inner = side >= first
                want[inner] = np.maximum(want[inner], level[side[inner] - first] + 1)
            if np.array_equal(want, level):
                break
            level = want
        for k in range(int(level.max(initial=-1)) + 1):
            own = np.flatnonzero(level == k)
            out = self.expand(np.stack([lefts[own], rights[own]], 1).ravel())
            n = self.lengths[own]
            self.flat[np.repeat(self.starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = out

    def sizes(self, seq: np.ndarray) -> np.ndarray:
        size = np.ones(len(seq), np.int64)
        inner = seq >= self.first
        size[inner] = self.lengths[seq[inner] - self.first]
        return size

    def expand(self, seq: np.ndarray) -> np.ndarray:
        inner = seq >= self.first
        n = self.sizes(seq)
        out = np.repeat(seq.astype(np.uint32), n)
        held = np.repeat(inner, n)
        rule = seq[inner] - self.first
        n = self.lengths[rule]
        out[held] = self.flat[np.repeat(self.starts[rule] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return out


def expand(seq: np.ndarray, lefts: np.ndarray, rights: np.ndarray, first: int) -> np.ndarray:
    return Grammar(lefts, rights, first).expand(seq.astype(np.int64))


def pack(docs: list[tuple[int, np.ndarray]], first: int) -> bytes:
    """One shard of (identifier, ids) documents."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    seq, lefts, rights = compress(ids, first)
    sizes = np.array([len(x) for _, x in docs], np.int64)
    width = 2 if first + len(lefts) <= 1 << 16 else 4
    head = _HEAD.pack(_MAGIC, first, len(lefts), len(seq), width, len(docs), len(ids))
    return head + b"".join(
        x.tobytes()
        for x in (
            lefts.astype("<u4"), rights.astype("<u4"), lengths_of(lefts, rights, first).astype("<u4"),
            np.array([i for i, _ in docs], "<i8"), (np.cumsum(sizes) - sizes).astype("<u8"), seq.astype(f"<u{width}"),
        )
    )


class Shard:
    """Reads a packed shard."""

    def __init__(self, payload: bytes):
        magic, self.first, rules, symbols, width, docs, self.n_ids = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.lefts, self.rights, self.lengths = (take("<u4", rules).astype(np.int64) for _ in range(3))
        self.doc_ids, self.starts = take("<i8", docs), take("<u8", docs).astype(np.int64)
        self.seq = take(f"<u{width}", symbols).astype(np.int64)
        self.grammar = Grammar(self.lefts, self.rights, self.first, self.lengths)
        self._ends = np.cumsum(self.grammar.sizes(self.seq))

    def all_ids(self) -> np.ndarray:
        return self.grammar.expand(self.seq)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n``, expanding only the symbols that cover them."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self._ends, start, "right"), np.searchsorted(self._ends, start + n)
        before = int(self._ends[a - 1]) if a else 0
        return self.grammar.expand(self.seq[a : b + 1])[start - before : start - before + n]

    def document(self, k: int) -> np.ndarray:
        stop = self.starts[k + 1] if k + 1 < len(self.starts) else self.n_ids
        return self.read(int(self.starts[k]), int(stop - self.starts[k]))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Identifiers and texts of so many batches that they hold ``AT_ONCE`` bytes; the rest at the end."""
    keys, texts, held = [], [], 0
    for b in batches:
        keys += b.column(0).to_pylist()
        texts += b.column(1).to_pylist()
        held += b.nbytes
        if held >= AT_ONCE:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, enc = TaskContext.get().partitionId(), encoder(path)
    first = max(enc.whole.get_vocab_size(True), end_id + 1)
    end = np.array([end_id], "<u4").tobytes()
    docs, held, shard, base = [], 0, 0, 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, shard, base, held, len(docs), pack(docs, first)), _SHARDS)], schema=_SHARDS)

    for keys, texts in _gathered(batches):
        for i, own in zip(keys, enc.encode_all(texts)):
            ids = np.frombuffer(own + end, "<u4")
            docs.append((NO_ID if i is None else i, ids))
            held += len(ids)
            if held >= SHARD_IDS:
                yield flush()
                shard, base, docs, held = shard + 1, base + held, [], 0
    if docs:
        yield flush()


def write_token_shards(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of shards: part, shard (in its part), base (ids of the part before it), n_ids, n_docs, payload."""
    spark = tune(docs.sparkSession)
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    return materialise(ordered.mapInArrow(partial(_write, path=path, end_id=end_id), _SHARD_DDL), "token-shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, base, payload in zip(*(b.column(c).to_pylist() for c in ("part", "base", "payload"))):
            s = Shard(payload)
            stops = np.append(s.starts[1:], s.n_ids)
            ids = memoryview(s.all_ids().astype("<u4", copy=False)).cast("B")  # every document is asked for, so all symbols expand at once
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(s.starts.tolist(), stops.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == NO_ID), pa.array(np.full(len(crc), part), pa.int32()), pa.array(s.starts + base, pa.int64()), pa.array(stops - s.starts, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "part", "local", "n_tokens", "ids_crc32"],
            )


def read_token_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each document, decoded from the shards: id, start (ids before it in all), n_tokens, ids_crc32."""
    spark = tune(shards.sparkSession)
    # one number for each part, of which there are as many as partitions
    sizes = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "part int, before long"))
    rows = shards.select("part", "base", "payload").mapInArrow(_read, "id long, part int, local long, n_tokens long, ids_crc32 long")
    return rows.join(before, "part").select(F.col("id").alias(id_col), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
