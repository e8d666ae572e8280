"""Removal of repeated byte strings by a distributed, truncated suffix array.

A byte goes when a string of ``length`` bytes that covers it also starts earlier
(in a document of smaller identifier, or earlier in the same one).

Texts are laid out in blocks.  Winnowing picks, in every window of ``length``
bytes, the smallest hash of its short strings, so equal windows pick equal
anchors at equal offsets.  Anchors whose hash occurs once in the corpus can't lie
in a repeated window; only windows of the other anchors go on, as one record for
each anchor with the bytes around it.  Records of one anchor meet, equal ones are
settled at once, and the suffixes of the others are sorted to ``length`` bytes by
deep-shallow sorting: multikey quicksort with three-way partitions of 8-byte
digits to a shallow depth, then a blind trie for each group that still shares its
prefix.  Equal neighbours in the order are repeats, all but the first of them.

Equal records are settled inside a block before they travel, and again as they
arrive, so a passage, however common, is never held in more copies than a task's
memory allows; windows of very frequent anchors are dealt by their own content.

Defined cases: a null text is empty; texts below ``length`` bytes keep all; of
rows that repeat an identifier one counts as earlier; a null identifier stays null
and counts as the first; an empty table gives an empty result; other columns,
whatever their names, don't matter to ``remove_repeats`` and stay as they are in
``cut_rows``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StructField, StructType

from .common import col, lean, materialise, partitions, tune
from .shingles import mix

#: Bytes of text in a block, what is sorted at once, and what arrives before equal records are settled.
BLOCK_BYTES, SORT_BYTES, SETTLE_BYTES = 2 << 20, 1 << 20, 8 << 20
#: Bytes of a block whose anchors are looked for at once, in some ten numbers a byte.
ANCHOR_BYTES = 1 << 18
#: Level of compression of blocks and records.
LEVEL = 6
#: Bytes of an anchor.
GRAM = 16
#: Occurrences from which an anchor's windows are dealt by their content.
FREQUENT = 2000
#: Bytes that multikey quicksort orders before blind tries take over.
SHALLOW = 16
#: Stands for a null identifier, which comes first.
NO_ID = np.iinfo(np.int64).min

_BLOCK_DDL = "block long, payload binary"
#: Records of a block for one bucket, or (bytes of) spans of a block: kind 0 or 1.
_PACK_DDL = "bucket int, block long, kind int, payload binary"
_PACK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Spans of a block: triples of 32-bit document, start and end.
_SPAN = pa.schema([("block", pa.int64()), ("spans", pa.binary())])
#: A record beside its bytes: key, document's identifier, place in the corpus, first window, offset of the anchor, size.
_RECORD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("uid", "<i8"), ("lo", "<i4"), ("delta", "<i4"), ("size", "<i4")])


# -- blocks ---------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: identifiers and sizes, texts, and the other columns as an Arrow stream."""
    lean()
    from pyspark import TaskContext

    part, seq, ids, raws, others, size = TaskContext.get().partitionId(), 0, [], [], [], 0

    def flush() -> pa.RecordBatch:
        head = np.array([len(ids)], "<i8").tobytes() + np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes() + np.fromiter(map(len, raws), "<i8", len(raws)).tobytes()
        stream = b""
        if others:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, others[0].schema) as out:
                for o in others:
                    out.write_batch(o)
            stream = sink.getvalue().to_pybytes()
        payload = zstandard.compress(b"".join((head, *raws, stream)), LEVEL)
        return pa.RecordBatch.from_pydict({"block": pa.array([part << 20 | seq], pa.int64()), "payload": pa.array([payload], pa.binary())})

    for b in batches:
        texts, begin = b.column(1).to_pylist(), 0
        other = pa.RecordBatch.from_arrays(b.columns[2:], names=b.schema.names[2:]) if b.num_columns > 2 else None
        for k, (i, text) in enumerate(zip(b.column(0).to_pylist(), texts)):
            raw = (text or "").encode()
            ids.append(i)
            raws.append(raw)
            size += len(raw)
            if size >= BLOCK_BYTES or len(ids) >= 1 << 19:
                if other is not None:
                    others.append(other.slice(begin, k + 1 - begin))
                yield flush()
                seq, ids, raws, others, size, begin = seq + 1, [], [], [], 0, k + 1
        if other is not None and begin < b.num_rows:
            others.append(other.slice(begin))
    if ids:
        yield flush()


class Block:
    """Documents end to end: identifiers, sizes, bytes, other columns."""

    def __init__(self, payload: bytes):
        raw = zstandard.decompress(payload)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids, self.sizes = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
        at = 8 + 16 * n
        self.text = np.frombuffer(raw, np.uint8, int(self.sizes.sum()), at)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self._rest = raw, at + len(self.text)

    def others(self) -> pa.RecordBatch:
        raw, at = self._rest
        return pa.ipc.open_stream(pa.py_buffer(raw)[at:]).read_all().combine_chunks().to_batches()[0]


# -- anchors --------------------------------------------------------------------


def digits(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number; zeros follow the end."""
    w = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] << np.uint64(8 * step) | w[step:]
    return w[: len(text)]


def anchors(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, position, first and last window (positions in the block) and document of each anchor."""
    # no window crosses documents, so runs of whole documents go one after another
    cut = np.flatnonzero(np.diff(block.starts // ANCHOR_BYTES)) + 1
    edges = [0, *cut.tolist(), len(block.sizes)]
    found = []
    for x, y in zip(edges, edges[1:]):
        if y > x:
            base = block.starts[x]
            h, *places, doc = _anchors(block.text[base : block.ends[y - 1]], block.sizes[x:y], length)
            found.append((h, *(p + base for p in places), doc + x))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else _NO_ANCHORS


_NO_ANCHORS = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)


def _anchors(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, gram = len(text), min(GRAM, length)
    if n < length:
        return _NO_ANCHORS
    w = digits(text)
    h = np.zeros(n, np.uint64)
    for at in sorted({*range(0, gram - 7, 8), max(0, gram - 8)}):
        h[: n - at] = mix(h[: n - at] ^ (w[at:] if gram >= 8 else w[at:] >> np.uint64(64 - 8 * gram)))
    best = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    wide, span = length - gram + 1, 1
    while span * 2 <= wide:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if wide > span:
        best = np.minimum(best[: len(best) - (wide - span)], best[wide - span :])
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    windows = np.maximum(sizes - length + 1, 0)
    first = np.cumsum(windows) - windows
    where = np.arange(len(doc)) - np.repeat(first, windows) + (np.cumsum(sizes) - sizes)[doc]
    if not len(where):
        return _NO_ANCHORS
    pick = (best[where] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(pick), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(pick)) - 1
    return h[pick[lo]], pick[lo], where[lo], where[hi], doc[lo]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each block and bucket of hashes: its distinct hashes and how often each occurs."""
    lean()
    for b in batches:
        for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found, n = np.unique(anchors(Block(payload), length)[0], return_counts=True)
            if not len(found):
                continue
            at = (found >> np.uint64(40)).astype(np.int64) * buckets >> 24  # ascending, as the hashes are
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            stop = np.append(first[1:], len(at))
            n = np.minimum(n, 65535).astype(np.uint16)
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(at[first].astype(np.int32)),
                    "block": pa.array(np.full(len(first), block), pa.int64()),
                    "hashes": pa.array([found[x:y].tobytes() for x, y in zip(first, stop)], pa.binary()),
                    "counts": pa.array([n[x:y].tobytes() for x, y in zip(first, stop)], pa.binary()),
                }
            )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket: for each block, those of its hashes that occur twice or more."""
    lean()

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(h, np.uint64) for _, h, _ in rows]
        hashes, counts = np.concatenate(parts), np.concatenate([np.frombuffer(c, np.uint16) for _, _, c in rows]).astype(np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
        order = np.argsort(hashes, kind="stable")
        hashes, counts, owner = hashes[order], counts[order], owner[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        total = np.add.reduceat(counts, first)
        total = np.repeat(total, np.diff(np.append(first, len(hashes))))
        again = total > 1
        hashes, owner, often = hashes[again], owner[again], total[again] >= FREQUENT
        order = np.argsort(owner, kind="stable")
        hashes, owner, often = hashes[order], owner[order], often[order]
        cut = np.searchsorted(owner, np.arange(len(rows) + 1))
        some = [k for k in range(len(rows)) if cut[k + 1] > cut[k]]
        if some:
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([rows[k][0] for k in some], pa.int64()),
                    "part": pa.array([0] * len(some), pa.int32()),
                    "a": pa.array([hashes[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()),
                    "b": pa.array([often[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()),
                }
            )

    now, rows = None, []
    for b in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now:
                if rows:
                    yield from settle(rows)
                now, rows = bucket, []
            rows.append(tuple(row))
    if rows:
        yield from settle(rows)


def _records(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block and part: the repeated hashes of a block, then the block."""
    lean()
    now, known, often = None, [], []
    for b in batches:
        for block, part, x, y in zip(*(c.to_pylist() for c in b.columns)):
            if block != now:
                now, known, often = block, [], []
            if part == 0:
                known.append(np.frombuffer(x, np.uint64))
                often.append(np.frombuffer(y, bool))
            elif known:
                yield from _block_records(block, Block(x), np.concatenate(known), np.concatenate(often), length, buckets)


def _block_records(number: int, block: Block, known: np.ndarray, often: np.ndarray, length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(known)
    known, often = known[order], often[order]
    h, pos, lo, hi, doc = anchors(block, length)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[at] == h
    h, pos, lo, hi, doc, hot = h[hit], pos[hit], lo[hit], hi[hit], doc[hit], often[at[hit]]
    if hot.any():  # a record for each window, dealt by its content
        n = np.where(hot, hi - lo + 1, 1)
        src = np.repeat(np.arange(len(h)), n)
        step = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
        one = hot[src]
        lo = lo[src] + np.where(one, step, 0)
        hi = np.where(one, lo, hi[src])
        h, pos, doc = h[src], pos[src], doc[src]
        hot = one
    raw = block.text.tobytes()
    text = [raw[a : b + length] for a, b in zip(lo.tolist(), hi.tolist())]
    key = h.copy()
    if hot.any():
        own = np.flatnonzero(hot)
        key[own] = [int.from_bytes(hashlib.blake2b(text[k], digest_size=8).digest(), "little") for k in own.tolist()]
    start = block.starts[doc]
    rank = np.lexsort((lo, doc, block.ids[doc]))  # earlier documents first
    seen: set[tuple] = set()
    first, again = [], []
    delta = (pos - lo).tolist()
    for k in rank.tolist():
        mark = (text[k], delta[k])
        if mark in seen:
            again.append(k)
        else:
            seen.add(mark)
            first.append(k)
    own = np.array(first)
    made = np.empty(len(own), _RECORD)
    made["key"], made["doc"], made["uid"], made["lo"], made["delta"] = key[own], block.ids[doc[own]], number << 20 | doc[own], (lo - start)[own], (pos - lo)[own]
    made["size"] = np.fromiter((len(text[k]) for k in first), np.int64, len(first))
    to = (mix(made["key"]) >> np.uint64(40)).astype(np.int64) * buckets >> 24
    order = np.argsort(to, kind="stable")
    edge = np.flatnonzero(np.append(True, to[order][1:] != to[order][:-1])) if len(order) else np.zeros(0, np.int64)
    rows = []
    for x, y in zip(edge.tolist(), np.append(edge[1:], len(order)).tolist()):
        mine = order[x:y]
        payload = made[mine].tobytes() + b"".join([text[first[k]] for k in mine.tolist()])
        rows.append((int(to[mine[0]]), number, 0, np.array([y - x], "<i8").tobytes() + zstandard.compress(payload, LEVEL)))
    if again:  # an equal record stands earlier in this block: all of its windows are repeats
        own = np.array(again)
        d, x, y = _merged(doc[own], (lo - start)[own], (hi - start)[own] + length)
        rows.append((number % buckets, number, 1, np.stack([d, x, y], 1).astype("<i4").tobytes()))
    for a in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 64]), _PACK)], schema=_PACK)


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans [lo, hi) of each document."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    base = np.unique(doc, return_inverse=True)[1] * (np.int64(1) << 40)
    reach = np.maximum.accumulate(hi + base)
    new = np.ones(len(doc), bool)
    new[1:] = lo[1:] + base[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[last] - base[last]


# -- deep-shallow sorting -------------------------------------------------------


def _regroup(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (most significant last) and dense group numbers in that order."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def multikey_quicksort(word: np.ndarray, start: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``order`` of groups ``rank`` sorted to ``depth`` bytes, and their dense group numbers.

    All groups are partitioned side by side: each takes the digit of its middle suffix as its pivot and
    splits into less, equal and greater; only the equal part moves on to the next digit.
    """
    digit = np.zeros(len(order), np.int64)
    new = np.append(True, rank[1:] != rank[:-1]) if len(order) else np.zeros(0, bool)
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        go = (size > 1) & (digit[first] < depth)
        if not go.any():
            return order, np.cumsum(new) - 1
        n = size[go]
        part = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(first[go], n) + inner
        d = word[start[order[place]] + digit[place]]
        pivot = np.repeat(d[np.cumsum(n) - n + n // 2], n)
        side = part * 3 + (d >= pivot) + (d > pivot)
        o = np.argsort(side, kind="stable")
        order[place] = order[place[o]]
        side = side[o]
        new[place[1:]] |= side[1:] != side[:-1]
        digit[place] += 8 * (side % 3 == 1)


def deep_shallow_sort(word: np.ndarray, start: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``start``, to ``length`` bytes and within groups, and their class numbers.

    ``word`` holds the 8 bytes from each position.  Suffixes are of one class when
    group and all ``length`` bytes are equal.
    """
    depth = min(shallow, length) // 8 * 8
    order = np.argsort(group, kind="stable")
    order, rank = multikey_quicksort(word, start, order, np.unique(group, return_inverse=True)[1][order], depth)
    # blind tries: each group is laid beside the path of its head; those that leave the path at
    # one depth by one byte stay together, and no byte above that depth is read again
    out_order, level_rank = order.copy(), rank
    todo = np.ones(len(order), bool)
    while True:
        size = np.bincount(level_rank)
        many = size[level_rank] > 1
        if not (many & todo).any():
            break
        idx = np.flatnonzero(many & todo)
        g = level_rank[idx]
        first = np.append(True, g[1:] != g[:-1])
        heads = out_order[idx[np.flatnonzero(first)[np.cumsum(first) - 1]]]
        mine, theirs = start[out_order[idx]], start[heads]
        common = np.full(len(idx), length, np.int64)
        less = np.zeros(len(idx), bool)
        byte = np.zeros(len(idx), np.int64)
        open_ = np.arange(len(idx))
        for d in [*range(depth, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
            a, b = word[mine[open_] + d], word[theirs[open_] + d]
            differ = a != b
            if differ.any():
                k = open_[differ]
                x = a[differ] ^ b[differ]
                skip = np.zeros(len(x), np.int64)
                for s in (32, 16, 8):
                    zero = x >> np.uint64(64 - s) == 0
                    skip += np.where(zero, s // 8, 0)
                    x = np.where(zero, x << np.uint64(s), x)
                common[k] = d + skip
                less[k] = a[differ] < b[differ]
                byte[k] = (a[differ] >> (np.uint64(56) - np.uint64(8) * skip.astype(np.uint64)) & np.uint64(255)).astype(np.int64)
                open_ = open_[~differ]
        side = np.where(common == length, length, np.where(less, common, 2 * length - common))
        o, sub = _regroup((byte, side, g))
        out_order[idx] = out_order[idx][o]
        done = common[o] == length
        # new dense ranks over all, in order
        mark = np.zeros(len(level_rank), bool)
        mark[1:] = level_rank[1:] != level_rank[:-1]
        inner = np.append(False, sub[1:] != sub[:-1])
        mark[idx] |= inner
        level_rank = np.cumsum(mark)
        todo[idx[done]] = False
    return out_order, level_rank


class Gathered:
    """Records of a task, as they arrive; equal ones are settled when there are many."""

    def __init__(self) -> None:
        self.rows, self.texts, self.size, self.most = [], [], 0, SETTLE_BYTES

    def add(self, payload: bytes) -> Iterator[pa.RecordBatch]:
        n = int(np.frombuffer(payload, "<i8", 1)[0])
        raw = zstandard.decompress(payload[8:])
        self.rows.append(np.frombuffer(raw, _RECORD, n))
        self.texts.append(raw[n * _RECORD.itemsize :])
        self.size += len(raw)
        if self.size > self.most:
            yield from self.settle()
            self.most = max(SETTLE_BYTES, 2 * self.size)

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Keep the earliest of equal records; the windows of the others are repeats."""
        if not self.rows:
            return
        rows, text = np.concatenate(self.rows), b"".join(self.texts)
        ends = np.cumsum(rows["size"], dtype=np.int64)
        cut = [text[x - n : x] for x, n in zip(ends.tolist(), rows["size"].tolist())]
        keys, deltas = rows["key"].tolist(), rows["delta"].tolist()
        seen: set[tuple] = set()
        first, again = [], []
        for k in np.lexsort((rows["lo"], rows["uid"], rows["doc"])).tolist():
            mark = (keys[k], deltas[k], cut[k])
            if mark in seen:
                again.append(k)
            else:
                seen.add(mark)
                first.append(k)
        if again:
            own = rows[again]
            yield _merged_spans(own["uid"], own["lo"].astype(np.int64), own["lo"].astype(np.int64) + own["size"])
        first = np.array(first)
        first = first[np.argsort(rows["key"][first], kind="stable")]
        self.rows, self.texts = [rows[first]], [b"".join([cut[k] for k in first.tolist()])]
        self.size = len(self.texts[0]) + len(first) * _RECORD.itemsize


def _sort(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Of packed records: spans that repeat earlier bytes."""
    lean()
    all_ = Gathered()
    for b in batches:
        for block, kind, payload in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "payload"))):
            if kind:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([payload], pa.binary())], schema=_SPAN)
            else:
                yield from all_.add(payload)
    yield from all_.settle()
    if not all_.rows:
        return
    rows, text = all_.rows[0], np.frombuffer(all_.texts[0], np.uint8)  # in order of key
    ends = np.cumsum(rows["size"], dtype=np.int64)
    new = np.append(True, rows["key"][1:] != rows["key"][:-1])
    group = np.cumsum(new) - 1
    again = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(again):
        return
    # parts of whole groups of about SORT_BYTES
    size = np.cumsum(rows["size"][again], dtype=np.int64)
    at = 0
    while at < len(again):
        stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + SORT_BYTES, "right"))
        stop = max(stop, at + 1)
        while stop < len(again) and group[again[stop]] == group[again[stop - 1]]:
            stop += 1
        own = again[at:stop]
        n = rows["size"][own].astype(np.int64)
        place = np.arange(n.sum()) + np.repeat(ends[own] - n - (np.cumsum(n) - n), n)
        yield from _repeats(rows[own], group[own], text[place], length)
        at = stop


def _merged_spans(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    known, dense = np.unique(uid, return_inverse=True)
    d, x, y = _merged(dense, lo, hi)
    return _spans(known[d], x, y)


def _spans(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Spans as one value for each block."""
    order = np.argsort(uid, kind="stable")
    block = (uid >> 20)[order]
    triples = np.stack([uid & 0xFFFFF, lo, hi], 1).astype("<i4")[order]
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    stop = np.append(first[1:], len(block))
    return pa.RecordBatch.from_arrays([pa.array(block[first], pa.int64()), pa.array([triples[x:y].tobytes() for x, y in zip(first, stop)], pa.binary())], schema=_SPAN)


def _repeats(rows: np.ndarray, group: np.ndarray, text: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows of ``rows`` (their bytes end to end) that an earlier one of its group equals."""
    doc, uid, lo, delta, size = (rows[c].astype(np.int64) for c in ("doc", "uid", "lo", "delta", "size"))
    word = digits(text)
    count = size - length + 1
    rec = np.repeat(np.arange(len(rows)), count)
    step = np.arange(len(rec)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(size) - size)[rec] + step
    # equal windows have their anchor at one offset
    bound = group[rec] * 4096 + delta[rec] - step + 2048
    order, cls = deep_shallow_sort(word, start, bound, length)
    many = np.bincount(cls)[cls] > 1
    order, cls = order[many], cls[many]
    rec, step = rec[order], step[order]
    at = lo[rec] + step
    by = np.lexsort((at, uid[rec], doc[rec], cls))
    cls, rec, at = cls[by], rec[by], at[by]
    again = np.append(False, cls[1:] == cls[:-1])
    if again.any():
        yield _merged_spans(uid[rec[again]], at[again], at[again] + length)


# -- cutting --------------------------------------------------------------------


def _kept(block: Block, spans: list[np.ndarray]) -> Iterator[tuple[int, bytes, int]]:
    """For each document of a block: how many bytes it has, those that stay, its removed runs."""
    cut: dict[int, list[tuple[int, int]]] = {}
    if spans:
        for d, x, y in zip(*(v.tolist() for v in _merged(*np.concatenate(spans).T))):
            cut.setdefault(d, []).append((x, y))
    raw = block.text.tobytes()
    for d, (a, z) in enumerate(zip(block.starts.tolist(), block.ends.tolist())):
        text, gone = raw[a:z], cut.get(d, [])
        if gone:
            edges = [0, *(e for s in gone for e in s), len(text)]
            text = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
        yield z - a, text, len(gone)


def _cut(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block and part: the spans of a block, then the block.  ``rows`` makes the output
    columns of a block."""
    lean()
    now, spans = None, []
    for b in batches:
        for block, part, payload in zip(*(c.to_pylist() for c in b.columns)):
            if block != now:
                now, spans = block, []
            if part == 0:
                spans.append(np.frombuffer(payload, "<i4").reshape(-1, 3).astype(np.int64))
                continue
            out = rows(Block(payload), spans)
            for a in range(0, out.num_rows, 512):
                yield out.slice(a, 512)


_OUT_DDL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _figures(block: Block, spans: list[np.ndarray], digest: bool) -> pa.RecordBatch:
    ids = [None if i == NO_ID else i for i in block.ids.tolist()]
    made = [(i, n, n - len(t), k, hashlib.sha256(t).hexdigest() if digest else None, None if digest else t) for i, (n, t, k) in zip(ids, _kept(block, spans))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _OUT)], schema=_OUT)


def _texts(block: Block, spans: list[np.ndarray], at: int) -> pa.RecordBatch:
    """The other columns of the rows, and at place ``at`` their text without the parts of a character that
    a cut leaves."""
    texts = pa.array([t.decode("utf-8", "ignore") for _, t, _ in _kept(block, spans)], pa.string())
    other = block.others()
    columns, names = list(other.columns), list(other.schema.names)
    columns.insert(at, texts)
    names.insert(at, "text")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _spans_beside_blocks(rows: DataFrame, length: int) -> DataFrame:
    """The spans to remove, then the block (block, part, payload), sorted so in partitions."""
    if length < 8:
        raise ValueError("length must be 8 or more")
    n = partitions(rows.sparkSession)
    blocks = materialise(rows.mapInArrow(_blocks, _BLOCK_DDL), "blocks")
    buckets = min(1 << 20, max(1024, 8 * n))
    hashes = blocks.mapInArrow(partial(_anchor_rows, length=length, buckets=buckets), "bucket int, block long, hashes binary, counts binary")
    known = hashes.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, "block long, part int, a binary, b binary")
    both = known.union(blocks.select("block", F.lit(1).alias("part"), F.col("payload").alias("a"), F.lit(None).cast("binary").alias("b")))
    records = both.repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(partial(_records, length=length, buckets=n), _PACK_DDL)
    spans = records.repartitionById(n, F.col("bucket")).mapInArrow(partial(_sort, length=length), "block long, spans binary")
    both = spans.select("block", F.lit(0).alias("part"), F.col("spans").alias("payload")).union(blocks.select("block", F.lit(1).alias("part"), "payload"))
    return both.repartition(n, "block").sortWithinPartitions("block", "part")


def remove_repeats(docs: DataFrame, length: int = 100, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_bytes, n_removed, n_spans, kept (bytes; with ``digest`` kept_sha256)."""
    tune(docs.sparkSession)
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text"))
    out = _spans_beside_blocks(rows, length).mapInArrow(partial(_cut, rows=partial(_figures, digest=digest)), _OUT_DDL)
    return out.withColumnRenamed("id", id_col)


def cut_rows(docs: DataFrame, length: int = 100, count_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their texts cut, and ``count_col``, if there, counting what is left."""
    tune(docs.sparkSession)
    other = [c for c in docs.columns if c != text_col]
    names = [f"c{k}" for k in range(len(other))]
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text"), *(col(docs, c).alias(k) for c, k in zip(other, names)))
    at = docs.columns.index(text_col)
    fields = [StructField(k, docs.schema[c].dataType) for c, k in zip(other, names)]
    fields.insert(at, StructField("text", docs.schema[text_col].dataType))
    out = _spans_beside_blocks(rows, length).mapInArrow(partial(_cut, rows=partial(_texts, at=at)), StructType(fields))
    back = dict(zip(other, (F.col(k) for k in names))) | {text_col: F.col("text")}
    if count_col in other:
        back[count_col] = F.length("text").cast(docs.schema[count_col].dataType)
    return out.select(*(back[c].alias(c) for c in docs.columns))
