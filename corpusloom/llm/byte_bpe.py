"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Texts of a batch are laid end to end as code points.  Each code point gets a
class (with one character of look-ahead folded in), and a finite automaton over
classes says where a slice begins.  The automaton runs as an associative scan:
the transition functions of each block of characters are composed for all start
states at once, the block functions are scanned by doubling, and a second sweep
with known states marks the boundaries.  No regular expression is run.  Slices
go through a cache of merged pairs; their offsets are kept for decoding.

Defined cases: a null text is empty and has no ids; special tokens don't exist,
so their strings are ordinary text; texts of any length are encoded whole, and a
slice of any length is merged in n log n; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Slices a worker's cache may hold.
CACHE_SLICES = 350_000
#: Characters composed in one block of the scan.
BLOCK = 256
#: Slices over this many bytes are merged with a heap and not cached.
LONG_SLICE = 200

# classes
STOP, SPACE_END, SPACE, BLANK_END, BLANK, LETTER, SHORT_TAIL, LONG_TAIL, NUMBER, QUOTE, OTHER = range(11)
# states: what the open slice is
NONE, GAP, BLANKS, WORD, DIGITS, MARKS, OPEN_QUOTE, HALF_TAIL, WHOLE_TAIL = range(9)
_N_CLASS, _N_STATE = 11, 9


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begins-a-slice, each indexed by state * classes + class."""
    nxt, begins = np.zeros((_N_STATE, _N_CLASS), np.uint8), np.ones((_N_STATE, _N_CLASS), bool)
    letters = (LETTER, SHORT_TAIL, LONG_TAIL)
    for s in range(_N_STATE):
        nxt[s, STOP] = NONE
        for c in (SPACE_END, SPACE, BLANK_END, BLANK):
            nxt[s, c] = GAP if c == SPACE_END else BLANKS
            # a run of white space is one slice, but its last character stands apart before other text
            begins[s, c] = s not in (GAP, BLANKS) or c in (SPACE_END, BLANK_END)
        for c in letters:
            nxt[s, c] = WORD
            begins[s, c] = s not in (GAP, WORD)
        nxt[s, NUMBER], begins[s, NUMBER] = DIGITS, s not in (GAP, DIGITS)
        nxt[s, OTHER], begins[s, OTHER] = MARKS, s not in (GAP, MARKS, OPEN_QUOTE)
        joins = s in (GAP, MARKS, OPEN_QUOTE)
        nxt[s, QUOTE], begins[s, QUOTE] = (MARKS if joins else OPEN_QUOTE), not joins
    nxt[OPEN_QUOTE, SHORT_TAIL], begins[OPEN_QUOTE, SHORT_TAIL] = WHOLE_TAIL, False
    nxt[OPEN_QUOTE, LONG_TAIL], begins[OPEN_QUOTE, LONG_TAIL] = HALF_TAIL, False
    for c in letters:
        nxt[HALF_TAIL, c], begins[HALF_TAIL, c] = WHOLE_TAIL, False
    return nxt.ravel(), begins.ravel()


NEXT, BEGINS = _automaton()
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that strings of classes make of the states, few as they are.

    Returns the functions as rows, the number of (function, then class), and the
    number of (function, then function).  Composition of numbers is associative.
    """
    step = NEXT.reshape(_N_STATE, _N_CLASS)
    rows, number = [tuple(range(_N_STATE))], {tuple(range(_N_STATE)): 0}
    then = []
    for row in rows:
        out = []
        for c in range(_N_CLASS):
            new = tuple(int(step[s, c]) for s in row)
            if new not in number:
                number[new] = len(rows)
                rows.append(new)
            out.append(number[new])
        then.append(out)
    table = np.array(rows, np.uint8)
    both = np.array([[number[tuple(table[g][table[f]].tolist())] for g in range(len(rows))] for f in range(len(rows))], np.int16)
    return table, np.array(then, np.int16), both


FUNCTIONS, THEN_CLASS, THEN_FUNCTION = _monoid()
#: Code points of the White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Stands between texts; no code point.
_BETWEEN = 0x110000
# kinds of one code point, before look-ahead
_K_STOP, _K_SPACE, _K_BLANK, _K_LETTER, _K_STMD, _K_R, _K_V, _K_L, _K_E, _K_NUMBER, _K_QUOTE, _K_OTHER = range(12)
_tables: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    if "kind" not in _tables:
        table = np.full(_BETWEEN + 1, _K_OTHER, np.uint8)
        major = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(_BETWEEN)).encode(), np.uint8)
        table[:-1][major == ord("L")] = _K_LETTER
        table[:-1][major == ord("N")] = _K_NUMBER
        table[_WHITE] = _K_BLANK
        for text, kind in ((" ", _K_SPACE), ("stmd", _K_STMD), ("r", _K_R), ("v", _K_V), ("l", _K_L), ("e", _K_E), ("'", _K_QUOTE)):
            table[[ord(c) for c in text]] = kind
        table[_BETWEEN] = _K_STOP
        _tables["kind"] = table
    return _tables["kind"]


def _look_ahead() -> np.ndarray:
    """Class by kind * 16 + kind of the next code point."""
    table = np.zeros((16, 16), np.uint8)
    for kind, plain in ((_K_STOP, STOP), (_K_SPACE, SPACE), (_K_BLANK, BLANK), (_K_LETTER, LETTER), (_K_STMD, SHORT_TAIL), (_K_R, LETTER), (_K_V, LETTER), (_K_L, LETTER), (_K_E, LETTER), (_K_NUMBER, NUMBER), (_K_QUOTE, QUOTE), (_K_OTHER, OTHER)):
        table[kind] = plain
    table[_K_SPACE, _K_LETTER:], table[_K_BLANK, _K_LETTER:] = SPACE_END, BLANK_END
    table[_K_R, _K_E] = table[_K_V, _K_E] = table[_K_L, _K_L] = LONG_TAIL
    return table.ravel()


LOOK_AHEAD = _look_ahead()


def classify(points: np.ndarray) -> np.ndarray:
    """Class of each code point, with the look-ahead that white space and contractions need."""
    kind = np.take(_kinds(), points)
    pair = kind << 4
    pair[:-1] |= kind[1:]
    return np.take(LOOK_AHEAD, pair)


def slice_starts(cls: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Positions at which a slice begins, by a blocked scan of transition functions."""
    n = len(cls)
    if not n:
        return np.zeros(0, np.int64)
    block = min(block, int(n**0.5) + 1)
    blocks = -(-n // block)
    grid = np.zeros(blocks * block, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T)
    flat, pairs = THEN_CLASS.ravel(), THEN_FUNCTION.ravel()
    whole = np.zeros(blocks, np.int16)
    for column in grid:
        whole = np.take(flat, whole * _N_CLASS + column)
    step = 1
    while step < blocks:  # inclusive scan: each block after the function of all blocks before it
        moved = whole.copy()
        moved[step:] = np.take(pairs, whole[:-step].astype(np.int32) * len(FUNCTIONS) + whole[step:])
        whole, step = moved, step * 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = FUNCTIONS[whole[:-1], NONE]
    marks = np.empty((block, blocks), bool)
    for j, column in enumerate(grid):
        at = state * np.uint8(_N_CLASS) + column
        marks[j], state = np.take(BEGINS, at), np.take(NEXT, at)
    return np.flatnonzero(np.ascontiguousarray(marks.T).ravel()[:n])


class Merger:
    """Merges a slice's bytes by rank; remembers what it has merged."""

    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        outer = self

        class Cache(dict):
            def __missing__(self, text: str) -> bytes:  # long slices, which are not kept
                return np.array(outer.merge(text.encode()), "<u4").tobytes()

        self.cache = Cache()
        pairs = {}
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                if (a := self.ranks.get(piece[:i])) is not None and (b := self.ranks.get(piece[i:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def merge(self, raw: bytes) -> list[int]:
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        return self._merge_long(raw)

    def merge_many(self, raws: list[bytes]) -> list[bytes]:
        """Ids of many short slices at once: each round merges the leftmost best pair of each slice."""
        done: list[bytes] = [b""] * len(raws)
        none = np.int64(1 << 40)
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        ids = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        which = np.arange(len(raws))
        while len(which):
            starts = np.cumsum(lengths) - lengths
            key = ids << 32
            key[:-1] |= ids[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], none)
            rank[starts + lengths - 1] = none
            best = np.minimum.reduceat(rank, starts)
            more = best < none
            if not more.all():
                ended = np.flatnonzero(~more)
                raw, sizes = ids.astype("<u4").tobytes(), lengths[ended] * 4
                for i, a, size in zip(which[ended].tolist(), (starts[ended] * 4).tolist(), sizes.tolist()):
                    done[i] = raw[a : a + size]
                if not more.any():
                    break
            owner = np.repeat(np.arange(len(which)), lengths)
            hits = np.flatnonzero((rank == best[owner]) & (rank < none))
            hits = hits[np.unique(owner[hits], return_index=True)[1]]
            ids[hits] = rank[hits]
            stays = more[owner]
            stays[hits + 1] = False
            ids, which, lengths = ids[stays], which[more], lengths[more] - 1
        return done

    def _merge_long(self, raw: bytes) -> list[int]:
        get, n = self.ranks.get, len(raw)
        end = list(range(1, n + 1))  # where the part that begins here ends; 0: no part begins here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids (little-endian, 4 bytes each) and the offsets of its slices."""
        if not texts:
            return []
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(length + 1) - 1
        points[stops] = _BETWEEN
        starts = slice_starts(classify(points))
        first = np.searchsorted(starts, stops - length)
        last = np.searchsorted(starts, stops)
        places = starts.tolist()
        slices = list(map(joined.__getitem__, map(slice, places, places[1:])))
        new = [t for t in set(slices) if t not in self.cache and len(t) <= LONG_SLICE]
        if new:
            raws = [t.encode() for t in new]
            whole = [self.ranks.get(r) for r in raws]
            rest = [i for i, r in enumerate(whole) if r is None]
            for i, ids in zip(rest, self.merge_many([raws[i] for i in rest]) if rest else ()):
                self.cache[new[i]] = ids
            for t, r in zip(new, whole):
                if r is not None:
                    self.cache[t] = r.to_bytes(4, "little")
        ids = list(map(self.cache.__getitem__, slices))
        out = [(b"".join(ids[a:b]), starts[a:b] - o) for a, b, o in zip(first.tolist(), last.tolist(), (stops - length).tolist())]
        if len(self.cache) > CACHE_SLICES:
            self.cache.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One for each rank file and Python worker."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = merger(path)
    for b in batches:
        done = m.encode([t or "" for t in b.column(1).to_pylist()])
        ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in done], pa.list_(pa.int32()))
        starts = pa.array([s.astype(np.int32) for _, s in done], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), ids, starts], names=[b.schema.names[0], "ids", "slice_starts"])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = merger(path)
    for b in batches:
        done = [x for x, _ in m.encode([t or "" for t in b.column(1).to_pylist()])]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([len(x) // 4 for x in done], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in done], pa.string()),
                pa.array([hashlib.sha256(m.decode(x)).hexdigest() for x in done], pa.string()),
            ],
            names=[b.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = merger(path)
    for b in batches:
        texts = [m.decode(np.asarray(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[b.schema.names[0], "text"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, ids, and slice_starts, the character offsets of its slices."""
    return _rows(docs, id_col, text_col).mapInArrow(partial(_encode, path=path), f"{id_col} long, ids array<int>, slice_starts array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """For each row of ids: id and text (bytes that aren't UTF-8 are replaced)."""
    rows = tune(encoded.sparkSession) and encoded.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(partial(_decode, path=path), f"{id_col} long, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_tokens, digest of its ids, digest of what they decode to."""
    return _rows(docs, id_col, text_col).mapInArrow(partial(_digest, path=path), f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
