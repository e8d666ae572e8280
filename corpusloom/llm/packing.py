"""Best-fit packing through a configuration linear program.

The driver sees only the histogram of piece lengths, at most as many numbers as a
sequence has tokens.  A configuration is a multiset of lengths that fits one
sequence; the program asks for the fewest configurations that cover the histogram.
Multiplicative weights solve it in small steps: the price of a length falls with
how much of it is covered, and a knapsack dynamic program finds, for each length,
the configuration of the highest price that holds it; those near the highest of
all take a step.  Rounds go on until every length is covered in full.  The solution
is scaled to cover no length twice, then rounded: configurations are taken whole,
the most used first, while their lengths last.  What is left is filled best-fit,
largest first.  Pieces then find their place from their length and their rank
among pieces of that length, by arithmetic.

Defined cases: a null text is empty and is one piece, its end id; a document of
more than the limit is cut into full pieces and a last one; repeated rows are
packed apart; of pieces of one length any may take any of their places; a null
identifier stays null; an empty table gives an empty result; other columns,
whatever their names, don't matter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, materialise, tune
from .encode import encoder

#: How much of a length's demand a round may cover at least and at most (in proportion to the number of lengths,
#: up to ``MANY``), how fast prices fall with coverage, how near to the highest price a configuration must be.
STEP, MANY, RATE, NEAR = (0.25, 1.0), 4_000, 4.0, 0.03
#: Shares of the solution that roundings take.
SHARES = (1.0, 0.9, 0.8, 0.5, 0.2)
#: Configurations without a step after which a round ends.
IDLE = 150

_PIECE_DDL = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, enc, end = TaskContext.get().partitionId(), encoder(path), np.array([end_id], "<u4").tobytes()
    seen: Counter[int] = Counter()
    for b in batches:
        rows = []
        for i, own in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
            ids = own + end
            for k, at in enumerate(range(0, len(ids), 4 * limit)):
                own = ids[at : at + 4 * limit]
                n = len(own) // 4
                rows.append((i, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                seen[n] += 1
        columns = list(zip(*rows)) if rows else [[]] * len(_PIECES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)


class Knapsack:
    """The multisets of lengths within ``limit`` of the highest price: an unbounded knapsack."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, limit: int):
        worth = np.maximum.accumulate(np.concatenate([[0.0], prices[:-1]]))
        use = prices > worth * (1 + 1e-12)  # a longer piece at no higher price never helps
        self.sizes, values = lengths[use], prices[use]
        self.best, self.pick = np.zeros(limit + 1), np.full(limit + 1, -1)
        fit = np.searchsorted(self.sizes, np.arange(limit + 1), "right").tolist()
        best, pick, sizes = self.best, self.pick, self.sizes
        for w in range(1, limit + 1):
            best[w] = best[w - 1]
            if m := fit[w]:
                total = best[w - sizes[:m]] + values[:m]
                k = total.argmax()
                if total[k] > best[w]:
                    best[w], pick[w] = total[k], k

    def filling(self, room: int) -> dict[int, int]:
        """The best configuration within ``room``: lengths and how often."""
        out: dict[int, int] = {}
        while room > 0:
            if (k := self.pick[room]) < 0:
                room -= 1
            else:
                n = int(self.sizes[k])
                out[n] = out.get(n, 0) + 1
                room -= n
        return out


def solve(histogram: dict[int, int], limit: int) -> list[tuple[dict[int, int], float]]:
    """A fractional solution of the configuration program, by multiplicative weights: it covers every
    length's demand."""
    order = sorted(n for n in histogram if n < limit)
    lengths = np.array(order, np.int64)
    if not len(lengths):
        return []
    demand = np.array([histogram[n] for n in order], float)
    place = {n: i for i, n in enumerate(order)}
    covered = np.zeros(len(lengths))
    step = min(max(STEP[0], len(lengths) / MANY), STEP[1])
    mass: dict[tuple, float] = {}
    for _ in range(1000 + 4 * len(lengths)):  # some rounds a length at most; what they leave open is filled best-fit
        if (low := covered.min()) >= 1:
            break
        prices = lengths / limit * np.exp(-RATE * (covered - low))
        sack = Knapsack(lengths, prices, limit)
        whole = prices + sack.best[limit - lengths]  # of the best configuration with each length
        least = (1 - NEAR) * whole.max()
        top, idle = covered + step, 0
        for i in np.argsort(covered, kind="stable").tolist():
            if whole[i] < least:
                continue
            config = sack.filling(limit - order[i])
            config[order[i]] = config.get(order[i], 0) + 1
            at = [(place[n], k) for n, k in config.items()]
            much = min((top[j] - covered[j]) * demand[j] / k for j, k in at)
            if much <= 1e-6 * demand[i]:
                idle += 1
                if idle > IDLE:  # what fills up is used up at these prices
                    break
                continue
            key = tuple(sorted(config.items()))
            mass[key] = mass.get(key, 0.0) + much
            for j, k in at:
                covered[j] += much * k / demand[j]
    return [(dict(key), x / max(1.0, covered.min())) for key, x in mass.items()]


def rounded(histogram: dict[int, int], limit: int, solution: list[tuple[dict[int, int], float]], share: float) -> list[tuple[list[int], int]]:
    """``share`` of a fractional solution in whole configurations, the most used first while their lengths
    last, and best-fit, largest first, for what is left."""
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    out = []
    if full := left.pop(limit, 0):
        out.append(([limit], full))

    def take(config: dict[int, int], times: int) -> None:
        out.append((sorted((n for n, k in config.items() for _ in range(k)), reverse=True), times))
        for n, k in config.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]

    for up in (0, 1):  # whole parts, then one more of each that leaves no gap
        for config, x in solution:
            times = min([up or int(x * share), *(left[n] // k for n, k in config.items())])
            if times > 0 and (not up or sum(n * k for n, k in config.items()) == limit):
                take(config, times)
    order = sorted(left)
    while left:  # each turn uses up a length or comes close
        order = [n for n in order if n in left]
        config, gap, at = Counter(), limit, len(order)
        while gap and (at := bisect_right(order, gap, 0, at)):
            n = order[at - 1]
            k = min(gap // n, left[n])
            config[n] += k
            gap -= n * k
            at -= 1
        take(config, min(left[n] // k for n, k in config.items()))
    return out


def least_sequences(histogram: dict[int, int], limit: int) -> int:
    """A bound from below: the volume, and for each size the pieces over limit - size, which meet no piece of that size
    or more, with the volume of those between."""
    volume = -(-sum(n * c for n, c in histogram.items()) // limit)
    best, large = volume, 0
    order = sorted(n for n in histogram if histogram[n])
    for small in (n for n in order if 2 * n <= limit):
        large = sum(histogram[n] for n in order if n > limit - small)
        middle = sum(histogram[n] for n in order if limit < 2 * n and n <= limit - small)
        rest = sum(n * histogram[n] for n in order if small <= n and 2 * n <= limit)
        room = middle * limit - sum(n * histogram[n] for n in order if limit < 2 * n and n <= limit - small)
        best = max(best, large + middle + max(0, -(-(rest - room) // limit)))
    return max(best, sum(c for n, c in histogram.items() if 2 * n > limit))


def plan(histogram: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Whole configurations (their lengths in order) and how often each is used; covers all.  Of several
    roundings of the program's solution, and best-fit without it, that of the fewest sequences."""
    solution = sorted(solve(histogram, limit), key=lambda c: (-c[1], sorted(c[0].items())))
    plans = [*(rounded(histogram, limit, solution, share) for share in SHARES), rounded(histogram, limit, [], 0.0)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _table(plan_: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of ranks: key (length << 40 | first rank), first sequence, offset."""
    ranks: Counter[int] = Counter()
    rows, base = [], 0
    for config, times in plan_:
        offset = 0
        for n in config:
            rows.append((n << 40 | ranks[n], ranks[n], base, offset))
            ranks[n] += times
            offset += n
        base += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def _place(batches: Iterator[pa.RecordBatch], table: tuple) -> Iterator[pa.RecordBatch]:
    keys, ranks, bases, offsets = table
    for b in batches:
        length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(keys, length << 40 | rank, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(bases[at] + rank - ranks[at], pa.int64()), pa.array(offsets[at], pa.int64())],
            names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_documents(docs: DataFrame, path: str, end_id: int, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    tune(docs.sparkSession)
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text"))
    pieces = materialise(rows.mapInArrow(partial(_cut, path=path, end_id=end_id, limit=limit), _PIECE_DDL), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # as many rows for a length as there are parts; a part's pieces of a length are numbered already
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("part", "length", "before")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _table(plan(histogram, limit))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.mapInArrow(partial(_place, table=table), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
