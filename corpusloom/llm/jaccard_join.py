"""Similarity self-join of shingle sets by a grouped prefix join.

Two sets can only reach the threshold if their prefixes, under one global order
of shingles, share one.  The order goes by the rarest word of a shingle, by word
counts over all documents in a fixed number of hashed counters; any order gives
the same links, a better one fewer candidates.  Equal sets make a class.  Classes
of equal prefix and size make a group, and groups are joined on the shingles of
their prefixes.

Only the components of the link graph are asked for, so candidates come in three
steps.  First every group of a bucket is paired with the bucket's first group of
about its size and with its neighbour.  Then, in buckets that still hold several
components, each group is paired with the one of another component whose bitmap is
nearest; both steps are linear in the bucket.  Last, all groups of different
components are paired where size, position and bitmap filters allow a link; none
of them drops one.  Group pairs are expanded to classes, filtered by the classes'
own bitmaps and verified on whole texts.  A bucket above ``BUCKET_ROWS`` is cut into blocks
whose pairs go to different tasks.

Defined cases: a null text is empty and linked with nothing; texts with fewer
words than a shingle have one shingle; equal sets are linked; repeated rows are
linked, and rows of one identifier with different texts are apart; a null
identifier stays null and never names a component that has another; an empty
table gives an empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, drop_table, materialise, partitions, tune
from .components import connected_components
from .shingles import shingle_set, text_shingles, word_prints

#: Hashed word counters, as a power of two, and the blocks in which they are summed.
COUNTER_BITS, BLOCKS = 22, 64
#: 64-bit words of the parity bitmap of a set.
BITMAP_WORDS = 8
#: Members that one copy of a hub is compared with in one task.
HUB_MEMBERS = 256
#: Rows of a bucket that one task pairs at once, and up to which a bucket is paired by offsets.
BUCKET_ROWS, SMALL_BUCKET = 20_000, 32

_BITS = [f"b{i}" for i in range(BITMAP_WORDS)]
_NODE = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("gid", pa.int64()), ("prefix", pa.binary()), *((b, pa.int64()) for b in _BITS)])
_NODE_DDL = ", ".join(f"{f.name} {'binary' if f.name == 'prefix' else 'long'}" for f in _NODE)


# -- the global order -------------------------------------------------------------


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNTER_BITS, np.uint32)
    some = False
    for b in batches:
        words, _ = word_prints(b.column(0).to_pylist())
        if len(words):
            some = True
            np.add.at(total, (words >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), np.uint32(1))
    if some:
        parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(BLOCKS, -1)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "counts": pa.array(parts, pa.binary())})


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks as they stream by, in order of block."""
    now, total = None, None
    out = lambda: pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})
    for b in batches:
        for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if block != now:
                if now is not None:
                    yield out()
                now, total = block, np.zeros((1 << COUNTER_BITS) // BLOCKS, np.uint64)
            total += np.frombuffer(zlib.decompress(raw), np.uint32)
    if now is not None:
        yield out()


def commonness(texts: DataFrame) -> np.ndarray:
    """For each counter, how common its words are, on a logarithmic scale of one byte.

    The size is fixed, so the driver and the broadcast get as much from any table.
    """
    parts = texts.mapInArrow(_counts, "block int, counts binary")
    parts = parts.repartition(BLOCKS, "block").sortWithinPartitions("block").mapInArrow(_sum, "block int, counts binary")
    out = np.zeros((BLOCKS, (1 << COUNTER_BITS) // BLOCKS), np.uint64)
    for r in parts.collect():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return np.minimum(255, 8 * np.log2(1 + out.ravel().astype(float))).astype(np.uint8)


# -- sets, groups, buckets --------------------------------------------------------


def prefix_length(n: int, percent: int) -> int:
    """Shingles at the head of a set of ``n`` of which a similar set must have one."""
    return n - -(-percent * n // 100) + 1


def _nodes(batches: Iterator[pa.RecordBatch], common, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    weight = lambda words: common.value[(words >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    for b in batches:
        rows = []
        for i, h, (s, least) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_shingles(b.column(2).to_pylist(), width, weight)):
            n = len(s)
            if not n:
                rows.append((i, h, 0, *(None,) * (len(_NODE) - 3)))
                continue
            head = s[np.argsort(least, kind="stable")[: prefix_length(n, percent)]].tobytes()
            bits = (np.bincount((s & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1).astype(np.uint8)
            key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist()
            group = int.from_bytes(hashlib.blake2b(n.to_bytes(8, "little") + head, digest_size=8).digest(), "little", signed=True)
            rows.append((i, h, n, *key, group, head, *np.packbits(bits).view("<i8").tolist()))
        columns = list(zip(*rows)) if rows else [[]] * len(_NODE)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], schema=_NODE)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the groups' prefixes."""
    for b in batches:
        heads = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
        size = np.array([len(h) for h in heads], np.int64)
        if not size.sum():
            continue
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(heads)), pa.array(np.repeat(b.column("gid").to_numpy(), size)), pa.array(np.repeat(b.column("n").to_numpy(), size).astype(np.int32)), pa.array(at.astype(np.int32))],
            names=["token", "gid", "n", "at"],
        )


_BUCKET_DDL = "token long, gid long, n int, at int, hub long, near long"
_BUCKET = ["token", "gid", "n", "at", "hub", "near"]


def _buckets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and size: those with another of fitting size in their bucket, each with
    the first group of its size class and with its neighbour.

    Sizes of one class differ by less than the threshold allows.  Only the last row and its hub are
    held from batch to batch, so a bucket of any size streams by.
    """
    step = np.log(100 / percent) if percent < 100 else 1e-9
    held = None  # (token, gid, n, at), hub, near, fits

    def give(t, g, n, at, hub, near, use):
        out = [pa.array(t[use]), pa.array(g[use]), pa.array(n[use].astype(np.int32)), pa.array(at[use].astype(np.int32))]
        out += [pa.array(x[use], mask=(x == g)[use]) for x in (hub, near)]
        return pa.RecordBatch.from_arrays(out, names=_BUCKET)

    for b in batches:
        if not b.num_rows:
            continue
        t, g, n, at = (b.column(c).to_numpy().astype(np.int64) for c in _BUCKET[:4])
        if held is not None:
            t, g, n, at = (np.append(x, y) for x, y in zip(held[0], (t, g, n, at)))
        fits = (t[1:] == t[:-1]) & (100 * n[:-1] >= percent * n[1:])
        size = np.floor(np.log(np.maximum(n, 1)) / step)
        start = np.ones(len(t), bool)
        start[1:] = (t[1:] != t[:-1]) | (size[1:] != size[:-1])
        own = g.copy()
        if held is not None:
            own[0] = held[1]
        hub = own[np.maximum.accumulate(np.where(start, np.arange(len(t)), 0))]
        near = g.copy()
        near[1:] = np.where(fits, g[:-1], g[1:])
        before = np.append(held is not None and held[3], fits)
        if held is not None:
            near[0] = held[2]
        use = before[:-1] | fits
        if use.any():
            yield give(t[:-1], g[:-1], n[:-1], at[:-1], hub[:-1], near[:-1], use)
        held = (tuple(x[-1:] for x in (t, g, n, at)), hub[-1], near[-1], bool(before[-1]))
    if held is not None and held[3]:
        yield give(*held[0], *(np.array([x]) for x in held[1:3]), np.ones(1, bool))


# -- pairs across components ------------------------------------------------------


_SIDE = ["token", "cell", "blk", "key", "n", "at", "lo", "hi", "single", *_BITS]


def _may_link(n1, at1, n2, at2, percent: int) -> np.ndarray:
    """Size and position: with the shared shingle as their first, the sets can still reach the threshold."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (100 * small >= percent * large) & ((100 + percent) * np.minimum(n1 - at1, n2 - at2) >= percent * (n1 + n2))


def _nearest(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the closest of their i, or of their j."""
    order = np.argsort(apart, kind="stable")
    return np.union1d(*(order[np.unique(x[order], return_index=True)[1]] for x in (i, j)))


def _across(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, cell and size: pairs of a bucket's keys that are not in one component;
    with ``nearest`` the closest one of each key alone."""

    def settled(lo, hi, i, j):
        return (lo[i] == hi[i]) & (lo[j] == hi[j]) & (lo[i] == lo[j])

    def checked(c, bits, i, j):
        """The pairs among rows i and j that pass every filter."""
        n, at, lo, hi = (c[x] for x in ("n", "at", "lo", "hi"))
        ok = ~settled(lo, hi, i, j) & _may_link(n[i], at[i], n[j], at[j], percent) & (c["key"][i] != c["key"][j])
        ok &= (c["blk"][i] != c["blk"][j]) == c["mixed"][i]
        i, j = i[ok], j[ok]
        # |A xor B| = |A| + |B| - 2 |A and B|, and each shingle of it flips one bit at most
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = ~(c["single"][i] & c["single"][j]) | (apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent))
        return i[ok], j[ok], apart[ok]

    def pairs(c, bits):
        key = c["token"] ^ c["cell"] << 40
        new = np.append(True, (c["token"][1:] != c["token"][:-1]) | (c["cell"][1:] != c["cell"][:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        found = []
        small = np.repeat(size <= SMALL_BUCKET, size)
        end = np.repeat(first + size, size)
        i = np.flatnonzero(small)
        for d in range(1, SMALL_BUCKET):
            i = i[i + d < end[i]]
            if not len(i):
                break
            found.append(checked(c, bits, i, i + d))
        for a, m in zip(first[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist()):
            lo, hi, n = c["lo"][a : a + m], c["hi"][a : a + m], c["n"][a : a + m]
            known, many = np.unique(lo[lo == hi], return_counts=True)
            most = known[many.argmax()] if len(known) else None
            outside = (lo != hi) | (lo != most) if most is not None else np.ones(m, bool)
            for k in np.flatnonzero(outside).tolist():
                x, y = np.searchsorted(n, [-(-percent * n[k] // 100), 100 * n[k] // percent + 1])
                j = np.arange(x, y)
                j = j[j != k] if nearest else j[~outside[j] | (j > k)]
                if not len(j):
                    continue
                some = checked(c, bits, np.full(len(j), a + k), a + j)
                if nearest and len(some[2]):
                    best = int(some[2].argmin())
                    some = tuple(x[best : best + 1] for x in some)
                found.append(some)
        if not found:
            return
        i, j, apart = (np.concatenate(x) for x in zip(*found))
        if nearest:
            use = _nearest(i, j, apart)
            i, j = i[use], j[use]
        if len(i):
            u, v = c["key"][i], c["key"][j]
            both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    held: dict[str, list[np.ndarray]] = {x: [] for x in _SIDE}
    rows = 0

    def split(last: bool):
        """The complete buckets of what is held; the bucket at the end waits."""
        nonlocal held, rows
        c = {x: np.concatenate(v) for x, v in held.items()}
        cut = len(c["token"])
        if not last:
            cut = int(np.flatnonzero((c["token"] != c["token"][-1]) | (c["cell"] != c["cell"][-1]))[-1:].sum() + 1) if ((c["token"] != c["token"][-1]) | (c["cell"] != c["cell"][-1])).any() else 0
        held = {x: [v[cut:]] for x, v in c.items()}
        rows = len(held["token"][0])
        c = {x: v[:cut] for x, v in c.items()}
        c["mixed"] = c["cell"] >> 20 != c["cell"] & 0xFFFFF
        return c, np.stack([c[b] for b in _BITS], 1).view(np.uint64)

    for b in batches:
        if not b.num_rows:
            continue
        for x in _SIDE:
            held[x].append(b.column(x).to_numpy(zero_copy_only=False).astype(bool if x == "single" else np.int64))
        rows += b.num_rows
        if rows >= BUCKET_ROWS:
            yield from pairs(*split(False))
    if rows:
        yield from pairs(*split(True))


def unsettled_pairs(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Distinct (a, b) keys of rows (token, key, n, at, lo, hi, single, bits) that share a token, may be
    linked and are not known to be in one component; with ``nearest`` a bounded number for each row."""
    spark = rows.sparkSession
    buckets = rows.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("u"), F.count(F.lit(1)).alias("m")).where("l < u").select("token", F.ceil(F.col("m") / BUCKET_ROWS).alias("blocks"))
    rows = rows.join(buckets, "token").withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blocks")))
    # block i meets block j in cell (i, j) with i <= j
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.shiftleft(F.least(j, F.col("blk")), 20).bitwiseOR(F.greatest(j, F.col("blk"))))
    rows = rows.withColumn("cell", F.explode(cells)).select(*_SIDE)
    dealt = rows.repartition(partitions(spark), "token", "cell").sortWithinPartitions("token", "cell", "n")
    return dealt.mapInArrow(partial(_across, percent=percent, nearest=nearest), "a long, b long").distinct()


# -- verification -----------------------------------------------------------------


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hub, copy and role: hub first, then the members to compare with it."""
    now, own = None, None
    for b in batches:
        u, v = [], []
        for hub, copy, member, node, text in zip(*(b.column(c).to_pylist() for c in ("hub", "copy", "member", "node", "text"))):
            if not member:
                if now != (hub, copy):
                    now, own = (hub, copy), shingle_set(text, width)
            elif now == (hub, copy) and similar(own, shingle_set(text, width), percent):
                u.append(hub)
                v.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _bits_of(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), *(F.col(b).alias(f"{b}_{name}") for b in _BITS))


def bitmap_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs of classes that size and bitmap don't rule out."""
    pairs = pairs.join(_bits_of(classes, "a"), "a").join(_bits_of(classes, "b"), "b")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in _BITS])
    small, large, total = F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), F.col("n_a") + F.col("n_b")
    return pairs.where((100 * small >= percent * large) & (apart * (100 + percent) <= total * (100 - percent))).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (u, v) of distinct (a, b) pairs of classes that reach the threshold on whole texts."""
    spark = pairs.sparkSession
    pairs = pairs.withColumn("copy", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_MEMBERS).alias("copies"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod("copy", "copies").alias("copy"))
    asked = dealt.select(F.col("a").alias("hub"), "copy", F.lit(True).alias("member"), F.col("b").alias("node")).union(
        dealt.select(F.col("a").alias("hub"), "copy", F.lit(False), F.col("a").alias("node")).distinct()
    )
    rows = asked.join(texts, "node").select("hub", "copy", "member", "node", "text")
    rows = rows.repartition(partitions(spark), "hub", "copy").sortWithinPartitions("hub", "copy", "member")
    return rows.mapInArrow(partial(_verify, width=width, percent=percent), "u long, v long")


def _open_pairs(buckets: DataFrame, named: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Distinct (a, b) classes of ``named`` whose groups share a bucket, or that share a group, and that
    are in different components."""
    groups = named.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("many"), *(F.first(b).alias(b) for b in _BITS))
    here = buckets.select("token", "gid", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at")).join(groups, "gid")
    here = here.select("token", F.col("gid").alias("key"), "n", "at", "lo", "hi", (F.col("many") == 1).alias("single"), *_BITS)
    pairs = unsettled_pairs(here, percent, nearest).select(F.col("a").alias("x"), F.col("b").alias("y"))
    inside = named.join(groups.where("lo < hi").select("gid"), "gid", "left_semi").select(
        F.xxhash64("gid", F.lit("group")).alias("token"), F.col("cid").alias("key"), "n", F.lit(0).cast("long").alias("at"), F.col("component").alias("lo"), F.col("component").alias("hi"), F.lit(True).alias("single"), *_BITS
    )
    side = lambda gid, out: named.select(F.col("gid").alias(gid), F.col("cid").alias(out), F.col("component").alias(f"c_{out}"))
    expanded = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").where("c_a <> c_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return expanded.union(unsettled_pairs(inside, percent, nearest)).distinct()


def _digest(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _own_texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the classes whose cid is ``wanted``."""
    keys = nodes.where("n > 0").join(wanted, nodes["rid"] == wanted["cid"], "left_semi").select(F.col("rid").alias("node"), F.col("id").alias("own"), "h")
    rows = docs.withColumn("h", _digest(F.col("text")))
    return rows.join(keys, (rows["h"] == keys["h"]) & rows["id"].eqNullSafe(keys["own"])).select("node", "text").dropDuplicates(["node"])


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_shingles, text_hash, class_id (smallest id of its equal sets), component_id
    (smallest id of its component), stays (of the component, and of its rows, this one stays; rows that
    repeat identifier and text have one value)."""
    spark = tune(docs.sparkSession)
    n_parts = partitions(spark)
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(commonness(rows.select("text")))
    made = rows.select("id", _digest(F.col("text")).alias("h"), "text").mapInArrow(partial(_nodes, common=common, width=width, percent=percent), _NODE_DDL)
    nodes = materialise(made.withColumn("rid", F.monotonically_increasing_id()), "shingle-sets")
    sets = nodes.where("n > 0")
    # a class is known by the least row number of its equal sets
    classes = materialise(sets.groupBy("k1", "k2").agg(F.min("rid").alias("cid"), F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("n", "gid", *_BITS))), "classes")
    heads = classes.groupBy("gid").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("many"))
    tokens = sets.select("gid", "n", "prefix").dropDuplicates(["gid"]).mapInArrow(_tokens, "token long, gid long, n int, at int")
    buckets = materialise(tokens.repartition(n_parts, "token").sortWithinPartitions("token", "n", "gid").mapInArrow(partial(_buckets, percent=percent), _BUCKET_DDL), "buckets")

    # first every group with the first of its size in a bucket, its neighbour, and each class with its group's head
    near = buckets.select(F.explode(F.array("hub", "near")).alias("x"), F.col("gid").alias("y")).where("x is not null").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    first_of = lambda name, out: heads.select(F.col("gid").alias(name), F.col("head").alias(out))
    near = near.join(first_of("x", "a"), "x").join(first_of("y", "b"), "y").select("a", "b")
    within = classes.join(heads.where("many > 1"), "gid").where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b"))
    stars = materialise(bitmap_filter(near.union(within), classes, percent), "stars")
    in_buckets = buckets.select("gid").distinct().union(heads.where("many > 1").select("gid")).distinct()
    members = materialise(classes.join(in_buckets, "gid", "left_semi"), "members")
    texts = materialise(_own_texts(rows, nodes, members.select("cid")), "candidates")
    links = materialise(verified(stars, texts, width, percent), "links")
    drop_table(stars)

    # then whatever may be linked and is in different components
    for nearest in (True, False):
        known = materialise(connected_components(links).select(F.col("node").alias("cid"), "component"), "components")
        named = members.join(known, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        rest = materialise(bitmap_filter(_open_pairs(buckets, named, percent, nearest), classes, percent), "pairs")
        more = materialise(links.union(verified(rest, texts, width, percent)), "links")
        drop_table(rest, links, known)
        links = more
    final = materialise(connected_components(links).select(F.col("node").alias("cid"), "component"), "labels")
    drop_table(buckets, members, texts, links)

    # ids of components, and the one row of each that stays
    whole = classes.select("cid", "k1", "k2", "least").join(final, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "cid"))["cid"].alias("first"))
    final_of = whole.join(least, "component").select("k1", "k2", "component_id", F.col("least").alias("class_id"), "cid", "first")
    out = sets.select("id", "n", "h", "rid", "k1", "k2").join(final_of, ["k1", "k2"])
    # of the class that stays, the row of the smallest identifier
    lead = out.where((F.col("cid") == F.col("first")) & F.col("id").eqNullSafe(F.col("class_id"))).groupBy("cid").agg(F.min("h").alias("lead"))
    out = out.join(lead, "cid", "left")
    stays = (F.col("cid") == F.col("first")) & F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("lead"))
    out = out.select("id", "n", "h", "class_id", "component_id", F.coalesce(stays, F.lit(False)).alias("stays"))
    none = nodes.where("n = 0").select("id", "n", "h", F.col("id").alias("class_id"), F.col("id").alias("component_id"), F.lit(True).alias("stays"))
    return out.union(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("h").alias("text_hash"), "class_id", "component_id", "stays")
