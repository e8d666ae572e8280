"""Density clusters of groups of any size, from a neighbour graph.

Equal vectors count as one with its copies.  The nearest neighbours of every vector
are looked for in cells around pivots, in blocks, so no group meets itself whole.
The minimum spanning tree over mutual reachability grows by Boruvka rounds, in which
every component takes its lightest edge if its rows' lists of neighbours prove it
the lightest; else the components' closest rows are found in blocks that a ball
bound lets through.  So the tree is exact if the lists are.  The tree's edges, in order of weight, are
cut into bands.  Bands learn in halves which rows the lighter edges have joined
already; then one pass up the bands sums each condensed cluster's mass and settles
which clusters are worth more than their parts, and one pass down hands labels to
the rows.  A task holds a band's edges of one group, never a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from .align import numbered
from .tables import Shelf

#: Rows of a block; edges that one task takes; pivots of all groups together; parts of a group that all meet.
BLOCK, EDGES, PIVOTS, PARTS = 4_096, 1_000_000, 65_536, 1_000
FAR = 1e-12


def spread_out(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows as the metric sees them: of unit length under cosine."""
    if metric == "euclidean":
        return x
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Between all rows of x and y, which are ``spread_out``."""
    if metric == "cosine":
        return 1 - x @ y.T
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Between rows of x and y at the same place, to 12 digits."""
    d = 1 - np.einsum("ij,ij->i", x, y) if metric == "cosine" else np.linalg.norm(x - y, axis=1)
    return np.round(d, 12) + 0.0


def _none(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})


def _anew(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that ``df`` can meet a table it shares its origin with."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _matrix(column: pd.Series, metric: str) -> np.ndarray:
    return spread_out(np.array(column.tolist(), float), metric)


# -- neighbours -------------------------------------------------------------------


def pivots_of(rows: DataFrame, sizes: dict[str, int], metric: str) -> dict[str, np.ndarray]:
    """Rows of each group around which its cells lie: about the root of its size, ``PIVOTS`` over all groups."""
    most = max(1, PIVOTS // max(1, len(sizes)))
    share = F.lit(1)
    for g, n in sizes.items():
        share = F.when(F.col("_group") == g, F.lit(max(1, n // max(1, min(math.isqrt(n), most))))).otherwise(share)
    found = rows.where(F.pmod(F.xxhash64("_key", F.lit("pivot")), share) == 0).select("_group", "_v").toArrow()  # flat numbers, no objects
    names, vectors = found["_group"].to_numpy(), found["_v"].combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1).astype(float) if len(names) else np.zeros((0, 1))
    return {g: spread_out(flat[names == g], metric) for g in set(names)}


def neighbours(rows: DataFrame, sizes: dict[str, int], k: int, metric: str = "cosine", probes: int = 8, asking: DataFrame | None = None) -> DataFrame:
    """(_group, a, n, d): about the ``k`` nearest rows n of each row a in its group, a itself left out; or of
    each row a of another table ``asking``.

    The tables have _key, _group, _v.  A row is looked for in the cells of the ``probes`` pivots nearest to
    the asking row; a cell is dealt into blocks, so its size doesn't matter.  Cells are found once, and the table
    of their blocks, no longer than there are pivots, goes to every task, so vectors are shuffled once for a cell.
    A row is looked for in its first cell before the others, which then list only what is as near as the ``k``-th there;
    lists are shuffled whole.  Vectors stay floats if they are.
    """
    alone = asking is None
    spark, kind = rows.sparkSession, dict(rows.dtypes)["_key"]
    pivots = spark.sparkContext.broadcast(pivots_of(rows, sizes, metric))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.empty(len(pdf), object)
            for g, at in pdf.groupby("_group").indices.items():
                p = pivots.value.get(g)
                if p is None or len(p) <= 1:
                    out[at] = [[0]] * len(at)
                    continue
                x = _matrix(pdf["_v"].iloc[at], metric)
                for start in range(0, len(at), 1024):
                    d = distances(x[start : start + 1024], p, metric)
                    near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                    for i, c in zip(at[start : start + 1024], near.tolist()):
                        out[i] = c
            yield pdf.assign(_cells=out)

    shelf = Shelf(spark, "cells")
    celled = lambda df: shelf.keep(df.select("_key", "_group", "_v").mapInPandas(cells, f"_key {dict(df.dtypes)['_key']}, _group string, _v {dict(df.dtypes)['_v']}, _cells array<int>"))
    placed = celled(rows)
    home = placed.select("_key", "_group", "_v", F.get("_cells", F.lit(0)).alias("_cell"))
    asked_kind = kind if alone else dict(asking.dtypes)["_key"]
    asking = placed if alone else celled(asking)
    held = home.groupBy("_group", "_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_held"))
    own = lambda n: F.pmod(F.xxhash64("_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def looked(asking: DataFrame) -> DataFrame:
        """Lists of the nearest rows in the block that a row of ``asking`` (_key, _group, _v, _bound, _cell) meets."""
        asked = asking.groupBy("_group", "_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_asked"))
        blocks = F.broadcast(shelf.keep(held.join(asked, ["_group", "_cell"])))
        left = asking.join(blocks, ["_group", "_cell"]).select("_group", "_cell", "_key", "_v", "_bound", own("_asked").alias("_i"), every("_held").alias("_j"))
        right = home.join(blocks, ["_group", "_cell"]).select("_group", "_cell", "_key", "_v", own("_held").alias("_j"), every("_asked").alias("_i"))
        met = left.groupBy("_group", "_cell", "_i", "_j").cogroup(_anew(right).groupBy("_group", "_cell", "_i", "_j"))
        return shelf.keep(met.applyInArrow(nearest, f"_group string, a {asked_kind}, n array<{kind}>, d array<double>"))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("_key")
        askers, keys, bound = a["_key"].combine_chunks(), b["_key"].combine_chunks(), a["_bound"].to_numpy()
        parts, far, near = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, int)]
        if len(a) and len(b):
            x, y = (spread_out(t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1).astype(float), metric) for t in (a, b))
            itself = pc.index_in(askers, keys).fill_null(-1).to_numpy(zero_copy_only=False) if alone else np.full(len(a), -1)
            for at in range(0, len(x), 256):
                d = distances(x[at : at + 256], y, metric)
                own = itself[at : at + 256]
                d[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
                take = min(k, d.shape[1])
                best = np.argpartition(d, take - 1, axis=1)[:, :take]
                i, j = np.repeat(np.arange(len(best)), take), best.ravel()
                good = np.isfinite(d[i, j])
                i, j = i[good] + at, j[good]
                e = exact(x[i], y[j], metric)
                good = e <= bound[i]
                parts.append(i[good])
                near.append(j[good])
                far.append(e[good])
        i, n, d = (np.concatenate(c) for c in (parts, near, far))
        rows, counts = np.unique(i, return_counts=True)
        ends = pa.array(np.r_[0, np.cumsum(counts)].astype("int32"))
        return pa.table({"_group": pa.array([a["_group"][0].as_py()] * len(rows) if len(a) else [], pa.string()), "a": askers.take(pa.array(rows)), "n": pa.ListArray.from_arrays(ends, keys.take(pa.array(n))), "d": pa.ListArray.from_arrays(ends, pa.array(d))})

    found = looked(asking.select("_key", "_group", "_v", F.lit(math.inf).alias("_bound"), F.get("_cells", F.lit(0)).alias("_cell")))
    if probes > 1:
        full = F.when(F.size("d") >= k, F.array_max("d"))
        bounds = found.groupBy(F.col("a").alias("_key")).agg(F.min(full).alias("_bound"))
        others = asking.where(F.size("_cells") > 1).join(_anew(bounds), "_key", "left")
        more = others.select("_key", "_group", "_v", F.coalesce("_bound", F.lit(math.inf)).alias("_bound"), F.explode(F.slice("_cells", 2, probes)).alias("_cell"))
        found = found.unionByName(looked(more))
    shelf.drop(placed, *([] if alone else [asking]))  # vectors aren't needed any more
    lists = found.groupBy("_group", "a").agg(F.flatten(F.collect_list(F.arrays_zip("d", "n"))).alias("_l"))
    best = lists.select("_group", "a", F.inline(F.slice(F.array_sort("_l"), 1, k)))
    return best.select("_group", "a", "n", "d")


def recall(found: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", every: int = 50) -> float:
    """The share of the true ``k`` nearest rows that ``found`` has, by brute force for one row in ``every`` by hash."""
    asked = rows.where(F.pmod(F.xxhash64("_key", F.lit("recall")), F.lit(every)) == 0)
    x = asked.select(F.col("_key").alias("a"), "_group", F.col("_v").alias("_a"))
    pairs = x.join(rows.select(F.col("_key").alias("n"), "_group", "_v"), "_group").where("a <> n")
    d = 1 - V.cosine_similarity(F.col("_a"), F.col("_v")) if metric == "cosine" else V.norm(F.zip_with("_a", "_v", lambda p, q: p - q))
    true = pairs.select("a", "n", F.round(d, 9).alias("d")).withColumn("_rank", F.row_number().over(Window.partitionBy("a").orderBy("d", "n"))).where(F.col("_rank") <= k)
    limit = true.groupBy("a").agg(F.max("d").alias("_limit"), F.count(F.lit(1)).alias("_k"))
    # a neighbour as near as the last true one counts, whatever its name
    got = found.join(limit, "a").where(F.col("d") <= F.col("_limit") + 1e-9).groupBy("a").agg(F.count(F.lit(1)).alias("_got"), F.first("_k").alias("_k"))
    all_k = limit.agg(F.sum("_k")).first()[0]
    return (got.agg(F.sum(F.least("_got", "_k"))).first()[0] or 0) / all_k if all_k else 1.0


# -- spanning tree ----------------------------------------------------------------


def _sure_picks(edges: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """Boruvka rounds over a group's edges for as long as a component's lightest edge is surely the lightest.

    An edge row is in the list of the row p, whose unlisted edges weigh ``far`` at least; u and v are the
    components of its ends.  A component's bound is the least ``far`` of its rows whose lists lie inside it.
    """
    if not len(edges):
        return _none("_group", "u", "v", "w", "a", "b")
    edges = edges.sort_values(["w", "a", "b"])
    ends = np.concatenate([edges["u"], edges["v"]])
    names, at = np.unique(ends, return_inverse=True)
    u, v = at[: len(edges)], at[len(edges) :]
    w, far = edges["w"].to_numpy(), edges["far"].to_numpy()
    p = np.unique(edges["p"], return_inverse=True)[1]
    bound = np.full(len(names), np.inf)
    if len(bounds):
        known = bounds[bounds["u"].isin(names)]
        np.minimum.at(bound, np.searchsorted(names, known["u"].to_numpy()), known["far"].to_numpy())
    rows, picked = np.arange(len(edges)), []
    while len(rows):
        first = np.full(len(bound), len(w))
        np.minimum.at(first, u[rows], rows)  # rows are in order of weight
        np.minimum.at(first, v[rows], rows)
        able = np.flatnonzero(first < len(w))
        sure = able[w[first[able]] <= bound[able]]
        if not len(sure):
            break
        take = np.unique(first[sure])
        picked.append(take)
        low = _lowest(u[take], v[take], np.arange(len(bound)))
        np.minimum.at(bound, low, bound.copy())
        was, u, v = p[rows], low[u], low[v]
        inside = u[rows] == v[rows]
        still = np.zeros(p.max() + 1, bool)
        still[p[rows[~inside]]] = True
        closed = rows[~still[was]]  # lists that lie inside now
        np.minimum.at(bound, u[closed], far[closed])
        rows = rows[~inside]
    take = np.concatenate(picked) if picked else np.zeros(0, int)
    return pd.DataFrame({c: edges[c].to_numpy()[take] for c in ("_group", "u", "v", "w", "a", "b")})


def _lowest(a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches over the links a, b."""
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return low
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, low[low]):
            low = low[low]


def _components(links: DataFrame, shelf: Shelf, by: list[str]) -> DataFrame:
    """(by, node, low): the smallest node reachable over links (by, u, v); by hooking to the smallest
    neighbour's label and jumping, until nothing changes."""
    both = shelf.keep(links.select(*by, "u", "v").union(links.select(*by, F.col("v"), F.col("u"))).distinct())
    labels = shelf.keep(both.groupBy(*by, F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("low")))
    while True:
        named = labels.select(*by, F.col("node").alias("v"), F.col("low").alias("_near"))
        near = both.join(named, [*by, "v"]).groupBy(*by, F.col("u").alias("node")).agg(F.min("_near").alias("_near"))
        lower = labels.join(near, [*by, "node"]).select(*by, "node", F.col("low").alias("_was"), F.least("low", "_near").alias("_low"))
        jump = labels.select(*by, F.col("node").alias("_low"), F.col("low").alias("_next"))
        new = shelf.keep(lower.join(jump, [*by, "_low"]).select(*by, "node", "_was", F.least("_low", "_next").alias("low")))
        done = new.where("low <> _was").isEmpty()
        shelf.drop(labels)
        labels = new.select(*by, "node", "low")
        if done:
            shelf.drop(both)
            return labels


def spanning_tree(rows: DataFrame, lists: DataFrame, core: DataFrame, metric: str, shelf: Shelf, most: int | None = None) -> DataFrame:
    """(_group, w, a, b): the minimum spanning tree of each group, under the order (w, a, b).

    ``lists`` has (_group, p, n, w, far): the edges that each row lists, and what those that it doesn't list weigh
    at least.  Every Boruvka round lets the components pick their lightest edge whose rows' lists prove it to be
    the lightest; where none can, the closest rows of the components are searched for.  Groups of at most ``most``
    edges run their rounds in a task, larger ones as joins.
    """
    most, kind = most or EDGES, dict(lists.dtypes)["p"]
    left = shelf.keep(lists.select("_group", "p", F.least("p", "n").alias("a"), F.greatest("p", "n").alias("b"), "w", "far", F.col("p").alias("u"), F.col("n").alias("v")))
    bounds = shelf.keep(left.select("_group", "u", "far").limit(0))
    labels = shelf.keep(rows.select("_group", F.col("_key").alias("node"), F.col("_key").alias("low")))
    kept: list[DataFrame] = []
    schema = f"_group string, u {kind}, v {kind}, w double, a {kind}, b {kind}"
    while True:
        if left.groupBy("_group").count().where(F.col("count") > most).isEmpty():
            picks = left.groupBy("_group").cogroup(_anew(bounds).groupBy("_group")).applyInPandas(_sure_picks, schema)
        else:
            edge = F.struct("w", "a", "b").alias("_e")
            ends = left.select("_group", "u", "v", edge).union(left.select("_group", F.col("v").alias("u"), F.col("u").alias("v"), edge))
            best = ends.groupBy("_group", "u").agg(F.min_by("v", "_e").alias("v"), F.min("_e").alias("_e")).join(bounds, ["_group", "u"], "left")
            picks = best.where(F.col("far").isNull() | (F.col("_e")["w"] <= F.col("far"))).select("_group", "u", "v", "_e.*")
        picks = shelf.keep(picks)
        if picks.isEmpty():
            apart = labels.groupBy("_group").agg(F.count_distinct("low").alias("_parts")).where("_parts > 1").select("_group")
            if apart.isEmpty():
                break
            both = left.select("u", "w").union(left.select("v", "w"))
            limits = both.groupBy(F.col("u").alias("_part")).agg(F.min("w").alias("_known"))
            picks = _closest_links(rows.join(apart, "_group", "left_semi"), labels, core, limits, metric, shelf)
        kept.append(picks.select("_group", "w", "a", "b").distinct())
        low = _components(picks, shelf, ["_group"])
        old = [left, bounds, labels]
        to = lambda c: low.select("_group", F.col("node").alias(c), F.col("low").alias(f"_{c}"))
        named = left.join(to("u"), ["_group", "u"], "left").join(to("v"), ["_group", "v"], "left")
        moved = shelf.keep(named.select("_group", "p", "a", "b", "w", "far", F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")))
        open_ = moved.where("u <> v")
        closed = moved.join(open_.select("p").distinct(), "p", "left_anti").select("_group", "u", "far")
        held = bounds.join(to("u"), ["_group", "u"], "left").select("_group", F.coalesce("_u", "u").alias("u"), "far").union(closed)
        bounds = shelf.keep(held.groupBy("_group", "u").agg(F.min("far").alias("far")))
        labels = shelf.keep(labels.join(low.select("_group", F.col("node").alias("low"), F.col("low").alias("_to")), ["_group", "low"], "left").select("_group", "node", F.coalesce("_to", "low").alias("low")))
        left = shelf.keep(open_)
        shelf.drop(*old, moved, low)
    out = rows.select("_group", F.lit(0.0).alias("w"), F.col("_key").alias("a"), F.col("_key").alias("b")).limit(0)
    for more in kept:
        out = out.union(more)
    return shelf.keep(out)


def _closest_links(rows: DataFrame, parts: DataFrame, core: DataFrame, limits: DataFrame, metric: str, shelf: Shelf) -> DataFrame:
    """(_group, u, v, w, a, b): for each part of a group, the lightest edge to a row outside it.

    Rows of a part lie in blocks with a centre and a radius; two blocks meet only if their balls come as near
    as a link that is known to exist.  Balls are measured as straight-line distances, which order as cosine does.
    Of a group of more than ``PARTS`` parts only those of the nearest centres meet; the others wait for the next
    round, when there are at most half as many parts.
    """
    kind = dict(rows.dtypes)["_key"]
    held = rows.join(parts.select(F.col("node").alias("_key"), F.col("low").alias("_part")), "_key").join(core, "_key")
    sizes = held.groupBy("_group", "_part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    dealt = shelf.keep(held.join(sizes, ["_group", "_part"]).withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")).cast("int")).drop("_blocks"))

    def ball(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["_v"], metric)
        centre = x.mean(axis=0)
        return pd.DataFrame({"_group": [pdf["_group"].iloc[0]], "_part": [pdf["_part"].iloc[0]], "_block": [int(pdf["_block"].iloc[0])], "_centre": [centre.tolist()], "_radius": [float(np.linalg.norm(x - centre, axis=1).max())], "_core": [float(pdf["_core"].max())]})

    balls = shelf.keep(dealt.groupBy("_group", "_part", "_block").applyInPandas(ball, f"_group string, _part {kind}, _block int, _centre array<double>, _radius double, _core double"))
    x, y = balls, balls.select(*(F.col(c).alias(f"{c}2") for c in balls.columns))
    gap = V.norm(F.zip_with("_centre", "_centre2", lambda p, q: p - q))
    flat = lambda d: d * d / 2 if metric == "cosine" else d
    reach = F.col("_radius") + F.col("_radius2")
    counts = {r[0]: r[1] for r in balls.groupBy("_group").agg(F.count_distinct("_part")).where(F.col("count(DISTINCT _part)") > PARTS).collect()}
    many = F.col("_group").isin(list(counts)) if counts else F.lit(False)
    met = x.join(y, (F.col("_group") == F.col("_group2")) & (F.col("_part") != F.col("_part2")) & ~many)
    if counts:
        first = balls.where(F.col("_group").isin(list(counts)) & (F.col("_block") == 0))
        pairs = neighbours(first.select(F.col("_part").alias("_key"), "_group", F.col("_centre").alias("_v")), counts, 8, "euclidean")
        pairs = pairs.select("a", "n").union(pairs.select("n", "a")).distinct()
        met = met.union(x.join(pairs, F.col("_part") == F.col("a")).join(y, F.col("_part2") == F.col("n")).drop("a", "n"))
    bounds = met.select(
        "_group", "_part", "_block", "_part2", "_block2",
        flat(F.greatest(gap - reach, F.lit(0.0))).alias("_least"), F.greatest(flat(gap + reach), "_core", "_core2").alias("_most"),
    )
    bounds = shelf.keep(bounds)
    near = bounds.groupBy("_group", "_part").agg(F.min("_most").alias("_limit")).join(limits, "_part", "left").select("_group", "_part", F.least("_limit", "_known").alias("_limit"))
    open_ = bounds.join(near, ["_group", "_part"]).where(F.col("_least") <= F.col("_limit") + 1e-9)
    left = dealt.join(open_, ["_group", "_part", "_block"])
    other = dealt.select("_group", F.col("_part").alias("_part2"), F.col("_block").alias("_block2"), F.col("_key").alias("_key2"), F.col("_v").alias("_v2"), F.col("_core").alias("_core2"))
    right = other.join(open_.select("_group", "_part", "_block", "_part2", "_block2"), ["_group", "_part2", "_block2"])

    def link(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return _none("_group", "_part", "_part2", "w", "a", "b")
        x, y = _matrix(a["_v"], metric), _matrix(b["_v2"], metric)
        best = None
        for at in range(0, len(x), 256):
            w = np.maximum(np.maximum(distances(x[at : at + 256], y, metric), a["_core"].to_numpy()[at : at + 256, None]), b["_core2"].to_numpy()[None, :])
            i, j = np.nonzero(w <= w.min() + 1e-9)
            w = np.maximum(np.maximum(exact(x[i + at], y[j], metric), a["_core"].to_numpy()[i + at]), b["_core2"].to_numpy()[j])
            p, q = a["_key"].to_numpy()[i + at], b["_key2"].to_numpy()[j]
            here = min(zip(w.tolist(), *(np.minimum(p, q).tolist(), np.maximum(p, q).tolist())) if p.dtype.kind in "iuf" else ((d, *sorted(e)) for d, *e in zip(w.tolist(), p, q)))
            best = here if best is None else min(best, here)
        return pd.DataFrame([(a["_group"].iloc[0], a["_part"].iloc[0], b["_part2"].iloc[0], *best)], columns=["_group", "_part", "_part2", "w", "a", "b"])

    by = ["_group", "_part", "_block", "_part2", "_block2"]
    found = left.groupBy(*by).cogroup(_anew(right).groupBy(*by)).applyInPandas(link, f"_group string, _part {kind}, _part2 {kind}, w double, a {kind}, b {kind}")
    edge = F.struct("w", "a", "b")
    best = found.groupBy("_group", "_part").agg(F.min_by("_part2", edge).alias("v"), F.min(edge).alias("_e"))
    picks = shelf.keep(best.select("_group", F.col("_part").alias("u"), "v", "_e.*"))
    shelf.drop(dealt, balls, bounds)
    return picks


def density_tree(rows: DataFrame, shelf: Shelf, metric: str = "cosine", samples: int = 1, k: int = 16, probes: int = 8, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning tree (_group, w, a, b) of each group's mutual reachability, and (_key, _core).

    ``rows`` has _key, _group, _v; the copies of a vector hang on that of the smallest key.
    """
    k = max(k, samples)
    firsts = shelf.keep(rows.groupBy("_group", "_v").agg(F.min("_key").alias("_key"), F.count(F.lit(1)).alias("_copies")).select("_key", "_group", "_v", "_copies"))
    copies = rows.join(firsts.where("_copies > 1").select("_group", "_v", F.col("_key").alias("_first")), ["_group", "_v"]).where("_key <> _first").select("_group", F.col("_first").alias("a"), F.col("_key").alias("b"))
    sizes = {r[0]: r[1] for r in firsts.groupBy("_group").count().collect()}
    single = firsts.drop("_copies")
    near = shelf.keep(neighbours(single, sizes, k, metric, probes))
    weight = near.join(firsts.select(F.col("_key").alias("n"), F.col("_copies").alias("_c")), "n").join(firsts.select(F.col("_key").alias("a"), F.col("_copies").alias("_own")), "a")
    seen = weight.withColumn("_seen", F.col("_own") - 1 + F.sum("_c").over(Window.partitionBy("a").orderBy("d", "n")))
    core = seen.where((F.col("_seen") >= samples) & (F.col("_own") - 1 < samples)).groupBy(F.col("a").alias("_key")).agg(F.min("d").alias("_core"))
    core = shelf.keep(firsts.join(core, "_key", "left").select("_key", F.coalesce("_core", F.lit(0.0)).alias("_core")))
    at = lambda c: core.select(F.col("_key").alias(c), F.col("_core").alias(f"_{c}"))
    # a list as long as the group has all edges of its row
    ends = near.groupBy("a").agg(F.max("d").alias("_last"), F.count(F.lit(1)).alias("_listed"))
    every = F.lit(False)
    for g, n in sizes.items():
        every = every | ((F.col("_group") == g) & (F.col("_listed") == n - 1))
    lists = near.join(ends, "a").join(at("a"), "a").join(at("n"), "n").select(
        "_group", F.col("a").alias("p"), "n", F.greatest("d", "_a", "_n").alias("w"), F.when(every, F.lit(math.inf)).otherwise(F.greatest("_last", "_a")).alias("far")
    )
    tree = spanning_tree(single, lists, core, metric, shelf, most)
    stars = copies.join(core.select(F.col("_key").alias("a"), F.col("_core").alias("w")), "a").select("_group", "w", "a", "b")
    all_core = core.unionByName(copies.join(at("a"), "a").select(F.col("b").alias("_key"), F.col("_a").alias("_core")))
    return shelf.keep(tree.unionByName(stars)), all_core


# -- condensed tree -----------------------------------------------------------------


class Merges:
    """The merges of a band's edges in order, over nodes that may come with a state from lighter bands.

    A state is (size, rate, mass, parts): rows; 1 / height of the last merge while the node is large; the mass
    that its topmost condensed cluster has above that; and the worth of that cluster's parts.
    """

    def __init__(self, edges: pd.DataFrame, states: dict, least: int):
        edges = edges.sort_values(["w", "a", "b"])
        self.nodes, at = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
        n = len(self.nodes)
        self.name = self.nodes.tolist()
        self.state = [states.get(k, (1, 0.0, 0.0, 0.0)) for k in self.name]
        self.children: list[tuple[int, int] | None] = [None] * n
        self.chosen: dict[int, bool] = {}  # of the children of a split: worth more than its parts
        top = list(range(n))
        for w, x, y in zip(edges["w"].tolist(), at[: len(edges)].tolist(), at[len(edges) :].tolist()):
            while top[x] != x:
                top[x] = x = top[top[x]]
            while top[y] != y:
                top[y] = y = top[top[y]]
            k = len(top)
            top.append(k)
            top[x] = top[y] = k
            self.children.append((x, y))
            self.name.append(min(self.name[x], self.name[y]))
            self.state.append(self._merged(x, y, 1 / max(w, FAR), least))
        self.tops = [k for k, t in enumerate(top) if t == k]

    def _merged(self, x: int, y: int, rate: float, least: int) -> tuple[int, float, float, float]:
        (n, *_), (m, *_) = self.state[x], self.state[y]
        large = [k for k in (x, y) if self.state[k][0] >= least]
        if not large:
            return n + m, rate, 0.0, 0.0  # if large now, all its rows leave it here
        if len(large) == 1:
            size, was, mass, parts = self.state[large[0]]
            return n + m, rate, mass + size * (was - rate), parts
        worth = 0.0
        for k in large:
            size, was, mass, parts = self.state[k]
            mass += size * (was - rate)
            self.chosen[k] = mass >= parts
            worth += max(mass, parts)
        return n + m, rate, 0.0, worth


def _bands(tree: DataFrame, shelf: Shelf, width: int) -> tuple[DataFrame, int]:
    """The edges with their band, and with u, v: what lighter bands have joined their ends to."""
    placed = numbered(tree, ["_group", "w", "a", "b"], "_place")
    first = placed.groupBy("_group").agg(F.min("_place").alias("_first"))
    edges = shelf.keep(placed.join(first, "_group").select("_group", "w", "a", "b", F.floor((F.col("_place") - F.col("_first")) / width).cast("int").alias("band"), F.col("a").alias("u"), F.col("b").alias("v")))
    count = (edges.agg(F.max("band")).first()[0] or 0) + 1
    span = 1 << (count - 1).bit_length()
    while span > 1:
        part = F.floor(F.col("band") / span).cast("int")
        upper = F.col("band") % span >= span // 2
        low = _components(edges.where(~upper).withColumn("_part", part), shelf, ["_group", "_part"])
        name = lambda c: low.select("_group", "_part", F.col("node").alias(c), F.col("low").alias(f"_{c}"))
        moved = edges.withColumn("_part", part).join(name("u"), ["_group", "_part", "u"], "left").join(name("v"), ["_group", "_part", "v"], "left")
        new = shelf.keep(moved.select("_group", "w", "a", "b", "band", F.when(upper, F.coalesce("_u", "u")).otherwise(F.col("u")).alias("u"), F.when(upper, F.coalesce("_v", "v")).otherwise(F.col("v")).alias("v")))
        shelf.drop(edges)
        edges, span = new, span // 2
    return edges, count


def tree_labels(tree: DataFrame, shelf: Shelf, least: int, width: int | None = None) -> DataFrame:
    """(_group, node, label, level): for every end of the tree's edges the cluster of excess of mass, by its smallest
    row, and the height at which it splits from the others; both null for noise."""
    if least < 2:
        raise ValueError("a cluster has two rows at least")
    kind = dict(tree.dtypes)["a"]
    edges, count = _bands(tree, shelf, width or EDGES)
    ends = edges.select("_group", F.explode(F.array("u", "v")).alias("node"), "band").distinct()
    order = Window.partitionBy("_group", "node").orderBy("band")
    touched = shelf.keep(ends.select("_group", "node", "band", F.coalesce(F.lag("band").over(order), F.lit(-1)).alias("prev"), F.coalesce(F.lead("band").over(order), F.lit(-1)).alias("next")))
    state = f"_group string, node {kind}, size long, rate double, mass double, parts double"
    spark = tree.sparkSession
    state_schema = spark.createDataFrame([], state).schema
    labels = f"_group string, node {kind}, label {kind}, level double"
    label_schema = spark.createDataFrame([], labels).schema

    def built(e: pd.DataFrame, s: pd.DataFrame) -> Merges:
        return Merges(e, {r[0]: tuple(r[1:]) for r in s[["node", "size", "rate", "mass", "parts"]].itertuples(index=False, name=None)}, least)

    def up(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        m = built(e, s) if len(e) else None
        rows = [(e["_group"].iloc[0], m.name[k], *m.state[k]) for k in m.tops] if m else []
        return pd.DataFrame(rows, columns=["_group", "node", "size", "rate", "mass", "parts"]) if rows else _none("_group", "node", "size", "rate", "mass", "parts")

    def down(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(e):
            return _none("_group", "node", "label", "level")
        known = s[s["label"].notna()]
        given = dict(zip(known["node"], zip(known["label"], known["level"])))
        m = built(e, s[s["size"].notna()])
        label: list = [(None, None)] * len(m.name)
        for k in m.tops:
            label[k] = given.get(m.name[k], (None, None))
        for k in range(len(m.name) - 1, len(m.nodes) - 1, -1):  # a merge comes after its children
            for c in m.children[k]:
                label[c] = label[k] if label[k][0] is not None or not m.chosen.get(c) else (m.name[c], 1 / m.state[k][1])
        names, levels = zip(*label[: len(m.nodes)])
        return pd.DataFrame({"_group": e["_group"].iloc[0], "node": m.nodes, "label": pd.Series(names, dtype=object), "level": pd.Series(levels, dtype=object)})

    for band in range(count):
        own = edges.where(F.col("band") == band)
        made = own.groupBy("_group").cogroup(shelf.part("states", "next", band, state_schema).groupBy("_group")).applyInPandas(up, state)
        following = touched.where(F.col("band") == band).select("_group", "node", "next")
        shelf.add(made.join(following, ["_group", "node"]), "states", "next")
    for band in range(count - 1, -1, -1):
        own = edges.where(F.col("band") == band)
        states = shelf.part("states", "next", band, state_schema)
        given = shelf.part("labels", "prev", band, label_schema)
        both = states.join(given, ["_group", "node"], "full")
        out = own.groupBy("_group").cogroup(both.groupBy("_group")).applyInPandas(down, labels)
        shelf.add(out.join(touched.where(F.col("band") == band).select("_group", "node", "prev"), ["_group", "node"]), "labels", "prev")
    return shelf.part("labels", "prev", -1, label_schema)
