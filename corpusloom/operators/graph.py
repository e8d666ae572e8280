"""Co-occurrence networks and graph metrics on edge tables (a, b, weight), a < b."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import numbered
from .sketches import neighbourhoods
from .tables import Shelf

#: Edges up to which a graph is broadcast, or its communities are found in one task.
SMALL_EDGES = 200_000


def cooccurrence(rows: DataFrame, basket: list[str], node: str, least: int) -> DataFrame:
    """Pairs of nodes that share a basket, with how many they share; at least ``least``.

    Baskets hold one row for each node, so a basket makes no more pairs than nodes allow.
    """
    sets = rows.select(*basket, node).distinct().groupBy(*basket).agg(F.array_sort(F.collect_set(node)).alias("nodes"))
    pairs = sets.select(F.explode(F.flatten(F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def actor_network(df: DataFrame, basket: list[str], least: int, prefix: str = "actor_") -> DataFrame:
    """The co-occurrence network of a wide table's columns that start with ``prefix``: an actor is in a row where its
    number is over 0.  A table without such columns gives no edges.
    """
    actors = [c for c in df.columns if c.startswith(prefix)]
    if not actors:
        return df.sparkSession.createDataFrame([], "a string, b string, weight long")
    seen = F.filter(F.array(*(F.when(F.col(f"`{c}`") > 0, F.lit(c)) for c in actors)), lambda x: x.isNotNull())
    return cooccurrence(df.select(*basket, F.explode(seen).alias("node")), basket, "node", least)


def node_sizes(edges: DataFrame, sizes: DataFrame | None = None, scale: int = 100) -> DataFrame:
    """(node, size): the given number of each node (node, value), 1 where it has none, or its degree, times ``scale``."""
    degree = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("value"))
    value = degree if sizes is None else degree.select("node").join(sizes.select("node", "value"), "node", "left")
    return value.select("node", (F.coalesce("value", F.lit(1)) * scale).alias("size"))


def node_groups(communities: DataFrame) -> DataFrame:
    """(node, hue): a hue in [0, 1) for each community, evenly spread: what colours a drawing's nodes."""
    n = F.broadcast(communities.agg(F.count_distinct("community").alias("_n")))  # one row
    return communities.join(n).select("node", F.round(F.col("community") / F.col("_n"), 6).alias("hue"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def nodes_of(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("a").alias("node")).distinct()


def edge_widths(edges: DataFrame, widest: float = 5.0) -> DataFrame:
    top = F.broadcast(edges.agg(F.max("weight").alias("_top")))  # one row
    return edges.join(top).select("a", "b", "weight", F.round(F.col("weight") / F.col("_top") * widest, 6).alias("width"))


def network_stats(edges: DataFrame) -> DataFrame:
    n = F.broadcast(nodes_of(edges).agg(F.count(F.lit(1)).alias("nodes")))  # one row
    return edges.agg(F.count(F.lit(1)).alias("edges")).join(n).select("nodes", "edges", F.round(F.expr("try_divide(2.0D * edges, nodes * (nodes - 1))"), 6).alias("density"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    n = F.broadcast(nodes_of(edges).agg(F.count(F.lit(1)).alias("_n")))  # one row
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")).join(n).select("node", "degree", F.round(F.expr("try_divide(1.0D * degree, _n - 1)"), 6).alias("centrality"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """Average over nodes of triangles / possible triangles; 0 for fewer than two neighbours.

    Edges point to the end of more neighbours, so a hub, to which they point, makes few of the wedges.
    """
    degree = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    ends = edges.select("a", "b").join(degree.select(F.col("node").alias("a"), F.col("k").alias("_a")), "a").join(degree.select(F.col("node").alias("b"), F.col("k").alias("_b")), "b")
    up = F.struct("_a", "a") < F.struct(F.col("_b").alias("_a"), F.col("b").alias("a"))
    out = ends.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"))
    one, two = out.select("low", F.col("high").alias("x")), out.select("low", F.col("high").alias("y"))
    wedge = one.join(two, "low").where("x < y")
    corners = wedge.join(edges.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]).select(F.explode(F.array("low", "x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    local = degree.join(corners, "node", "left").select(F.when(F.col("k") < 2, F.lit(0.0)).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("c"))
    return local.agg(F.round(F.avg("c"), 6).alias("average_clustering"))


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): smallest label reachable, by alternating minima and label jumps.

    Labels are checkpointed each round in the shared folder, so lineage stays short.
    """
    around = both_ways(edges).cache()
    labels = nodes.select("node", F.col("node").alias("component")).checkpoint() if _checkpointing(nodes) else nodes.select("node", F.col("node").alias("component"))
    for _ in range(most_rounds):
        near = around.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_near"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("_was"), F.least("component", F.coalesce("_near", "component")).alias("_low"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = low.join(jump, F.col("_low") == F.col("_n")).select("node", "_was", F.least("_low", "_c").alias("component")).checkpoint()
        labels = new.select("node", "component")
        if new.where("component <> _was").isEmpty():
            around.unpersist()
            return labels
    raise RuntimeError("components did not settle")


def _checkpointing(df: DataFrame) -> bool:
    """Make sure there is a checkpoint folder: the session's, or one of its own for a session in one process."""
    import re
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="corpusloom-"))
    return True


def materialise(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder."""
    _checkpointing(df)
    return df.checkpoint()


def shortest_paths(edges: DataFrame, most_steps: int = 1000) -> DataFrame:
    """(a, b, d): hops between connected nodes, by joining the frontier with the edges.

    The result has a row for each connected pair, so this is for graphs of modest size.
    """
    around = both_ways(edges)
    known = nodes_of(edges).select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("d"))
    _checkpointing(edges)
    for d in range(1, most_steps + 1):
        step = known.where(F.col("d") == d - 1).select("a", F.col("b").alias("_at")).join(around.select(F.col("a").alias("_at"), "b"), "_at").select("a", "b").distinct()
        new = step.join(known, ["a", "b"], "left_anti").withColumn("d", F.lit(d)).checkpoint()
        if new.isEmpty():
            return known
        known = known.union(new).checkpoint() if d % 10 == 0 else known.union(new)
    raise RuntimeError("paths did not end")


def closeness_centrality(edges: DataFrame) -> DataFrame:
    """(reached / total distance) * (reached / (n - 1)), the usual correction for parts of a graph."""
    n = F.broadcast(nodes_of(edges).agg(F.count(F.lit(1)).alias("_n")))  # one row
    far = shortest_paths(edges).where("d > 0").groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("total"))
    return far.join(n).select("node", F.round(1.0 * F.col("r") / F.col("total") * F.col("r") / (F.col("_n") - 1), 6).alias("closeness"))


def sketched_closeness(edges: DataFrame, lg_registers: int = 12, most_steps: int = 1000) -> DataFrame:
    """(node, reached, total, closeness) for graphs of any size, from sketches of neighbourhoods.

    Each node starts with a sketch of itself and takes in its neighbours' each round, so after d rounds the sketch
    counts the nodes within d hops: a row of about 2^``lg_registers`` bytes for each node in place of one for each
    pair.  Only sketches that changed are sent on.  A count's standard error is 1.04 / sqrt(2^``lg_registers``),
    1.6 % as set; neighbourhoods of up to some hundred nodes are kept as they are and count exactly.
    ``reached`` leaves out the node itself, ``total`` is the sum of its distances.  An edge may be given more than
    once or lead back to its node; nulls at an end are dropped.  In a graph of more than ``SMALL_EDGES`` edges the
    same registers are spread by blocks of nodes, a band of them after another.
    """
    shelf = Shelf(edges.sparkSession, "closeness")
    pairs = shelf.keep(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n_pairs = pairs.count()
    if n_pairs > SMALL_EDGES:
        far = neighbourhoods(pairs, n_pairs, lg_registers, most_steps)
        return _scored(far, far.count())
    around = shelf.keep(both_ways(pairs).distinct())
    n = around.select("a").distinct().count()
    first = around.select(F.col("a").alias("node")).groupBy("node").agg(F.hll_sketch_agg(F.col("node").cast("string"), F.lit(lg_registers)).alias("sketch"))
    state = shelf.keep(first.select("node", "sketch", F.lit(1).cast("long").alias("near"), F.lit(0).cast("long").alias("total"), F.lit(True).alias("changed")))
    for step in range(1, most_steps + 1):
        sent = around.join(state.where("changed").select(F.col("node").alias("b"), "sketch"), "b").select(F.col("a").alias("node"), "sketch")
        whole = sent.union(state.select("node", "sketch")).groupBy("node").agg(F.hll_union_agg("sketch").alias("_sketch"))
        now = F.greatest("near", F.hll_sketch_estimate("_sketch"))
        # a list of few nodes is stored in any order, but a longer one shows in the count; full registers compare by bytes
        full = (F.octet_length("_sketch") > 1 << lg_registers) & (F.col("_sketch") != F.col("sketch"))
        grown = state.join(whole, "node").select("node", F.col("_sketch").alias("sketch"), now.alias("near"), (F.col("total") + step * (now - F.col("near"))).alias("total"), ((now > F.col("near")) | full).alias("changed"))
        old, state = state, shelf.keep(grown)
        shelf.drop(old)
        if state.where("changed").isEmpty():
            return _scored(state.select("node", (F.col("near") - 1).alias("reached"), "total"), n)
    raise RuntimeError("neighbourhoods did not end")


def _scored(far: DataFrame, n: int) -> DataFrame:
    score = F.when(F.col("total") > 0, F.round(1.0 * F.col("reached") / F.col("total") * F.least(F.col("reached") / F.lit(n - 1), F.lit(1.0)), 6)).otherwise(0.0)
    return far.select("node", "reached", "total", score.alias("closeness"))


def eigenvector_centrality(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Power iteration on A + I; each round a join and a sum."""
    _checkpointing(edges)
    around = both_ways(edges).cache()
    x = nodes_of(edges).withColumn("x", F.lit(1.0))
    for _ in range(rounds):
        pulled = around.join(x, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("x").alias("s"))
        y = x.join(pulled, F.col("node") == F.col("a")).select("node", F.col("x").alias("was"), (F.col("x") + F.col("s")).alias("y")).cache()
        size = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("z")).first()["z"] or 1.0
        x = y.select("node", (F.col("y") / size).alias("x"), "was").checkpoint()
        y.unpersist()
        if (x.agg(F.max(F.abs(F.col("x") - F.col("was"))).alias("d")).first()["d"] or 0) < 1e-7:
            return x.select("node", F.round("x", 6).alias("centrality"))
        x = x.select("node", "x")
    raise RuntimeError("centrality did not settle")


def _adjacency(batches: Iterator[pd.DataFrame]) -> dict:
    near: dict = {}
    for rows in batches:
        for a, b in zip(rows["a"], rows["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def betweenness(edges: DataFrame, kind: str = "string", block_rows: int = 50_000_000) -> DataFrame:
    """Brandes' algorithm, normalised for undirected graphs.

    A graph of at most ``SMALL_EDGES`` edges is broadcast and its sources are dealt over the tasks.  In a larger
    one sources go in blocks of about ``block_rows`` / nodes: their paths are counted level by level by joins of
    the frontier with the edges, then what nodes owe is summed back level by level.
    """
    e = edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    small = e.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES
    owed = _owed_by_sources(e, kind) if small else _owed_by_levels(e, block_rows)
    n = nodes_of(e).agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row
    scale = F.when(F.col("n") > 2, 1 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(1.0)
    return owed.groupBy("node").agg(F.sum("owed").alias("_owed")).join(F.broadcast(n)).select("node", F.round(F.col("_owed") * scale, 6).alias("betweenness"))


def _owed_by_sources(edges: DataFrame, kind: str) -> DataFrame:
    """(node, owed): each task's sums over its sources, with the whole graph, of checked size, at hand."""
    near: dict = {}
    for r in edges.collect():
        near.setdefault(r["a"], []).append(r["b"])
        near.setdefault(r["b"], []).append(r["a"])
    graph = edges.sparkSession.sparkContext.broadcast(near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = graph.value
        score = dict.fromkeys(near, 0.0)
        for s in (s for rows in batches for s in rows["node"]):
            order, parents, paths, dist = [s], {s: []}, {s: 1.0}, {s: 0}
            for v in order:
                for w in near[v]:
                    if w not in dist:
                        dist[w], paths[w], parents[w] = dist[v] + 1, 0.0, []
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
                        parents[w].append(v)
            owed = dict.fromkeys(order, 0.0)
            for w in reversed(order[1:]):
                for v in parents[w]:
                    owed[v] += paths[v] / paths[w] * (1 + owed[w])
                score[w] += owed[w]
        yield pd.DataFrame(list(score.items()), columns=["node", "owed"])

    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return nodes_of(edges).repartition(parts, "node").mapInPandas(run, f"node {kind}, owed double")


def _owed_by_levels(edges: DataFrame, block_rows: int) -> DataFrame:
    shelf = Shelf(edges.sparkSession, "paths")
    around = shelf.keep(both_ways(edges))
    nodes = shelf.keep(nodes_of(edges))
    blocks = -(-nodes.count() ** 2 // block_rows)
    sums = []
    for block in range(blocks):
        own = nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block)
        levels = [shelf.keep(own.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))]
        while True:  # a neighbour is at most one level off, so the last two levels tell which nodes are new
            step = levels[-1].join(around.select(F.col("a").alias("v"), "b"), "v").groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
            for known in levels[-2:]:
                step = step.join(known.select("s", "v"), ["s", "v"], "left_anti")
            step = shelf.keep(step)
            if step.isEmpty():
                break
            levels.append(step)
        owed = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("owed"))
        total = []
        for level in reversed(levels[:-1]):
            own_sum = owed.groupBy(F.col("v").alias("node")).agg(F.sum("owed").alias("owed"))
            total.append(shelf.keep(own_sum))
            back = owed.join(around.select(F.col("a").alias("v"), F.col("b").alias("_to")), "v").select("s", F.col("_to").alias("v"), ((1 + F.col("owed")) / F.col("paths")).alias("_share"))
            given = back.groupBy("s", "v").agg(F.sum("_share").alias("_share"))
            owed = shelf.keep(level.join(given, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("_share", F.lit(0.0))).alias("owed")))
        sums += [*total, nodes.select("node", F.lit(0.0).alias("owed"))] if block == 0 else total
    out = sums[0]
    for more in sums[1:]:
        out = out.union(more)
    return out


def communities(edges: DataFrame, kind: str = "string") -> DataFrame:
    """(node, community), the largest 0: greedy modularity, in which the two communities whose union gains most are
    merged while one gains; in a graph of more than ``SMALL_EDGES`` edges, by rounds in which all pairs that are each
    other's best are merged at once."""
    e = edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    if e.limit(SMALL_EDGES + 1).count() > SMALL_EDGES:
        return communities_by_rounds(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = _adjacency(batches)
        m = sum(map(len, near.values())) / 2
        groups = {v: {v} for v in near}
        weight = {v: len(n) for v, n in near.items()}
        links = {v: {w: 1.0 for w in n} for v, n in near.items()}
        while True:
            gain, a, b = max(((links[a][b] / m - weight[a] * weight[b] / (2 * m * m), a, b) for a in sorted(links) for b in sorted(links[a]) if a < b), default=(0, None, None), key=lambda x: x[0])
            if gain <= 1e-12:
                break
            groups[a] |= groups.pop(b)
            weight[a] += weight.pop(b)
            for w, x in links.pop(b).items():
                links[w].pop(b)
                if w != a:
                    links[a][w] = links[w][a] = links[a].get(w, 0) + x
        rows = [(v, k) for k, g in enumerate(sorted(groups.values(), key=lambda g: (-len(g), min(g)))) for v in sorted(g)]
        yield pd.DataFrame(rows, columns=["node", "community"])

    return e.coalesce(1).mapInPandas(run, f"node {kind}, community int")


def communities_by_rounds(edges: DataFrame) -> DataFrame:
    """(node, community) from rounds over tables of communities and of the links between them, which shrink as
    communities merge.  The pair of the highest gain is each other's best, so every round merges one at least."""
    shelf = Shelf(edges.sparkSession, "communities")
    links = shelf.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1.0).alias("w")))
    m = float(links.count())
    size = shelf.keep(both_ways(edges).groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("k")))
    member = shelf.keep(size.select(F.col("c").alias("node"), F.col("c").alias("community")))
    while True:
        end = lambda c: size.select(F.col("c").alias(c), F.col("k").alias(f"_{c}"))
        gain = links.join(end("a"), "a").join(end("b"), "b").select("a", "b", F.round(F.col("w") / m - F.col("_a") * F.col("_b") / (2 * m * m), 15).alias("g")).where("g > 1e-12")
        each = gain.select(F.col("a").alias("c"), F.col("b").alias("o"), "g").union(gain.select("b", "a", "g"))
        # of equal gains the smallest pair wins at both ends, so a chain of ties has a pair that agrees
        rank = F.struct((-F.col("g")).alias("g"), F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"))
        best = each.groupBy("c").agg(F.min_by("o", rank).alias("o"))
        merges = shelf.keep(best.join(best.select(F.col("c").alias("o"), F.col("o").alias("_back")), "o").where("_back = c and o < c").select("c", F.col("o").alias("into")))
        if merges.isEmpty():
            break
        to = lambda c: merges.select(F.col("c").alias(c), F.col("into").alias("_to"))
        moved = lambda df, c: df.join(to(c), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        ends = moved(moved(links, "a"), "b").where("a <> b")
        links = shelf.keep(ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
        size = shelf.keep(moved(size, "c").groupBy("c").agg(F.sum("k").alias("k")))
        member = shelf.keep(moved(member, "community"))
    sizes = member.groupBy("community").agg((-F.count(F.lit(1))).alias("_n"), F.min("node").alias("_first"))
    placed = numbered(sizes, ["_n", "_first"], "_place")
    return member.join(placed.select("community", F.col("_place").cast("int").alias("_k")), "community").select("node", F.col("_k").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Of a division (node, community): the share of edges inside minus what chance would put there."""
    end = lambda c: communities.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"))
    m = edges.count()
    inside = edges.join(end("a"), "a").join(end("b"), "b").where("_a = _b").count()
    degree = both_ways(edges).join(end("a"), "a").groupBy("_a").agg(F.count(F.lit(1)).alias("k"))
    return inside / m - (degree.agg(F.sum(F.pow(F.col("k") / (2 * m), 2))).first()[0] or 0.0) if m else 0.0
