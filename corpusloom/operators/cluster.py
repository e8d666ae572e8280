"""Density clustering of vectors by cosine distance, and topic operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import density
from .tables import Shelf

#: Rows of a group up to which the whole distance structure is built in one task.
LARGEST_GROUP = 20_000
#: Rows of a block when all rows meet all rows.
BLOCK = 4_096
#: Numbers of all vectors that go to every task, and tokens that one task pools.
LISTED, POOLED = 4_000_000, 250_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def block_pairs(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks (``_i`` <= ``_j``) that its own block ``_own`` is in."""
    own = rows.withColumn("_own", F.pmod(F.xxhash64(key), blocks).cast("int"))
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return dealt.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_other")


def _part_of(pdf: pd.DataFrame) -> int:
    """The number of a pair of blocks."""
    i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
    return j * (j + 1) // 2 + i


def _lowest(a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches over the links ``a``, ``b`` and what ``low`` has so far."""
    while True:
        x, y = low[a], low[b]
        open_ = x != y
        if not open_.any():
            return low
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, low[low]):
            low = low[low]


def similar_links(df: DataFrame, key: str, vector: str, above: float, block: int | None = None) -> DataFrame:
    """(a, b): links that connect the same rows as all pairs of cosine similarity over ``above`` do.

    Every row meets every other, in pairs of blocks.  A pair of blocks gives a star
    for each of its connected parts, so links don't grow with the similar pairs.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(key, F.col(vector).alias("_v")).where(V.valid_vector(F.col("_v")))
    blocks = -(-max(rows.count(), 1) // (block or BLOCK))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x, own, keys = unit_rows(np.array(pdf["_v"].tolist(), float)), pdf["_own"].to_numpy(), pdf[key].to_numpy()
        left, right = (np.flatnonzero(own == pdf[c].iloc[0]) for c in ("_i", "_j"))
        low = np.arange(len(x))
        for at in range(0, len(left), 512):
            here = left[at : at + 512]
            a, b = np.nonzero(x[here] @ x[right].T > above)
            low = _lowest(here[a], right[b], low)
        return stars(keys, low, _part_of(pdf))

    def stars(keys: np.ndarray, low: np.ndarray, part: int) -> pd.DataFrame:
        linked = np.flatnonzero(low != np.arange(len(low)))
        return pd.DataFrame({"_part": np.full(len(linked), part), "a": keys[low[linked]], "b": keys[linked]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
        return stars(keys, _lowest(at[: len(pdf)], at[len(pdf) :], np.arange(len(keys))), pdf["_part"].iloc[0])

    schema = f"_part int, a {kind}, b {kind}"
    links, parts = block_pairs(rows, key, F.lit(blocks)).groupBy("_i", "_j").applyInPandas(run, schema), blocks * (blocks + 1) // 2
    while parts > 3:  # a part has fewer links than there are rows
        parts = -(-parts // 4)
        links = links.withColumn("_part", F.col("_part") % parts).groupBy("_part").applyInPandas(merge, schema)
    return links.select("a", "b")


def core_distances(x: np.ndarray, metric: str, samples: int) -> np.ndarray:
    """Of each row, the distance to its ``samples``-th nearest other row (the farthest if there are fewer)."""
    out = np.zeros(len(x))
    for at in range(0, len(x), 512):
        d = density.distances(x[at : at + 512], x, metric)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = -1  # itself comes first
        k = min(samples, len(x) - 1)
        near = np.argpartition(d, k, axis=1)[:, : k + 1]
        i = np.repeat(np.arange(len(d)), k + 1)
        out[at : at + 512] = density.exact(x[i + at], x[near.ravel()], metric).reshape(-1, k + 1).max(axis=1)
    return out


def single_linkage(x: np.ndarray, metric: str = "cosine", samples: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (distance, a, b), a < b, of the minimum spanning tree of mutual reachability, by Prim's algorithm.

    Distances count to 12 digits and equal ones by their ends, so there is one such tree.  With one sample a
    core distance is that to the nearest row, so reachability is the distance itself.
    """
    unit = density.spread_out(x, metric)
    core = core_distances(unit, metric, samples) if samples > 1 else np.zeros(len(x))
    n = len(x)
    places = np.arange(n)
    best, ends, inside = np.full(n, np.inf), np.full(n, n * n), np.zeros(n, bool)
    at, out = 0, []
    for _ in range(n - 1):
        inside[at] = True
        d = np.round(1 - unit @ unit[at] if metric == "cosine" else np.linalg.norm(unit - unit[at], axis=1), 12) + 0.0
        d = np.maximum(np.maximum(d, core), core[at])
        own = np.minimum(places, at) * n + np.maximum(places, at)
        closer = ~inside & ((d < best) | ((d == best) & (own < ends)))
        best[closer], ends[closer] = d[closer], own[closer]
        left = np.where(inside, np.inf, best)
        ties = np.flatnonzero(left == left.min())
        at = int(ties[ends[ties].argmin()])
        out.append((best[at], ends[at]))
    return _in_order(*(np.array(c) for c in ([d for d, _ in out], [e // n for _, e in out], [e % n for _, e in out])))


def _in_order(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a, d))
    return d[order], a[order], b[order]


def density_labels(x: np.ndarray, least: int, metric: str = "cosine", samples: int = 1) -> np.ndarray:
    """Labels by excess of mass on the condensed single-linkage tree; -1 is noise."""
    return labels_and_levels(x, least, metric, samples)[0]


def labels_and_levels(x: np.ndarray, least: int, metric: str = "cosine", samples: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The labels, and for each row the height at which its cluster splits from the others (NaN for noise)."""
    if len(x) < max(2, least):
        return np.full(len(x), -1), np.full(len(x), np.nan)
    return tree_labels(len(x), *single_linkage(x, metric, samples), least)


def tree_labels(n: int, d_: np.ndarray, a_: np.ndarray, b_: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``labels_and_levels`` from the edges of the minimum spanning tree, in order."""
    top = list(range(n))  # tree node of each set
    children, height, size = {}, {}, {i: 1 for i in range(n)}

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for d, a, b in zip(d_.tolist(), a_.tolist(), b_.tolist()):
        a, b, k = find(a), find(b), len(top)
        top.append(k)
        top[a] = top[b] = k
        children[k], height[k], size[k] = (a, b), d, size[a] + size[b]
    root = len(top) - 1
    rate = lambda k: 1 / max(height[k], 1e-12)
    clusters: dict[int, dict] = {}
    stack = [(root, root, 0.0)]
    clusters[root] = {"birth": 0.0, "mass": 0.0, "points": [], "parts": []}
    while stack:
        node, own, _ = stack.pop()
        a, b = children[node]
        now, c = rate(node), clusters[own]
        big = [k for k in (a, b) if size[k] >= least]
        if len(big) == 2:
            c["mass"] += size[node] * (now - c["birth"])
            for k in big:
                clusters[k] = {"birth": now, "mass": 0.0, "points": [], "parts": []}
                c["parts"].append(k)
                if k in children:
                    stack.append((k, k, now))
                else:
                    clusters[k]["points"].append(k)
            continue
        for k in (a, b):
            if k in big:
                if k in children:
                    stack.append((k, own, now))
                else:
                    c["points"].append(k)
            else:
                leaves, todo = [], [k]
                while todo:
                    t = todo.pop()
                    todo.extend(children[t]) if t in children else leaves.append(t)
                c["points"] += leaves
                c["mass"] += len(leaves) * (now - c["birth"])
    chosen: set[int] = set()
    worth: dict[int, float] = {}
    for k in sorted(clusters):  # children have smaller numbers than their parents
        parts = sum(worth[p] for p in clusters[k]["parts"])
        if k != root and clusters[k]["mass"] >= parts:
            worth[k] = clusters[k]["mass"]
            chosen.add(k)
        else:
            worth[k] = parts
    labels, levels, todo = np.full(n, -1), np.full(n, np.nan), [(root, None)]
    while todo:
        k, label = todo.pop()
        label = k if label is None and k in chosen else label
        if label is not None:
            labels[clusters[k]["points"]] = label
            levels[clusters[k]["points"]] = 1 / clusters[label]["birth"]
        todo += [(p, label) for p in clusters[k]["parts"]]
    return labels, levels


def density_clusters(df: DataFrame, key: str, vector: str, group: Column, prefix: str, least: int, metric: str = "cosine", samples: int = 1, probes: int = 8, levels: bool = False) -> DataFrame:
    """(key, group, cluster_id): clusters inside each group, named by their smallest key; null is noise.  Keys are unique.

    Rows without a valid vector or group are noise.  A group of at most ``LARGEST_GROUP`` rows is clustered in a
    task from all its distances, a larger one by ``density`` from its neighbour graph, which looks for a row in
    ``probes`` cells: the more of them, the nearer its labels are to those of all distances.  With ``levels``
    there is also ``level``, the height at which a row's cluster splits from the others.
    """
    rows = df.select(key, group.cast("string").alias("_group"), V.numbers(df, vector).alias("_v"))
    good = rows.where(V.valid_vector(F.col("_v")) & F.col("_group").isNotNull())
    sizes = good.groupBy("_group").agg((F.count(F.lit(1)) > LARGEST_GROUP).alias("_large"))
    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, group string, cluster_id string, level double"
    columns = [key, "group", "cluster_id", *(["level"] if levels else [])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        keys, where = pdf[key].to_numpy(), pdf["_group"].iloc[0]
        labels, level = labels_and_levels(np.array(pdf["_v"].tolist(), float), least, metric, samples)
        names = pd.Series(keys).groupby(labels).min()
        named = [None if k < 0 else f"{prefix}_{where}__{names[k]}" for k in labels]
        return pd.DataFrame({key: keys, "group": where, "cluster_id": named, "level": [None if k < 0 else d for k, d in zip(labels, level)]})

    large = [r["_group"] for r in sizes.where("_large").select("_group").collect()]  # few: each has many rows
    found = good.where(~F.col("_group").isin(large)).groupBy("_group").applyInPandas(run, schema)
    if large:
        shelf = Shelf(df.sparkSession, "density")
        own = good.where(F.col("_group").isin(large)).select(F.col(key).alias("_key"), "_group", "_v")
        tree, _ = density.density_tree(own, shelf, metric, samples, probes=probes)
        labels = density.tree_labels(tree, shelf, least)
        found = found.unionByName(labels.select(F.col("node").alias(key), F.col("_group").alias("group"), F.concat(F.lit(f"{prefix}_"), "_group", F.lit("__"), F.col("label").cast("string")).alias("cluster_id"), "level"))
    noise = rows.where(~F.coalesce(V.valid_vector(F.col("_v")) & F.col("_group").isNotNull(), F.lit(False))).select(key, F.col("_group").alias("group"), F.lit(None).cast("string").alias("cluster_id"), F.lit(None).cast("double").alias("level"))
    return found.unionByName(noise).select(*columns)


def assign_clusters(new: DataFrame, key: str, vector: str, fitted: DataFrame, fitted_key: str, fitted_vector: str, label: str, metric: str = "cosine", probes: int = 8) -> DataFrame:
    """(key, label): the fitted tree's cluster that each new row would join, null if none.

    ``fitted`` has the clustered rows with ``label`` and ``level``, as ``density_clusters`` gives them.  A new row
    hangs on its nearest fitted row, at their distance; it is in that row's cluster if the cluster splits from
    the others farther out, so rows between clusters and neighbours of noise stay outside.
    """
    own = lambda df, k, v: df.select(F.col(k).alias("_key"), F.lit("all").alias("_group"), V.doubles(F.col(v)).alias("_v")).where(V.valid_vector(F.col("_v")))
    rows = own(fitted, fitted_key, fitted_vector)
    near = density.neighbours(rows, {"all": rows.count()}, 1, metric, probes, asking=own(new, key, vector))
    held = near.join(fitted.select(F.col(fitted_key).alias("n"), F.col(label).alias("_label"), "level"), "n")
    joined = held.select(F.col("a").alias(key), F.when(F.col("d") < F.col("level"), F.col("_label")).alias(label))
    return new.select(key).join(joined, key, "left")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count_if(F.col("cluster_id").isNull()).alias("n_noise"), F.count(F.lit(1)).alias("n"))


def hashing_embedder(df: DataFrame, id_col: str, text_col: str, width: int = 64) -> DataFrame:
    """An offline stand-in for a sentence encoder: signed hashed words, unit length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            out = []
            for text in pdf["_text"]:
                v = np.zeros(width)
                for w in (text or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % width] += 1 if h >> 16 & 1 else -1
                size = np.linalg.norm(v)
                out.append((v / size if size else v).astype("float32").tolist())
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": out})

    return df.select(id_col, F.col(text_col).alias("_text")).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, embedding array<float>")


#: The fields that each kind of row is embedded by.
PRESETS = {"mentions": ("name", "body"), "relations": ("relation", "evidence"), "events": ("event_type", "trigger")}


def embed_rows(rows: DataFrame, key: str, preset: str, width: int = 64) -> DataFrame:
    """(key, embedding) of rows by the joined fields of a preset."""
    from ..functions.text import join_fields

    return hashing_embedder(rows.select(key, join_fields(*map(F.col, PRESETS[preset])).alias("_joined")), key, "_joined", width)


def mean_pool(tokens: DataFrame, doc: str, word: str, vectors: DataFrame, size: int) -> DataFrame:
    """Mean of the known words' vectors of each document, zeros where none is known.

    Only documents' words are shuffled: up to ``LISTED`` numbers of vectors that are used go to where the documents
    are, and a document's sums grow there.  With more, words meet their vectors by a join before.
    """
    shelf = Shelf(tokens.sparkSession, "pooled")
    named = vectors.select(F.col("word").alias(word), "vector")
    used = shelf.keep(named.join(tokens.select(word).distinct(), word, "left_semi"))
    sizes = used.agg(F.max(F.size("vector")).alias("width"), F.sum(F.size("vector")).alias("listed")).first()
    width = max(size, sizes["width"] or 0)
    parts = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens.count() // POOLED))
    dealt = lambda df: df.repartition(parts, doc)
    if (sizes["listed"] or 0) <= LISTED:
        known = dealt(tokens.select(doc, word)).join(F.broadcast(used), word, "left")
    else:
        known = dealt(tokens.select(doc, word).join(used, word, "left").drop(word))
    means = [F.avg(F.get("vector", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(width)]
    pooled = known.groupBy(doc).agg(F.max(F.size("vector")).alias("_n"), *means)
    mean = F.slice(F.array(*(f"_{i}" for i in range(width))), F.lit(1), F.col("_n"))
    return pooled.select(doc, F.when(F.col("_n") >= 0, mean).otherwise(F.array_repeat(F.lit(0.0), size)).alias("vector"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    at = df.select(group, F.posexplode(V.doubles(F.col(vector))).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("m"))
    return at.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def assign_topics(df: DataFrame, key: str, vector: str, topics: DataFrame, topic: str, most_topics: int = 5000) -> DataFrame:
    """The nearest centroid of each row.  Topics are a model's, so their number is checked before the broadcast."""
    if topics.limit(most_topics + 1).count() > most_topics:
        raise ValueError("too many topics to broadcast; assign by blocks")
    listed = F.broadcast(topics.agg(F.array_sort(F.collect_list(F.struct(topic, "centroid"))).alias("_all")))
    scored = F.transform("_all", lambda t: F.struct(F.round(V.cosine_similarity(F.col(vector), t["centroid"]), 9).alias("s"), (-t[topic]).alias("k")))
    best = df.join(listed).select(key, F.array_max(scored).alias("b"))
    return best.select(key, (-F.col("b")["k"]).alias(topic), F.round(F.col("b")["s"], 6).alias("similarity"))


def class_words(docs: DataFrame, topic: str, tokens: Column) -> DataFrame:
    """(topic, word, tf): the table that all topics' weights and counts come from."""
    return docs.select(topic, F.explode(tokens).alias("word")).groupBy(topic, "word").agg(F.count(F.lit(1)).alias("tf"))


def class_weights(words: DataFrame, topic: str) -> DataFrame:
    """Class-based TF-IDF: weight of a word in a topic is tf * ln(1 + average words of a topic / frequency)."""
    whole = words.groupBy("word").agg(F.sum("tf").alias("f"))
    per_topic = words.groupBy(topic).agg(F.sum("tf").alias("total"))
    mean = F.broadcast(per_topic.agg(F.avg("total").alias("mean")))  # one row
    return words.join(whole, "word").join(per_topic, topic).join(mean).select(topic, "word", F.round(F.col("tf") / F.col("total") * F.log(1 + F.col("mean") / F.col("f")), 9).alias("weight"))


def class_keywords(docs: DataFrame, topic: str, tokens: Column, n: int) -> DataFrame:
    """The ``n`` words of the highest class-based weight in each topic.  Texts are read once, for the table of words."""
    from .stats import top_per_group

    words = Shelf(docs.sparkSession, "words").keep(class_words(docs, topic, tokens))
    return top_per_group(class_weights(words, topic), topic, "weight", "word", n)


def cosine_topk(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(q, n, similarity, rank): the ``k`` nearest rows of each query, exact, with all rows as neighbours but itself.

    Blocks of queries meet blocks of rows, each pair in a task of its own as one product of
    matrices, and only the best ``k`` of a query leave it.  Nothing is broadcast.  Ties go to the
    smaller key; rows without a valid vector are neither queries nor neighbours.
    """
    from pyspark.sql.window import Window

    kind, size = dict(df.dtypes)[key], block or BLOCK
    parts = lambda t: t.select(F.col(key).alias("_k"), F.col(vector).alias("_v")).where(V.valid_vector(F.col("_v")))
    rows, asked = parts(df), parts(queries)
    n_rows, n_asked = (-(-max(t.count(), 1) // size) for t in (rows, asked))
    slot = lambda n: F.pmod(F.xxhash64("_k"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("_k", "_v", slot(n_asked).alias("_i"), every(n_rows).alias("_j"))
    right = rows.select("_k", "_v", slot(n_rows).alias("_j"), every(n_asked).alias("_i"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "n": [], "raw": []})
        b = b.sort_values("_k")
        keys, x = b["_k"].to_numpy(), unit_rows(np.array(b["_v"].tolist(), float)).T
        own, y = a["_k"].to_numpy(), unit_rows(np.array(a["_v"].tolist(), float))
        out = []
        for at in range(0, len(own), 256):
            raw = y[at : at + 256] @ x
            raw[own[at : at + 256, None] == keys[None, :]] = -np.inf
            best = np.argsort(-np.round(raw, 6), axis=1, kind="stable")[:, :k]  # keys are sorted: ties go to the smaller
            found = np.take_along_axis(raw, best, axis=1)
            q = np.repeat(own[at : at + 256], best.shape[1])
            good = np.isfinite(found.ravel())
            out.append(pd.DataFrame({"q": q[good], "n": keys[best.ravel()[good]], "raw": found.ravel()[good]}))
        return pd.concat(out)

    near = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(run, f"q {kind}, n {kind}, raw double")
    scored = near.select("q", "n", F.round("raw", 6).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "n"))).where(F.col("rank") <= k)
