"""Operators that do the whole job, against independent brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import QUERIES
from corpusloom.operators import cluster, graph

SF = "/root/testdata/sf0.001"


def parts_of(keys, links):
    near = {k: set() for k in keys}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for k in sorted(keys):
        todo = [k] if k not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = k
                todo += near[x]
    return out


def vectors_of(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def links_of(keys, x, above):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T > above, 1))
    return [(keys[i], keys[j]) for i, j in zip(a, b)]


# -- single linkage components ---------------------------------------------------


def test_components_of_all_similar_pairs(spark):
    keys, x = vectors_of(spark, "/root/testdata/sf0.01")
    links = links_of(keys, x, 0.35)
    assert len(links) == 271
    got = {r["node"]: r["component"] for r in QUERIES["single_linkage_components"](spark, "/root/testdata/sf0.01").collect()}
    assert got == parts_of(keys, links) and len(set(got.values())) == 237


@pytest.mark.parametrize("block", [7, 100, 5000])
def test_similar_links_in_blocks(spark, block):
    keys, x = vectors_of(spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = rows.where("vec_id < 60").unionByName(rows.where("vec_id < 9").withColumn("vec_id", F.col("vec_id") + 1000))
    few = [k for k in keys if k < 60]
    keys2, x2 = few + [k + 1000 for k in few if k < 9], np.concatenate([x[: len(few)], x[: len([k for k in few if k < 9])]])
    got = [(r["a"], r["b"]) for r in cluster.similar_links(rows, "vec_id", "embedding", 0.3, block).collect()]
    assert parts_of(keys2, got) == parts_of(keys2, links_of(keys2, x2, 0.3))


# -- density clusters ------------------------------------------------------------


def test_large_groups_are_clustered_whole(spark, monkeypatch):
    g = np.random.default_rng(5)
    x = np.concatenate([c + g.normal(0, 0.05, (40, 6)) for c in g.normal(0, 1, (6, 6))] + [g.normal(0, 1, (50, 6)), np.tile(g.normal(0, 1, 6), (30, 1))])
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], "hot" if i % 3 else "cold") for i in g.permutation(len(x)).tolist()], "k long, v array<double>, g string")
    labels = lambda: {r["k"]: r["cluster_id"] for r in cluster.density_clusters(rows, "k", "v", F.col("g"), "c", 2).collect()}
    want = labels()
    monkeypatch.setattr(cluster, "LARGEST_GROUP", 120)
    monkeypatch.setattr(cluster, "BLOCK", 45)
    assert labels() == want and len(set(want.values())) > 5 and len(want) == len(x)


# -- models ----------------------------------------------------------------------


def test_word_vectors_of_reference_size(spark):
    from corpusloom.operators import models

    assert models.word_vectors.__defaults__ == (100, 5, 2, 10, 42)
    rows = QUERIES["word2vec"](spark, SF)
    assert rows.count() > 300 and rows.where(F.size("vector") != 100).isEmpty()


def test_topic_models_of_reference_size(spark, monkeypatch):
    from corpusloom.operators import models

    seen = {}
    for name in ("lda", "nmf"):
        monkeypatch.setattr(models, name, lambda matrix, id_col, topics, name=name, **more: seen.update({name: (matrix, more)}))
        QUERIES[name](spark, SF)
    vocabulary = {name: matrix.schema["weights"].metadata.get("ml_attr", {}).get("num_attrs") or matrix.first()["weights"].size for name, (matrix, _) in seen.items()}
    assert vocabulary["lda"] == 1000 and vocabulary["nmf"] > 300
    assert seen["lda"][1] == {"column": "weights"} and seen["nmf"][1] == {}


def test_nmf_runs_until_it_settles(spark):
    from pyspark.ml.linalg import Vectors

    from corpusloom.operators import models

    g = np.random.default_rng(1)
    w = g.random((60, 3)) @ g.random((3, 20))
    rows = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(w)], ["id", "weights"])
    f = np.array([r["topics"] for r in models.nmf(rows, "id", 3).orderBy("id").collect()])
    left = w - f @ np.linalg.lstsq(f, w, rcond=None)[0]
    assert np.linalg.norm(left) < 0.06 * np.linalg.norm(w)


# -- graph metrics ---------------------------------------------------------------


def test_long_paths_and_limits(spark):
    path = spark.createDataFrame([(k, k + 1, 1) for k in range(33)], "a int, b int, weight int").coalesce(1)
    assert graph.shortest_paths(path).agg(F.max("d")).first()[0] == 33
    with pytest.raises(RuntimeError):
        graph.shortest_paths(path, 2)
    with pytest.raises(RuntimeError):
        graph.eigenvector_centrality(path, 2)
