"""Density clusters of large groups against the one-task path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cluster, density
from corpusloom.operators.tables import Shelf


def planted(seed, dims=6, blobs=7, rows=90, noise=60, spread=0.06):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(blobs, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.concatenate([c + g.normal(0, spread, (rows, dims)) for c in centres] + [g.normal(size=(noise, dims))])
    x[5:25] = x[4]  # copies
    return x


def groups_of(labels):
    out = {}
    for k, v in labels.items():
        out.setdefault(v, set()).add(k)
    return out


@pytest.mark.parametrize("metric,samples,least", [("cosine", 1, 2), ("euclidean", 3, 10)])
def test_large_groups_get_the_labels_of_one_task(spark, monkeypatch, metric, samples, least):
    x = planted(3)
    df = spark.createDataFrame([(k, v.tolist(), "g" if k % 9 else "h") for k, v in enumerate(x)] + [(10_000, None, "g"), (10_001, [1.0] * 6, None)], "k long, v array<double>, g string").repartition(5)
    labels = lambda probes=8: {r["k"]: r["cluster_id"] for r in cluster.density_clusters(df, "k", "v", F.col("g"), "c", least, metric, samples, probes).collect()}
    whole = labels()
    for name, value in (("BLOCK", 64), ("EDGES", 300)):
        monkeypatch.setattr(density, name, value)
    monkeypatch.setattr(cluster, "LARGEST_GROUP", 50)
    assert labels(probes=1000) == whole and len(set(whole.values())) > 5  # every cell: exact
    if samples == 1:
        few = labels()
        assert few.keys() == whole.keys() and sum(few[k] == whole[k] for k in whole) >= 0.98 * len(whole)


@pytest.mark.parametrize("samples", [1, 4])
def test_spanning_tree_weight(spark, monkeypatch, samples):
    """Two far parts, more copies than neighbours, and rounds of joins down to few edges."""
    g = np.random.default_rng(8)
    x = np.concatenate([g.normal(0, 1, (150, 3)), g.normal(40, 1, (120, 3)), np.ones((40, 3))])
    rows = spark.createDataFrame([(k, "a", v.tolist()) for k, v in enumerate(x)], "_key long, _group string, _v array<double>")
    monkeypatch.setattr(density, "BLOCK", 32)
    shelf = Shelf(spark, "test")
    tree, core = density.density_tree(rows, shelf, "euclidean", samples, most=100)
    got = tree.toPandas()
    want = cluster.single_linkage(x, "euclidean", samples)
    assert len(got) == len(x) - 1 and np.allclose(np.sort(got["w"]), np.sort(want[0]), atol=1e-9)
    cores = dict(core.collect())
    exact = cluster.core_distances(x, "euclidean", samples)
    if samples > 1:
        assert all(abs(cores[k] - exact[k]) < 1e-9 for k in range(len(x)))
    shelf.clear()


def test_many_parts_meet_by_their_centres(spark, monkeypatch):
    monkeypatch.setattr(density, "PARTS", 5)
    g = np.random.default_rng(2)
    x = np.concatenate([c * 30 + g.normal(0, 0.5, (20, 2)) for c in np.stack(np.meshgrid(range(4), range(3)), -1).reshape(-1, 2)])
    rows = spark.createDataFrame([(k, "a", v.tolist()) for k, v in enumerate(x)], "_key long, _group string, _v array<double>")
    tree, _ = density.density_tree(rows, Shelf(spark, "test"), "euclidean")
    want = cluster.single_linkage(x, "euclidean")
    assert np.allclose(np.sort(tree.toPandas()["w"]), np.sort(want[0]), atol=1e-9)


def test_neighbours_have_their_recall(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 100)
    x = planted(1, dims=24, blobs=12, rows=120, noise=300, spread=0.2)
    rows = spark.createDataFrame([(k, "a" if k % 3 else "b", v.tolist()) for k, v in enumerate(x)], "_key long, _group string, _v array<double>")
    sizes = {r[0]: r[1] for r in rows.groupBy("_group").count().collect()}
    found = density.neighbours(rows, sizes, 10).cache()
    assert density.recall(found, rows, 10, every=10) >= 0.9
    assert found.groupBy("a").count().where("count <> 10").isEmpty()


def test_rounds_leave_only_their_edges(spark):
    """Tables of a round go when the next has its own, and cells are looked up without shuffling vectors twice."""
    import os

    g = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, "all", (g.normal(size=8) + 3 * (k % 40)).tolist()) for k in range(400)], "_key long, _group string, _v array<double>")
    shelf = Shelf(spark, "rounds")
    tree, _ = density.density_tree(rows, shelf, "euclidean", k=3)
    assert tree.count() == 399
    edges = sum(set(spark.read.parquet(f"{shelf.path}/{t}").columns) >= {"far", "p"} for t in os.listdir(shelf.path) if os.path.isdir(f"{shelf.path}/{t}"))
    assert edges == 1  # the last round's open edges
    found = density.neighbours(rows, {"all": 400}, 3, "euclidean")
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2


def test_later_cells_list_only_what_is_near_enough(spark, monkeypatch):
    """All rows in every cell give the true neighbours, but the lists that are shuffled are not as long as cells times k."""
    x = np.random.default_rng(5).normal(size=(600, 3)).astype("float32")
    rows = spark.createDataFrame([(f"r{i:03}", "all", v.tolist()) for i, v in enumerate(x)], "_key string, _group string, _v array<float>")
    kept, keep = [], Shelf.keep
    monkeypatch.setattr(Shelf, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    monkeypatch.setattr(density, "BLOCK", 20)
    found = density.neighbours(rows, {"all": 600}, 5, "euclidean", probes=1000).toPandas()
    d = np.linalg.norm(x[:, None].astype(float) - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(f"r{i:03}", f"r{j:03}") for i, row in enumerate(d) for j in row.argsort()[:5]}
    assert set(zip(found["a"], found["n"])) == want and len(found) == len(want)
    lists = [t for t in kept if t.columns == ["_group", "a", "n", "d"]]
    assert len(lists) == 2 and sum(t.agg(F.sum(F.size("n"))).first()[0] for t in lists) < 0.6 * 600 * 5 * len(density.pivots_of(rows, {"all": 600}, "euclidean")["all"])
    assert dict(lists[0].dtypes)["d"] == "array<double>" and [t for t in kept if "_cells" in t.columns][0].schema["_v"].dataType.elementType.simpleString() == "float"
