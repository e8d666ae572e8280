"""Graph measures beyond one task against their small-graph paths."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, sketches


def planted(spark, seed=3, groups=5, size=14):
    g = random.Random(seed)
    edges = {(f"n{a:03d}", f"n{b:03d}") for a, b in combinations(range(groups * size), 2) if g.random() < (0.6 if a // size == b // size else 0.02)}
    return spark.createDataFrame(sorted(edges), "a string, b string").cache()


def rows(df):
    return {r[0]: r[1] for r in df.collect()}


def test_betweenness_by_levels(spark, monkeypatch):
    edges = planted(spark, groups=3, size=9).union(spark.createDataFrame([("x", "y"), ("y", "z")], "a string, b string"))
    want = rows(graph.betweenness(edges))
    monkeypatch.setattr(graph, "SMALL_EDGES", 5)
    for block_rows in (10**9, 400):  # one block, some blocks of sources
        assert rows(graph.betweenness(edges, block_rows=block_rows)) == pytest.approx(want, abs=2e-6)


def test_betweenness_of_a_graph_above_the_limit(spark):
    """70,000 paths of four nodes: 210,000 edges."""
    ids = spark.range(70_000)
    edges = ids.select(F.explode(F.array(*(F.struct((F.col("id") * 4 + i).alias("a"), (F.col("id") * 4 + i + 1).alias("b")) for i in range(3)))).alias("e")).select("e.*")
    assert edges.count() > graph.SMALL_EDGES
    owed = graph._owed_by_levels(edges, 10**12).groupBy("node").agg(F.sum("owed").alias("o"))
    assert owed.count() == 280_000 and owed.where("o <> if(node % 4 in (1, 2), 4.0, 0.0)").isEmpty()


def test_communities_by_rounds(spark, monkeypatch):
    for seed in (3,):
        edges = planted(spark, seed)
        whole = graph.communities(edges)
        monkeypatch.setattr(graph, "SMALL_EDGES", 5)
        many = graph.communities(edges)
        monkeypatch.undo()
        assert graph.modularity(edges, many) >= graph.modularity(edges, whole) - 1e-9
        assert len({(v, rows(many)[k]) for k, v in rows(whole).items()}) == len(set(rows(whole).values()))
    ties = spark.createDataFrame([(f"{k:02d}", f"{k + 1:02d}") for k in range(40)], "a string, b string")  # a chain of equal gains
    assert graph.communities_by_rounds(ties).count() == 41 and graph.communities_by_rounds(ties.limit(0)).count() == 0


def hops(pairs):
    """(reached, total distance) of each node by breadth-first search."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        seen, line = {s: 0}, [s]
        for v in line:
            for w in near[v]:
                if w not in seen:
                    seen[w] = seen[v] + 1
                    line.append(w)
        out[s] = len(seen) - 1, sum(seen.values())
    return out


def test_sketched_closeness_counts_small_graphs_exactly(spark):
    edges = planted(spark).union(spark.createDataFrame([("x", "y"), ("y", "z"), ("y", "x"), ("w", "w"), ("x", None)], "a string, b string"))
    got = {r["node"]: r for r in graph.sketched_closeness(edges).collect()}
    clean = edges.where("b is not null").distinct()
    want = hops([(r["a"], r["b"]) for r in clean.collect()])
    assert {k: (r["reached"], r["total"]) for k, r in got.items()} == want
    same = rows(graph.closeness_centrality(planted(spark)))
    alone = {r["node"]: r["closeness"] for r in graph.sketched_closeness(planted(spark)).collect()}
    assert alone == pytest.approx(same, abs=1e-6) and got["w"]["closeness"] == 0
    assert graph.sketched_closeness(edges.limit(0)).count() == 0


def test_sketched_closeness_keeps_its_error(spark):
    """3,000 nodes, a hub among a third of them, and a chain of 7."""
    g = random.Random(5)
    pairs = {(f"n{g.randrange(min(k, 40)):04d}", f"n{k:04d}") for k in range(1, 3000)} | {("n0000", f"n{k:04d}") for k in range(1000, 2000)}
    pairs |= {(f"x{k:02d}", f"x{k + 1:02d}") for k in range(7)}
    want = hops(pairs)
    got = graph.sketched_closeness(spark.createDataFrame(sorted(pairs), "a string, b string")).collect()
    assert len(got) == len(want)
    for r in got:
        reached, total = want[r["node"]]
        assert r["reached"] == pytest.approx(reached, rel=0.06) and r["total"] == pytest.approx(total, rel=0.12)
    assert sum(abs(r["total"] / want[r["node"]][1] - 1) for r in got) / len(got) < 0.03
    few = graph.sketched_closeness(spark.createDataFrame(sorted(pairs), "a string, b string"), lg_registers=6).collect()
    assert sum(abs(r["reached"] / want[r["node"]][0] - 1) for r in few) / len(few) < 0.2


def test_sketches_by_blocks_count_as_those_along_edges(spark, monkeypatch):
    """Nodes of some hundred neighbours, three parts, a chain, a node alone: a row a node and block moves, not a row an edge."""
    g = random.Random(6)
    pairs = {(f"p{k % 3}-{k:04d}", f"s{k % 3}-{g.randrange(30):02d}") for k in range(1500) for _ in range(4)}
    pairs |= {(f"x{k:02d}", f"x{k + 1:02d}") for k in range(5)} | {("x03", "x02"), ("w", "w"), ("w", None)}
    edges = spark.createDataFrame(sorted(pairs, key=str), "a string, b string")
    along = {r["node"]: r for r in graph.sketched_closeness(edges).collect()}
    monkeypatch.setattr(graph, "SMALL_EDGES", 5)
    monkeypatch.setattr(sketches, "BAND_BYTES", 4 << 20)  # two bands
    monkeypatch.setattr(sketches, "BLOCK_EDGES", 2000)
    sent = []
    monkeypatch.setattr(graph, "both_ways", sent.append)  # what sends along edges
    got = {r["node"]: r for r in graph.sketched_closeness(edges).collect()}
    want = hops([p for p in pairs if p[1]])
    assert not sent and got.keys() == want.keys()
    for k, r in got.items():
        if k[0] in "xw":
            assert (r["reached"], r["total"]) == want[k]
        assert r["reached"] == pytest.approx(want[k][0], rel=0.06) and r["total"] == pytest.approx(want[k][1], rel=0.12)
        assert r["closeness"] == pytest.approx(along[k]["closeness"], rel=0.03)


def test_triangles_of_a_hub(spark):
    spokes = [("hub", f"n{k:03d}") for k in range(300)] + [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(0, 300, 2)]
    edges = spark.createDataFrame([tuple(sorted(e)) for e in spokes], "a string, b string")
    want = (300 * 1.0 + 150 / (300 * 299 / 2)) / 301
    assert graph.clustering_coefficient(edges).first()[0] == pytest.approx(want, abs=1e-6)
