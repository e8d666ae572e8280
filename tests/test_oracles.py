"""Every query with an SQL twin against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or pd.isna(v):
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stems_of_whole_texts(spark):
    """Every word as a word-to-stem table has it, in its place."""
    from corpusloom.functions.stemmer import stem

    got = {r[0]: r[1] for r in QUERIES["tokenize_stem"](spark, SF).collect()}
    plain = {r[0]: r[1].split() for r in QUERIES["tokenize_nostem"](spark, SF).collect()}
    table = {w: stem(w) for w in {w for words in plain.values() for w in words}}
    assert got.keys() == plain.keys() and all(got[k].split() == [table[w] for w in words] for k, words in plain.items())


def test_articles_are_whole(spark):
    rows = QUERIES["article_extract"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and sum(len(r["body"] or "") > 100 for r in rows) > len(rows) / 2


def test_hdbscan_clusters_by_brute_force(spark):
    from corpusloom.operators.cluster import density_labels

    got = {r["vec_id"]: r["cluster_id"] for r in QUERIES["hdbscan_clusters"](spark, SF).collect()}
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    assert got.keys() == set(e["vec_id"])
    for _, own in e.groupby("label"):
        labels = density_labels(np.array(own["embedding"].tolist(), float), 2)
        pairs = {(lab, got[k]) for lab, k in zip(labels.tolist(), own["vec_id"])}
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs) and all((a < 0) == (b is None) for a, b in pairs)


def test_network_queries(spark):
    edges = {(r["a"], r["b"]) for r in QUERIES["edge_widths"](spark, SF).collect()}
    nodes = {n for e in edges for n in e}
    for name in ("betweenness", "communities"):
        rows = QUERIES[name](spark, SF).collect()
        assert {r["node"] for r in rows} == nodes
    assert all(0 <= r["betweenness"] <= 1 for r in QUERIES["betweenness"](spark, SF).collect())


def test_projections(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    got = QUERIES["pca"](spark, SF).toPandas()
    x = got.select_dtypes("number").drop(columns=[c for c in got.columns if c.endswith("_id")]).to_numpy()
    assert len(got) == e and abs(np.corrcoef(x[:, :2].T)[0, 1]) < 1e-6 and x[:, 0].var() >= x[:, 1].var()
    assert QUERIES["lsa"](spark, SF).count() > 0


def test_hashed_embeddings(spark):
    rows = QUERIES["hashed_embeddings"](spark, SF).collect()
    sizes = [np.linalg.norm(r["embedding"]) for r in rows]
    assert len(rows) == len({r["id"] for r in rows}) > 0 and all(abs(s - 1) < 1e-5 or s == 0 for s in sizes) and max(sizes) > 0


def test_embedded_clusters_keep_equal_names_together(spark):
    from corpusloom.plans.queries import _Graph

    g = _Graph(spark, SF, embedded=True)
    rows = g.mentions.join(g.clusters, "mention_id").select("type", "name", "cluster_id", "mention_id").toPandas()
    assert len(rows) == g.mentions.count()
    assert rows.groupby(["type", "name"])["cluster_id"].nunique(dropna=False).max() == 1 and rows["cluster_id"].nunique() > 5
    triples = QUERIES["graph_triples_embedded"](spark, SF)
    assert triples.columns == QUERIES["graph_triples_keep_null"](spark, SF).columns and 0 < triples.count() <= g.relations.count()
    by_body = QUERIES["mention_type_clusters"](spark, SF).toPandas()
    assert len(by_body) == len(rows) and set(by_body["mention_id"]) == set(rows["mention_id"])


def test_document_vectors(spark):
    rows = QUERIES["document_vectors"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/benchmark.parquet").count() and all(len(r["vector"]) == 100 for r in rows)


def test_windowed_counts_and_small_readers(spark, tmp_path):
    from corpusloom.sources import files, web
    from corpusloom.streaming import merge

    events = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a"), ("2024-01-01 00:11:00", "b")], "t string, k string").selectExpr("cast(t as timestamp) as t", "k")
    got = {(str(r["start"]), r["k"]): r["n"] for r in merge.windowed_counts(events, "t", "k", "10 minutes", "1 hour").collect()}
    assert got == {("2024-01-01 00:00:00", "a"): 2, ("2024-01-01 00:10:00", "b"): 1}
    files.save_json([{"x": 1, "y": "é"}, {"x": None, "y": "z"}], str(tmp_path / "a.json"))
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "a.json"), "x int, y string").collect()] == [(1, "é"), (None, "z")]
    text = spark.createDataFrame([("a\n\nb\nc",), (None,)], "t string")
    assert [r[0] for r in text.select(web.collapse_blank_lines(F.col("t"))).collect()] == ["a b\nc", None]


@pytest.mark.parametrize("shuffle", [16])
def test_places_at_a_larger_size(spark, shuffle):
    """More rows in a range than a sample holds: every place once, as the SQL twin numbers them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        from corpusloom.operators.align import numbered

        orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").repartition(7)
        n = orders.count()
        got = numbered(orders, ["o_orderdate", "o_orderkey"], "p").agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
        assert tuple(got) == (n, 0, n - 1)
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.1/{t}.parquet'")
        assert rows(QUERIES["positional_alignment"](spark, "/root/testdata/sf0.1").toPandas()) == rows(con.sql(ORACLES["positional_alignment"]).df())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["subject", "relation_type_id", "object", "doc_id", "confidence", "evidence"]
