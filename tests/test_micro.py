"""Hand-written cases for rulings on odd inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.functions.stemmer import stem
from corpusloom.operators import canon, cluster, extract, flow, graph, resolve, stats
from corpusloom.sources import files, web


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


def test_clean_text_unicode(spark):
    got = one(spark, X.clean_text(F.col("t")), t="Peñón, año_2024 http://x.y www.k ² ½ ٣ fin")
    assert got == "peñón año_ ² ½ fin"
    assert one(spark, X.clean_text(F.col("t")), t=None) == "" and one(spark, X.clean_text(F.col("t")), t="") == ""


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("abÉñ 1_.²\n", max_size=20), min_size=1, max_size=20))
def test_clean_text_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.clean_text(F.col("t")).alias("a"))
    assert all(r["a"] == r["b"] for r in df.select("a", X.clean_text(F.col("a")).alias("b")).collect())


def test_stop_words_go_before_folding(spark):
    df = spark.createDataFrame([("más mas está casa él",)], "t string")
    assert df.select(X.tokenize(F.col("t")).alias("x")).first()["x"] == ["mas", "casa"]


@pytest.mark.parametrize(("word", "want"), [("corriendo", "corr"), ("ciudades", "ciudad"), ("nacionales", "nacional"), ("rápidamente", "rapid"), ("cheque", "chequ"), ("torear", "tor"), ("toro", "tor"), ("torneos", "torne")])
def test_stems(word, want):
    assert stem(word) == want


def test_keep_last_and_no_parts(spark):
    a = spark.createDataFrame([(1, "old", 0), (2, "two", 0)], "id int, v string, seq int")
    b = spark.createDataFrame([(1, "new", 1)], "id int, v string, seq int")
    assert sorted(map(tuple, flow.merge_parts([a, b], "id", "seq").select("id", "v").collect())) == [(1, "new"), (2, "two")]
    assert flow.merge_parts([], "id", "seq") is None


@pytest.mark.parametrize(("n", "w", "sizes"), [(10, 3, [3, 3, 4]), (0, 3, []), (2, 3, [1, 1])])
def test_worker_ranges(spark, n, w, sizes):
    out = flow.worker_ranges(spark.range(n), "id", w).groupBy("worker").count().orderBy("worker").collect()
    assert [r["count"] for r in out] == sizes


def test_relevance_with_numeric_classes_only(spark):
    j = spark.createDataFrame([(1, "0"), (2, "1")], "id long, llm_class string")
    assert j.where("llm_class = '1'").count() == 1


def test_parse_malformed_and_null_items(spark):
    df = spark.createDataFrame([(1, "[]", "[]", "[]"), (2, "[{", "oops", None), (3, "[null]", "[]", "[]")], "id long, entities string, relations string, events string")
    assert extract.mentions(extract.parse(df)).count() == 0


def test_unresolved_modes(spark):
    rel = spark.createDataFrame([("1__r1", 1, "e1", "e2", "x", "y", "high"), ("1__r2", 1, "e1", "e3", "x", "y", "high"), ("1__r3", 1, "e1", "e9", "x", "y", "high")], "relation_id string, id long, subject string, object string, relation string, evidence string, confidence string")
    clusters = spark.createDataFrame([("1__e1", "c1"), ("1__e2", "c1"), ("1__e3", None)], "mention_id string, cluster_id string")
    entities = spark.createDataFrame([("c1", "E1"), ("c1", "E1"), ("noise__1__e3", "E3")], "cluster_id string, entity_id string")
    kinds = spark.createDataFrame([(f"1__r{k}", "t") for k in (1, 2, 3)], "relation_id string, type_id string")
    count = lambda mode: resolve.triples(rel, resolve.mention_to_entity(clusters, entities, mode), kinds, mode).count()
    assert (count("drop"), count("keep_null"), count("singleton")) == (1, 2, 2)


def test_null_claimant_and_last_of_equal_names(spark):
    m = spark.createDataFrame([("1__a", 1, "Ana", 1), ("1__b", 1, "ANA", 2)], "mention_id string, id long, name string, seq int")
    e = spark.createDataFrame([("1__a", "E1"), ("1__b", "E2")], "mention_id string, entity_id string")
    a = spark.createDataFrame([(1, "ana", None), (1, None, "ANA")], "id long, claimant string, target string")
    got = {(r["claimant_id"], r["target_id"]) for r in resolve.link_arguments(a, m, e).collect()}
    assert got == {("E2", None), (None, "E2")}


def test_coverage_of_nothing_is_null(spark):
    none = spark.range(0)
    assert resolve.coverage(none, none, "x").first()["percent"] is None


def test_first_seen_order_and_noise(spark):
    m = spark.createDataFrame([("1__a", 1, 1, "PER", "Zoe"), ("1__b", 1, 2, "PER", "Ana"), ("2__a", 2, 1, "PER", "Zoe"), ("2__b", 2, 2, None, "Solo")], "mention_id string, id long, seq int, type string, name string")
    c = spark.createDataFrame([("1__a", "c"), ("1__b", "c"), ("2__a", "c"), ("2__b", None)], "mention_id string, cluster_id string")
    d = spark.createDataFrame([(1, "one"), (2, "two")], "id long, body string")
    got = {r["cluster_id"]: (r["type"], r["mentions"], r["contexts"]) for r in canon.linking_input(m, c, d).collect()}
    assert got == {"c": ("PER", ["Zoe", "Ana"], ["one", "one", "two"]), "noise__2__b": (None, ["Solo"], ["two"])}


def test_softmax_and_ties(spark):
    r = spark.createDataFrame([([1.0, 1.0],)], "v array<double>").select(V.softmax(F.col("v")).alias("p"), V.argmax(F.col("v")).alias("k")).first()
    assert r["p"] == [0.5, 0.5] and r["k"] == 0


def test_months_without_rows_are_absent(spark):
    df = spark.createDataFrame([("2024-01-05", "a"), ("2024-03-01", "b")], "d string, t string").select(F.to_date("d").alias("d"), "t")
    got = sorted((str(r["month"]), r["a"], r["b"]) for r in stats.monthly_pivot(df, "d", "t", ["a", "b"]).collect())
    assert got == [("2024-01-31", 1, 0), ("2024-03-31", 0, 1)]


def test_small_graph(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("x", "y", 1)], "a string, b string, weight int")
    parts = {r["node"]: r["component"] for r in graph.connected_components(graph.nodes_of(e), e).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graph.clustering_coefficient(e).first()[0] == 0.6
    assert {r["community"] for r in graph.communities(e).collect()} == {0, 1}
    path = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "a string, b string, weight int")
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(path).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_density_clusters_find_blobs(spark):
    g = np.random.default_rng(3)
    centres = np.eye(3) * 10
    rows = [(i, "g", (centres[i % 3] + g.normal(0, 0.3, 3)).tolist()) for i in range(60)] + [(99, "g", [-5.0, -5.0, -5.0]), (100, None, [1.0, 1.0, 1.0]), (101, "g", [None]), (102, "lone", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, g string, v array<double>")
    got = {r["k"]: r["cluster_id"] for r in cluster.density_clusters(df, "k", "v", F.col("g"), "c", 5).collect()}
    assert len(got) == 64 and got[100] is None and got[101] is None and got[102] is None
    for c in range(3):
        names = [got[i] for i in range(60) if i % 3 == c and got[i]]
        assert len(set(names)) == 1 and len(names) >= 15


def test_csv_quotes(spark, tmp_path):
    rows = [(1, 'say "hi",\nthen NA'), (2, "NA")]
    files.write_csv(spark.createDataFrame(rows, "id long, body string").coalesce(1), str(tmp_path / "x"))
    back = files.read_csv(spark, str(tmp_path / "x"), "id long, body string")
    assert sorted(map(tuple, back.collect())) == rows


def test_references_cut_short_are_text():
    """An ampersand is a reference's only if the name is whole and ends in a semicolon."""
    got = web.article("<article><h1>a&amp</h1><p>b&amp;&lt;c &copy; &#65; &notit; &am & d &amp;lt;</p></article>")[0]
    assert got == "a&amp b&<c © A &notit; &am & d &lt;"


def test_config_and_article():
    c = files.Config({"a": {"b": {"c": 0}}})
    assert c.get("a.b.c", 5) == 0 and c.get("a.x", 5) == 5
    body, keywords, error = web.article('<meta name="keywords" content="x, y"><nav>no</nav><article><h1>T</h1><p>One &amp; two</p><script>z</script></article>tail')
    assert (body, keywords, error) == ("T One & two", ["x", "y"], None)
    assert web.article(None)[2] == web.FAILED


def test_fetch_survives_failures(spark):
    def make():
        def get(url):
            if "bad" in url:
                raise OSError("down")
            return "<p>hi</p>", True

        return get

    got = {r["url"]: r["ok"] for r in web.fetch(spark.createDataFrame([("good",), ("bad",)], "url string"), make).collect()}
    assert got == {"good": True, "bad": False}


def test_stream_merge(spark, tmp_path):
    from corpusloom.streaming.merge import merge_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, v string, seq long"
    spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], schema).coalesce(1).write.parquet(src)
    q = merge_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp"), "id", "seq")
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{out}/v0").select("id", "v").collect())) == [(1, "b"), (2, "c")]


def test_mean_pool_shuffles_words_only(spark, monkeypatch):
    """No row for each number of a vector, and the same means whether vectors are sent to the documents or joined."""
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, "b"), (3, "z"), (4, None)], "doc int, word string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, 5.0, 6.0]), ("q", [9.0])], "word string, vector array<double>")
    want = {1: [2.0, 3.0, 6.0], 2: [0.0, 0.0], 3: [4.0, 5.0, 6.0], 4: [0.0, 0.0]}
    for listed in (cluster.LISTED, 0):
        monkeypatch.setattr(cluster, "LISTED", listed)
        out = cluster.mean_pool(tokens, "doc", "word", vectors, 2)
        assert {r["doc"]: r["vector"] for r in out.collect()} == want
        assert "posexplode" not in out._jdf.queryExecution().toString().lower()


def test_workers_get_batches_bounded_by_bytes(spark, tmp_path):
    """Long texts come to a backend in several batches."""
    from corpusloom.sources import adapters

    spark.range(40).select("id", F.repeat(F.lit("x"), 200_000).alias("text")).coalesce(1).write.parquet(str(tmp_path / "long.parquet"))
    sizes = adapters.table(spark, str(tmp_path), "long").mapInPandas(lambda batches: (b.assign(n=len(b))[["n"]].head(1) for b in batches), "n int").collect()
    assert sum(r["n"] for r in sizes) == 40 and max(r["n"] for r in sizes) <= 10


def test_a_worker_keeps_a_bounded_number_of_stems():
    from corpusloom.functions import stemmer

    stems = stemmer._Stems()
    for k in range(stemmer.STEMS + 10):
        stems[f"w{k}"]
    assert len(stems) <= stemmer.STEMS and not hasattr(stemmer.stem, "cache_info")
