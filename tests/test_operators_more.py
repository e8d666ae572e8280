"""Providers, scraper, alignment, graphs, topics, models and the experiment, on hand-written cases."""

import itertools
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.functions import text as X
from corpusloom.operators import align, canon, chat, cluster, extract, flow, graph, models, resolve, topics
from corpusloom.plans.experiment import Experiment, analyse_network, setup_logging
from corpusloom.sources import files, graphs, web
from corpusloom.sources.files import Config

SF = "/root/testdata/sf0.001"


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string")


# -- providers ------------------------------------------------------------------


def test_fenced_answers_and_pacing():
    calls = []

    def connect():
        def send(system, prompt, schema):
            calls.append(prompt)
            return '```json\n{"canonical": "A", "is_new": true}\n```'

        return send

    ask = chat.text_api(connect, pause=0.01).open()
    assert ask("s", "p", chat.LINK) == {"canonical": "A", "is_new": True} and calls == ["p"]
    with pytest.raises(ValueError):
        chat.local_model(connect).open()("s", "p", chat.LINK)  # a fence isn't JSON


@pytest.mark.parametrize(("value", "schema"), [({"canonical": "x"}, chat.LINK), ({"canonical": 1, "is_new": True}, chat.LINK), ({"classification": "2", "reason": "", "company": ""}, chat.JUDGEMENT), ({"frames": [{"frame": "x"}]}, chat.FRAMING), ([], chat.LINK)])
def test_answers_that_break_their_schema(value, schema):
    with pytest.raises(ValueError):
        chat.check(value, schema)


def test_null_fields_of_arguments_are_allowed():
    chat.check({"arguments": [{"sentence": "s", "claimant": None, "argument_type": "t", "target": None}]}, chat.ARGUMENTS)


def test_failures_stay_with_their_row(spark):
    def connect():
        def send(system, prompt, schema):
            if "bad" in prompt:
                raise OSError("down")
            return {"classification": "1", "reason": "two\nlines", "company": ""}

        return send

    got = flow.run_backend(bodies(spark, "good", "bad", None), lambda: chat.Judge(chat.object_api(connect, pause=0)), chat.Judge.schema)
    assert {r["id"]: (r["llm_class"], r["llm_reason"], r["error"]) for r in got.collect()} == {0: ("1", "two lines", None), 1: ("ERROR", "down", "down"), 2: ("1", "two lines", None)}


def test_extractor_failures_are_empty_lists_and_miner_leaves_out_nothing_found(spark):
    broken = chat.local_model(lambda: lambda s, p, k: "{oops")
    got = flow.run_backend(bodies(spark, "x"), lambda: chat.Extractor(broken), chat.Extractor.schema).first()
    assert (got["entities"], got["relations"], got["events"]) == ("[]", "[]", "[]") and got["error"]
    none = chat.local_model(lambda: lambda s, p, k: '{"arguments": []}')
    assert flow.run_backend(bodies(spark, "x"), lambda: chat.Miner(none), chat.Miner.schema).count() == 0
    failed = flow.run_backend(bodies(spark, "x"), lambda: chat.Miner(broken), chat.Miner.schema)
    assert failed.count() == 1 and flow.drop_failed(failed).count() == 0


def test_framer_takes_the_last_of_a_frame_and_nulls_on_failure(spark):
    twice = chat.local_model(lambda: lambda s, p, k: json.dumps({"frames": [{"frame": "problem", "present": True, "evidence": "z"}, {"frame": "problem", "present": False, "evidence": "a"}]}))
    got = flow.run_backend(bodies(spark, "x"), lambda: chat.Framer(twice), chat.Framer.schema).first()
    assert (got["frame_problem"], got["frame_problem_evidence"], got["frame_solution"]) == (False, "a", None)


def test_links_are_looked_up_only_for_known_entities(spark):
    inputs = spark.createDataFrame([("c1", "PER", ["Ana", "Ana M"], ["body"]), ("c2", None, ["Bobs"], [])], "cluster_id string, type string, mentions array<string>, contexts array<string>")
    known = spark.createDataFrame([("ana m", "Q1"), ("bobs", "Q2")], "name string, wikidata_id string")
    got = {r["cluster_id"]: (r["canonical"], r["wikidata_id"], r["is_new"]) for r in canon.link_entities(canon.link_prompt(inputs), chat.local_model(lambda: chat.link_rules), known).collect()}
    assert got == {"c1": ("Ana M", "Q1", False), "c2": ("Bobs", None, True)}


def test_type_names_and_failed_clusters(spark):
    inputs = spark.createDataFrame([("c1", ["opone", "opo"], ["e"]), ("c2", [], None)], "cluster_id string, relations array<string>, evidences array<string>")
    got = canon.name_types(canon.relation_prompt(inputs), lambda: chat.RelationNamer(chat.local_model(lambda: chat.relation_rules)), "rt_").collect()
    assert [(r["cluster_id"], r["canonical"]) for r in got if r["cluster_id"] == "c1"] == [("c1", "OPO_A")] and all(r["type_id"].startswith("rt_") for r in got)


def test_validation_of_all_lists(spark):
    rows = [(1, "[]", '[{"frame": "problem", "present": true, "evidence": ""}]', '[{"sentence": "s", "claimant": null, "argument_type": "t"}]'), (2, None, '[{"frame": "other", "present": true, "evidence": ""}]', "[{}]"), (3, "[null]", "x", "[]")]
    df = spark.createDataFrame(rows, "id long, entities string, frames string, arguments string")
    got = {(r["id"], r["kind"]): r["error"] for r in extract.validate_lists(df, ["entities", "frames", "arguments"]).collect()}
    assert got == {(1, "entities"): None, (1, "frames"): None, (1, "arguments"): None, (2, "entities"): "malformed", (2, "frames"): "invalid", (2, "arguments"): "invalid", (3, "entities"): "invalid", (3, "frames"): "malformed", (3, "arguments"): None}


def test_the_last_of_equal_clusters_counts(spark):
    clusters = spark.createDataFrame([("m", "c")], "mention_id string, cluster_id string")
    entities = spark.createDataFrame([("c", "Z", 1), ("c", "A", 2)], "cluster_id string, entity_id string, seq int")
    assert resolve.mention_to_entity(clusters, entities).first()["entity_id"] == "A"


# -- scraper --------------------------------------------------------------------


@pytest.mark.parametrize(("status", "header", "content", "want"), [(200, "text/html; charset=latin-1", "ñ".encode("latin-1"), "ñ"), (200, "text/html", b"x", None), (404, "text/html; charset=utf-8", b"x", None), (200, "application/pdf; charset=utf-8", b"x", None), (200, "text/html; charset=utf-8", b"\xff", None), (200, "text/html; charset=nope", b"x", None)])
def test_which_responses_count(status, header, content, want):
    assert web.decoded((status, header, content)) == want


def test_scraper_over_a_local_server(spark):
    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.path != "/gone"
            self.send_response(200 if ok else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(f"<article><p>{self.path}</p></article>".encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(1, "m", "d", "t", f"{at}/live"), (2, "m", "d", "t", f"{at}/gone"), (3, "m", "d", "t", "nowhere:1"), (4, None, None, None, None)], "id long, media_name string, publish_date string, title string, url string")

    def connect():
        return web.http_get(timeout=5, pause=(0, 0)), lambda url: iter([f"{at}/gone", f"{at}/old"] if url.endswith("/gone") else [])

    got = {r["id"]: (r["body"], r["error"]) for r in web.scrape(rows, connect).collect()}
    server.shutdown()
    assert got == {1: ("/live", None), 2: ("/old", None), 3: (None, web.FAILED), 4: (None, web.FAILED)}


def test_first_response_that_decodes(spark):
    rows = [("u", 0, 200, "text/html; charset=utf-8", b"\xff"), ("u", 1, 200, "text/html; charset=utf-8", b"yes"), ("v", 0, 500, "text/html; charset=utf-8", b"no")]
    df = spark.createDataFrame(rows, "url string, attempt_no int, status int, content_type string, content binary")
    assert {r["url"]: (r["attempt_no"], r["html"]) for r in web.pick_response(df).collect()} == {"u": (1, "yes"), "v": (None, None)}


# -- columns, alignment, text -----------------------------------------------------


def test_columns_and_paths(spark):
    df = spark.createDataFrame([(1, 2, 3)], "actor_a int, actor_b int, other int")
    assert C.with_prefix(df, "actor_") == ["actor_a", "actor_b"] and C.panel(df, "x, other ,actor_a,actor_b") == ["other", "actor_a"]
    assert C.worker_path("a/b.csv", 3) == "a/b_worker3.csv" and C.beside("a/b.csv", "_labels", ".json") == "a/b_labels.json"
    p = spark.createDataFrame([("a/b.tar.gz",), ("a/.rc",), ("plain",)], "p string")
    assert [tuple(r) for r in p.select(C.file_name(F.col("p")), C.file_stem(F.col("p"))).collect()] == [("b.tar.gz", "b.tar"), (".rc", ".rc"), ("plain", "plain")]


def test_alignment_by_position(spark):
    a = spark.createDataFrame([(k, f"a{k}") for k in range(50)], "k long, x string").orderBy(F.rand(1))
    b = spark.createDataFrame([(k * 2, f"b{k}") for k in range(30)], "j long, y string").orderBy(F.rand(2))
    got = {r["k"]: r["y"] for r in align.by_position(a, b, ["k"], ["j"], ["y"]).collect()}
    assert got == {k: f"b{k}" if k < 30 else None for k in range(50)}
    assert align.by_position(a.limit(0), b, ["k"], ["j"], ["y"]).count() == 0


def test_stop_words_and_folding():
    assert {"estuviéramos", "habríais", "tuvieseis", "fuésemos", "serán", "nosotros"} <= set(X.STOP_WORDS)
    fold = dict(zip(X.ACCENTED, X.PLAIN))
    assert fold["ñ"] == "n" and fold["ő"] == "o" and fold["ø"] == "o" and fold["ễ"] == "e" and "ß" not in fold


def test_process_and_bigrams(spark):
    r = X.process(spark.createDataFrame([("Las Ciudades grandes 12",), (None,)], "body string")).collect()
    assert (r[0]["clean_text"], r[0]["tokens"], r[0]["processed_text"]) == ("las ciudades grandes ", ["ciudad", "grand"], "ciudad grand") and r[1]["tokens"] == []
    t = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>").select(X.with_bigrams(F.col("t")).alias("x")).collect()
    assert [x["x"] for x in t] == [["a", "b", "c", "a b", "b c"], ["a"], []]


# -- vectors, topics, models --------------------------------------------------------


def test_nearest_rows_against_brute_force(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(120, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, [None])], "k long, v array<double>")
    got = {(r["q"], r["rank"]): r["n"] for r in cluster.cosine_topk(df, "k", "v", df.where("k % 10 = 3"), 3, block=50).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3, 120, 10):
        s = np.round(u @ u[q], 6)
        want = sorted((k for k in range(120) if k != q), key=lambda k: (-s[k], k))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == want
    assert len(got) == 36


def test_topics_of_planted_blobs(spark):
    g = np.random.default_rng(1)
    vectors = [(k, (np.eye(8)[k % 2] * 10 + g.normal(0, 0.2, 8)).tolist()) for k in range(60)]
    docs = spark.createDataFrame([(k, "cobre mina" if k % 2 else "lluvia campo") for k in range(60)] + [(99, "nada solo")], "id long, body string")
    found = topics.fit_topics(docs, "id", spark.createDataFrame(vectors, "id long, embedding array<double>"), 5, 10).cache()
    at = {r["id"]: r["topic_id"] for r in found.collect()}
    assert len(at) == 61 and at[99] == topics.OUTLIER
    for side in (0, 1):
        assert len({at[k] for k in range(60) if k % 2 == side} - {topics.OUTLIER}) == 1
    table = {r["topic_id"]: r for r in topics.topic_keywords(docs, "id", found, F.split("body", " ")).collect()}
    assert topics.OUTLIER not in table and set(table[at[1]]["keywords"]) == {"cobre", "mina"} and table[at[1]]["label"] is None
    report = topics.outliers(found).first()
    assert report["n"] == 61 and report["n_outliers"] == sum(v == -1 for v in at.values()) and topics.outliers(found.limit(0)).first()["share"] is None


def word_docs(spark, n=40):
    words = [f"w{k}" for k in range(12)]
    g = np.random.default_rng(2)
    return spark.createDataFrame([(k, [words[(k % 2) * 6 + i] for i in g.integers(0, 6, 20)]) for k in range(n)], "id long, tokens array<string>").cache()


def test_factors_of_topic_models(spark):
    docs = word_docs(spark)
    got = models.fit_all(docs, "id", "tokens", 2)
    assert set(got) == {"lda", "nmf", "lsa"}
    nmf = {r["id"]: r["topics"] for r in got["nmf"].collect()}
    assert len(nmf) == 40 and all(min(t) >= 0 for t in nmf.values())
    assert len({int(np.argmax(nmf[k])) for k in range(0, 40, 2)}) == 1 and np.argmax(nmf[0]) != np.argmax(nmf[1])
    assert all(abs(sum(r["topics"]) - 1) < 1e-6 for r in got["lda"].collect())
    m = models.tf_idf(models.term_matrix(docs, "tokens", bigrams=True)[0])
    dense = {r["id"]: np.array(r["weights"].toArray()) for r in m.select("id", "weights").collect()}
    want = np.linalg.svd(np.array([dense[k] for k in range(40)]), full_matrices=False)
    lsa = {r["id"]: r["topics"] for r in got["lsa"].collect()}
    assert np.allclose(np.abs([lsa[k] for k in range(40)]), np.abs(want[0][:, :2] * want[1][:2]), atol=1e-6)


def test_principal_coordinates_against_numpy(spark):
    x = np.random.default_rng(4).normal(size=(50, 6)) * [5, 3, 1, 1, 1, 1]
    got = {r["k"]: (r["x1"], r["x2"]) for r in models.pca(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>"), "k", "v").collect()}
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs([got[k] for k in range(50)]), np.abs(x @ axes), atol=1e-5)


def test_searches(spark):
    docs = word_docs(spark)
    best, size = models.search_word_vectors(docs, "tokens", trials=20)
    assert size == 12 and set(best) == set(models.WORD_SPACE)
    space = {"topics": [2, 3], "least": [2], "rounds": [3]}
    chosen, score = models.search_topics(docs, "tokens", trials=3, space=space)
    assert chosen["topics"] in (2, 3) and -score == pytest.approx(models.perplexity(docs, "tokens", **chosen)) and -score > 1


def test_models_are_kept(spark, tmp_path):
    from pyspark.ml.feature import CountVectorizer

    m = CountVectorizer(inputCol="tokens", outputCol="c").fit(word_docs(spark))
    for _ in range(2):
        models.save_models({"terms": m}, str(tmp_path))
    assert models.load_models(str(tmp_path), ["terms"])["terms"].vocabulary == m.vocabulary


def test_word_vectors_have_their_size(spark):
    rows = models.word_vectors(word_docs(spark), "tokens", size=7, rounds=1).collect()
    assert {r["word"] for r in rows} == {f"w{k}" for k in range(12)} and all(len(r["vector"]) == 7 for r in rows)


# -- networks ---------------------------------------------------------------------


def small(spark):
    return spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("c", "d", 1), ("a", "c", 1), ("d", "e", 1)], "a string, b string, weight long")


def test_betweenness_and_eigenvector_against_brute_force(spark):
    edges = small(spark)
    pairs = [(r["a"], r["b"]) for r in edges.collect()]
    nodes = sorted({n for p in pairs for n in p})
    near = {n: {y if x == n else x for x, y in pairs if n in (x, y)} for n in nodes}

    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [[*p, n] for p in level for n in near[p[-1]] if n not in p]
        return found

    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        every = paths(s, t)
        for n in nodes:
            if n not in (s, t):
                want[n] += sum(n in p for p in every) / len(every)
    scale = 2 / ((len(nodes) - 1) * (len(nodes) - 2))
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(edges).collect()}
    assert all(got[n] == pytest.approx(want[n] * scale, abs=1e-5) for n in nodes)
    m = np.array([[float(y in near[x]) for y in nodes] for x in nodes])
    v = np.abs(np.linalg.eigh(m)[1][:, -1])
    r = graph.eigenvector_centrality(edges).collect()
    column = next(c for c in r[0].asDict() if c != "node")
    assert np.allclose([x[column] for x in sorted(r, key=lambda x: x["node"])], v, atol=1e-3)


def test_actor_columns(spark):
    df = spark.createDataFrame([(k, 1, k % 2, 0) for k in range(6)], "id long, actor_x int, actor_y int, actor_z int")
    assert [tuple(r) for r in graph.actor_network(df, ["id"], 3).collect()] == [("actor_x", "actor_y", 3)]
    assert graph.actor_network(df.select("id"), ["id"], 1).count() == 0 and analyse_network(df.select("id"), ["id"]) == {}
    assert {r["node"]: r["size"] for r in graph.node_sizes(small(spark)).collect()}["c"] == 300


@pytest.mark.parametrize("kind", ["graphml", "gexf"])
def test_graph_files_are_xml(spark, tmp_path, kind):
    from xml.etree import ElementTree

    edges = spark.createDataFrame([('a"<', "b&", 1.5)], "a string, b string, weight double")
    graphs.write_graph(edges, str(tmp_path / "g"), kind)
    root = ElementTree.parse(tmp_path / "g").getroot()
    assert {e.get("id") for e in root.iter() if e.tag.endswith("}node")} == {'a"<', "b&"}
    assert [(e.get("source"), e.get("target")) for e in root.iter() if e.tag.endswith("}edge")] == [('a"<', "b&")]


def test_other_graph_files(spark, tmp_path):
    graphs.write_graph(small(spark), str(tmp_path / "g.gml"), "gml")
    assert (tmp_path / "g.gml").read_text().count("edge [") == 5
    graphs.write_edges(small(spark), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).count() == 5
    with pytest.raises(ValueError):
        graphs.write_graph(small(spark), str(tmp_path / "x"), "dot")


# -- files and the experiment -------------------------------------------------------


def test_parts_labels_and_edits(spark, tmp_path):
    for k in (0, 1):
        files.write_csv(spark.createDataFrame([(k, "x")], "id long, body string").coalesce(1), str(tmp_path / f"p{k}"))
    assert files.read_parts(spark, str(tmp_path / "p*"), "id long, body string").select("_part").distinct().count() == 2
    files.append_rows(spark.range(2), str(tmp_path / "a"))
    files.append_rows(spark.range(3), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 5
    files.save_json([{"a": "ñ"}], str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "a string").first()["a"] == "ñ"
    files.write_labels(spark.createDataFrame([(1, 1.0), (2, None)], "id long, label double"), str(tmp_path / "l"), "id")
    assert files.read_csv(spark, str(tmp_path / "l"), "id long, label double").count() == 1
    t = files.edited(spark.createDataFrame([(1, "a"), (2, "b")], "id long, body string"), spark.createDataFrame([(2, "c")], "id long, body string"), "id", "body")
    assert sorted(map(tuple, t.collect())) == [(1, "a"), (2, "c")]


def test_fences_are_stripped(spark):
    df = spark.createDataFrame([("```json\n{}\n```",), ("{}",)], "t string")
    assert [r["x"] for r in df.select(X.strip_fence(F.col("t")).alias("x")).collect()] == ["{}", "{}"] and chat.unfence("{}") == "{}"


def test_experiment(spark, tmp_path):
    docs = spark.createDataFrame([(k, "cobre mina agua campo lluvia" if k % 2 else "huelga paro obrero sueldo sindicato", 1, k % 2) for k in range(24)], "id long, body string, actor_x int, actor_y int")
    setup_logging("WARNING", str(tmp_path / "log"))
    e = Experiment(Config({"embeddings": {"size": 4}, "topic_modeling": {"n_topics": 2}}), "one")
    e.run(docs)
    path = e.save(str(tmp_path))
    s = json.loads(spark.read.text(f"{path}/summary").first()["value"])
    assert s["n_documents"] == 24 and s["modules_executed"] == ["preprocessing", "embeddings", "topic_modeling", "networks"]
    assert s["embeddings"]["word2vec"]["shape"] == [24, 4] and s["topics"]["nmf"]["n_topics"] == 2 and s["network"]["edges"] == 1
    back = spark.read.parquet(f"{path}/documents")
    assert back.count() == 24 and {"word2vec_vector", "topic_lda", "topic_lda_prob", "processed_text"} <= set(back.columns)
    off = Experiment(Config({k: {"enabled": False} for k in ("preprocessing", "embeddings", "topic_modeling", "networks")}))
    assert set(off.run(docs)) == {"documents"} and off.modules == []
