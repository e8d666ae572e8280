"""Paragraph vectors on planted topics."""

import numpy as np

from corpusloom.operators import paragraphs


def planted(spark, n=90):
    g = np.random.default_rng(2)
    words = [[f"w{k}_{i}" for i in range(15)] for k in range(3)]
    rows = [(k, [*g.choice(words[k % 3], 25), *g.choice([f"c{i}" for i in range(10)], 6)]) for k in range(n)]
    return spark.createDataFrame([(k, [str(w) for w in t]) for k, t in rows] + [(900, []), (901, ["once"])], "id long, tokens array<string>").repartition(3).cache()


def unit(df, n=90):
    v = {r["id"]: np.array(r["vector"]) for r in df.collect()}
    x = np.array([v[k] for k in range(n)])
    return v, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_documents_share_a_topic(spark, monkeypatch):
    docs = planted(spark)
    fitted, words = paragraphs.fit_document_vectors(docs, "id", "tokens", size=16, epochs=40, rounds=4)
    v, x = unit(fitted)
    assert len(v) == 92 and np.linalg.norm(v[900]) < 0.2  # without known words: as it started
    near = x @ x.T - 2 * np.eye(90)
    assert np.mean(near.argmax(axis=1) % 3 == np.arange(90) % 3) > 0.97
    assert words.where("word = 'once'").isEmpty() and words.count() == 55
    again = paragraphs.fit_document_vectors(docs.repartition(2), "id", "tokens", size=16, epochs=40, rounds=4)[0]
    assert all(np.array_equal(v[r["id"]], r["vector"]) for r in again.collect())
    # a training text is inferred near its own vector
    _, y = unit(paragraphs.infer_document_vectors(docs, "id", "tokens", words))
    assert np.mean((y @ x.T).argmax(axis=1) % 3 == np.arange(90) % 3) > 0.97 and np.mean((x * y).sum(axis=1)) > 0.8


def test_blocks_go_round(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "DOCS", 40)
    monkeypatch.setattr(paragraphs, "WORDS", 20)  # three blocks of documents and of words
    docs = planted(spark)
    fitted, words = paragraphs.fit_document_vectors(docs, "id", "tokens", size=12, epochs=40, rounds=4)
    v, x = unit(fitted)
    near = x @ x.T - 2 * np.eye(90)
    assert len(v) == 92 and words.count() == 55 and np.mean(near.argmax(axis=1) % 3 == np.arange(90) % 3) > 0.9
    assert paragraphs.fit_document_vectors(docs.limit(0), "id", "tokens", size=4, epochs=2, rounds=1)[0].count() == 0
