"""Whitening, importance resampling and source mixing against brute force, SQL and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusloom.llm import mixing, oracles, registry, resampling, whitening

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_source_mixing"])
def test_same_as_sql(spark, duck, name):
    cell = lambda v: "" if pd.isna(v) else f"{float(v):.12g}"
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(oracles.SQL[name]).df()
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# -- whitening --------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 16, 33])
def test_jacobi(n):
    g = np.random.default_rng(n)
    q = np.linalg.qr(g.normal(size=(n, n)))[0]
    want = np.sort(10.0 ** g.uniform(-6, 3, n))[::-1]
    e, v = whitening.jacobi((q * want) @ q.T)
    a = (q * want) @ q.T
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-9, atol=1e-12 * want[0])
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13 and np.abs(a @ v - v * e).max() < 1e-12 * want[0]


def test_jacobi_keeps_small_eigenvalues():
    d = np.array([1.0, 1e-8, 1e-16])  # scaled diagonally dominant: eigenvalues are near the squares of the scales
    a = d[:, None] * np.array([[2, 0.3, 0.1], [0.3, 1, 0.2], [0.1, 0.2, 1.5]]) * d
    e = whitening.jacobi(a)[0]
    exact = np.array([2.0, (1 - 0.3**2 / 2) * 1e-16])
    assert np.allclose(e[:2], exact, rtol=1e-10) and 0 < e[2] < 1.5e-32


def whitening_brute(rows):
    """n, the deviations and the eigenvalues of valid vectors of the most frequent length."""
    good = {k: v for k, v in rows.items() if v and all(c is not None and math.isfinite(c) for c in v)}
    dims = max(Counter(len(v) for v in good.values()).items(), key=lambda x: (x[1], x[0]))[0]
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in good.items() if len(v) == dims}
    n, sums = len(x), [sum(c) for c in zip(*x.values())]
    dev = {k: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for k, v in x.items()}
    cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x.values()), n**3)) for j in range(dims)] for i in range(dims)])
    return n, x, sums, dev, cov


def check_whitening(got, rows, most=32):
    n, x, sums, dev, cov = whitening_brute(rows)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    keep = [i for i in range(len(e)) if e[i] > len(e) * 2.0**-52 * e[0]][:most]
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((k, i + 1) for k in x for i in keep)
    centred = {k: np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]) for k, v in x.items()}
    signs = {}
    for r in got:
        i = r["component"] - 1
        want = centred[r["vec_id"]] @ u[:, i] / math.sqrt(e[i])
        if abs(want) > 1e-3:
            assert signs.setdefault(i, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(abs(want) - abs(r["whitened"])) < 1e-8
        assert r["n"] == n and r["deviation"] == dev[r["vec_id"]]
        assert abs(r["explained"] / (e[i] / cov.trace()) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_query(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check_whitening(registry.QUERIES["op11_whitening"](spark, SF).collect(), rows)


def test_whitening_of_odd_rows(spark):
    g = np.random.default_rng(3)
    rows = {i: g.normal(size=4).tolist() for i in range(40)}
    rows |= {50: None, 51: [1.0, None, 0.0, 0.0], 52: [math.nan, 0.0, 0.0, 0.0], 53: [math.inf, 0.0, 0.0, 0.0], 54: [], 55: [1.0, 2.0], 56: rows[3], 57: [1e300, 0.0, 0.0, 0.0], 58: [40.0, -40.0, 3.0, 1.0]}
    df = spark.createDataFrame([(k, v, 1.0, 2) for k, v in rows.items()], "vec_id long, embedding array<double>, whitened double, _v int").repartition(5)
    got = whitening.whiten(df, most=3).collect()
    del rows[57]  # beyond a long when quantised
    check_whitening(got, rows, most=3)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 50")).count() == 0
    assert whitening.whiten(df.where("vec_id in (3, 56)")).count() == 0  # equal vectors: no variance
    far = spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (None, [5.0, 2.0])], "vec_id int, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(far).collect()} >= {None}  # exceeds a long
    flat = spark.createDataFrame([(i, [float(i % 7), 2.0 * (i % 7), 5.0]) for i in range(50)], "vec_id int, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}  # one direction has all variance


def test_whitening_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = (whitening.fit_whitening(df.repartition(k), "embedding") for k in (1, 7))
    assert np.array_equal(one.covariance, many.covariance) and np.array_equal(one.vectors, many.vectors)


# -- importance resampling ----------------------------------------------------------


def resample_brute(docs, target, percent, width, buckets, least, seed=2024):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    s_all, t_all = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        w, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("width,buckets", [(1, 10_000), (3, 97)])
def test_resample_odd(spark, width, buckets):
    rows = [(i, f"alpha beta{i % 5} Ünïcode {'w ' * (i % 7)}" + "gamma-delta " * (i % 4)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "--- \x00\x7f \n"), (None, "no id at all here"), (103, "中文 \U0001f600 É é x_y " * 3000), (104, rows[0][1]), (0, rows[0][1]), (0, rows[0][1])]
    target = ["alpha gamma", None, "", "Beta1 delta"]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, buckets string, _row int, weight int").repartition(6)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.resample(docs, wanted, 40, width, buckets, 3).collect()]
    assert sorted(map(key, got)) == sorted(map(key, resample_brute(rows, target, 40, width, buckets, 3)))
    assert resampling.resample(docs.limit(0), wanted, 40, width, buckets, 3).count() == 0
    alone = resampling.resample(docs, wanted.limit(0), 40, width, buckets, 3)
    assert sorted(key((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in alone.collect()) == sorted(map(key, resample_brute(rows, [], 40, width, buckets, 3)))


def test_resample_prefers_the_target(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat(repeat(if(id % 2 = 0, 'proof lemma theorem ', 'sale price cheap '), 10), id) as text")
    wanted = spark.createDataFrame([("theorem lemma proof proof",)] * 30, "text string")
    drawn = [r["doc_id"] for r in resampling.resample(docs, wanted, percent=10).where("rank is not null").collect()]
    assert len(drawn) == 40 and sum(i % 2 == 0 for i in drawn) >= 38


# -- source mixing ------------------------------------------------------------------


def targets_brute(sizes, weights=(5, 2, 1), percent=100, most=3):
    """The rule as it is worded: share, cut what is above, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values()) * percent / 100
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return full | share
        for s in above:
            full[s] = most * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("case", range(6))
def test_source_targets(spark, case):
    g = np.random.default_rng(case)
    sizes = {("s%d" % i if i else None): int(10 ** g.uniform(0, 5)) * int(g.random() < 0.9) for i in range(1 if case == 0 else 25)}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = targets_brute(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)


def test_progress_inverts_the_integral(spark):
    schedule = ((0.0, 0.0), (0.25, 2.0), (0.5, 1.0), (1.0, 0.0))
    at = np.linspace(0, 1, 41)
    density = np.interp(np.linspace(0, 1, 400_001), *zip(*schedule))
    reached = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    share = np.interp(at, np.linspace(0, 1, 400_001), reached / reached[-1])
    df = spark.createDataFrame([(float(a), float(s)) for a, s in zip(at, share)], "a double, s double")
    from pyspark.sql import functions as F

    assert df.select(F.max(F.abs(mixing.progress(F.col("s"), schedule) - F.col("a")))).first()[0] < 1e-5


def check_mix(rows, sizes):
    targets = targets_brute(sizes)
    for s, size in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert {(r["source_size"]) for r in own} == {size} and sum(r["size"] for r in own) == size
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= 0.5 + 1e-6
        assert all(abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s]) for r in own)
        passes = sum(0 < u["words"] < r["size"] for r in own for u in r["uses"])
        assert passes <= 1  # one document at most is taken in part
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(u["words"] for u in r["uses"]) for r in rows)


def test_mix_odd(spark):
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 12}") for i in range(300)]
    rows += [(None, "no id", None), (None, "no id", None), (7, None, "only-empty"), (5, "long " * 20_000, "s3"), (9, "a b", "É"), (9, "a b", "\U0001f600")]
    rows += [(None, "same text", "hot")] * 200  # one identifier and text for a third of all rows
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, _row int").repartition(5)
    mix = mixing.mix_sources(df)
    got = mix.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    check_mix(got, dict(sizes))
    key = lambda m: sorted(tuple(str(x) for x in (r["doc_id"], r["source"], r["size"], r["taken"])) for r in m)
    assert key(got) == key(mixing.mix_sources(df.repartition(3)).collect())
    places = [(r["position"], r["words"]) for r in mixing.training_order(mix).collect()]
    assert places == sorted(places, key=lambda p: p[0]) and sum(w for _, w in places) == sum(r["taken"] for r in got) and all(0 <= p <= 1 for p, _ in places)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_curriculum_follows_its_schedules(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', 10) as text", "concat('s', id % 2) as source")
    mix = mixing.mix_sources(df, weights=(1, 1), schedules=(((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 2.0))))
    order = mixing.training_order(mix).selectExpr("floor(position * 10) as tenth", "source", "words").groupBy("tenth", "source").sum("words").collect()
    at = {(r["tenth"], r["source"]): r["sum(words)"] for r in order}
    for k in range(10):
        assert abs(at.get((k, "s0"), 0) - 30_000 * (0.19 - 0.02 * k)) < 60 and abs(at.get((k, "s1"), 0) - 30_000 * (0.01 + 0.02 * k)) < 60


def test_mixing_stays_native(spark, capsys):
    registry.op13_source_mixing(spark, SF).explain("extended")
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", capsys.readouterr().out)
