"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word enters as a word vector beside the mean vector of its character
n-grams.  Two recurrent passes read a window of words, attention pools their
states, and a logistic unit scores the pool.  All overlapping windows of a text
are scored; the text's score is the highest.  Training is plain numpy: labels
belong to texts, so after the first epoch a toxic text teaches through the
windows that score highest in it, and a clean text through all of its windows.

The training sample is bounded (``SAMPLE_TEXTS`` for each class, of at most
``SAMPLE_CHARS`` characters each) and taught in one task of an executor, from
which the driver gets the parameters alone; scoring covers every text whole.

Defined cases: a null text is empty; a text without words has one window of
padding, which the model scores; labels of one class only, or none, give 0.5 * the
share of toxic ones to every text; repeated rows score alike; a null identifier
stays null, is not held out and teaches nothing; an empty table gives an empty
result; other columns, whatever their names, don't matter; label, language, source
and identifier are never inputs.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import col, materialise, tune, worker_store

#: Bounds of the training sample: texts of each class, characters of each text.
SAMPLE_TEXTS, SAMPLE_CHARS = 1200, 5000
#: Words in a window and words between the starts of windows.
WINDOW, STRIDE = 32, 16
HIDDEN, WIDTH = 8, 12
WORD_SLOTS, GRAM_SLOTS = 1 << 13, 1 << 15
GRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE = 6, 512, 0.01
#: Windows that are scored at once.
BATCH_SCORED = 1024
#: Steps that a small sample is trained for at least.
LEAST_STEPS = 120
#: Words whose input projections a worker remembers.
REMEMBERED = 100_000

_APART = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_APART).split()


def word_slots(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % WORD_SLOTS for w in words), np.int64, len(words))


def gram_slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character n-grams of all words, and where each word's begin."""
    marked = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(marked))  # characters from here to the word's end
    slots, owners = [], []
    for n in GRAMS:
        m = len(marked) - n + 1
        if m < 1:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ marked[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = left[:m] >= n
        slots.append((h[inside] % np.uint64(GRAM_SLOTS)).astype(np.int64))
        owners.append(owner[:m][inside])
    slot, of = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return slot[order], np.searchsorted(of[order], np.arange(len(words)))


def windows_of(n: int) -> list[int]:
    """Starts of the overlapping windows of a text of ``n`` words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes; every array is float32."""

    def __init__(self, seed: int = 11):
        g = np.random.default_rng(seed)
        H, D = HIDDEN, WIDTH
        draw = lambda *shape, scale: (g.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "words": draw(WORD_SLOTS, D, scale=0.05), "grams": draw(GRAM_SLOTS, D, scale=0.1), "inputs": draw(2 * D, 6 * H, scale=0.3), "bias": np.zeros(6 * H, np.float32),
            "ahead": draw(H, 3 * H, scale=0.3), "back": draw(H, 3 * H, scale=0.3), "attend": draw(2 * H, scale=0.3), "out": draw(2 * H, scale=0.3), "offset": np.full(1, -1, np.float32),
        }

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        slot = word_slots(words)
        grams, begin = gram_slots(words)
        count = np.diff(np.append(begin, len(grams))).astype(np.float32)
        mean = np.add.reduceat(self.p["grams"][grams], begin, axis=0) / count[:, None]
        return np.concatenate([self.p["words"][slot], mean], axis=1), (slot, grams, count)

    def project(self, words: list[bytes]) -> np.ndarray:
        return self.inputs(words)[0] @ self.p["inputs"] + self.p["bias"]

    def _pass(self, steps: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction; steps: time, window, 3H."""
        H = HIDDEN
        h = np.zeros((steps.shape[1], H), np.float32)
        out = np.empty((steps.shape[0], steps.shape[1], H), np.float32)
        for t in range(steps.shape[0]):
            hu = h @ u
            gates = _sigmoid(steps[t, :, : 2 * H] + hu[:, : 2 * H])
            z, r = gates[:, :H], gates[:, H:]
            n = np.tanh(steps[t, :, 2 * H :] + r * hu[:, 2 * H :])
            new = (n + z * (h - n)) * mask[t][:, None]
            if keep is not None:
                keep.append((h, z, r, n, hu[:, 2 * H :]))
            h = out[t] = new
        return out

    def states(self, steps: np.ndarray, mask: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        H = HIDDEN
        a = self._pass(steps[:, :, : 3 * H], mask, self.p["ahead"], keep and keep[0])
        b = self._pass(steps[::-1, :, 3 * H :], mask[::-1], self.p["back"], keep and keep[1])
        return np.concatenate([a, b[::-1]], axis=2)

    def pool(self, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = h @ self.p["attend"] + (mask - 1) * 1e4
        alpha = np.exp(e - e.max(0))
        alpha /= alpha.sum(0)
        pooled = (alpha[:, :, None] * h).sum(0)
        return alpha, pooled, _sigmoid(pooled @ self.p["out"] + self.p["offset"][0])

    def score(self, steps: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self.pool(self.states(steps, mask), mask)[2]

    def gradients(self, words: list[bytes], at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """at: time, window -> place in ``words``."""
        p, H, D = self.p, HIDDEN, WIDTH
        x, (slot, grams, count) = self.inputs(words)
        steps = (x @ p["inputs"] + p["bias"])[at]
        keep: tuple[list, list] = ([], [])
        h = self.states(steps, mask, keep)
        alpha, pooled, prob = self.pool(h, mask)
        d = ((prob - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "offset": d.sum(keepdims=True)}
        d_pool = d[:, None] * p["out"]
        d_alpha = (h * d_pool).sum(2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["attend"] = np.einsum("tw,twk->k", d_e, h)
        d_h = alpha[:, :, None] * d_pool + d_e[:, :, None] * p["attend"]
        d_steps = np.empty_like(steps)
        for name, kept, order, cols, own in (("ahead", keep[0], range(len(at)), slice(0, 3 * H), d_h[:, :, :H]), ("back", keep[1], range(len(at) - 1, -1, -1), slice(3 * H, 6 * H), d_h[:, :, H:])):
            u, du, dh = p[name], np.zeros_like(p[name]), np.zeros((at.shape[1], H), np.float32)
            for (before, z, r, n, un), t in reversed(list(zip(kept, order))):
                dh = (dh + own[t]) * mask[t][:, None]
                d_n = dh * (1 - z) * (1 - n * n)
                gates = np.concatenate([dh * (before - n) * z * (1 - z), d_n * un * r * (1 - r), d_n * r], axis=1)
                du += before.T @ gates
                d_steps[t, :, cols] = np.concatenate([gates[:, : 2 * H], d_n], axis=1)
                dh = dh * z + gates @ u.T
            g[name] = du
        flat, place = d_steps.reshape(-1, 6 * H), at.ravel()
        order = np.argsort(place, kind="stable")
        first = np.searchsorted(place[order], np.arange(len(words)))
        d_proj = np.add.reduceat(flat[order], first, axis=0)
        g["bias"], g["inputs"] = d_proj.sum(0), x.T @ d_proj
        d_x = d_proj @ p["inputs"].T
        per_gram = np.repeat(d_x[:, D:] / count[:, None], count.astype(np.int64), axis=0)
        g["words"] = np.stack([np.bincount(slot, d_x[:, k], WORD_SLOTS) for k in range(D)], 1).astype(np.float32)
        g["grams"] = np.stack([np.bincount(grams, per_gram[:, k], GRAM_SLOTS) for k in range(D)], 1).astype(np.float32)
        return g


def _grid(places: list[np.ndarray], starts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word places and mask (time, window) of (text, start) windows."""
    at, mask = np.zeros((WINDOW, len(starts)), np.int64), np.zeros((WINDOW, len(starts)), np.float32)
    for k, (d, s) in enumerate(starts):
        own = places[d][s : s + WINDOW]
        at[: len(own), k], mask[: len(own), k] = own, 1
    return at, mask


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Fit the network to whole-text labels by Adam."""
    net, g = Network(seed), np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    places = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    vocabulary = list(number)
    del number
    starts = [windows_of(len(p)) if len(p) else [] for p in places]
    text = np.repeat(np.arange(len(places), dtype=np.int32), [len(s) for s in starts])
    start = np.array([x for s in starts for x in s], np.int32)
    if not len(text):
        return net
    toxic = np.array(labels, np.int8)[text] > 0
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(text)))
    heavy = min(2.0, max(1.0, labels.count(0) / max(1, labels.count(1))))
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    use, step = np.ones(len(text), bool), 0
    for epoch in range(epochs):
        order = g.permutation(np.flatnonzero(use))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            at, mask = _grid(places, list(zip(text[own].tolist(), start[own].tolist())))
            used, at = np.unique(at, return_inverse=True)
            grads = net.gradients([vocabulary[i] for i in used.tolist()], at.reshape(mask.shape), mask, toxic[own].astype(np.float32), np.where(toxic[own], heavy, 1.0).astype(np.float32))
            step += 1
            for k, v in grads.items():
                first, second = m[k]
                first += 0.1 * (v - first)
                second += 0.01 * (v * v - second)
                net.p[k] -= (RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if epoch + 1 < epochs:  # a toxic text goes on with the windows that score high in it, its highest at least
            positive, score = np.flatnonzero(toxic), np.zeros(len(text), np.float32)
            for a in range(0, len(positive), BATCH):
                own = positive[a : a + BATCH]
                at, mask = _grid(places, list(zip(text[own].tolist(), start[own].tolist())))
                used, at = np.unique(at, return_inverse=True)
                score[own] = net.score(net.project([vocabulary[i] for i in used.tolist()])[at.reshape(mask.shape)], mask)
            best = np.zeros(len(places), np.float32)
            np.maximum.at(best, text[positive], score[positive])
            use = ~toxic | (score > 0.9) | (score == best[text])
    return net


class Scorer:
    """Scores texts; remembers the input projections of words."""

    def __init__(self, net: Network):
        self.net = net
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((1, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        if len(self.number) > REMEMBERED:
            self.number = {}
        number = self.number
        new = list({w for words in split for w in words if w not in number})
        if new:
            at = len(number) + 1  # row 0 is padding
            if at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:at], np.zeros((max(len(new), 20_000), 6 * HIDDEN), np.float32)])
            self.rows[at : at + len(new)] = self.net.project(new)
            number.update(zip(new, range(at, at + len(new))))
        size = [len(w) for w in split]
        # one row of places for all texts, each followed by a window of padding (row 0)
        flat = np.zeros(sum(size) + WINDOW * len(split), np.int64)
        starts, stops, owners, at = [], [], [], 0
        for d, words in enumerate(split):
            flat[at : at + size[d]] = np.fromiter(map(number.__getitem__, words), np.int64, size[d])
            own = windows_of(size[d])
            starts += [at + s for s in own]
            stops += [at + size[d]] * len(own)
            owners += [d] * len(own)
            at += size[d] + WINDOW
        out = np.zeros(len(split))
        starts, stops, owners = np.array(starts), np.array(stops), np.array(owners)
        for a in range(0, len(starts), BATCH_SCORED):
            s = starts[a : a + BATCH_SCORED]
            grid = s[None, :] + np.arange(WINDOW)[:, None]
            mask = (grid < stops[a : a + BATCH_SCORED]).astype(np.float32)
            np.maximum.at(out, owners[a : a + BATCH_SCORED], self.net.score(self.rows[flat[grid]], mask))
        return out


_scorers: dict[int, Scorer] = worker_store()


def _scorer(params: dict[str, np.ndarray]) -> Scorer:
    """One for each model and Python worker."""
    key = zlib.crc32(params["out"].tobytes() + params["inputs"].tobytes())
    if key not in _scorers:
        _scorers.clear()
        net = Network.__new__(Network)
        net.p = params
        _scorers[key] = Scorer(net)
    return _scorers[key]


def _score(batches: Iterator[pa.RecordBatch], model, rate: float, text: int, keep: int, name: str) -> Iterator[pa.RecordBatch]:
    """Scores of column ``text``, under ``name``, beside the first ``keep`` columns."""
    for b in batches:
        texts = b.column(text).to_pylist()
        scores = np.full(len(texts), rate) if model is None else _scorer(model.value).score(texts)
        yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(scores, pa.float64())], names=[*b.schema.names[:keep], name])


_MODEL_DDL = "name string, shape array<int>, data binary, rate double"


def _teach(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The model's arrays, taught by the first ``n`` texts of each class in the order of their mark;
    one nameless row without texts of both classes."""
    rows = sorted((r["mark"], r["id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist())
    sample = [(t, y) for toxic in (0, 1) for _, _, t, y in [r for r in rows if r[3] == toxic][:n]]
    labels = [y for _, y in sample]
    if len(set(labels)) < 2:
        rows = [("", [], b"", 0.5 * (sum(labels) / len(labels) if labels else 0.0))]
    else:
        rows = [(k, list(v.shape), v.tobytes(), 0.0) for k, v in train([t for t, _ in sample], labels).p.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.list_(pa.int32()), pa.binary(), pa.float64()))], names=["name", "shape", "data", "rate"])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, n: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(id, mark, text, toxic) of about ``n`` texts of each class or some more, chosen by a hash of the
    identifier, not held out.  Ids are matched before they are chosen, so removed and long texts don't
    thin the sample."""
    known = labels.select(col(labels, id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    texts = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).cast("string").alias("text")).where(F.length("text").between(1, chars))
    mark = F.xxhash64("id", F.lit(17))
    found = materialise(texts.select("id").join(known, "id").select("id", "toxic", mark.alias("mark")).distinct(), "labelled")
    share = {r["toxic"]: min(1.0, (1.2 * n + 50) / r["n"]) for r in found.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a share of the marks' range, so some n identifiers of each class are broadcast
    below = lambda toxic: F.lit(int(min(2**63 - 1, share[toxic] * 2.0**64 - 2.0**63)))
    chosen = found.where(reduce(lambda x, y: x | y, [(F.col("toxic") == k) & (F.col("mark") <= below(k)) for k in share], F.lit(False)))
    return texts.join(F.broadcast(chosen), "id").select("id", "mark", "text", "toxic")


def held_out(id_column):
    """Rows that never teach: crc32 of the identifier as text, mod 5, is 0."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLE_TEXTS) -> tuple:
    """The broadcast parameters (None without labels of both classes) and the score to give without them."""
    sample = training_rows(docs, labels, id_col, text_col, n)
    taught = sample.repartition(1).mapInArrow(partial(_teach, n=n), _MODEL_DDL).collect()
    if not taught or not taught[0]["name"]:
        return None, taught[0]["rate"] if taught else 0.0
    params = {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in taught}
    return docs.sparkSession.sparkContext.broadcast(params), 0.0


def score_rows(docs: DataFrame, labels: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``name``, which it must not have; only the text is scored."""
    tune(docs.sparkSession)
    model, rate = fit(docs, labels, id_col, text_col)
    at, n = docs.columns.index(text_col), len(docs.columns)
    rows = docs.toDF(*(f"c{k}" for k in range(n)))  # any name may stand in ``docs``
    scored = rows.mapInArrow(partial(_score, model=model, rate=rate, text=at, keep=n, name="score"), StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return scored.toDF(*docs.columns, name)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, held_out, score, predicted (1 from a score of 0.5)."""
    tune(docs.sparkSession)
    model, rate = fit(docs, labels, id_col, text_col)
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(partial(_score, model=model, rate=rate, text=1, keep=1, name="score"), "id long, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
