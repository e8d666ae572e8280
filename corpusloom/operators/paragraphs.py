"""Paragraph vectors: a vector for each document that predicts its words, by negative sampling.

Documents and words are dealt into as many blocks each.  In a turn every task holds one block of documents and one
of words, with the words of these documents that lie in that block, and moves both; the word blocks then go round,
so after as many turns as blocks every document has met all its words and no two tasks ever move the same vector.
With frozen words the same turns infer vectors of new documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .density import _anew
from .tables import Shelf

#: Documents and words of a block; pairs that move at once.
DOCS, WORDS, BATCH = 20_000, 50_000, 512


def _start(keys: list, size: int, seed: int) -> np.ndarray:
    return np.array([np.random.default_rng([seed, zlib.crc32(str(k).encode())]).uniform(-0.5, 0.5, size) / size for k in keys]).reshape(len(keys), size)


def moved(d: np.ndarray, w: np.ndarray, pairs: np.ndarray, times: np.ndarray, rates: np.ndarray, frozen: bool, rng: np.random.Generator, against: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Documents ``d`` and words ``w`` after a pass over ``pairs`` (document, word), used ``times``, for each rate."""
    d, w = d.copy(), w.copy()
    chance = np.bincount(pairs[:, 1], times, len(w)) ** 0.75
    chance = np.cumsum(chance / chance.sum())
    for rate in rates:
        order = np.repeat(np.arange(len(pairs)), times)
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            i, j = pairs[order[at : at + BATCH]].T
            other = np.minimum(np.searchsorted(chance, rng.random((len(i), against))), len(w) - 1)
            target = np.concatenate([j[:, None], other], 1)
            own, met = d[i], w[target]
            score = np.einsum("id,ikd->ik", own, met)
            miss = -1 / (1 + np.exp(-np.clip(score, -30, 30)))
            miss[:, 0] += 1
            miss[:, 1:][other == j[:, None]] = 0  # the word itself is no counter-example
            miss *= rate
            np.add.at(d, i, np.einsum("ik,ikd->id", miss, met))
            if not frozen:
                np.add.at(w, target.ravel(), (miss[..., None] * own[:, None, :]).reshape(-1, d.shape[1]))
    return d, w


def _turns(d: DataFrame, w: DataFrame, pairs: DataFrame, blocks: int, shelf: Shelf, epochs: int, rounds: int, rate: float, frozen: bool, seed: int) -> tuple[DataFrame, DataFrame]:
    """``d`` (_key, _block, vector) and ``w`` (word, _block, vector) after all turns over ``pairs`` (_key, word, n, _d, _w)."""
    kind = dict(d.dtypes)["_key"]
    schema = f"_key {kind}, word string, _block int, vector array<double>"
    each = max(1, epochs // rounds)

    def mover(rates: np.ndarray, turn: int):
        def move(own: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
            own, words = own.sort_values("_key"), words.sort_values("word")
            if not len(own):
                return pd.DataFrame({"_key": pd.Series([None] * len(words), dtype=object), "word": words["word"].to_numpy(), "_block": words["_block"].to_numpy(), "vector": list(words["vector"])})
            x = np.array(own["vector"].tolist(), float)
            y = np.array(words["vector"].tolist(), float).reshape(len(words), x.shape[1])
            at = {k: i for i, k in enumerate(words["word"])}
            met = [(i, at[u], n) for i, (ws, ns) in enumerate(zip(own["_words"], own["_times"])) if ws is not None for u, n in zip(ws, ns)]
            if met:
                met = np.array(met)
                x, y = moved(x, y, met[:, :2], met[:, 2], rates, frozen, np.random.default_rng([seed, turn, int(own["_block"].iloc[0])]))
            docs = pd.DataFrame({"_key": own["_key"].to_numpy(), "word": pd.Series([None] * len(own), dtype=object), "_block": own["_block"].to_numpy(), "vector": list(x)})
            if frozen:
                return docs
            return pd.concat([docs.astype(object), pd.DataFrame({"_key": pd.Series([None] * len(words), dtype=object), "word": words["word"].to_numpy(), "_block": words["_block"].to_numpy(), "vector": list(y)}).astype(object)])

        return move

    for k in range(rounds * blocks):
        turn = k % blocks
        left = 1 - (k // blocks * each + np.arange(each)) / (rounds * each)
        here = pairs.where(F.pmod(F.col("_d") + turn, F.lit(blocks)) == F.col("_w"))
        lists = here.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("_l")).select("_key", F.col("_l")["word"].alias("_words"), F.col("_l")["n"].alias("_times"))
        own = d.join(lists, "_key", "left").withColumn("_task", F.col("_block"))
        words = w.withColumn("_task", F.pmod(F.col("_block") - turn, F.lit(blocks)))
        out = shelf.keep(own.groupBy("_task").cogroup(_anew(words).groupBy("_task")).applyInPandas(mover(rate * np.maximum(left, 1e-2), k), schema))
        d = out.where("word is null").select("_key", "_block", "vector")
        if not frozen:
            w = out.where("word is not null").select("word", "_block", "vector")
    return d, w


def _block(c: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def _started(docs: DataFrame, key: str, column: str, blocks: int, size: int, seed: int, shelf: Shelf) -> DataFrame:
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({column: pdf[column], "_block": pdf["_block"], "vector": list(_start(pdf[column].tolist(), size, seed))})

    return shelf.keep(docs.select(F.col(key).alias(column)).distinct().withColumn("_block", _block(column, blocks)).mapInPandas(run, f"{column} {kind}, _block int, vector array<double>"))


def fit_document_vectors(docs: DataFrame, key: str, tokens: str, size: int = 100, least: int = 2, epochs: int = 40, rounds: int = 10, rate: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(key, vector) of each document, keys unique, and (word, vector) of each word used ``least`` times.

    Seeded: a rerun gives the same vectors.  A document without known words keeps its small starting vector.
    """
    shelf = Shelf(docs.sparkSession, "paragraphs")
    used = shelf.keep(docs.select(F.col(key).alias("_key"), F.explode(tokens).alias("word")).groupBy("_key", "word").agg(F.count(F.lit(1)).alias("n")))
    known = shelf.keep(used.groupBy("word").agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).select("word"))
    blocks = max(1, -(-docs.count() // DOCS), -(-known.count() // WORDS))
    pairs = shelf.keep(used.join(known, "word").select("_key", "word", "n", _block("_key", blocks).alias("_d"), _block("word", blocks).alias("_w")))
    d = _started(docs, key, "_key", blocks, size, seed, shelf)
    w = shelf.keep(known.select("word", _block("word", blocks).alias("_block"), F.array_repeat(F.lit(0.0), size).alias("vector")))
    d, w = _turns(d, w, pairs, blocks, shelf, epochs, rounds, rate, False, seed)
    return d.select(F.col("_key").alias(key), "vector"), w.select("word", "vector")


def infer_document_vectors(docs: DataFrame, key: str, tokens: str, words: DataFrame, epochs: int = 40, rounds: int = 4, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """(key, vector) of documents under fitted ``words``, which stay as they are."""
    shelf = Shelf(docs.sparkSession, "paragraphs")
    head = words.first()
    size = len(head["vector"]) if head else 1
    blocks = max(1, -(-docs.count() // DOCS), -(-words.count() // WORDS))
    w = shelf.keep(words.select("word", _block("word", blocks).alias("_block"), "vector"))
    used = docs.select(F.col(key).alias("_key"), F.explode(tokens).alias("word")).groupBy("_key", "word").agg(F.count(F.lit(1)).alias("n"))
    pairs = shelf.keep(used.join(w.select("word"), "word").select("_key", "word", "n", _block("_key", blocks).alias("_d"), _block("word", blocks).alias("_w")))
    d, _ = _turns(_started(docs, key, "_key", blocks, size, seed, shelf), w, pairs, blocks, shelf, epochs, rounds, rate, True, seed)
    return d.select(F.col("_key").alias(key), "vector")
