"""Importance resampling of documents towards a target distribution.

Documents and target texts are bags of hashed n-grams.  A bucket's gain is the log
ratio of its smoothed shares in target and corpus; a document's weight is its mean
gain, and the draw without replacement adds Gumbel noise to the weights and takes
the highest.

Higher-order functions make each document's array of buckets once; these arrays,
two bytes a word, are kept in the shared folder.  Counting explodes them into a
partial count, so only totals by bucket are shuffled.  Scoring doesn't explode: it
folds the array over a literal array of gains, one for each bucket.  Drawn documents
are ranked by ranges of (score, identifier), of which only the sizes reach the
driver, as do the number of documents at each whole-number score, whose span is
bounded by the gains'.

Defined cases: a null text has no words; a document without features has weight 0;
a null doc_id is hashed as an empty one and precedes others in ties; repeated rows
are documents of their own, in any order between equals; empty tables on either
side are smoothed like others; no column of the inputs may clash, as only id and
text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import numbered
from .common import col, drop_table, materialise

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that are no letters or digits: they separate words.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Runs of ASCII letters (lower-cased), digits and any characters beyond ASCII."""
    plain = F.translate(text, _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    return F.coalesce(F.filter(F.split(plain, " "), lambda w: w != ""), F.array().cast("array<string>"))


def bucket_array(words: Column, width: int, buckets: int) -> Column:
    """The buckets of all runs of 1 to ``width`` words."""
    bucket = lambda s: (F.crc32(s.cast("binary")) % buckets).cast("int")
    out = [F.transform(words, bucket)]
    runs = lambda n: F.transform(words, lambda _, i: bucket(F.concat_ws(" ", F.slice(words, i + 1, n))))
    for n in range(2, width + 1):
        out.append(F.slice(runs(n), 1, F.greatest(F.size(words) - (n - 1), F.lit(0))))
    return F.concat(*out) if len(out) > 1 else out[0]


def _counts(arrays: DataFrame) -> dict[int, int]:
    """How often each bucket is used: at most as many rows as there are buckets."""
    return {r[0]: r[1] for r in arrays.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()}


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((corpus.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, width: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """For each document: doc_id, n_words, n_features, weight, score, and rank among the drawn (else null).

    Drawn are ``percent`` of the documents of at least ``least_words`` words, rounded down.
    """
    arrays = lambda df, text: df.select(words_of(col(df, text).cast("string")).alias("w"), *([] if df is target else [col(df, id_col).alias("doc_id")]))
    own = arrays(docs, text_col).select("doc_id", F.size("w").cast("long").alias("n_words"), bucket_array(F.col("w"), width, buckets).alias("buckets"), F.monotonically_increasing_id().alias("_row"))
    own = materialise(own, "bucket-arrays")
    wanted = arrays(target, target_text).select(bucket_array(F.col("w"), width, buckets).alias("buckets"))
    gains = F.expr("array(" + ",".join(f"{g}L" for g in bucket_gains(_counts(own), _counts(wanted), buckets)) + ")")

    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda n, b: n + F.element_at(gains, b + 1))
    n = F.size("buckets").cast("long")
    summed = own.select("doc_id", "n_words", n.alias("n_features"), total.alias("_total"), "_row")
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(_total - pmod(_total, n_features)) div n_features")).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = materialise(summed.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"), "_row"), "scores")
    drop_table(own)

    able = F.col("n_words") >= least_words
    at_score = sorted(scored.where(able).groupBy("score").count().collect(), reverse=True)
    wanted_rows = percent * sum(r[1] for r in at_score) // 100
    least, seen = None, 0
    for score, count in at_score:
        if seen >= wanted_rows:
            break
        least, seen = score, seen + count
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    reach = able & (F.col("score") >= F.lit(least).cast("long")) if least is not None else F.lit(False)
    rest = scored.where(~reach).select(*columns, F.lit(None).cast("long").alias("rank"))
    if least is None:
        return rest
    placed = numbered(scored.where(reach).withColumn("_down", -F.col("score")), ["_down", "doc_id", "_row"], "_place")
    return placed.select(*columns, F.when(F.col("_place") < wanted_rows, F.col("_place") + 1).alias("rank")).unionByName(rest)
