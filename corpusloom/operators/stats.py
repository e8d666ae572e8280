"""Counts, summaries, pivots and other tables behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of values, null among them."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    n = F.length(F.coalesce(column, F.lit("")))
    return df.select(n.alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n"), 6).alias("mean"), F.expr("percentile(n, 0.5)").alias("median"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins from the least to the largest value; the last is closed."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = F.broadcast(v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    slot = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return v.join(ends).select(slot.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def category_summary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, the mode (the smallest of the most frequent), and its size."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col(column).alias("v")))
    return counts.agg(F.count(F.lit(1)).alias("n_values"), best["v"].alias("mode"), (-best["k"]).alias("mode_count"))


def monthly_pivot(df: DataFrame, ts: str, topic: str, topics: list[str]) -> DataFrame:
    """Rows a month end and topic; months without rows are absent, topics without rows 0."""
    return df.groupBy(F.last_day(ts).alias("month")).pivot(topic, topics).count().na.fill(0)


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, in one pass, long."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.round(F.corr(a, b), 6).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)))))


def term_frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def document_frequencies(docs: DataFrame, id_col: str, terms: Column, least: int, share: float, most: int) -> DataFrame:
    """Terms in ``least`` documents or more and at most ``share`` of them; the ``most`` most frequent."""
    total = F.broadcast(docs.agg(F.count(F.lit(1)).alias("docs")))  # one row
    seen = docs.select(id_col, F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return seen.where(F.col("df") >= least).join(total).where(F.col("df") <= F.col("docs") * share).orderBy(F.desc("df"), "term").limit(most).select("term", "df")


def top_per_group(df: DataFrame, group: str, weight: str, tie: str, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(weight), tie))).where(F.col("rank") <= n)


def label_overlay(seed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Existing labels over seeds, as numbers where they are numbers."""
    return seed.join(existing, key, "left").select(key, F.coalesce("existing", "seed").try_cast("double").alias("label"))


def label_breakdown(labels: DataFrame) -> DataFrame:
    one, zero, none = (F.count_if(c) for c in (F.col("label") == 1, F.col("label") == 0, F.col("label").isNull()))
    return labels.agg(one.alias("n1"), zero.alias("n0"), none.alias("n_null"), F.round(100 * F.expr("try_divide(count_if(label = 1), count(label))"), 1).alias("percent1"))


def dashboard(df: DataFrame, text: str, topic: str, group: str, bins: int = 50, most: int = 10) -> DataFrame:
    """(panel, key, value): lengths by bin, the ``most`` frequent topics, sizes of groups, and a summary."""
    line = lambda t, panel, key: t.select(F.lit(panel).alias("panel"), F.col(key).cast("string").alias("key"), F.col("n").cast("double").alias("value"))
    s = length_stats(df, text).select(F.inline(F.array(*(F.struct(F.lit("summary").alias("panel"), F.lit(k).alias("key"), F.col(c).cast("double").alias("value")) for k, c in (("documents", "docs"), ("mean_length", "mean"), ("median_length", "median"))))))
    return line(histogram(df, F.length(text), bins), "length", "bin").union(line(top_counts(df, topic, most), "topic", topic)).union(line(value_counts(df, group), "cluster", group)).union(s)
