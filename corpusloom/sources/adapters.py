"""The logical tables of the knowledge pipeline, derived from the given tables.

Each view is lazy; nested values stay native, and JSON appears only where a
stage's input is JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names that the data contract gives to entity types, confidence and frames.
ENTITY_TYPES = ("PER", "ORG", "LOC", "PROJ", "NORM", "DATE", "MONEY")
CONFIDENCE = ("high", "medium", "low")
FRAMES = ("problem", "diagnosis", "responsibles", "solution")
FRAME_TOKENS = {"problem": "the", "diagnosis": "der", "responsibles": "les", "solution": "que"}

#: Bytes of an Arrow batch that a Python worker receives.
BATCH_BYTES = 1 << 20

_S = T.StringType()
ENTITY = T.StructType([T.StructField(n, _S) for n in ("id", "name", "type", "confidence")])
RELATION = T.StructType([T.StructField(n, _S) for n in ("id", "subject", "relation", "object", "evidence", "confidence")])
EVENT = T.StructType([T.StructField("id", _S), T.StructField("type", _S), T.StructField("trigger", _S), T.StructField("arguments", T.MapType(_S, _S)), T.StructField("confidence", _S)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  Python workers get its rows in batches bounded by bytes, whatever the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("source").alias("media_name"), "lang")


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return docs.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.coalesce(F.col("quality").cast("string"), F.lit("ERROR")).alias("llm_class"))


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _local(prefix: str, i: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(i.cast("string"), 3, "0"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and the first names of each article: the one step of the extraction that reads texts."""
    found = F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"\p{Lu}\p{Ll}{3,}"), 0)), 1, 8)
    return articles(spark, sf_dir).select("id", found.alias("names"))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_names(names(spark, sf_dir))


def from_names(docs: DataFrame) -> DataFrame:
    """id and native entities, relations, events: rule-made from capitalised words, no shuffle."""
    entity = lambda x, k: F.struct(_local("e", k + 1).alias("id"), x.alias("name"), _pick(ENTITY_TYPES, F.length(x)).alias("type"), _pick(CONFIDENCE, F.length(x)).alias("confidence"))
    size = F.size("names")
    numbers = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    name = lambda i: F.get(F.col("names"), i - 1)
    relation = lambda i: F.struct(
        _local("r", i).alias("id"), _local("e", i).alias("subject"), F.substring(F.lower(name(i)), 1, 3).alias("relation"),
        F.when(i % 7 == 0, F.lit("e999")).otherwise(_local("e", i + 1)).alias("object"), F.concat_ws(" ", name(i), name(i + 1)).alias("evidence"), _pick(CONFIDENCE, F.length(name(i))).alias("confidence"),
    )
    roles = lambda i: F.map_filter(F.create_map(F.lit("actor"), _local("e", i), F.lit("lugar"), F.when(i < size, _local("e", i + 1)), F.lit("otro"), F.lit("e999")), lambda _, v: v.isNotNull())
    event = lambda i: F.struct(_local("ev", i).alias("id"), F.substring(F.lower(name(i)), 1, 4).alias("type"), F.lower(name(i)).alias("trigger"), roles(i).alias("arguments"), _pick(CONFIDENCE, F.length(name(i))).alias("confidence"))
    return docs.select(
        "id",
        F.transform("names", entity).alias("entities"),
        F.transform(F.filter(numbers, lambda i: i < size), relation).alias("relations"),
        F.transform(F.filter(numbers, lambda i: i % 3 == 0), event).alias("events"),
    )


def extraction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON text, as an extractor would answer."""
    return extractions(spark, sf_dir).select("id", *(F.to_json(c).alias(c) for c in ("entities", "relations", "events")))


def broken_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor answers of which every tenth is cut short, and some hold an unknown type."""
    e = F.to_json("entities")
    return extractions(spark, sf_dir).select("id", F.when(F.col("id") % 10 == 0, F.substring(e, 1, 5)).when(F.col("id") % 10 == 1, F.replace(e, F.lit('"PER"'), F.lit('"XXX"'))).otherwise(e).alias("entities"))


def argument_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and an array of arguments: claimants in capitals, targets null, unknown or the next name."""
    kinds = ("claim", "premise", "rebuttal", "proposal")
    one = lambda e, k: F.struct(
        _pick(kinds, k + 1).alias("argument_type"), F.upper(F.replace(e["name"], F.lit("ß"), F.lit("ss"))).alias("claimant"),
        F.when((k + 1) % 2 == 1, F.lit(None).cast("string")).when((k + 1) % 4 == 0, F.lit("ZZZ")).otherwise(F.get(F.col("entities"), k + 1)["name"]).alias("target"), F.concat(F.lit("says "), e["name"]).alias("sentence"),
    )
    return extractions(spark, sf_dir).select("id", F.transform("entities", one).alias("arguments"))


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, frame, present, evidence: four rows a document."""
    structs = [F.struct(F.lit(k).alias("seq"), F.lit(f).alias("frame"), F.contains(F.lower("body"), F.lit(t)).alias("present"), F.when(F.contains(F.lower("body"), F.lit(t)), F.lit(t)).otherwise("").alias("evidence")) for k, (f, t) in enumerate(FRAME_TOKENS.items())]
    return articles(spark, sf_dir).select("id", F.inline(F.array(*structs)))


def actor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user and day the number of events of each type: a document by actor matrix, long."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("node")).agg(F.count(F.lit(1)).alias("n"))
