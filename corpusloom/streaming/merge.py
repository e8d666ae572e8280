"""Keep-last merging and windowed counts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flow import keep_last


def merge_stream(stream: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Each micro-batch is upserted as the next version of a table at ``path``.

    A version is a folder named by its batch; repeating a batch after a failure
    writes the same folder, so the merge is idempotent.
    """
    spark = stream.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        whole = batch
        if number > 0:
            whole = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}").unionByName(batch)
        keep_last(whole, key, order).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """Events a window and kind; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
