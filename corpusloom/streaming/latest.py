"""The last row of each key as keyed state of a stream.

State is partitioned by key and holds one row a key, so a micro-batch costs what its own rows cost, whatever
the table's size.  Rows that change a key's state leave as updates; a state that no row has touched for ``ttl``
expires.  The session needs a state store that keeps typed state (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.flow import keep_last

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class Latest(StatefulProcessor):
    """Keeps the row of the highest order of its key; an equal order replaces it, as the later arrival."""

    def __init__(self, order: str, columns: list[str], schema: str, ttl: int | None):
        self.order, self.columns, self.schema, self.ttl = order, columns, schema, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema, self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for row in pdf[self.columns].itertuples(index=False, name=None):
                if best is None or row[self.columns.index(self.order)] >= best[self.columns.index(self.order)]:
                    best = row
        at = self.columns.index(self.order)
        held = self.last.get() if self.last.exists() else None
        if best is not None and (held is None or best[at] >= held[at]):
            self.last.update(best)
            yield pd.DataFrame([best], columns=self.columns)

    def close(self) -> None:
        pass


def latest_updates(stream: DataFrame, key: str, order: str, ttl: int | None = None) -> DataFrame:
    """The rows of ``stream`` that become the last of their key, in its columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    processor = Latest(order, stream.columns, schema, ttl)
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=stream.schema, outputMode="Update", timeMode="ProcessingTime" if ttl else "None")


def latest_stream(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, ttl: int | None = None) -> StreamingQuery:
    """Append the updates of each micro-batch to its own folder of a log at ``path``; a repeated batch writes the same folder."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return latest_updates(stream, key, order, ttl).writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last row of each key from the log: that of the latest batch."""
    log = spark.read.parquet(path)
    return keep_last(log, key, "batch").drop("batch")
