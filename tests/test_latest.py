"""The last row of each key as a stream's state."""

import pytest

from corpusloom.operators.flow import keep_last
from corpusloom.streaming import latest


def test_stream_of_last_rows(spark, tmp_path):
    pytest.importorskip("google.protobuf")  # the state server's messages
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    latest.use_state_store(spark)
    try:
        src, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
        schema = "id string, seq long, text string"
        batches = [[("a", 1, "x"), ("b", 5, None), ("a", 3, "y")], [("a", 2, "late"), ("c", 1, "z")], [("b", 9, "new"), ("c", 1, "same order")]]
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            q = latest.latest_stream(spark.readStream.schema(schema).parquet(src), out, at, "id", "seq")
            q.awaitTermination(120)
            assert q.exception() is None
        got = sorted(map(tuple, latest.read_latest(spark, out, "id").select("id", "seq", "text").collect()))
        assert got == [("a", 3, "y"), ("b", 9, "new"), ("c", 1, "same order")]
        whole = spark.createDataFrame([r for b in batches for r in b], schema)
        assert [r[:2] for r in got] == sorted((r["id"], r["seq"]) for r in keep_last(whole, "id", "seq").collect())
        # a batch writes its own updates alone: the late row of the second one changes nothing
        assert [spark.read.parquet(f"{out}/batch={k}").count() for k in range(3)] == [2, 1, 2]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
