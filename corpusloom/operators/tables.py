"""Tables kept in the shared folder while an iterative operator runs."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session in one process may do without and gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="corpusloom-")
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


class Shelf:
    """A folder of its own for the tables of one call; dropped with ``clear`` or when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_remove, spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back, which cuts its lineage."""
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, table: str, by: str) -> None:
        """Append to a table of the shelf in one folder for each value of ``by``."""
        df.write.mode("append").partitionBy(by).parquet(f"{self.path}/{table}")

    def part(self, table: str, by: str, value: int, schema: StructType) -> DataFrame:
        """The rows added with one value of ``by``, without that column; none where nothing was added."""
        path = f"{self.path}/{table}/{by}={value}"
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove kept tables that nothing reads any more."""
        for df in tables:
            for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
                _remove(self.spark, f)

    def clear(self) -> None:
        _remove(self.spark, self.path)
