"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession

#: Bytes of an Arrow batch that a Python worker receives: bounds its memory whatever the rows' length.
BATCH_BYTES = 1 << 20
#: Folders of sessions in one process without a shared folder, by application.
_own: dict[str, str] = {}
#: What modules keep for a Python worker's later tasks.
_kept: list[dict] = []


def worker_store() -> dict:
    """A store of a Python worker that ``lean`` empties."""
    _kept.append({})
    return _kept[-1]


def lean() -> None:
    """Give the system back what a worker's earlier tasks, of whatever operator, have left."""
    import pyarrow as pa

    for store in _kept:
        store.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers receive by their bytes; row counts stay as set."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a folder of its own; any other must set it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and re.match(r"local(\[|$)", spark.sparkContext.master):
        path = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="corpusloom-")
        _own[spark.sparkContext.applicationId] = path
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads the table, it does not
    recompute it.  ``drop_table`` removes it; what is left goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Remove tables made by ``materialise`` once nothing reads them any more."""
    for df in tables:
        _remove(df.sparkSession, df._scratch)


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores appended until no column has it (case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(df: DataFrame, name: str) -> Column:
    """The column called ``name``, whatever characters the name has."""
    quoted = name.replace("`", "``")
    return df[f"`{quoted}`"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
