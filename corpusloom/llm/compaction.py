"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable shards.  Shards of similar size form a
tier; once a tier holds enough of them they are merged into files of the target
size.  A manifest names the shards of a version.  It is written beside the others
and renamed to the next version, which fails if another writer was first, so a
reader sees the old or the new version and never a part of one.

A merge reads whole files and packs them into tasks of the target size: rows are
not shuffled, and no task holds more than one target file.  Who loses the race for
a version tries the next one with the shards it has written, or removes them if it
gives up.  Old versions stay readable until ``vacuum``, which keeps the newest.

Defined cases: nulls, empty and long texts, ties, repeated rows and any other
columns are stored as they come; appending an empty table commits a version
without new shards; a shard at or above the target is never rewritten.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh

TARGET_BYTES, FANOUT, LEAST_BYTES = 128 << 20, 4, 1 << 20
#: Times that a lost race is run again; versions that ``vacuum`` leaves to readers.
TRIES, KEPT = 20, 3


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


def _file_name(part: int) -> Column:
    """A part of the path of the file that a row was read from; unlike the metadata column no column's name can hide it."""
    return F.element_at(F.split(F.input_file_name(), "/"), part)


class ShardStore:
    """A table of immutable shards at ``root``, on any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT, least: int = LEAST_BYTES):
        self.spark, self.root, self.target, self.fanout, self.least = spark, root.rstrip("/"), target, fanout, least
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # -- versions --

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The shards of a version, the latest by default."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else 0
        if not version:
            return {"version": 0, "shards": [], "schema": None}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str | None) -> dict:
        """Make ``shards`` the version after ``base``, or raise ``CommitConflict``."""
        new = {"version": base["version"] + 1, "schema": schema or base["schema"], "shards": sorted(shards, key=lambda s: s["file"])}
        draft = self._path(f"{self.root}/manifest/.draft-{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/manifest/v{new['version']:08d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(option, 1)
        how[0] = option.NONE  # fails where the version exists
        try:
            files.rename(draft, final, how)
        except Exception as e:
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {new['version']} is there") from e
        return new

    # -- shards --

    def _shards(self, folder: str, df: DataFrame) -> list[dict]:
        """The files of a written folder with their sizes and rows."""
        spark = df.sparkSession
        rows = {r["file"]: r["n"] for r in spark.read.schema(df.schema).parquet(folder).groupBy(_file_name(-1).alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()}
        out = []
        for s in self._fs.listStatus(self._path(folder)):
            name = s.getPath().getName()
            if name in rows:
                out.append({"file": f"{folder}/{name}", "bytes": s.getLen(), "rows": rows[name]})
        return out

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._shards(folder, df)

    def _remove(self, shards: list[dict]) -> None:
        for s in shards:
            self._fs.delete(self._path(s["file"]), False)

    def _add(self, shards: list[dict], schema: str) -> dict:
        for _ in range(TRIES):
            base = self.manifest()
            try:
                return self.commit(base, base["shards"] + shards, schema)
            except CommitConflict:  # another writer's version came first; the shards fit onto it as well
                continue
        self._remove(shards)
        raise CommitConflict(f"lost {TRIES} races")

    def append(self, df: DataFrame) -> dict:
        """Add ``df`` as small shards, in one version."""
        return self._add(self._write(df), df.schema.json())

    def append_waves(self, df: DataFrame, wave: Column, waves: int) -> Iterator[dict]:
        """Add the rows of each wave as an arrival of its own, in one version each; ``df`` is read once."""
        folder, name = f"{self.root}/data/{uuid.uuid4().hex}", fresh("_wave", df.columns)
        df.withColumn(name, wave).write.option("compression", "zstd").partitionBy(name).parquet(folder)
        for k in range(waves):
            own = f"{folder}/{name}={k}"
            yield self._add(self._shards(own, df) if self._fs.exists(self._path(own)) else [], df.schema.json())

    def tier(self, shard: dict) -> int:
        return max(0, int(math.log(max(shard["bytes"], 1) / self.least, self.fanout))) if shard["bytes"] > self.least else 0

    def due(self, manifest: dict, but: frozenset[int] = frozenset()) -> list[dict]:
        """The shards of the lowest tier that holds ``fanout`` or more below the target."""
        tiers: dict[int, list[dict]] = {}
        for s in manifest["shards"]:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s), []).append(s)
        full = [t for t, own in tiers.items() if len(own) >= self.fanout and t not in but]
        return tiers[min(full)] if full else []

    def compact(self) -> dict:
        """Merge tiers until none is due; each merge is one version.  A tier that doesn't get fewer files is left alone."""
        base, but, lost = self.manifest(), frozenset(), 0
        while own := self.due(base, but):
            merged = self._write_packed(own, base["schema"])
            gone = {s["file"] for s in own}
            if len(merged) >= len(own):
                self._remove(merged)
                but |= {self.tier(own[0])}
                continue
            while True:
                try:
                    base = self.commit(base, [s for s in base["shards"] if s["file"] not in gone] + merged, None)
                    break
                except CommitConflict:
                    base, lost = self.manifest(), lost + 1
                    if not gone <= {s["file"] for s in base["shards"]} or lost >= TRIES:  # another merge took them
                        self._remove(merged)
                        if lost >= TRIES:
                            raise
                        break
        return base

    def _write_packed(self, shards: list[dict], schema: str) -> list[dict]:
        """Read ``shards`` packed into tasks of the target size, and write a file from each; in a session of its own,
        so the caller's settings stay."""
        own = self.spark.newSession()
        settings = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": str(max(1, sum(s["bytes"] for s in shards) // self.target))}
        for k, v in settings.items():
            own.conf.set(k, v)
        return self._write(self._files(shards, schema, own))

    def _files(self, shards: list[dict], schema: str, session: SparkSession | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        return (session or self.spark).read.schema(StructType.fromJson(json.loads(schema))).parquet(*(s["file"] for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["shards"]:
            from pyspark.sql.types import StructType

            return self.spark.createDataFrame([], StructType.fromJson(json.loads(m["schema"])) if m["schema"] else StructType())
        return self._files(m["shards"], m["schema"])

    def vacuum(self, keep: int = KEPT) -> int:
        """Delete files that none of the last ``keep`` versions names; returns how many."""
        known = self.versions()
        live = {s["file"] for v in known[-keep:] for s in self.manifest(v)["shards"]}
        gone = 0
        for v in known[:-keep]:
            for s in self.manifest(v)["shards"]:
                if s["file"] not in live and self._fs.exists(self._path(s["file"])):
                    self._fs.delete(self._path(s["file"]), False)
                    gone += 1
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        return gone


def shard_documents(docs: DataFrame, root: str, waves: int = 4, id_col: str = "doc_id", **sizes: int) -> ShardStore:
    """Append ``docs`` in ``waves`` arrivals dealt by identifier, compacting after each."""
    store = ShardStore(docs.sparkSession, root, **sizes)
    wave = F.coalesce(F.pmod(F.crc32(col(docs, id_col).cast("string").cast("binary")), F.lit(waves)), F.lit(0))
    for _ in store.append_waves(docs, wave, waves):
        store.compact()
    store.vacuum()
    return store


def shard_contents(store: ShardStore, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each stored row: id, shard (its place in the manifest), shard_rows, text_sha256."""
    spark, m = store.spark, store.manifest()
    files = [(s["file"].rsplit("/", 1)[-1], "/".join(s["file"].split("/")[-3:-1]), i, s["rows"]) for i, s in enumerate(m["shards"])]
    if not files:
        return spark.createDataFrame([], f"{id_col} long, shard int, shard_rows long, text_sha256 string")
    names = spark.createDataFrame(files, "file string, folder string, shard int, shard_rows long")  # Spark checks its size before it broadcasts
    held = store.read()
    rows = held.select(col(held, id_col).alias(id_col), F.sha2(F.coalesce(col(held, text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"), _file_name(-1).alias("file"), F.concat_ws("/", _file_name(-3), _file_name(-2)).alias("folder"))
    return rows.join(names, ["file", "folder"]).select(id_col, "shard", "shard_rows", "text_sha256")
