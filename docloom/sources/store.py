"""Chunks and registry as one versioned store: changes of both become visible together, or not at all.

A file's rows lie in the bucket of its hash's first two digits. A version is a manifest that names, for each bucket
(256 by default) of each table, the folder that holds it. A change reads the buckets that it touches, writes them anew into a folder of its
own, and then puts the next manifest in place by one rename that fails if it is there already: until then readers see the
old version, and a crash leaves folders that no manifest names. Two changes at once: the later one is done again on
top of the other. A change has a name; a name that the current version knows isn't done twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.sinks import BUCKETS, bucket

CHUNKS, REGISTRY = "chunks", "registry"


class Conflict(Exception):
    """Another change took the version."""


class Store:
    """A store in a folder of the shared file system. schemas: of the two tables; both have file_hash. splits: tasks that write a bucket."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType], buckets: int = BUCKETS, splits: int = 8):
        self.spark, self.path, self.schemas, self.buckets, self.splits = spark, path, schemas, buckets, splits
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._context = self._fs.FileContext.getFileContext(self._fs.Path(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions

    def _manifest(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def latest(self) -> int:
        """0: nothing was written yet."""
        folder = self._fs.Path(f"{self.path}/versions")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if not version:
            return {"version": 0, "names": [], CHUNKS: {}, REGISTRY: {}}
        return json.loads("\n".join(self.spark.sparkContext.textFile(self._manifest(version), 1).collect()))

    def _publish(self, told: dict) -> None:
        """A manifest of a few KB: written under another name, then renamed."""
        draft = self._fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        fs = draft.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(draft)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        fs.mkdirs(self._fs.Path(f"{self.path}/versions"))
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self._context.rename(draft, self._fs.Path(self._manifest(told["version"])), options)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(told["version"]) from e
            raise

    # --- reading

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a version, or some of its buckets."""
        folders = self.manifest(version)[table]
        paths = [f"{self.path}/{table}/{folder}/bucket={b}" for b, folder in folders.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    # --- changes

    def change(self, name: str, hashes: DataFrame, make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 5) -> int:
        """The rows of these files (file_hash) are replaced by what make gives for them, in both tables; the version that shows it.

        make(tables): the files' rows so far, by table, to their new rows by table. A name that was done already changes nothing.
        """
        for _ in range(tries):
            old = self.manifest()
            if name in old["names"]:
                return old["version"]
            try:
                return self._changed(old, name, hashes, make)
            except Conflict:
                continue
        raise Conflict(f"{name}: {tries} tries")

    def _changed(self, old: dict, name: str, hashes: DataFrame, make) -> int:
        of = bucket(F.col("file_hash"), self.buckets)
        asked = hashes.select("file_hash").distinct()
        touched = sorted(r.bucket for r in asked.select(of).distinct().collect())  # 256 at most
        before = {t: self.read(t, old["version"], touched) for t in (CHUNKS, REGISTRY)}
        made = make({t: rows.join(asked, "file_hash", "left_semi") for t, rows in before.items()})
        folder, told = uuid.uuid4().hex, {"version": old["version"] + 1, "names": [*old["names"][-999:], name]}
        for t in (CHUNKS, REGISTRY):
            columns = self.schemas[t].names
            rest = before[t].join(asked, "file_hash", "left_anti").select(columns)
            rows = rest.unionByName(made[t].select(columns)).withColumn("bucket", of)
            rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(*columns), F.lit(self.splits))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{t}/{folder}")
            # a bucket that is empty now has no folder
            home = self._fs.Path(f"{self.path}/{t}/{folder}")
            names = [i.getPath().getName() for i in home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(home)]
            left = {n.removeprefix("bucket=") for n in names if n.startswith("bucket=")}
            told[t] = {b: f for b, f in old[t].items() if int(b) not in touched} | {b: folder for b in left}
        self._publish(told)
        return told["version"]

    def put(self, name: str, chunks: DataFrame, registry: DataFrame) -> int:
        """Files with their chunks; those that are there already are replaced."""
        return self.change(name, registry.select("file_hash").union(chunks.select("file_hash")), lambda _: {CHUNKS: chunks, REGISTRY: registry})

    def delete(self, name: str, hashes: DataFrame, now: Column) -> int:
        """The files' chunks go, and their registry rows say so."""

        def gone(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
            marked = {"status": F.lit("deleted"), "chunks_count": F.lit(0).cast("long"), "updated_at": now}
            return {CHUNKS: tables[CHUNKS].limit(0), REGISTRY: tables[REGISTRY].withColumns({c: v for c, v in marked.items() if c in tables[REGISTRY].columns})}

        return self.change(name, hashes, gone)

    def reindex(self, name: str, plan: DataFrame, texts: DataFrame, chunked: Callable[[DataFrame], DataFrame], now: Column) -> int:
        """Deletes and processes again the files that a plan (registry.reindexed) leaves pending, as one change.

        texts: file_hash and what chunked needs; chunked(texts) gives their chunks. A pending file without a text is failed, and its chunks go.
        """
        pending = plan.where("status = 'pending'").select("file_hash").distinct()

        def again(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
            mine = texts.join(pending, "file_hash", "left_semi")
            chunks = chunked(mine)
            counts = chunks.groupBy("file_hash").agg(F.count("*").alias("n"))
            rows = tables[REGISTRY].join(mine.select("file_hash", F.lit(True).alias("read")).distinct(), "file_hash", "left").join(counts, "file_hash", "left")
            told = {
                "status": F.when(F.col("read"), "completed").otherwise("failed"), "chunks_count": F.coalesce("n", F.lit(0)).cast("long"), "updated_at": now,
                "error_message": F.when(F.col("read"), "").otherwise("no text"), "reindex_count": (F.coalesce("reindex_count", F.lit(0)) + 1).cast("long"),
            }
            return {CHUNKS: chunks, REGISTRY: rows.withColumns({c: v for c, v in told.items() if c in tables[REGISTRY].columns})}

        return self.change(name, pending, again)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last versions names, and older manifests; how many folders went. Not to be run beside a change."""
        last = self.latest()
        kept = {(t, f) for v in range(max(1, last - keep + 1), last + 1) for t in (CHUNKS, REGISTRY) for f in self.manifest(v)[t].values()}
        gone = 0
        fs = self._fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for t in (CHUNKS, REGISTRY):
            home = self._fs.Path(f"{self.path}/{t}")
            for status in fs.listStatus(home) if fs.exists(home) else ():
                if (t, status.getPath().getName()) not in kept:
                    fs.delete(status.getPath(), True)
                    gone += 1
        for v in range(1, last - keep + 1):
            fs.delete(self._fs.Path(self._manifest(v)), False)
        return gone
