"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import shutil
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places that hashes fall into: so many numbers are broadcast at most.
PLACES = 1 << 21
#: Rows and bytes of a batch that goes to Python, at most; so many are in a worker's memory at once, however large the table.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: What workers free goes back to the system.
LEAN_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def prepare(spark: SparkSession) -> None:
    """Small batches, and Python workers that keep little."""
    spark.sparkContext.environment.update(LEAN_ENV)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it isn't set (local mode), a folder under /tmp that goes when Python ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"/tmp/checkpoints/docloom-core-{spark.sparkContext.applicationId}"
    atexit.register(shutil.rmtree, own, True)
    return own


def fresh(spark: SparkSession, tag: str) -> str:
    """A new place for tables of one run; they go when the driver ends, as what stands at its name with -checkpoint behind."""
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path, f"{path}-checkpoint")
    return path


def _remove(spark: SparkSession, *paths: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone by then
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a file or folder: changes with its name, time, size and number of files. Asks the file system, reads nothing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(at)
    told = (path, fs.getFileStatus(at).getModificationTime(), size.getLength(), size.getFileCount())
    return hashlib.sha256(repr(told).encode()).hexdigest()[:24]


def parts(spark: SparkSession, path: str, each: int) -> int:
    """How many parts of at most each bytes a file or folder has, one for each core at least: for a shuffle of what grows in its tasks, which AQE would join into too few."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def narrowed(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key isn't among wanted's, for a join by key that then shuffles what it needs. At most PLACES numbers are broadcast, however many keys there are; nothing is shuffled of rows."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES))
    some = wanted.select(place(key).alias("asked_place")).distinct()
    return rows.join(F.broadcast(some), place(key) == F.col("asked_place"), "left_semi")


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
