"""What the operators of this package share: tables, the shared folder, row-wise Arrow columns."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of a batch that goes to Python, and bytes, where rows are large; so many are in memory at once.
BATCH_ROWS, BATCH_BYTES = 250, 16 << 20
#: Python workers are used again by later stages: with this, what they free goes back to the system.
LEAN_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "4194304"}
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Small batches, and Python workers that keep little."""
    spark.sparkContext.environment.update(LEAN_ENV)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set (tests in local mode), one under /tmp."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"/tmp/checkpoints/docloom-{spark.sparkContext.applicationId}"
    atexit.register(shutil.rmtree, own, True)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone by then
            remove(spark, path)


class Scratch:
    """Tables of one run of an operator in the shared folder; drop() deletes those that are spent, the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.paths = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", {}
        atexit.register(_remove_at_exit, spark, self.folder)

    def path(self, tag: str) -> str:
        return f"{self.folder}/{tag}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """df as a table: cuts the lineage, and outlives any executor. The job's shuffle files go with its end."""
        prepare(self.spark)
        path, before = self.path(tag), self.spark.conf.get(CLEAN)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths.pop(id(t))[1])


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores behind it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column: null is the empty text, bytes that aren't UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column: null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def append_columns(df: DataFrame, inputs: list[str], make, fields: list[T.StructField]) -> DataFrame:
    """df with the columns of fields behind its own; a column of df that bears such a name is replaced.

    make() is called once in each task and returns a function of the input columns (Arrow arrays of one
    batch) that returns one list or Arrow array for each field.
    """
    prepare(df.sparkSession)
    new = {f.name.lower() for f in fields}
    own = [f for f in df.schema.fields if f.name.lower() not in new]
    keep = [f.name for f in own]

    def run(batches):
        fn = make()
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            out = fn(*(batch.column(batch.schema.get_field_index(c)) for c in inputs))
            yield pa.RecordBatch.from_arrays(cols + [x if isinstance(x, pa.Array) else pa.array(x, type=ARROW[f.dataType.typeName()]) for x, f in zip(out, fields)], names=keep + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(own + fields))


ARROW = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
LONG, INT, DOUBLE, STRING, BINARY, BOOLEAN = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType(), T.BooleanType()


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
