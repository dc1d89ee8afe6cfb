"""Auto-index: a stream of new documents into chunks and a registry, each batch written once."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators.chunking import text_chunks


PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def on_disk(spark: SparkSession):
    """State of the queries that start within is kept in RocksDB; a query takes its settings along when it starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def documents(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def indexed(stream: DataFrame, out: str, checkpoint: str, key: str = "file_hash"):
    """A query that chunks what is new and ends when all is done. A batch has a folder of its own, so doing it again replaces it.

    Which files are known is the stream's own state, kept in RocksDB beside the checkpoint: a batch costs what is in it,
    however many went before.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        chunks = text_chunks(batch).select(key, "chunk_id", "chunk_index", "total_chunks", "chunk_text", "chunk_strategy")
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        written = spark.read.parquet(f"{out}/chunks/batch={number}").groupBy(key).agg(F.count("*").alias("chunks_count"))
        batch.select(key).join(written, key, "left").withColumns({"chunks_count": F.coalesce("chunks_count", F.lit(0)), "status": F.lit("completed")}).write.mode("overwrite").parquet(f"{out}/registry/batch={number}")
        batch.unpersist()

    with on_disk(stream.sparkSession):
        return stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, finish and events of each run of events at most a gap apart. Timestamps without a zone are taken as the session's."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "events")
