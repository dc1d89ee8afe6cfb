"""Progress events of jobs, numbered without gaps, once each, to be replayed from any number.

A batch of a stream has a folder of its own, in which its events are numbered behind those that the batches before it gave
their jobs. A batch that is done again finds the same numbers, since it counts the earlier batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField("job", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("event", T.StringType()), T.StructField("body", T.StringType())])
LAST = T.StructType([T.StructField("job", T.StringType()), T.StructField("last", T.LongType())])


def told(results: DataFrame, order: list[str]) -> DataFrame:
    """results: job, file_name, status, chunks, error. Two events a file, its start and its end, in the given order: job, at (an order), event, body as JSON."""
    n = F.row_number().over(Window.partitionBy("job").orderBy(*order)) - 1
    good = F.col("status") == "completed"
    start = F.struct(F.lit("file_start").alias("event"), F.to_json(F.struct("file_name", F.col("n").alias("index"))).alias("body"))
    done = F.to_json(F.struct("file_name", "chunks"))
    failed = F.to_json(F.struct("file_name", F.substring("error", 1, 200).alias("error")))
    end = F.struct(F.when(good, "file_done").otherwise("file_error").alias("event"), F.when(good, done).otherwise(failed).alias("body"))
    rows = results.withColumn("n", n.cast("long")).select("job", "n", F.posexplode(F.array(start, end)).alias("half", "e"))
    return rows.select("job", (F.col("n") * 2 + F.col("half")).alias("at"), "e.event", "e.body")


def appended(events: DataFrame, out: str, number: int) -> None:
    """Writes a batch: events has job, at (their order within the batch), event, body."""
    spark = events.sparkSession
    before = spark.read.schema(T.StructType([*LAST.fields, T.StructField("batch", T.LongType())])).parquet(f"{out}/last") if number else spark.createDataFrame([], T.StructType([*LAST.fields, T.StructField("batch", T.LongType())]))
    # a job's last number is that of its latest batch; only jobs with events in this one are looked at
    known = before.where(F.col("batch") < number).groupBy("job").agg(F.max("last").alias("last"))
    mine = events.join(known, "job", "left")
    seq = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("job").orderBy("at"))
    rows = mine.select("job", seq.cast("long").alias("seq"), "event", "body")
    rows.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
    spark.read.schema(EVENT).parquet(f"{out}/events/batch={number}").groupBy("job").agg(F.max("seq").alias("last")).write.mode("overwrite").parquet(f"{out}/last/batch={number}")


def written(events: DataFrame, out: str, checkpoint: str):
    """events (a stream): job, at, event, body. Writes what there is and ends."""
    return events.writeStream.foreachBatch(lambda batch, number: appended(batch, out, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(spark: SparkSession, out: str, behind: DataFrame | None = None) -> DataFrame:
    """job, seq, event and body of all events, or (behind: job, seq) of these jobs those behind a number."""
    rows = spark.read.schema(EVENT).parquet(f"{out}/events/batch=*")
    if behind is None:
        return rows
    return rows.join(behind.select("job", F.col("seq").alias("seen")), "job").where("seq > seen").drop("seen")


def as_stream_text(events: DataFrame) -> DataFrame:
    """Events as the lines of a server-sent stream: job, seq, line."""
    return events.select("job", "seq", F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\nevent: "), F.col("event"), F.lit("\ndata: "), F.col("body"), F.lit("\n\n")).alias("line"))
