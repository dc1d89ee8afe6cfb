"""Chunk tables and reports on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.metadata import stored_chunk

STRINGS = ["chunk_id", "file_hash", "file_name", "file_path", "text", "domain", "category", "doc_number", "publish_level", "voltage_level", "discipline", "equipment_type", "region", "project_stage", "chunk_strategy"]
#: A row of the chunk table: search reads it by exact scans, so it needs no index of its own.
CHUNK = T.StructType(
    [T.StructField(c, T.StringType()) for c in STRINGS]
    + [T.StructField(c, T.IntegerType()) for c in ("year", "page_num", "chunk_index", "total_chunks")]
    + [T.StructField("is_drawing", T.BooleanType()), T.StructField("dense", T.ArrayType(T.DoubleType())), T.StructField("words", T.ArrayType(T.StringType()))]
)
BUCKETS = 256


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a hash: its first two hexadecimal digits."""
    return (F.conv(F.substring(key, 1, 2), 16, 10).cast("int") % buckets).alias("bucket")


def as_chunks(df: DataFrame) -> DataFrame:
    """df's columns in the chunk table's order and kinds, nulls as it stores them; what df lacks is null or its default."""
    known = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK.fields))
    return stored_chunk(known).select(*CHUNK.fieldNames())


def write_chunks(df: DataFrame, path: str, buckets: int = BUCKETS, rows_per_file: int = 100_000) -> None:
    """Append chunks, a folder for each bucket, so that deleting or reading a file touches one."""
    rows = as_chunks(df).withColumn("bucket", bucket(F.col("file_hash"), buckets))
    rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("append").partitionBy("bucket").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_chunks(df: DataFrame, file_hash: str, buckets: int = BUCKETS) -> DataFrame:
    """Chunks of one file: its bucket's folder alone is read."""
    return df.where((F.col("bucket") == int(file_hash[:2], 16) % buckets) & (F.col("file_hash") == file_hash)).drop("bucket")


def markdown(rows: DataFrame, title: str, digits: int = 4) -> str:
    """A small table (averages of an evaluation) as Markdown."""
    told = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    body = ["| " + " | ".join(told(v) for v in r) + " |" for r in rows.collect()]
    return "\n".join([f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *body, ""])


def excerpts(reports: DataFrame, report: str, keywords: list[str], most: int = 400) -> DataFrame:
    """reports: question_id and Markdown with <details> blocks. question_id, place, summary, excerpt (of the block's code) and the keywords that its code holds."""
    fence = "`" * 3
    blocks = reports.select("question_id", F.posexplode(F.split(report, "<details>")).alias("place", "block")).where("place > 0")
    inner = F.trim(F.regexp_extract("block", "(?s)<summary>(.*?)</summary>", 1))
    code = F.regexp_replace(F.regexp_extract("block", f"(?s){fence}(.*?){fence}", 1), r"^\s+|\s+$", "")
    held = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains("code", k))
    return blocks.select("question_id", "place", F.substring(inner, 1, 60).alias("summary"), code.alias("code")).select("question_id", "place", "summary", F.substring("code", 1, most).alias("excerpt"), held.alias("keywords"))
