"""All queries outside the training-data package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import search
from docloom.operators.metadata import filename_metadata
from docloom.plans import fixtures as x
from docloom.plans import ingest, lifecycle, quality, retrieval, streams

QUERIES = ingest.QUERIES | retrieval.QUERIES | quality.QUERIES | lifecycle.QUERIES | streams.QUERIES
ORACLE_SQL = ingest.SQL | retrieval.SQL | quality.SQL | lifecycle.SQL | streams.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks by weighted words for each benchmark passage, with their files' metadata and a preview."""
    store = x.store(spark, sf_dir)
    asked = x.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), search.words("text").alias("words"))
    found = search.sparse_search(asked, store, 10)
    files = filename_metadata(store.chunks.select("chunk_id", "file_name", "file_path", F.substring("text", 1, 500).alias("preview")))
    return found.join(files, "chunk_id").select("query_id", "rank", "chunk_id", "score", "file_path", "doc_number", "discipline", "preview")
