"""Reranking by a score times a metadata boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import config as C
from docloom.functions import text as t


def drawing_query(query: Column) -> Column:
    return t.contains_any(query, C.DRAWING_WORDS)


def boost(query: Column, asked_domain: Column, asked_voltage: Column) -> Column:
    """1 and what fits: of the chunk's doc_number, file_path, category, publish_level, is_drawing, domain, voltage_level; 1.15 at most."""
    number = F.coalesce(F.col("doc_number"), F.lit(""))
    name = F.lower(t.basename(F.coalesce(F.col("file_path"), F.lit(""))))
    asked = F.lower(query)
    tokens = F.filter(F.split(name, r"(?U)[_\-.\s]+"), lambda w: (F.length(w) >= 2) & F.contains(asked, w))
    add = lambda test, x: F.when(test, x).otherwise(0.0)
    parts = (
        add((number != "") & F.contains(query, number), 0.05) + add(F.size(tokens) >= 2, 0.10) + add(F.col("category") == C.STANDARDS, 0.03)
        + add(F.col("publish_level").isin("国标", "行标"), 0.03) - add(F.coalesce(F.col("is_drawing"), F.lit(False)) & ~drawing_query(query), 0.10)
        + add(asked_domain == F.col("domain"), 0.05) + add(asked_voltage == F.col("voltage_level"), 0.05)
    )
    return F.round(F.least(F.lit(1.15), 1 + parts), 4)


def confidence(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def rerank(hits: DataFrame, k: int = C.FINE_K, model: bool = True, digits: int = 6, score: str = "score") -> DataFrame:
    """hits: query_id, query, asked_domain, asked_voltage, rank, score and the chunk's columns.

    Not more hits than k keep their order and score. Else the score of the pair (a column, pair_score of pairs.py or the
    list's own) times boost orders them, and what is equal keeps its order. Without a model the boost alone does, as it is
    for an empty query.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    query = F.col("query") if model else F.lit("")
    weighed = boost(query, F.col("asked_domain"), F.col("asked_voltage"))
    rows = hits.withColumns({"n": n, "boost": weighed})
    final = F.when(F.col("n") <= k, F.col("score")).otherwise(F.col(score) * F.col("boost") if model else F.col("boost"))
    rows = rows.withColumn("fine_score", F.round(final, digits))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("n") <= k, F.col("rank")), F.desc("fine_score"), "rank")
    rows = rows.withColumn("fine_rank", F.row_number().over(order)).where(F.col("fine_rank") <= k)
    return rows.withColumn("confidence", confidence(F.col("fine_score"))).drop("n")
