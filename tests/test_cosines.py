"""All pairs of queries and vectors of a group, from cells instead of joined rows."""

import math
import random

from pyspark.sql import functions as F

from docloom.operators import search
from docloom.plans import fixtures as x
from docloom.plans import retrieval

SHAPE = "chunk_id long, dense array<float>, label int"


def joined(rows):
    q, v = rows.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), F.col("dense").alias("q"), "label"), rows
    return v.join(q, "label").select("query_id", "chunk_id", F.round(search.cosine(F.col("q"), F.col("dense")), 4).alias("score"))


def cells(rows):
    return search.all_cosines(rows.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id"), rows, "label")


def plain(df):
    return sorted((r[0], r[1], str(r[2])) for r in df.collect())


def test_cells_equal_joined_rows(spark, monkeypatch):
    rng = random.Random(2)
    odd = [None, [], [0.0, 0.0, 0.0], [None, 1.0, 2.0], [1.0], [math.nan, 1.0, 0.0], [3.0, 4.0, 0.0, 1.0], [-1.0, -2.0, -3.0]]
    data = [(i, rng.choice(odd) if i % 4 == 0 else [rng.uniform(-1, 1) for _ in range(3)], rng.choice([1, 1, 1, 2, 3, None])) for i in range(400)]
    rows = spark.createDataFrame([*data, data[3], data[6], data[6]], SHAPE)
    want = plain(joined(rows))
    assert plain(cells(rows)) == want and len({s for *_, s in want}) > 100 and {"None", "nan", "0.0"} < {s for *_, s in want}
    for name, value in (("CELL_VECTORS", 7), ("CELL_QUERIES", 5), ("TASK_PAIRS", 1000), ("BATCH_PAIRS", 10), ("SPREAD", 6)):
        monkeypatch.setattr(search, name, value)
    assert plain(cells(rows)) == want
    assert cells(rows.limit(0)).count() == 0


def test_a_large_group_is_in_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_PAIRS", 10_000)
    rows = spark.range(3000).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("dense"), (F.col("id") / 10_000).cast("int").alias("label"))
    found = cells(rows).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in found) == 3_000_000 and max(r[1] for r in found) < 300_000


def test_no_row_of_a_pair_is_joined(spark, sf):
    # the join is of cells; before, it had a row for each pair, with both vectors
    plan = retrieval.rr_cosine(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "zip_with" not in plan
    v = x.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("dense"), "label").where("label < 3")
    assert plain(cells(v)) == plain(joined(v))
