"""Steps whose shuffles, batches and broadcasts must not follow the size of a table."""

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.plans import fixtures as x
from docloom.plans import quality, retrieval
from docloom.sources import shared


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrowed_keeps_all_that_is_wanted_and_little_else(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") % 1000 != 7, F.concat(F.lit("k"), "id")).alias("key"), "id")
    wanted = rows.where("id % 5000 = 0").select("key")
    left = shared.narrowed(rows, wanted, "key")
    assert left.join(wanted, "key").count() == 10
    assert left.count() < 20
    assert left.columns == ["key", "id"]
    assert shared.narrowed(rows, wanted.limit(0), "key").count() == 0


def test_passages_are_narrowed_before_they_are_shuffled(spark, sf, monkeypatch):
    seen = []

    def narrowed(rows, wanted, key, real=shared.narrowed):
        seen.append((rows.count(), real(rows, wanted, key).count()))
        return real(rows, wanted, key)

    monkeypatch.setattr(shared, "narrowed", narrowed)
    monkeypatch.setattr(x, "once", lambda s, d, tag, make: make())
    x.relevant(spark, sf)
    assert len(seen) == 1 and seen[0][1] * 20 < seen[0][0]


def test_texts_of_chunks_meet_lists_after_narrowing(spark, sf, monkeypatch):
    seen = []
    x.ranked(spark, sf, True)  # lists that stand there already aren't made again

    def narrowed(rows, wanted, key, real=shared.narrowed):
        seen.append(key)
        return real(rows, wanted, key)

    monkeypatch.setattr(shared, "narrowed", narrowed)
    quality.texts(spark, sf)
    assert seen == ["chunk_id"]
    retrieval.scored(spark, sf)
    assert seen == ["chunk_id"] * 3


def test_batches_for_python_are_bounded(spark, sf):
    x.table(spark, sf, "documents")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    assert spark.range(5000).coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= shared.BATCH_ROWS
    wide = spark.range(2000).coalesce(1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    assert wide.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] <= 2 * shared.BATCH_BYTES // 100_000


def test_the_second_leg_is_made_once_a_label(spark, sf):
    other = retrieval.legs(spark, sf)[1]
    text = plan(other)
    # the window stands below the join with the queries
    assert text.index("Join") < text.index("Window")
    v = [(r["vec_id"], r["label"]) for r in x.table(spark, sf, "embeddings").collect()]
    want = set()
    for q, label in v:
        if q % 50 == 0:
            found = sorted((-(i % 97 / 10), i) for i, own in v if own == label)[:100]
            want |= {(q, i, -s, n) for n, (s, i) in enumerate(found, 1)}
    assert {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in other.collect()} == want
