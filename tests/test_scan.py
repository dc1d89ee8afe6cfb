"""Evaluations' lists come from one pass over the chunks; no index is built for them."""

import random

from pyspark.sql import functions as F

from docloom.operators import search
from docloom.plans import fixtures as x
from docloom.plans import quality


def test_scan_equals_search_by_index(spark, monkeypatch):
    rng = random.Random(3)
    pick = lambda n: rng.choices([*"abcdefghij", "kk", None], [9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1, 1], k=n)
    chunks = [(f"c{i}", [w for w in pick(rng.randrange(0, 12)) if w]) for i in range(300)] + [("null", None), ("empty", [])]
    asked = [(i, [w for w in pick(6) if w]) for i in range(20)] + [(20, None), (21, []), (22, ["nowhere"]), (23, ["a"])]
    c = spark.createDataFrame(chunks, "chunk_id string, words array<string>").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, words array<string>")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    want = rows(search.sparse_search(q, c, 7))
    assert rows(search.sparse_scan(q, c, 7)) == want and len(want) > 100
    assert rows(search.sparse_scan(q, c, 7, block=5)) == want
    assert search.sparse_scan(q.limit(0), c, 7).count() == 0 and search.sparse_scan(q.where("query_id > 19 AND query_id < 22"), c, 7).count() == 0
    monkeypatch.setattr(search, "TILE_BYTES", 64)  # tiles of one chunk
    assert rows(search.sparse_scan(q, c, 7)) == want


def test_null_words_of_a_scan_count_as_none(spark):
    c = spark.createDataFrame([("a", ["x", None]), ("b", [None])], "chunk_id string, words array<string>")
    q = spark.createDataFrame([(1, [None, "x"])], "query_id int, words array<string>")
    assert [(r.chunk_id, r.score) for r in search.sparse_scan(q, c, 3).collect()] == [("a", 1.0)]


def test_lists_need_no_index_and_first_layer_no_fine_list(spark, sf, monkeypatch):
    made = []

    def once(s, d, tag, make):
        made.append(tag)
        return make()

    def store(s, d):
        raise AssertionError("an index of all chunks")

    monkeypatch.setattr(x, "once", once)
    monkeypatch.setattr(x, "store", store)
    assert quality.ev_by_category(spark, sf).count() == 4
    assert sorted(made) == ["coarse", "relevant"]
    assert quality.ev_layer3(spark, sf).count() == 40


def test_passages_by_hand(spark, sf, monkeypatch):
    monkeypatch.setattr(x, "once", lambda s, d, tag, make: make())
    words = lambda text: search.words(text).alias("words")
    grams = lambda w: {tuple(w[i : i + x.PASSAGE]) for i in range(len(w) - x.PASSAGE + 1)}
    items = [(r[0], grams(r[1])) for r in x.table(spark, sf, "benchmark").select("item_id", words("text")).collect()]
    chunks = [(r[0], grams(r[1])) for r in x.chunks(spark, sf).select("chunk_id", words("text")).collect()]
    want = {(i, c) for i, a in items for c, b in chunks if a & b}
    assert {tuple(r) for r in x.relevant(spark, sf).select(F.col("question_id"), "chunk_id").collect()} == want and want
