"""The index at rest against scores of all pairs."""

import math
import random

import pytest

from docloom.operators import index, search
from docloom.sources import shared

SCHEMA = "chunk_id string, words array<string>, domain string, doc_number string, dense array<double>"


def made(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(f"c{i}", rng.choices(vocabulary, weights, k=rng.randrange(30)) if i % 17 else None, rng.choice(["a", "b", None]), rng.choice(["GB 1", "GB 22", None]), [rng.random() - 0.5 for _ in range(4)]) for i in range(n)]


def asked(rng, n):
    return [(q, rng.choices([f"w{i}" for i in range(70)], k=rng.randrange(6)), rng.choice([None, "a", "b", "none"]), rng.choice([None, "GB", "22"])) for q in range(n)]


def all_pairs(queries, chunks, k, conditions=()):
    out = []
    for q, words, domain, number in queries:
        scored = []
        for c, ws, d, nr, _ in chunks:
            if "domain" in conditions and domain is not None and domain != d or "doc_number" in conditions and number is not None and (nr is None or number not in nr):
                continue
            s = sum((1 + math.log(words.count(w))) * (1 + math.log(ws.count(w))) for w in set(words) if w in (ws or ()))
            if s > 0:
                scored.append((-math.floor(s * 1e4 + 0.5) / 1e4, c))
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("segment", [64, 2048])
def test_index_finds_what_all_pairs_do(spark, segment, monkeypatch):
    monkeypatch.setattr(index, "WAVE", 4)
    rng = random.Random(segment)
    chunks, queries = made(rng, 900), asked(rng, 40)
    ready = index.build(spark.createDataFrame(chunks, SCHEMA).repartition(3), shared.fresh(spark, "t"), segment)
    df = spark.createDataFrame(queries, "query_id int, words array<string>, domain string, doc_number string")
    assert ready.segments >= 3
    assert rows(search.sparse_search(df, ready, 5)) == all_pairs(queries, chunks, 5)
    both = {"domain": "equal", "doc_number": "contains"}
    assert rows(search.sparse_search(df, ready, 5, conditions=both, block=7)) == all_pairs(queries, chunks, 5, both)
    strict = df.where("doc_number IS NOT NULL")
    assert rows(search.sparse_search(strict, ready, 3, conditions=both)) == all_pairs([q for q in queries if q[3]], chunks, 3, both)


def test_blocks_are_skipped(spark):
    common = [(f"c{i:04}", ["the"] * (40 if i < 30 else 1), None, None, None) for i in range(1500)]
    ready = index.build(spark.createDataFrame(common, SCHEMA).coalesce(1), shared.fresh(spark, "t"))
    one = spark.createDataFrame([(1, ["the"])], "query_id int, words array<string>").collect()
    met = index.found_in(ready, one, 5, {}, lambda x: search.rounded(x, 4)).first()
    assert met.chunk_ids == [f"c000{i}" for i in range(5)] and met.scored < met.blocks / 4


def test_added_segments(spark):
    rng = random.Random(4)
    chunks, queries = made(rng, 300), asked(rng, 20)
    path = shared.fresh(spark, "t")
    ready = index.build(spark.createDataFrame(chunks[:200], SCHEMA), path, 50)
    before = ready.segments
    more = ready.add(spark.createDataFrame(chunks[200:], SCHEMA), 50)
    df = spark.createDataFrame(queries, "query_id int, words array<string>, domain string, doc_number string")
    assert more.segments > before and index.opened(spark, path).segments == more.segments
    assert rows(search.sparse_search(df, more, 4)) == all_pairs(queries, chunks, 4)
    assert index.opened(spark, shared.fresh(spark, "none")) is None


def test_conditions_reach_the_scan(spark):
    rng = random.Random(5)
    ready = index.build(spark.createDataFrame(made(rng, 50), SCHEMA), shared.fresh(spark, "t"))
    (row,) = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "22")], "query_id int, dense array<double>, doc_number string").collect()
    df = search.dense_block([row], ready.chunks, 3, 4, {"doc_number": "contains"}, search.shape_of(spark.createDataFrame([row]), ready.chunks))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(doc_number,22)" in plan and "words" not in plan.split("ReadSchema", 1)[1]
    assert {r.chunk_id for r in df.collect()} <= {c[0] for c in made(random.Random(5), 50) if c[3] == "GB 22"}


def test_tiles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE_BYTES", 800)
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "chunk_id int, dense array<double>")
    few = rows(search.dense_search(vectors.withColumnRenamed("chunk_id", "query_id"), vectors, 5))
    monkeypatch.undo()
    assert few == rows(search.dense_search(vectors.withColumnRenamed("chunk_id", "query_id"), vectors, 5))
