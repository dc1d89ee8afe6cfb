"""Operators 3, 8 and 1."""

import random
import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import op1_mixing as one
from docloom.llm import op3_topk as three
from docloom.llm import op8_sharding as eight


def brute(rows, k=20, step=20):
    vs = [(i, [floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(vs):
        if i % step == 0:
            s = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(vs) if a != b and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_top_k(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, three.op3_topk(spark, sf).collect())) == brute(rows)


def test_top_k_shards_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5]) for _ in range(3)]) for i in range(400)]
    rows += [(7, [9.0, 9.0, 9.0]), (40, [0.5, -1.0, 0.0]), rows[40], rows[41], (None, [1.0] * 3), (401, None), (402, [None, 1.0, 1.0]), (403, [float("nan")] * 3), (404, [float("inf"), 0.0, 0.0]), (420, [1.0]), (421, [2.0]), (440, []), (441, []), (460, [3.0e18, 1.0, -4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([r for r in rows if r[0] != 460])
    small = df.where("vec_id IS NULL OR vec_id <> 460")
    assert sorted(map(tuple, three.top_k(small, lambda i: i % 20 == 0, shard_rows=60, query_rows=7).collect())) == want
    assert three.top_k(df, lambda i: i % 20 == 0, k=3).where("query_id = 460").count() == 3


def test_top_k_empty(spark, empty_docs):
    assert three.op3_topk(spark, empty_docs).collect() == []


def test_tree_prunes():
    x = np.concatenate([np.random.default_rng(0).normal(c, 0.1, (200, 4)) for c in (0, 5, 10)])
    q = np.array([[1.0, 1, 1, 1]])
    bounds = three.BallTree(x, 50).bounds(q)[0]
    best = np.sort(x @ q[0])[-5]
    assert (bounds >= best).sum() < len(bounds)


def test_waves():
    assert list(three.waves(1)) == [(0, 1)] and list(three.waves(30)) == [(0, 1), (1, 4), (4, 16), (16, 30)]


def smallest(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            n, at = (n + 1, s) if at + s > mid else (n, at + s)
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def test_capacity_is_the_smallest(spark):
    rng = random.Random(5)
    for n, shards, bits in ((500, 7, 3), (40, 24, 2), (2000, 24, 4), (3, 5, 1)):
        rows = sorted((rng.randrange(-(2**63), 2**63), rng.choice([8, 20, 100, 5000])) for _ in range(n))
        cuts, capacity = eight.cut_hashes(spark.createDataFrame(rows, "h long, size long"), shards, bits, 3)
        assert capacity == smallest([s for _, s in rows], shards)
        sums = Counter()
        for h, s in rows:
            sums[sum(h >= c for c in cuts)] += s
        assert max(sums.values()) <= capacity and cuts == sorted(cuts) and len(cuts) == shards - 1


@pytest.mark.parametrize("where", ["sf", "odd_docs", "empty_docs"])
def test_shards(spark, where, request):
    d = request.getfixturevalue(where)
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = eight.op8_sharding(spark, d).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows), key=str)
    slots, home, size = defaultdict(list), {}, Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        assert home.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 24 for s in slots)
    if where == "sf":
        assert len(size) == 24 and max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got)


def shares(sizes, weights):
    """Targets by bisection: the unit at which the capped shares add up to 150 %."""
    low, high = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(300):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(2 * s, unit * w) for s, w in zip(sizes, weights)) < 1.5 * sum(sizes) else (low, unit)
    return [min(2.0 * s, high * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("where", ["sf", "odd_docs", "empty_docs"])
def test_mixture(spark, where, request):
    d = request.getfixturevalue(where)
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = one.op1_mixing(spark, d).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, one.op1_mixing(spark, d).collect()), key=str)
    import re

    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted(((r.doc_id, r["size"]) for r in got), key=str) == sorted(((r.doc_id, size(r.text)) for r in rows), key=str)
    sources, want = Counter(), {}
    for r in rows:
        sources[r.source] += size(r.text)
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    for s, t in zip(names, shares([sources[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])):
        want[s] = t
        assert t <= 2 * sources[s] + 1e-6
    assert abs(sum(want.values()) - 1.5 * sum(sources.values())) < 1e-3
    per = defaultdict(float)
    assert Counter((round(r.target, 4), r.source_size) for r in got) == Counter((round(want[r.source], 4), sources[r.source]) for r in rows)
    for r in got:
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 2 * r["size"]
        per[round(r.target, 4)] += r.taken
    for t, x in per.items():
        same = [n for n in names if round(want[n], 4) == t]
        assert abs(x - t * len(same)) <= len(same) * max(size(r.text) for r in rows if r.source in same)


def test_splitting_tree():
    quotas = np.array([17, 0, 400, 3])
    leaves = one.split_quotas(quotas, 7, np.random.default_rng(2))
    assert (leaves.sum(axis=0) == quotas).all() and leaves.min() >= 0 and np.ptp(leaves.sum(axis=1)) <= 3
    assert one.targets([10, 10, 1000], [3, 1, 2]) == [20.0, 20.0, 1490.0]


def test_mixture_of_clashing_columns(spark):
    rows = [(i, f"s{i % 2}", i % 7, f"a{i}", f"b{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int, mix_block string, MIX_SHARD string, mix_limit long")
    key = F.xxhash64("doc_id")
    mixture = one.mix(df, F.col("n").cast("long"), key, shards=3, shard_words=100)
    assert mixture.shards == -(-1.5 * sum(r[2] for r in rows) // 100)
    got = one.shuffled(mixture, key)
    assert got.columns == df.columns
    taken = Counter(map(tuple, got.collect()))
    assert set(taken) <= set(rows) and max(taken.values()) <= 2
    words = {t: s for t, s in ((r["target"], r["source"]) for r in mixture.sources.collect())}
    for target, source in words.items():
        assert abs(sum(r[2] * n for r, n in taken.items() if r[1] == source) - target) <= 6


def test_shards_draw_disjoint_blocks(spark, sf):
    rng = np.random.default_rng(1)
    blocks = [rng.integers(1, 50, n) for n in (40, 7, 1, 64)]
    goals = [1.5 * blocks[0].sum(), 0.4 * blocks[1].sum(), 2.0 * blocks[2].sum(), 0.9 * blocks[3].sum()]
    plan = one.draw_plan(blocks, goals, 8, 3)
    assert len({(s, b, copy) for s, b, copy, _, _ in plan}) == len(plan)
    totals = Counter(shard for _, _, _, shard, _ in plan)
    assert max(totals.values()) - min(totals[i] for i in range(8)) <= 1
    for s, (words, goal) in enumerate(zip(blocks, goals)):
        assert abs(sum(words[b] if limit is None else limit for o, b, _, _, limit in plan if o == s) - goal) < 0.5


def test_copies_of_the_mixture(spark, sf):
    rows = one.op1_mixing(spark, sf).collect()
    places = defaultdict(list)
    for r in rows:
        assert (r.taken == len(r.copies) * r["size"]) and len(r.copies) <= 2
        for c in r.copies:
            places[c.shard].append((c.place, r.doc_id))
    assert set(places) <= set(range(32)) and all(sorted(p for p, _ in ps) == list(range(len(ps))) for ps in places.values())
    ordered = [d for ps in places.values() for _, d in sorted(ps)]
    assert ordered != sorted(ordered) and [r.copies for r in sorted(one.op1_mixing(spark, sf).collect(), key=str)] == [r.copies for r in sorted(rows, key=str)]
