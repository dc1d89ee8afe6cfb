"""Scores of pairs against one pair at a time."""

import math
import random

from docloom.operators import index, pairs, search
from docloom.sources import shared


def one_by_one(asked, text, held, n):
    """The score by its definition."""
    asked, text = sorted(set(asked or []) - {None}), set(text or []) - {None}

    def grams(w):
        return {f"^{w}$"[i : i + 3] for i in range(len(w))}

    def like(a, b):
        v = 2 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b)))
        return v if v >= pairs.LIKE else 0

    weights = [math.log(1 + n / (1 + held.get(w, 0))) for w in asked]
    return round(sum(w * max((like(q, t) for t in text), default=0) for q, w in zip(asked, weights)) / sum(weights), 6) if asked else 0.0


def test_pairs_equal_their_definition(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcß", k=rng.randrange(1, 9)))
    texts = [("none", None), ("empty", []), ("null", [None, "ab"]), ("long", [word() for _ in range(20_000)]), *((f"c{i}", [word() for _ in range(rng.randrange(40))]) for i in range(60))]
    asked = [(0, None), (1, []), (2, ["unheard", "of"]), *((q, [word() for _ in range(rng.randrange(8))] * rng.choice([1, 2])) for q in range(3, 12))]
    chunks = spark.createDataFrame([(c, w, f"x{c}") for c, w in texts], "chunk_id string, words array<string>, asked string")
    ready = index.build(chunks.drop("asked"), shared.fresh(spark, "pairs"), segment=16)
    held = {}
    for _, w in texts:
        for t in set(w or []) - {None}:
            held[t] = held.get(t, 0) + 1
    queries = spark.createDataFrame(asked, "query_id long, words array<string>")
    hits = queries.select("query_id").crossJoin(chunks.drop("asked")).repartition(3)
    got = {(r.query_id, r.chunk_id): r.pair_score for r in pairs.lexical(hits, queries, ready).collect()}
    assert len(got) == len(texts) * len(asked)
    words = dict(texts)
    for q, own in asked:
        for c in words:
            assert abs(got[q, c] - one_by_one(own, words[c], held, len(texts))) < 2e-6
    assert pairs.lexical(hits.where("false"), queries, ready).collect() == []
    assert all(r.pair_score == 0 for r in pairs.lexical(hits, queries.where("false"), ready).collect())


def test_a_misspelt_query_finds_its_text(spark):
    """Where no word is the same, the likest words decide."""
    texts = [("a", "transformer insulation clearance".split()), ("b", "overhead line conductor sag".split()), ("c", "pump valve".split())]
    ready = index.build(spark.createDataFrame(texts, "chunk_id string, words array<string>"), shared.fresh(spark, "pairs"))
    queries = spark.createDataFrame([(1, "transfromers insulated".split())], "query_id long, words array<string>")
    hits = queries.select("query_id").crossJoin(ready.chunks.select("chunk_id", "words"))
    best = search.best(pairs.lexical(hits, queries, ready), 1, score="pair_score").collect()
    assert [r.chunk_id for r in best] == ["a"] and 0 < best[0].pair_score < 1
