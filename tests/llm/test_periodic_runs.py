"""Operator 11 against runs found by comparing every shift."""

import hashlib
import random
import zlib

from docloom.llm import op11_periodic_runs as eleven
from tests.llm.conftest import by_id


def every_shift(w, least=12):
    got = {}
    for q in range(1, len(w) // 2 + 1):
        t = 0
        while t < len(w) - q:
            s = t
            while t < len(w) - q and w[t] == w[t + q]:
                t += 1
            if t > s and t - s + q >= max(least, 2 * q):
                got.setdefault((s, t + q), q)
            t += t == s
    return sorted(((s, e, q) for (s, e), q in got.items()), key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    rs = every_shift(w)
    gone = {i for s, e, q in rs for i in range(s + q, e)}
    best = min(rs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    four = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(rs), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in rs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def words(rng, n, kinds):
    w = [b"w%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 20:
            p, s = rng.randint(1, n // 2), rng.randrange(n - 1)
            for i in range(s + p, rng.randint(s, n)):
                w[i] = w[i - p]
    return w


def test_runs_equal_every_shift():
    rng = random.Random(1)
    for _ in range(300):
        lists = [words(rng, rng.choice([0, 3, 12, 30, 150, 500]), rng.choice([1, 2, 3, 40])) for _ in range(rng.randint(1, 4))]
        assert eleven.document_runs(lists) == [every_shift(w) for w in lists]


def test_long_periods_and_long_texts():
    rng = random.Random(2)
    block = [b"%d" % rng.randrange(10**6) for _ in range(3000)]
    text = block * 2 + [b"x"] + [b"y"] * 5000 + block[:500] + block[:500] + block[:499]
    assert eleven.document_runs([text])[0] == [(0, 6000, 3000), (6001, 11001, 1), (11001, 12500, 500)]


def test_masking_drops_lonely_words():
    x = eleven.np.array([1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5, 6, 8])
    assert eleven.surviving(x, eleven.np.zeros(14, int), 6).tolist() == [True] * 6 + [False] + [True] * 6 + [False]
    assert not eleven.surviving(x, (eleven.np.arange(14) > 6).astype(int), 6).any()


def test_query_on_odd_rows(spark, odd_docs, empty_docs):
    rows = spark.read.parquet(f"{odd_docs}/documents.parquet").select("doc_id", "text").collect()
    got = eleven.op11_periodic_runs(spark, odd_docs).collect()
    fast = [r for r in rows if r.text is None or len(r.text) < 50_000]
    want = {digest(r.doc_id, r.text) for r in fast}
    assert len(got) == len(rows) and want <= set(map(tuple, got))
    assert eleven.op11_periodic_runs(spark, empty_docs).collect() == []


def test_query_on_documents(spark, sf):
    rows = by_id(spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: tuple(r) for r in eleven.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows)
    some = [r for r in rows if len((r.text or "").split()) < 1500]
    assert [got[r.doc_id] for r in some] == [digest(r.doc_id, r.text) for r in some]


def test_columns_are_kept(spark):
    df = spark.createDataFrame([("a b " * 9, "old", 1)], "text string, RUNS string, x int")
    (row,) = eleven.periodic_runs(df).collect()
    assert (row.x, row.collapsed, [tuple(r) for r in row.runs]) == (1, "a b", [(0, 18, 2)])
