import math
import zlib

import numpy as np
import pytest

from docloom.llm import op9_toxicity as nine


def test_scores(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in nine.op9_toxicity(spark, d).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    assert all(e.similarity > 0 and e.toxic in (0, 1) for r in got.values() for e in r.evidence)


def test_held_out_recall(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in nine.op9_toxicity(spark, d).collect() if r.held_out}
    rows = [(r.lang, got[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect() if r.doc_id in got]
    recall = {k: (sum(p for g, p, y in rows if y and g == k), sum(y for g, _, y in rows if g == k)) for k in ("en", "de", "fr", "es")}
    assert sum(a for a, _ in recall.values()) >= 0.9 * sum(n for _, n in recall.values())
    assert sum(p for _, p, y in rows if not y) <= 0.01 * len(rows)


def test_words_of_one_stem_are_told_apart(spark):
    docs = spark.createDataFrame([(i, "achlichpf vu" if i % 2 else "achlibar vu") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == r.doc_id % 2 for r in nine.score(docs, nine.fit(docs, labels)).collect())


@pytest.mark.parametrize("where", ["odd_docs", "empty_docs"])
def test_odd_rows(spark, where, request, empty_docs):
    docs = spark.read.parquet(f"{request.getfixturevalue(where)}/documents.parquet")
    model = nine.fit(docs, spark.read.parquet(f"{empty_docs}/labels.parquet"))
    assert {r.score for r in nine.score(docs, model).collect()} <= {0.0}
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(12)] + [(3, 0, 1), (3, 0, 0), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = nine.score(docs, nine.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def examples(n=900):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        ids = rng.choice(60, rng.integers(0, 12), replace=False, p=np.arange(60, 0, -1) / 1830)
        rows.append(([f"w{chr(97 + t // 8)}{chr(97 + t % 8)}" for t in ids], rng.integers(1, 30, len(ids)).tolist(), int(rng.random() < 0.3 + 0.4 * (3 in ids)), str(i)))
    return rows


def vectors(rows, factor):
    out = []
    for terms, counts, *_ in rows:
        w = {t: (1 + math.log(c)) * factor[t] for t, c in zip(terms, counts)}
        length = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / length for t, x in w.items()} if length else {})
    return out


def factors(rows):
    """idf times chi-squared / n of each term, from the four counts of its table."""
    n, out = len(rows), {}
    for t in {t for r in rows for t in r[0]}:
        table = [[sum((t in r[0]) == has and r[2] == y for r in rows) for y in (0, 1)] for has in (True, False)]
        chi = sum((table[i][j] - (e := sum(table[i]) * (table[0][j] + table[1][j]) / n)) ** 2 / e for i in (0, 1) for j in (0, 1) if sum(table[i]))
        out[t] = (math.log((1 + n) / (1 + sum(table[0]))) + 1) * (chi / n) ** nine.POWER
    return out


def test_scores_are_those_of_all_pairs():
    """Weights, neighbours, votes and calibration against plain Python over all pairs."""
    rows, votes = examples(), (2.0, 1.0)
    model = nine.Model(rows, votes)
    factor = factors(rows)
    assert all(abs(model.factor[i] / factor[t] - 1) < 1e-6 for i, t in enumerate(model.names))
    own = vectors(rows, factor)
    shown = [i for i in range(len(rows)) if own[i]]
    cosine = lambda q, v: sum(x * v[t] for t, x in q.items() if t in v)

    def share(q, but=None):
        near = sorted(((round(s, 9), i) for i in shown if i != but and (s := cosine(q, own[i])) > 1e-9), reverse=True)
        sure = [x for x in near[: model.k] if len(near) <= model.k or x[0] > near[model.k][0] + 1e-8]
        vote = lambda picked: (sum(votes[rows[i][2]] * rows[i][2] / (1.05 - min(1, s)) for s, i in picked), sum(votes[rows[i][2]] / (1.05 - min(1, s)) for s, i in picked))
        return near, sure, vote

    texts = [" ".join(t for t, c in zip(r[0], r[1]) for _ in range(c)) for r in examples(120)[::2]]
    scores, evidence = model.score(texts, nine.Terms(model.names))
    checked = 0
    for text, score, shown_evidence in zip(texts, scores, evidence):
        words = nine.terms_of(text)
        q = vectors([(sorted(set(words)), [words.count(t) for t in sorted(set(words))])], factor)[0]
        near, sure, vote = share(q)
        assert len(shown_evidence) == min(3, len(near)) and all(abs(a - b) < 5e-9 for (a, _), (b, _) in zip(shown_evidence, near))
        if len(sure) == min(len(near), model.k) and near:  # no tie with the next
            a, b = vote(sure)
            assert abs(score - np.interp(a / b, model.steps, model.values)) < 1e-9
            checked += 1
        if not near:
            assert score == model.bare
    assert checked > 30
    bare = [r[2] for r in rows if not r[0]]
    assert abs(model.bare - sum(bare) / (sum(votes[y] for y in bare) + 1)) < 1e-12


def test_nearest_is_exact():
    rows = examples()
    model = nine.Model(rows, (2.0, 1.0))
    texts = [" ".join(r[0]) for r in rows]
    at, ids, counts = nine.Terms(model.names).counts(texts)
    weights = model.weigh(at, ids, counts.astype(float), len(texts))
    sims, numbers = model.nearest(at, ids, weights, len(texts))
    q, x = np.zeros((len(texts), len(model.names))), np.zeros((len(model.labels), len(model.names)))
    q[at, ids] = weights
    for t in range(len(model.names)):
        for run in range(model.term_runs[t], model.term_runs[t + 1]):
            here = slice(model.run_start[run], model.run_start[run] + model.run_length[run])
            x[model.posted[here], t] = model.post_weights[here]
    full = np.rint(q @ x.T * 1e9)
    for i in range(len(texts)):
        got = {int(j): s for s, j in zip(np.rint(sims[i] * 1e9), numbers[i]) if s > 0}
        # sums in another order differ by a unit or two
        assert len(got) == min(model.k, (full[i] > 3).sum()) and all(abs(full[i][j] - s) <= 2 for j, s in got.items())
        assert all(s <= min(got.values(), default=3) + 3 for j, s in enumerate(full[i]) if j not in got)


def test_isotonic_rises():
    x = np.array([0, 0.1, 0.2, 0.3, 0.4, 1.0])
    steps, values = nine.isotonic(x, np.array([0, 1, 0, 0, 1, 1]), np.ones(6))
    assert (np.diff(values) >= 0).all() and values[0] == 0 and values[-1] == 1
