"""Operator 12 against all pairs."""

import numpy as np
import pytest

from docloom.llm import op12_embedding_dedup as twelve

SCHEMA = "vec_id long, embedding array<float>, label int"


def all_pairs(rows, cosine=0.93):
    n = len(rows)
    good = [i for i, (v, x, lab) in enumerate(rows) if v is not None and lab is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    links = [set() for _ in rows]
    for k, i in enumerate(good):
        for j in good[k + 1 :]:
            a, b = rows[i], rows[j]
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    home = [None] * n
    for i in range(n):
        if home[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            for j in seen:
                home[j] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((r[0], len(links[i]), home[i], None if home[i] is None else r[0] == home[i]) for i, r in enumerate(rows)), key=str)


def near(rng, x, spread):
    y = x + rng.normal(0, spread, len(x))
    return (y * rng.uniform(0.5, 2)).tolist()


def made(rng, n, dim, labels):
    rows, i = [], 0
    while len(rows) < n:
        x = rng.normal(0, 1, dim)
        label = int(rng.integers(labels)) if rng.random() < 0.6 else 0
        copies = int(rng.choice([0, 0, 0, 1, 3, 40], p=[0.5, 0.2, 0.1, 0.1, 0.08, 0.02]))
        for y in [x.tolist(), *(near(rng, x, rng.choice([0.0, 0.1, 0.25])) for _ in range(copies))]:
            rows.append((i, y, label))
            i += 1
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.mark.parametrize("dim,cell", [(32, 1024), (6, 40)])
def test_no_pair_is_missed_with_all_probes(spark, dim, cell):
    rows = made(np.random.default_rng(dim), 1200, dim, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert sorted(map(tuple, twelve.links_of(df, probe=None, cell=cell, per_list=12).collect()), key=str) == all_pairs(rows)


def test_recall_of_the_query(spark):
    rows = made(np.random.default_rng(9), 1500, 64, 2)
    want = {r[0]: r[1] for r in all_pairs(rows)}
    got = {r.vec_id: r.n_links for r in twelve.links_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.99 * sum(want.values()) > 0


def test_odd_rows(spark, empty_docs):
    a, b = [1.0, 2.0, 3.0, 0.5], [2.0, 4.0, 6.0, 1.0]
    rows = [(i, a, 1) for i in range(20, 60)] + [(7, b, 1), (7, b, 1), (3, a, 2), (4, a, None), (None, a, 1), (5, None, 1), (6, [], 1), (8, [0.0] * 4, 1), (9, [1.0, None, 2.0, 3.0], 1), (10, [float("nan")] * 4, 1), (11, [float("inf"), 1.0, 1.0, 1.0], 1), (12, a[:3], 1), (13, a[:3], 1), (14, [-1.0, 0.0, 0.0, 0.0], 1)]
    got = sorted(map(tuple, twelve.links_of(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", KEPT string")).collect()), key=str)
    assert got == all_pairs(rows)
    assert twelve.op12_embedding_dedup(spark, empty_docs).collect() == []


def test_codes_never_hide_a_pair():
    rng = np.random.default_rng(2)
    x = twelve.unit(rng.normal(0, 1, (300, 20)))
    x[150:] = twelve.unit(x[:150] + rng.normal(0, 0.06, (150, 20)))
    index = twelve.Index({(1, 20): twelve.means(x, 7)}, 0.1)
    own, _ = index.placed((1, 20), x)
    index.fit_words({20: index.residuals((1, 20), x, own)[:40]})
    for at in range(7):
        members = np.flatnonzero(own == at)
        codes, errors = index.coded(20, index.residuals((1, 20), x[members], own[members]))
        maybe = index.near(20, index.residuals((1, 20), x, np.full(300, at)), codes, errors, np.sqrt(0.14))
        linked = x @ x[members].T >= 0.93
        assert linked.any() and maybe[linked].all() and maybe.mean() < 0.8
