"""Blocks of a page against cuts of one page at a time."""

import random
from statistics import median

from docloom.operators import layout
from docloom.sources import shared

SCHEMA = "doc string, page int, seq int, x0 double, y0 double, x1 double, y1 double, text string"


def parts(words, low, high, gap):
    """Words in stretches with no gap between them."""
    out, end = [], None
    for w in sorted(words, key=lambda w: (w[low], w[high], w["seq"])):
        if end is None or w[low] - end > gap:
            out.append([])
        out[-1].append(w)
        end = w[high] if end is None else max(end, w[high])
    return out


def leaves(words, height):
    """Blocks of a region: the first way that finds a gap cuts it, each part is a region of its own."""
    for low, high, gap in (("y0", "y1", layout.BELOW * height), ("x0", "x1", layout.BESIDE * height)):
        cut = parts(words, low, high, gap)
        if len(cut) > 1:
            return [b for p in cut for b in leaves(p, height)]
    return [words]


def page(rng, doc, depth):
    """A page made by dividing it: each half has a gap before the next."""
    words = []

    def fill(x, y, w, h, level):
        if level and rng.random() < 0.85:
            share = rng.uniform(0.3, 0.7)
            if level % 2:
                fill(x, y, w, h * share, level - 1), fill(x, y + h * share, w, h * (1 - share), level - 1)
            else:
                fill(x, y, w * share, h, level - 1), fill(x + w * share, y, w * (1 - share), h, level - 1)
            return
        for _ in range(rng.randrange(1, 6)):
            a, b = x + rng.uniform(0, w * 0.7), y + rng.uniform(0, h * 0.7)
            words.append((a, b, a + rng.uniform(1, w * 0.3), b + rng.choice([1.0, 2.0, 3.0])))

    fill(0, 0, 400, 600, depth)
    rng.shuffle(words)
    return [(doc, 1, i, *w, f"w{i}") for i, w in enumerate(words)]


def test_blocks_equal_recursive_cuts(spark):
    rng = random.Random(3)
    rows = [r for d in range(25) for r in page(rng, f"d{d}", d % 8)]
    # a stair whose steps lie within each other: more cuts than one pass has rounds
    x0, y0, x1, y1, n = 0.0, 0.0, 400.0, 400.0, 0
    for level in range(12):
        if level % 2:
            rows.append(("deep", 1, n, x0, y0, x0 + 1, y1, "v"))
            x0 += 6
        else:
            rows.append(("deep", 1, n, x0, y0, x1, y0 + 1, "h"))
            y0 += 6
        n += 1
    rows += [("deep", 1, n + i, x0 + i, y0, x0 + i + 1, y0 + 1, "w") for i in range(20)]
    want = {}
    for doc in {r[0] for r in rows}:
        own = [dict(zip(("doc", "page", "seq", "x0", "y0", "x1", "y1", "text"), r)) for r in rows if r[0] == doc]
        want[doc] = {frozenset(w["seq"] for w in b) for b in leaves(own, median(w["y1"] - w["y0"] for w in own))}
    words = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = layout.regions(words, ["doc", "page"], rounds=2).collect()
    got = {doc: {} for doc in want}
    for r in found:
        got[r.doc].setdefault(tuple(r.region), set()).update(w.seq for w in r.words)
    assert sum(len(r.words) for r in found) == len(rows)
    assert {doc: {frozenset(b) for b in blocks.values()} for doc, blocks in got.items()} == want
    assert max(map(len, want.values())) > 8 and len(want["deep"]) > 6
    counts = {r.doc: r["n"] for r in layout.blocks(words, ["doc", "page"]).groupBy("doc").count().withColumnRenamed("count", "n").collect()}
    assert counts == {doc: len(b) for doc, b in want.items()}


def test_lines_nulls_and_odd_boxes(spark):
    rows = [
        ("a", 1, 0, 0.0, 0.0, 10.0, 10.0, "one"), ("a", 1, 1, 30.0, 10.0, 12.0, 1.0, "two"), ("a", 1, 2, 0.0, 12.0, 9.0, 22.0, "three"), ("a", 1, 3, 0.0, 60.0, 9.0, 70.0, "far"),
        ("a", 1, 4, None, 60.0, 9.0, 70.0, "no box"), ("a", 1, 5, float("nan"), 60.0, 9.0, 70.0, "no number"), ("a", 1, 6, 0.0, 200.0, 9.0, 210.0, " \t"), ("a", 1, 7, 0.0, 300.0, 9.0, 310.0, None),
        ("b", 1, 0, None, None, None, None, "x"), ("c", 2, 0, 5.0, 5.0, 5.0, 5.0, "dot"), ("c", 2, 1, 5.0, 5.0, 5.0, 5.0, "dot"), (None, None, 0, 0.0, 0.0, 1.0, 1.0, "unknown"),
    ]
    got = layout.blocks(spark.createDataFrame(rows, SCHEMA), ["doc", "page"]).orderBy("doc", "block_no").collect()
    assert [(r.doc, r.block_no, r.n_lines, r.text) for r in got] == [(None, 1, 1, "unknown"), ("a", 1, 2, "one two\nthree"), ("a", 2, 1, "far"), ("c", 1, 1, "dot dot")]
    assert (got[1].x0, got[1].y0, got[1].x1, got[1].y1) == (0.0, 0.0, 30.0, 22.0)
    assert layout.blocks(spark.createDataFrame([], SCHEMA), ["doc", "page"]).collect() == []


def test_words_that_stand_by_page_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(5)
    rows = [r for d in range(12) for r in page(rng, f"d{d}", d % 7)]
    plans, write = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, path: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, path))
    words = spark.createDataFrame(rows, SCHEMA)
    got = layout.blocks(words.repartition(6, "doc"), ["doc", "page"])
    # the shuffle of the words that were given is the only one, and blocks come from the table as it was written
    assert plans[0].count("Exchange ") == 1 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    other = layout.blocks(words, ["doc", "page"])
    assert plans[-1].count("Exchange ") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, other.collect()))


def test_only_pages_that_are_not_through_go_on(spark, monkeypatch):
    rng = random.Random(7)
    rows = [r for d in range(8) for r in page(rng, f"d{d}", 1 if d else 7)]
    words, tables, write = spark.createDataFrame(rows, SCHEMA), [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, path: tables.append(write(df, path)) or tables[-1])
    got = layout.blocks(words, ["doc", "page"], rounds=1)
    docs = [{r.doc for r in t.select("doc").distinct().collect()} for t in tables]
    assert len(docs[0]) == 8 and len(docs) > 1 and "d0" in docs[1] and all(a > b or a == b for a, b in zip(docs, docs[1:]))
    assert docs[-1] < docs[0] and tables[0].where("NOT deep AND size(runs) > 0").count() == 0
    once = layout.blocks(words, ["doc", "page"], rounds=6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, once.collect()))
