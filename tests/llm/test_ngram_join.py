import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import op5_ngram_join as five


def sets_of(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k=4, num=85, den=100):
    sets = [sets_of(t, k) for _, t in rows]
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    home[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("where", ["sf", "odd_docs", "empty_docs"])
def test_against_all_pairs(spark, where, request):
    d = request.getfixturevalue(where)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, five.op5_ngram_join(spark, d).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("heavy", [2, 6, 1000])
def test_large_groups_and_shared_passages(spark, heavy):
    """Groups of near copies and passages that many texts share, with few copies counting as heavy already."""
    rng = random.Random(heavy)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base, other = words(60), words(120), words(30)
    rows = []
    for i in range(60):  # near copies of one text, near and far from each other
        text = list(base)
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append(" ".join(text))
    for i in range(40):  # a passage in texts of many lengths
        rows.append(" ".join(words(rng.randrange(0, 60)) + passage + words(rng.randrange(0, 60))))
    for i in range(40):  # a chain: each differs a little from the last
        other[rng.randrange(len(other))] = rng.choice(vocabulary)
        rows.append(" ".join(other))
    rows += [rows[3]] * 5 + ["a b", "a b", "A  b", "a", "", None, "a b c d", "a b c d e"]
    rows = list(enumerate(rows, 100))
    rng.shuffle(rows)
    rows += [rows[0], (None, rows[1][1]), (100, "another text under a known id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num, den in ((4, 85, 100), (5, 80, 100)):
        got = five.join_components(df, k, num, den, heavy, range_elements=900)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, num, den)


def test_structured_words_share_no_hash(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, one), (2, other), (3, one.upper()), (4, f"{one} x y z"), (5, f"{other} x y z"), (6, f"{near} {one}"), (7, f"{near} {other}"), (8, f"{one} {near}")]
    got = five.join_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_clashing_columns(spark):
    rows = [(i, text, f"g{i}", i, i) for i, text in enumerate(["a b c d e", "A b  c d e", "x y z", None, ""])]
    df = spark.createDataFrame(rows + rows[2:3], "doc_id long, text string, gone_id string, gone_h long, One_h long")
    got = five.one_of_each(df, 5, 80, 100)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_rows_without_those_of_a_table(spark):
    df = spark.createDataFrame([(i % 700 if i % 5 else None, f"t{i % 90}", i) for i in range(2000)], "doc_id long, text string, bits int")
    gone = df.where("doc_id % 3 = 0").select(F.col("doc_id").alias("a"), F.xxhash64("text").alias("b")).distinct()
    got = five.without(df, gone, [F.col("doc_id"), F.xxhash64("text")])
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, df.where("doc_id IS NULL OR doc_id % 3 <> 0").collect()))
    assert five.without(df, gone.limit(0), [F.col("doc_id"), F.xxhash64("text")]).count() == 2000
