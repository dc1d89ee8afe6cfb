"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Examples are at most MAX_EXAMPLES labelled texts of each class, those of least hash of their id (the bound of the
fit; everything else covers all rows). Terms are whole words, all that the examples hold. A term weighs
(1 + ln tf) * idf * (chi-squared of its presence against the label) ** POWER, and a text's vector has length 1: without
the last factor, which drops no term, the many neutral words of a text outvote the few that make it toxic (README).

The index is inverted: each term's postings, examples and weights, lie block by block of BLOCK examples, with the
largest weight of each of its blocks. Examples are ordered by their heaviest terms, so that like ones share blocks. Of
a text's terms those that together can bring at most a slack are put aside. Its bound for a block is the sum of the
others' weights times these largest, and the slack; blocks are visited in falling order of the bound, some at a time,
until it is under the text's kth sum so far. Examples whose sum and slack reach the kth sum are completed with the terms
put aside, so the K neighbours are exact. A text whose kth sum is no more than twice the slack goes through again with
a smaller one, at last none. Similarities are compared to nine digits, equal ones go to the example that stands first. Votes are weighted by nearness and by how many
labelled rows an example stands for; the share of toxic votes becomes a probability by isotonic regression over the
examples, each scored without itself.

A text that shares no term with any example gets the toxic share of such examples. Scores see the text alone.

Defined results: null and empty texts are texts without terms; a very long text is one vector; without usable labels all
scores are 0; labels that are null are left out, and of several labels of an id the highest counts; null ids and repeated rows
are scored like any other; an empty table gives none; columns of the input that bear a name of a result are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOUBLE, INT, append_columns, field, prepare, strings, table

MAX_EXAMPLES = 1_024
BLOCK, K, POWER = 64, 15, 2
SLACKS = (0.01, 0.001, 0.0)
#: Similarities are compared as whole numbers of 1 / UNIT; an example's number takes NUMBER_BITS bits below them.
UNIT, NUMBER_BITS = 1_000_000_000, 24
TOP_NUMBER = (1 << NUMBER_BITS) - 1
#: Blocks of a text that are visited together at first, and weights that are in memory at once.
FIRST_BLOCKS, MOST_WEIGHTS = 4, 250_000
WORD = re.compile(r"[^\W\d_]+")
#: No letters: around a word they leave it the only one.
MARKS = ".,;:!?%&$#()[]\"'-/*+=<>"


def terms_of(piece: str) -> list[str]:
    """Words of a piece without white space."""
    return WORD.findall(piece.lower())


class Terms:
    """Counts of known terms in texts; the terms of each distinct piece are found once, until max_chars of pieces are known."""

    def __init__(self, names: list[str], max_chars: int = 4_000_000):
        self.index, self.max_chars = {n: i for i, n in enumerate(names)}, max_chars
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths, self.chars = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def learn(self, pieces) -> None:
        """Number 0 stands for all pieces without a known term."""
        known, index, number = self.known, self.index, len(self.starts)
        ids: list[int] = []
        lengths: list[int] = []
        for p in pieces:
            word = p.lower().strip(MARKS)
            found = [index.get(word)] if word.isalpha() else list(map(index.get, terms_of(p)))
            found = [i for i in found if i is not None]
            known[p] = number + len(lengths) if found else 0
            if found:
                lengths.append(len(found))
                ids += found
        self.chars += sum(map(len, pieces))
        new = np.array(lengths, np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(new) - new])
        self.lengths, self.ids = np.concatenate([self.lengths, new]), np.concatenate([self.ids, np.array(ids, np.int64)])

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count, for each term that stands in a text."""
        if self.chars > self.max_chars:
            self.forget()
        split = [t.split() for t in texts]
        self.learn(set(chain.from_iterable(split)).difference(self.known))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        docs = np.repeat(np.arange(len(split)), sizes)
        docs, numbers = docs[numbers > 0], numbers[numbers > 0]
        lengths = self.lengths[numbers]
        ids = self.ids[spread(self.starts[numbers], lengths)]
        key, n = np.unique(np.repeat(docs, lengths) * (len(self.index) + 1) + ids, return_counts=True)
        return key // (len(self.index) + 1), key % (len(self.index) + 1), n


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of ranges, one range behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(lengths.sum()))


class Model:
    """Terms and their weights; the examples' labels and votes; the index."""

    def __init__(self, rows: list[tuple[list[str], list[int], int, str]], votes: tuple[float, float], k: int = K):
        """rows: terms, counts, label and a digest of each example. votes: labelled rows that a clean and a toxic example stand for."""
        self.known_terms: Terms | None = None
        self.names = sorted({t for r in rows for t in r[0]})
        self.k, place = k, {t: i for i, t in enumerate(self.names)}
        sizes = np.array([len(r[0]) for r in rows], np.int64)
        labels = np.array([r[2] for r in rows], np.int64)
        at, terms = np.repeat(np.arange(len(rows)), sizes), np.fromiter((place[t] for r in rows for t in r[0]), np.int64, int(sizes.sum()))
        counts = np.fromiter((c for r in rows for c in r[1]), np.float64, len(terms))
        df = np.bincount(terms, minlength=len(self.names))
        self.factor = (np.log((1 + len(rows)) / (1 + df)) + 1) * chi_squared(np.bincount(terms, labels[at], minlength=len(self.names)), df, int(labels.sum()), len(rows)) ** POWER
        weights = self.weigh(at, terms, counts, len(rows))
        # like examples together: by their heaviest terms, then the text's digest
        order = np.lexsort((terms, -weights, at))
        heavy = np.split(terms[order], np.cumsum(sizes)[:-1]) if len(rows) else []
        shown = [i for i in range(len(rows)) if sizes[i]]
        shown.sort(key=lambda i: (heavy[i][:4].tolist(), rows[i][3], rows[i][2]))
        number = np.full(len(rows), -1)
        number[shown] = np.arange(len(shown))
        weight = np.array(votes)
        self.labels = labels[shown]
        self.votes = weight[self.labels]
        bare = labels[sizes == 0]
        self.bare = float((weight[bare] * bare).sum() / (weight[bare].sum() + 1))
        self.index(number[at], terms, weights)
        self.steps, self.values = np.zeros(0), np.zeros(0)
        if shown:
            order = np.argsort(number[at], kind="stable")
            raw = self.raw(*self.nearest(number[at][order], terms[order], weights[order], len(shown), own=True))
            good = raw >= 0
            if good.any():
                self.steps, self.values = isotonic(raw[good], self.labels[good], self.votes[good])

    def worker_terms(self) -> Terms:
        """One in a Python worker, whatever number of tasks it runs."""
        if self.known_terms is None:
            self.known_terms = Terms(self.names)
        return self.known_terms

    def weigh(self, at, terms, counts, n) -> np.ndarray:
        w = (1 + np.log(counts)) * self.factor[terms]
        length = np.sqrt(np.bincount(at, w * w, minlength=n))
        return w / np.where(length > 0, length, 1)[at] if len(at) else w

    def index(self, example: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """Postings by term and example; runs of one term in one block; where each term's runs begin."""
        order = np.lexsort((example, terms))
        self.posted, self.post_weights, terms = example[order], weights[order], terms[order]
        block = self.posted // BLOCK
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        self.run_start = np.flatnonzero(new)
        self.run_length = np.diff(np.append(self.run_start, len(terms)))
        self.run_block = block[self.run_start]
        self.run_most = np.maximum.reduceat(self.post_weights, self.run_start) if len(terms) else np.zeros(0)
        self.term_runs = np.searchsorted(terms[self.run_start], np.arange(len(self.names) + 1))
        self.blocks, self.post_slot = -(-len(self.labels) // BLOCK), self.posted % BLOCK
        self.term_most = np.zeros(len(self.names))
        np.maximum.at(self.term_most, terms, self.post_weights)
        by_example = np.lexsort((terms, self.posted))
        self.example_start = np.searchsorted(self.posted[by_example], np.arange(len(self.labels) + 1))
        self.example_terms, self.example_weights = terms[by_example], self.post_weights[by_example]
        for name in ("posted", "post_slot", "run_start", "run_length", "run_block", "term_runs", "example_start", "example_terms"):  # the model travels to every worker
            setattr(self, name, getattr(self, name).astype(np.int32))

    def nearest(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Similarities (0 where there are fewer) and numbers of the k nearest examples of n texts. own: text i is example i, which doesn't count.

        at, terms, weights: the texts' vectors, in ascending order of at.
        """
        sims, numbers = np.zeros((n, self.k)), np.full((n, self.k), len(self.labels))
        todo = np.arange(n)
        for slack in SLACKS:
            left = []
            for here in self.portions(at, terms, todo):
                chosen = np.isin(at, here)
                local, texts = np.searchsorted(here, at[chosen]), here if own else None
                keys, sure = self.search(local, terms[chosen], weights[chosen], len(here), texts, slack)
                good = keys[sure] > 0
                sims[here[sure]] = np.where(good, (keys[sure] >> NUMBER_BITS) / UNIT, 0)
                numbers[here[sure]] = np.where(good, TOP_NUMBER - (keys[sure] & TOP_NUMBER), len(self.labels))
                left.append(here[~sure])
            todo = np.concatenate([np.zeros(0, np.int64), *left])
            if not len(todo):
                break
        return sims, numbers

    def portions(self, at, terms, texts):
        """texts in portions of about MOST_WEIGHTS runs."""
        runs = np.bincount(at, self.term_runs[terms + 1] - self.term_runs[terms], minlength=int(texts[-1]) + 1 if len(texts) else 0)
        return [p for p in np.split(texts, np.flatnonzero(np.diff(np.cumsum(runs[texts]) // MOST_WEIGHTS)) + 1) if len(p)]

    def search(self, at, terms, weights, n: int, own: np.ndarray | None, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the k nearest of each text, falling (similarity above, the number's complement below, 0 for none), and which texts they hold for."""
        # a text's terms by what they can bring; those behind which no more than the slack is left are put aside
        brings = weights * self.term_most[terms]
        order = np.lexsort((-brings, at))
        at, terms, weights, brings = at[order], terms[order], weights[order], brings[order]
        first = np.searchsorted(at, np.arange(n + 1))
        sums = np.concatenate([[0.0], np.cumsum(brings)])
        aside = np.repeat(sums[first[1:]], np.diff(first)) - sums[:-1] <= slack
        rest = np.bincount(at[aside], brings[aside], minlength=n)
        head = np.flatnonzero(~aside)
        lengths = self.term_runs[terms[head] + 1] - self.term_runs[terms[head]]
        run, text, weight = spread(self.term_runs[terms[head]], lengths), np.repeat(at[head], lengths), np.repeat(weights[head], lengths)
        cell = text * self.blocks + self.run_block[run]
        bounds = np.bincount(cell, weight * self.run_most[run], minlength=n * self.blocks).reshape(n, self.blocks)
        by_cell = np.argsort(cell, kind="stable")
        run, weight = run[by_cell], weight[by_cell]
        edges = np.searchsorted(cell[by_cell], np.arange(n * self.blocks + 1))
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = np.zeros((n, self.k), np.int64)
        # sums of weights in different orders: some units for rounding
        room = np.rint(rest * UNIT).astype(np.int64) + 4
        done, size, found = 0, FIRST_BLOCKS, []
        while done < self.blocks:
            chosen = order[:, done : done + size]
            upper = np.take_along_axis(bounds, chosen, 1) * UNIT
            rows, columns = np.nonzero((upper > 0) & (upper + room[:, None] >= best[:, -1:] >> NUMBER_BITS))
            if not len(rows):
                break
            pair = rows * self.blocks + chosen[rows, columns]
            counts = edges[pair + 1] - edges[pair]
            where = spread(edges[pair], counts)
            of_pair, runs_here, weights_here = np.repeat(np.arange(len(pair)), counts), run[where], weight[where]
            posted = spread(self.run_start[runs_here], self.run_length[runs_here])
            slot = np.repeat(of_pair * BLOCK, self.run_length[runs_here]) + self.post_slot[posted]
            sums = np.bincount(slot, np.repeat(weights_here, self.run_length[runs_here]) * self.post_weights[posted], minlength=len(pair) * BLOCK)
            number = (chosen[rows, columns] * BLOCK)[:, None] + np.arange(BLOCK)
            units = np.rint(sums * UNIT).astype(np.int64).reshape(-1, BLOCK)
            if own is not None:
                units[number == own[rows][:, None]] = 0
            keys = np.zeros((n, chosen.shape[1], BLOCK), np.int64)
            keys[rows, columns] = np.where(units > 0, (units << NUMBER_BITS) + TOP_NUMBER - number, 0)
            keys = keys.reshape(n, -1)
            best = np.partition(np.concatenate([best, keys], axis=1), keys.shape[1], axis=1)[:, -self.k :]
            best.sort(axis=1)
            best = best[:, ::-1]
            near = np.nonzero((keys > 0) & ((keys >> NUMBER_BITS) + room[:, None] >= best[:, -1:] >> NUMBER_BITS))
            found.append((near[0], keys[near]))
            done, size = done + size, 2 * size
        least = best[:, -1] >> NUMBER_BITS
        if slack == 0:
            return best, np.ones(n, bool)
        sure = least > 2 * room
        if found:
            best = self.completed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), least, room, sure, at, terms, weights, aside, n)
        return best, sure

    def completed(self, rows, keys, least, room, sure, at, terms, weights, aside, n: int) -> np.ndarray:
        """The k best of each text that is sure, from the sums of candidates (rows: their texts) and the terms put aside."""
        good = sure[rows] & ((keys >> NUMBER_BITS) + room[rows] >= least[rows])
        rows, keys = rows[good], keys[good]
        order = np.argsort(rows, kind="stable")
        rows, keys = rows[order], keys[order]
        edges, first = np.searchsorted(rows, np.arange(n + 1)), np.searchsorted(at, np.arange(n + 1))
        best, dense = np.zeros((n, self.k), np.int64), np.zeros(len(self.names))
        for i in np.flatnonzero(np.diff(edges)):
            own = slice(first[i], first[i + 1])
            late = terms[own][aside[own]]
            dense[late] = weights[own][aside[own]]
            mine = keys[edges[i] : edges[i + 1]]
            example = TOP_NUMBER - (mine & TOP_NUMBER)
            lengths = self.example_start[example + 1] - self.example_start[example]
            place = spread(self.example_start[example], lengths)
            more = np.bincount(np.repeat(np.arange(len(mine)), lengths), dense[self.example_terms[place]] * self.example_weights[place], minlength=len(mine))
            dense[late] = 0
            whole = np.sort(mine + (np.rint(more * UNIT).astype(np.int64) << NUMBER_BITS))[::-1][: self.k]
            best[i, : len(whole)] = whole
        return best

    def raw(self, sims: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Toxic share of the votes of the neighbours, the nearer the heavier; -1 without any."""
        labels, votes = np.append(self.labels, 0), np.append(self.votes, 0)
        weight = np.where(sims > 0, votes[numbers] / (1.05 - np.minimum(sims, 1)), 0)
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * labels[numbers]).sum(axis=1) / np.where(total > 0, total, 1), -1)

    def score(self, texts: list[str], terms: Terms) -> tuple[np.ndarray, list[list[tuple[float, int]]]]:
        scores = np.full(len(texts), self.bare)
        at, ids, counts = terms.counts(texts)
        if not len(self.steps) or not len(at):
            return scores, [[] for _ in texts]
        sims, numbers = self.nearest(at, ids, self.weigh(at, ids, counts.astype(np.float64), len(texts)), len(texts))
        raw = self.raw(sims, numbers)
        scores = np.where(raw < 0, self.bare, np.interp(raw, self.steps, self.values))
        labels = np.append(self.labels, 0)
        evidence = [[(s, y) for s, y in zip(ss, ys) if s > 0] for ss, ys in zip(sims[:, :3].tolist(), labels[numbers[:, :3]].tolist())]
        return scores, evidence


def chi_squared(toxic: np.ndarray, df: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """Of each term's presence against the label, divided by the number of examples: 0 to 1. toxic: toxic examples among the df that hold it."""
    rest = n - n_toxic
    if not n_toxic or not rest:
        return np.ones(len(df))
    gap = toxic * n - df * n_toxic
    return gap * gap / (df * np.maximum(1, n - df)) / (n_toxic * rest)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising function nearest to the labels, by pooling neighbours that fall."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a in np.unique(x[order]):
        here = x == a
        pools.append([float((w * y)[here].sum()), float(w[here].sum()), float(a), float(a)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2], b[3]]
    steps, values = [], []
    for s, total, a, b in pools:
        value = min(1.0, max(0.0, s / total))
        steps += [a, b] if b > a else [a]
        values += [value, value] if b > a else [value]
    return np.array(steps), np.array(values)


def fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. Only rows of a fold other than 0 are read."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != 0)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).collect()]
    if not chosen:
        return Model([], (1.0, 1.0))
    picked = spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, toxic int")
    # of an id that repeats, one text
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def split(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            found = [Counter(t for p in x.split() for t in terms_of(p)) for x in strings(column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())), column("toxic"), column("digest")], names=["terms", "counts", "toxic", "digest"])

    rows = [(r["terms"], r["counts"], r["toxic"], r["digest"] or "") for r in texts.withColumn("digest", F.md5("text")).mapInArrow(split, "terms array<string>, counts array<long>, toxic int, digest string").collect()]
    found = {y: max(1, sum(r[2] == y for r in rows)) for y in (0, 1)}
    return Model(rows, tuple(totals.get(y, 0) / found[y] for y in (0, 1)))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score, predicted (1 from 0.5 on) and evidence (similarity and label of the three nearest examples)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        terms = own.worker_terms()

        def fn(column):
            scores, evidence = own.score(strings(column), terms)
            kind = pa.list_(pa.struct([("similarity", pa.float64()), ("toxic", pa.int32())]))
            return [scores.tolist(), [int(s >= 0.5) for s in scores], pa.array([[{"similarity": s, "toxic": y} for s, y in e] for e in evidence], kind)]

        return fn

    shape = T.ArrayType(T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    return append_columns(df, [text], make, [field("score", DOUBLE), field("predicted", INT), field("evidence", shape)])


def without_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df, all its columns as they are, whose score is under 0.5."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        terms = own.worker_terms()
        for batch in batches:
            scores, _ = own.score(strings(batch.column(batch.schema.get_field_index(text))), terms)
            yield batch.filter(pa.array(scores < 0.5))

    return df.mapInArrow(run, df.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")
