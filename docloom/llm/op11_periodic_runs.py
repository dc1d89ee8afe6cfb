"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q and at least max(least, 2 * q) words that no neighbouring
word extends. A run of n words and its shift by q overlap in n - q >= least / 2 words, so each of its words lies in a
k-gram, k = least // 2, that stands at another place of the document too. Words outside such k-grams are masked; what
survives is some stretches of text. Periods under SHORT are found by comparing the survivors with their shifts, longer
ones by Main-Lorentz: a stretch is halved, and of the runs that cross its middle, those with period q have a gram of
q / 4 words or more at the middle that stands q words further on as well. Such q are read off the hashes of grams, and
words themselves are compared to find where a run ends, so that equal hashes can't make a run.

A document is one row and is worked on by one task: its words are in memory once, besides a batch of BATCH_BYTES. Time is
n * log(n). No rows are shuffled.

Null and empty texts have no words and no runs. A null id is never damaged by the query. Rows are worked on by themselves:
repeated rows give repeated results, an empty table none; other columns are kept, but those named runs and collapsed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table, utf8

#: Words of a run, at least; periods that are compared by shifts (a power of 2).
LEAST, SHORT = 12, 64
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
MIX, DOC = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def surviving(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that stands at two places of its document. ids: words as numbers, doc: document of each word."""
    n = len(ids) - k + 1
    if n <= 1:
        return np.zeros(len(ids), bool)
    gram = doc[:n].astype(np.uint64) * DOC
    for j in range(k):
        gram = (gram ^ ids[j : j + n].astype(np.uint64)) * MIX
        gram ^= gram >> np.uint64(29)
    whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
    # most k-grams are alone in their bucket; the rest is sorted
    bits = max(10, int(len(ids)).bit_length() + 2)
    bucket = (gram[whole] >> np.uint64(64 - bits)).astype(np.int64)
    whole = whole[np.bincount(bucket, minlength=1 << bits)[bucket] > 1]
    order = whole[np.argsort(gram[whole], kind="stable")]
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    steps = np.zeros(len(ids) + 1, np.int64)
    at = order[twice]
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps[:-1]) > 0


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    padded = np.zeros(len(flags) + 2, bool)
    padded[1:-1] = flags
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[::2], edges[1::2]


def ahead(x: np.ndarray, i: int, j: int) -> int:
    """How many words from i and from j > i on are equal."""
    done, step = 0, 64
    while True:
        right = x[j + done : j + done + step]
        unlike = np.flatnonzero(x[i + done : i + done + len(right)] != right)
        if len(unlike):
            return done + int(unlike[0])
        if len(right) < step:
            return done + len(right)
        done, step = done + step, 2 * step


def behind(x: np.ndarray, i: int, j: int) -> int:
    """How many words before i and before j > i are equal."""
    done, step = 0, 64
    while True:
        left = x[max(0, i - done - step) : i - done]
        unlike = np.flatnonzero(left != x[j - done - len(left) : j - done])
        if len(unlike):
            return done + len(left) - 1 - int(unlike[-1])
        if len(left) < step:
            return done + len(left)
        done, step = done + step, 2 * step


def short_runs(x: np.ndarray, least: int) -> dict[tuple[int, int], int]:
    """(start, end) -> period of the repetitions of period under SHORT."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(SHORT, len(x))):
        start, end = stretches(x[:-q] == x[q:])
        long = end - start >= max(least - q, q)
        for s, e in zip(start[long].tolist(), (end[long] + q).tolist()):
            found.setdefault((s, e), q)
    return found


def long_runs(x: np.ndarray, known: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """(start, end) -> period of the repetitions of period SHORT and more, by Main-Lorentz. known: repetitions of shorter periods, to pass over their multiples."""
    n = len(x)
    grams, size = {}, SHORT // 2
    h = x.astype(np.uint64) * DOC
    for step in (1 << b for b in range(size.bit_length() - 1)):
        h = (h[:-step] * MIX) ^ h[step:] * DOC
        h ^= h >> np.uint64(31)
    while 4 * size <= n:
        grams[size] = h
        h = (h[:-size] * MIX) ^ h[size:] * DOC
        h ^= h >> np.uint64(31)
        size *= 2
    found: dict[tuple[int, int], int] = {}
    nodes = [(0, n, np.array(known, np.int64).reshape(-1, 3))]
    while nodes:
        low, high, runs = nodes.pop()
        if high - low < 2 * SHORT:
            continue
        middle = (low + high) // 2
        for shift in (-1, 1):  # the middle's partner is q words before it, or behind it
            most, seen = (middle - low if shift < 0 else high - middle), []
            for g, h in grams.items():
                # periods from 2 * g to 4 * g - 1: a gram of g words that begins or ends at the middle
                q = np.arange(2 * g, min(4 * g - 1, most) + 1)
                if not len(q):
                    break
                for at in (middle, middle - g):
                    there = at + shift * q
                    fits = (there >= 0) & (there < len(h))
                    if 0 <= at < len(h) and fits.any():
                        seen.append(q[fits][h[there[fits]] == h[at]])
            asked = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            rest = runs
            while len(asked):
                for s, e, q in rest.tolist():  # inside a run of period q, its multiples give that run again
                    if s < middle < e:
                        inside = middle - asked >= s if shift < 0 else middle + asked <= e
                        asked = asked[(asked % q != 0) | ~inside]
                rest = rest[:0]
                if not len(asked):
                    break
                q, asked = int(asked[0]), asked[1:]
                i, j = (middle - q, middle) if shift < 0 else (middle, middle + q)
                s, e = i - behind(x, i, j), j + ahead(x, i, j)
                if e - s >= 2 * q:
                    found[s, e] = min(q, found.get((s, e), q))
                    rest = np.array([[s, e, q]], np.int64)
                    runs = np.concatenate([runs, rest])
        for a, b in ((low, middle), (middle, high)):
            nodes.append((a, b, runs[(runs[:, 1] > a) & (runs[:, 0] < b)]))
    return found


def runs_of(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, end and period of the runs of a stretch, by start and period."""
    return [r for rs in runs_of_many([x], least) for r in rs]


def runs_of_many(parts: list[np.ndarray], least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some stretches. For short periods they are compared in one go, parted by numbers that occur once."""
    out: list[dict[tuple[int, int], int]] = [{} for _ in parts]
    if not parts:
        return []
    joined = np.concatenate([np.append(p, -1 - i) for i, p in enumerate(parts)])
    begin = np.cumsum([0] + [len(p) + 1 for p in parts])
    short = short_runs(joined, least)
    for home, ((s, e), q) in zip((np.searchsorted(begin, [s for s, _ in short], "right") - 1).tolist(), short.items()):
        out[home][s - int(begin[home]), e - int(begin[home])] = q
    for own, part in zip(out, parts):
        if len(part) >= 2 * SHORT:
            for span, q in long_runs(part, [(s, e, q) for (s, e), q in own.items() if e - s >= 2 * SHORT]).items():
                own[span] = min(q, own.get(span, q))
    return [sorted(((s, e, q) for (s, e), q in own.items()), key=lambda r: (r[0], r[2])) for own in out]


def document_runs(lists: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """start, end and period of the runs of each list of words."""
    sizes = np.array([len(ws) for ws in lists], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.array([w for ws in lists for w in ws], pa.large_binary())
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), sizes)
    kept = surviving(ids, doc, least // 2)
    start, end = stretches(kept)
    # stretches of neighbouring documents may touch
    cuts = begin[1:-1][(begin[1:-1] > 0) & (begin[1:-1] < len(ids))]
    cuts = np.unique(cuts[kept[cuts] & kept[cuts - 1]])
    start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    wide = end - start >= least
    start, end = start[wide], end[wide]
    out: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    for s, rs in zip(start.tolist(), runs_of_many([ids[s:e] for s, e in zip(start.tolist(), end.tolist())], least)):
        home = int(doc[s])
        off = s - int(begin[home])
        out[home] += [(a + off, b + off, q) for a, b, q in rs]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats: each run keeps its first period, but for words that another run drops."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        steps[s + q] += 1
        steps[e] -= 1
    gone = np.cumsum(steps) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, key: str | None = None, change: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """df with runs (array of start, length, period, by start and period) and collapsed (the words that no run repeats, joined by a blank).

    Words are parted by blanks, tabs and ends of line. change(words, value of the column key) may give other words instead.
    """

    def make():
        def run(texts: pa.Array, keys: pa.Array):
            lists = [t.split() for t in utf8(texts)]
            if change is not None:
                lists = [change(ws, k) for ws, k in zip(lists, keys.to_pylist())]
            found = document_runs(lists, least)
            runs = pa.array([[{"start": s, "length": e - s, "period": q} for s, e, q in rs] for rs in found], ARROW_RUNS)
            return runs, pa.array([collapsed(ws, rs) for ws, rs in zip(lists, found)], pa.binary()).view(pa.string())

        return run

    return append_columns(df, [text, key or text], make, [T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def repeating(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The query's damage: the words of a tenth of the documents repeat with a period from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(docs, "text", key="doc_id", change=repeating)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("longest.start"), F.col("longest.length"), -F.col("longest.period"))
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
