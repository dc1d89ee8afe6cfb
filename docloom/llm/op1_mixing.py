"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks. A source of target t and size s gives its blocks
floor(t / s) times whole, and once more in a permuted order until the rest of its target is met; of the last
block, documents are taken in hash order. So a source's quota is an exact number of blocks to draw. A binary tree
splits all quotas among the output shards: at each node the left half's share of every source is one draw from
the multivariate hypergeometric distribution. A leaf's quotas are met by the next blocks of each source's
permutation, so shards draw disjoint blocks, and their documents are shuffled within the shard. There are as many
shards as SHARD_WORDS asks for.

The driver holds one row for each source and one for each block (BLOCKS and one a source, at most MAX_SOURCES
sources, an error beyond); documents meet the plan by a broadcast join of that bounded table. The last block of a
source, of which a part is taken, is summed up by PARTS parts of it first; within one part alone documents are put
in order, 1 / (MOST_BLOCKS * PARTS) of a large source.

Defined results: a null text has size 0; a very long text is one document, taken or not as a whole; a null source
is a source, the last; null ids and repeated rows are rows like any other; a source without words has target 0 and
gives nothing; an empty table gives none; further columns are handed on, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, unused

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SHARDS, BLOCKS, MOST_BLOCKS, SEED = 32, 8_192, 4_096, 11
MAX_SOURCES, PARTS, SHARD_WORDS = 100_000, 4_096, 1 << 26
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares of share * sum(sizes) by weight, none above most times its size; what is cut off is shared again."""
    caps, out = [most * s for s in sizes], [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= caps[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
        left = max(left, 0.0)
    return out


def split_quotas(quotas: np.ndarray, leaves: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of each leaf (leaves x sources): they add up to quotas, and leaves' totals differ by one at most."""
    out = np.zeros((leaves, len(quotas)), np.int64)

    def split(first: int, count: int, here: np.ndarray) -> None:
        if count == 1:
            out[first] = here
            return
        half, total = count // 2, int(here.sum())
        left = rng.multivariate_hypergeometric(here, total * half // count, method="marginals") if total else here
        split(first, half, left)
        split(first + half, count - half, here - left)

    split(0, leaves, np.asarray(quotas, np.int64))
    return out


def draw_plan(blocks: list[np.ndarray], goals: list[float], shards: int, seed: int) -> list[tuple[int, int, int, int, float | None]]:
    """blocks: words of each source's blocks. Rows: source, block, copy, shard, words to take of it (None: all)."""
    rng = np.random.default_rng(seed)
    draws: list[list[tuple[int, int, float | None]]] = []
    for words, goal in zip(blocks, goals):
        mine: list[tuple[int, int, float | None]] = []
        size = int(words.sum())
        whole = int(goal / size + 1e-9) if size else 0
        for copy in range(whole):
            mine += [(int(b), copy, None) for b in rng.permutation(len(words))]
        rest = float(goal - whole * size)
        for b in rng.permutation(len(words)) if rest >= 0.5 else ():
            mine.append((int(b), whole, None if words[b] <= rest else rest))
            rest -= int(words[b])
            if rest < 0.5:
                break
        draws.append(mine)
    leaf = split_quotas(np.array([len(m) for m in draws], np.int64), shards, rng)
    plan = []
    for s, mine in enumerate(draws):
        home = np.repeat(np.arange(shards), leaf[:, s])
        plan += [(s, b, copy, int(h), limit) for (b, copy, limit), h in zip(mine, home)]
    return plan


class Mixture:
    """rows: the mixture, df's rows as often as taken, with two further columns, named shard and copy here. sources: source, source_size and target."""

    def __init__(self, rows: DataFrame, sources: DataFrame, shard: str, copy: str, shards: int):
        self.rows, self.sources, self.shard, self.copy, self.shards = rows, sources, shard, copy, shards


def mix(df: DataFrame, size: Column, key: Column, source: str = "source", shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED, shard_words: int = SHARD_WORDS) -> Mixture:
    """size: words of a row. key: a hash of the row, the same on every run. shards: their least number."""
    spark, columns = df.sparkSession, df.columns
    scratch = Scratch(spark, "mixing")
    fine = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(MOST_BLOCKS)).cast("int")
    stats = scratch.write(df.groupBy(F.col(source).cast("string").alias("s"), fine.alias("fine")).agg(F.sum(size).alias("words")), "blocks")
    totals = stats.groupBy("s").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(((r["s"], int(r["words"])) for r in totals), key=lambda r: (r[0] is None, r[0] or ""))
    goals = targets([w for _, w in totals], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))])
    everything = max(1, sum(w for _, w in totals))
    shards = max(shards, math.ceil(sum(goals) / shard_words))
    # a power of two, so that a source's blocks are unions of its fine ones
    counts = [min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1.0, blocks * w / everything))) - 1)) for _, w in totals]
    named = spark.createDataFrame([(s, i, n, w, g) for i, ((s, w), n, g) in enumerate(zip(totals, counts, goals))], "s string, rank int, n_blocks int, source_size long, target double")
    sums = stats.join(F.broadcast(named), stats["s"].eqNullSafe(named["s"])).groupBy("rank", F.pmod("fine", "n_blocks").alias("block")).agg(F.sum("words").alias("words")).collect()
    scratch.drop(stats)
    words = [np.zeros(n, np.int64) for n in counts]
    for r in sums:
        words[r["rank"]][r["block"]] = r["words"]
    rank, block, copy, shard, limit, s, n, hashed, part, before, upto = unused(df, *(f"mix_{x}" for x in ("rank", "block", "copy", "shard", "limit", "s", "n", "hash", "part", "before", "sum")))
    plan = spark.createDataFrame(draw_plan(words, goals, shards, seed), f"{rank} int, {block} int, {copy} int, {shard} int, {limit} double")
    of_source = named.select(F.col("s").alias(s), F.col("rank").alias(rank), F.col("n_blocks").alias(n))
    # a block of which a part is taken is the only such block of its source
    cut = plan.where(F.col(limit).isNotNull())
    ranked = df.join(F.broadcast(of_source), F.col(source).cast("string").eqNullSafe(F.col(s))).withColumn(block, F.pmod(fine, F.col(n)))
    whole = ranked.join(F.broadcast(plan.where(F.col(limit).isNull())), [rank, block])
    partly = ranked.join(F.broadcast(cut), [rank, block]).withColumn(hashed, F.xxhash64(key, F.lit(seed + 1))).withColumn(part, F.shiftrightunsigned(hashed, 64 - (PARTS - 1).bit_length()))
    sums = partly.groupBy(rank, part).agg(F.sum(size).alias(upto))
    sums = sums.withColumn(before, F.sum(upto).over(Window.partitionBy(rank).orderBy(part)) - F.col(upto))
    sums = sums.join(F.broadcast(cut.select(rank, limit)), rank).where(F.col(before) <= F.col(limit)).select(rank, part, before)
    # documents in hash order; one goes in if it brings the sum nearer to what is left. Whole parts need no order
    inner = partly.join(sums, [rank, part])
    order = Window.partitionBy(rank, part).orderBy(hashed, key).rowsBetween(Window.unboundedPreceding, 0)
    taken = inner.withColumn(upto, F.col(before) + F.sum(size).over(order)).where(F.col(upto) - size / 2 <= F.col(limit))
    mixed = whole.select(*columns, shard, copy).unionByName(taken.select(*columns, shard, copy))
    return Mixture(mixed, named.select(F.col("s").alias("source"), "source_size", "target"), shard, copy, shards)


def placed(mixture: Mixture, key: Column, place: str, tie: str, seed: int = SEED) -> DataFrame:
    """The mixture's rows with their place in their shard, from 0 on, in the order of shuffled(); a shard holds SHARD_WORDS words or so. tie: a column that parts rows of one key."""
    order = Window.partitionBy(mixture.shard).orderBy(F.xxhash64(key, mixture.copy, F.lit(seed + 2)), tie, mixture.copy)
    return mixture.rows.withColumn(place, (F.row_number().over(order) - 1).cast("long"))


def shuffled(mixture: Mixture, key: Column, seed: int = SEED) -> DataFrame:
    """Each shard's rows together, in an order of their own."""
    order = F.xxhash64(key, mixture.copy, F.lit(seed + 2))
    return mixture.rows.repartition(mixture.shards, mixture.shard).sortWithinPartitions(mixture.shard, order).drop(mixture.shard, mixture.copy)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and of each copy in the mixture its shard and its place there (copies)."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), F.xxhash64("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("row"))
    sizes = Scratch(spark, "mixing").write(sizes, "sizes")
    mixture = mix(sizes, F.col("size"), F.col("key"))
    rows = placed(mixture, F.col("key"), "place", "row")
    copies = F.array_sort(F.collect_list(F.struct(F.col(mixture.copy).alias("copy"), F.col(mixture.shard).cast("int").alias("shard"), "place")))
    taken = rows.groupBy("row").agg(F.sum("size").alias("taken"), copies.alias("copies"))
    out = sizes.join(taken, "row", "left").join(F.broadcast(mixture.sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(F.transform("copies", lambda c: F.struct(c["shard"].alias("shard"), c["place"].alias("place"))), F.array().cast("array<struct<shard:int,place:bigint>>")).alias("copies"))
