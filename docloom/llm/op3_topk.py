"""Exact top-k search by inner product: a ball tree for each shard, searched by branch and bound.

Vectors are dealt into shards of about SHARD_ROWS, queries into blocks of about QUERY_ROWS; each pair of a shard
and a block is one group. It builds the shard's ball tree and visits its leaves, for each query, in the order of
the upper bound <q, centre> + |q| * radius (the least on the way from the root), until the bound falls under the
query's kth score. Shards are searched in waves, the first of one shard and each further one WAVE times as many as
all before it: a query's best k so far go along as its kth score into every later shard, where it prunes from the
start. A bound equal to the kth score is still visited, as a tie may go to a smaller id.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part;
rows that repeat an id are rows of their own: each is a candidate of the others, and a query if its id is one; only
vectors of a query's own length are compared with it; with fewer than k candidates all are returned; an empty table
gives no rows; further columns aren't read. Scores beyond a long are clipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8_192, 4_096, 128
K, SCALE, QUERY_STEP, WAVE = 20, 64, 20, 3
NONE = np.iinfo(np.int64).min


class BallTree:
    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        """x: float64, one row a vector. leaves: (rows, nodes from the root)."""
        centres, radii, self.leaves = [], [], []
        todo = [(np.arange(len(x)), ())]
        while todo:
            rows, way = todo.pop()
            part = x[rows]
            centre = part.mean(axis=0)
            far = ((part - centre) ** 2).sum(axis=1)
            way += (len(centres),)
            centres.append(centre)
            radii.append(far.max() ** 0.5)
            if len(rows) <= leaf or far.max() == 0:
                self.leaves.append((rows, way))
                continue
            a = part[far.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            order = np.argsort(part @ (b - a), kind="stable")
            half = len(rows) // 2
            todo += [(rows[order[:half]], way), (rows[order[half:]], way)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf an upper bound of the inner product, with room for rounding."""
        length = np.sqrt((q**2).sum(axis=1))[:, None]
        ball = length * self.radii[None, :]
        node = q @ self.centres.T + ball
        node += 1e-9 * (length * np.sqrt((self.centres**2).sum(axis=1))[None, :] + ball) + 1e-6
        return np.stack([node[:, list(way)].min(axis=1) for _, way in self.leaves], axis=1)


def search(x: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, q_own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (n queries x k, -inf where there are fewer) that may be among the best k; own, q_own: numbers of the rows; floor: the kth score known so far."""
    n = len(q)
    best, best_id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.copy()
    tree = BallTree(x)
    bounds = tree.bounds(q)
    order = np.argsort(-bounds, axis=1, kind="stable")
    for turn in range(len(tree.leaves)):
        leaf = order[:, turn]
        alive = np.flatnonzero(bounds[np.arange(n), leaf] >= kth)
        if not len(alive):
            break
        for node in np.unique(leaf[alive]):
            rows, members = alive[leaf[alive] == node], tree.leaves[node][0]
            scores = q[rows] @ x[members].T
            scores[q_own[rows][:, None] == own[members][None, :]] = -np.inf
            better = (scores >= kth[rows][:, None]) & (scores > -np.inf)
            gains = better.any(axis=1)
            if not gains.any():
                continue
            rows, scores = rows[gains], np.where(better[gains], scores[gains], -np.inf)
            all_scores = np.concatenate([best[rows], scores], axis=1)
            all_ids = np.concatenate([best_id[rows], np.broadcast_to(ids[members], scores.shape)], axis=1)
            pick = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[rows], best_id[rows] = np.take_along_axis(all_scores, pick, 1), np.take_along_axis(all_ids, pick, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
    return best, best_id


def search_wide(x, ids, own, q, q_own, k: int):
    """As search, in Python's integers: for components whose sums a double can't hold. Number of the query's row, id, score."""
    for row, number in zip(q, q_own):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(row, v)), int(i)) for v, i, o in zip(x, ids, own) if o != number)[:k]
        for s, i in scored:
            yield int(number), i, max(-(2**63), min(2**63 - 1, -s))


def group_search(k: int):
    def run(key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        names = ["query_row", "vec_id", "score"]
        if not len(vectors) or not len(queries):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        ids, own, q_own = vectors.column("vec_id").to_numpy(), vectors.column("row").to_numpy(), queries.column("query_row").to_numpy()
        x = vectors.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        q = queries.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(q_own), dim)
        if dim and float(np.abs(x.astype(np.float64)).max()) * float(np.abs(q.astype(np.float64)).max()) * dim >= 2.0**53:
            found = list(search_wide(x, ids, own, q, q_own, k))
            return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(names)})
        floor = queries.column("kth").to_numpy().astype(np.float64)
        floor[queries.column("kth").to_numpy() == NONE] = -np.inf
        best, best_id = search(x.astype(np.float64), ids, own, q.astype(np.float64), q_own, floor, k)
        at, place = np.nonzero(best > -np.inf)
        return pa.table({"query_row": q_own[at], "vec_id": best_id[at, place], "score": best[at, place].astype(np.int64)})

    return run


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id and q, array<bigint>, of the rows that take part."""
    x = F.col(vector)
    good = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("q"))


def waves(shards: int, growth: int = WAVE):
    """Ranges of shards, each growth times as long as all before it."""
    first, past = 0, 1
    while first < shards:
        yield first, min(past, shards)
        first, past = past, past * (growth + 1)


def top_k(df: DataFrame, is_query, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row for which is_query(vec_id) holds."""
    scratch = Scratch(df.sparkSession, "topk")
    # a row's number is fixed by the table that it is written to
    rows = scratch.write(quantised(df, vec_id, vector, scale).withColumns({"dim": F.size("q"), "row": F.monotonically_increasing_id()}), "vectors")
    asked = rows.where(is_query(F.col("vec_id"))).select(F.col("row").alias("query_row"), "q", "dim")
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_row", F.lit(1)), F.lit(blocks)).cast("int"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    keys = ["dim", "shard", "block"]
    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best = None
    for first, past in waves(shards):
        # aliases, as both sides come from one table
        vectors = dealt.where((F.col("shard") >= first) & (F.col("shard") < past)).select(F.col("dim").alias("dim"), F.col("shard").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", F.col("q").alias("q"), "row")
        queries = asked.withColumn("kth", F.lit(NONE))
        if best is not None:
            kth = best.where(F.col("rank") == k).select("query_row", F.col("score").alias("kth"))
            queries = asked.join(kth, "query_row", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE)))
        queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(past - 1)))).select(*(F.col(c).alias(c) for c in [*keys, "query_row", "q", "kth"]))
        found = vectors.groupBy(keys).cogroup(queries.groupBy(keys)).applyInArrow(group_search(k), "query_row long, vec_id long, score long")
        spent = best
        if best is not None:
            found = found.unionByName(best.select("query_row", "vec_id", "score"))
        best = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        if past < shards:
            best = scratch.write(best, "best")
        if spent is not None and past < shards:
            scratch.drop(spent)
    ids = rows.where(is_query(F.col("vec_id"))).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query_row").select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % QUERY_STEP == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q)
  WHERE a.vec_id % 20 = 0
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 20
"""
