"""Hybrid search: dense and sparse scores for many queries at once, fusion, and the best k of each query.

Queries come in blocks, which are broadcast. The dense leg reads the vectors once a block: tiles of a bounded number of
bytes hold the scores of some queries and a batch of chunks. The sparse leg goes through an index at rest (index.py). A task
keeps the best k of each query, so k rows of a query and task are shuffled, never a row for each pair. What all queries of a
block ask of a chunk reaches the scan; other conditions are masks over a tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import config as C
from docloom.operators import index, rerank
from docloom.sources import shared

#: Queries of a block, at most (the driver holds one block at a time); bytes of a tile of scores.
BLOCK_QUERIES, TILE_BYTES = 4_096, 8 << 20
#: All cosines: vectors and queries of a cell as expected, pairs that a task may have, pairs of a batch that leaves Python, and tasks that share a group.
CELL_VECTORS, CELL_QUERIES, TASK_PAIRS, BATCH_PAIRS, SPREAD = 2_048, 1_024, 1 << 25, 1 << 17, 256
WORD = "[a-z0-9]+"
ARROW = index.ARROW


def best(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """The k rows of the highest score of each query, ties by id; a row's rank is from 1 on."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a length is 0."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def query_blocks(queries: DataFrame, size: int) -> Iterator[list[Row]]:
    """The queries, a block at a time on the driver."""
    block: list[Row] = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def by_block(queries: DataFrame, size: int, search, shape: T.StructType) -> DataFrame:
    """search(block) of each block of queries. A second block makes every block's rows be written before the next one is read, so that a plan holds one block."""
    spark, path, last = queries.sparkSession, None, None
    for rows in query_blocks(queries, size):
        if last is not None:
            path = path or shared.fresh(spark, "found")
            last.write.mode("append").parquet(path)
        last = search(rows)
    if last is None:
        return spark.createDataFrame([], shape)
    if path is None:
        return last
    last.write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from 0, as round() of SQL."""
    unit = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * unit + 0.5), x) / unit


class Best:
    """The k best chunks of each query so far, ties by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.kth = k, np.full(queries, -np.inf)
        self.scores: list[np.ndarray] = [np.zeros(0)] * queries
        self.ids: list[np.ndarray | None] = [None] * queries

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: queries from number first on x chunks, -inf for no pair."""
        good = (scores >= self.kth[first : first + len(scores), None]) & (scores > -np.inf)
        for row in np.flatnonzero(good.any(axis=1)):
            chosen, q = good[row], first + row
            had = self.ids[q]
            mine = np.concatenate([self.scores[q], scores[row, chosen]])
            names = ids[chosen] if had is None else np.concatenate([had, ids[chosen]])
            order = np.lexsort((names, -mine))[: self.k]
            self.scores[q], self.ids[q] = mine[order], names[order]
            if len(order) == self.k:
                self.kth[q] = mine[order[-1]]


def shape_of(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    types = {f.name: f.dataType for f in [*queries.schema.fields, *chunks.schema.fields]}
    return T.StructType([T.StructField("query_id", types["query_id"]), T.StructField("chunk_id", types["chunk_id"]), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])


def dense_block(rows: list[Row], chunks: DataFrame, k: int, digits: int, conditions: dict[str, str], shape: T.StructType) -> DataFrame:
    """The k best chunks of each query of a block. A tile of scores has TILE_BYTES: as many queries at a time as a batch of chunks leaves room for."""

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(length > 0, length, 1)

    rows = [r for r in rows if r["dense"] is not None and None not in r["dense"]]
    if not rows:
        return chunks.sparkSession.createDataFrame([], shape)
    rows.sort(key=lambda r: len(r["dense"]))
    sides = []
    for n in sorted({len(r["dense"]) for r in rows}):
        at = [i for i, r in enumerate(rows) if len(r["dense"]) == n]
        sides.append((n, at[0], unit(np.array([rows[i]["dense"] for i in at], np.float64).reshape(len(at), n))))
    must, wanted = index.pushed(rows, conditions), [(c, kind, [r[c] for r in rows]) for c, kind in conditions.items()]
    block = chunks.sparkSession.sparkContext.broadcast((sides, wanted, [r["query_id"] for r in rows]))
    kind = ARROW[shape["query_id"].dataType.typeName()]

    def run(batches):
        sides, wanted, asked = block.value
        best, id_type = Best(len(asked), k), pa.null()
        for batch in batches:
            names = batch.column("chunk_id")
            ids, id_type = np.array(names.to_pylist()), names.type
            vectors = batch.column("dense")
            sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
            fits = index.masks(wanted, batch.column, len(ids))
            for n, first, q in sides:
                chosen = np.flatnonzero(sizes == n)
                if not len(chosen):
                    continue
                x = unit(vectors.take(pa.array(chosen)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(chosen), n))
                step = max(1, TILE_BYTES // (8 * len(chosen)))
                for i in range(0, len(q), step):
                    scores = rounded(q[i : i + step] @ x.T, digits)
                    for j in range(len(scores)) if fits else ():
                        if fits[first + i + j] is not None:
                            scores[j, ~fits[first + i + j][chosen]] = -np.inf
                    best.add(first + i, scores, ids[chosen])
        for q, own in enumerate(asked):
            if best.ids[q] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(best.scores[q]), kind), pa.array(best.ids[q].tolist(), id_type), pa.array(best.scores[q])], names=["query_id", "chunk_id", "score"])

    # conditions come before vectors: what no query of the block asks for isn't read
    chunks = (chunks if must is None else chunks.where(must)).select("chunk_id", "dense", *conditions).where(~F.exists("dense", lambda v: v.isNull()))
    return best(chunks.mapInArrow(run, T.StructType(shape.fields[:3])), k)


def dense_search(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 4, conditions: dict[str, str] | None = None, block: int = BLOCK_QUERIES) -> DataFrame:
    """queries: query_id, dense. chunks: chunk_id, dense. Exact cosine of each query with each chunk whose vector has its length (0 where a vector is 0).

    query_id, chunk_id, score and rank. conditions: column of both -> "equal", or "contains" (the query's value in the chunk's).
    """
    conditions, shape = conditions or {}, shape_of(queries, chunks)
    return by_block(queries.select("query_id", "dense", *conditions), block, lambda rows: dense_block(rows, chunks, k, digits, conditions, shape), shape)


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones with zeros behind them; their lengths and numbers of values (-1 where a value or the vector is null)."""
    sizes = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    x = np.zeros((len(sizes), int(sizes.max(initial=0))))
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    known = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    known[row[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    return x, np.sqrt((x * x).sum(axis=1)), np.where(known, sizes, -1)


def all_cosines(queries: DataFrame, chunks: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """query_id, chunk_id and cosine of every query with every chunk of the same group: queries has query_id, dense and by, chunks has chunk_id, dense and by.

    0 where a length is 0 or a value is null, null for vectors of different sizes. The pairs are the result, so rows grow with
    the square; they are made from cells of a group as products of matrices, so neither a row of a pair with its vectors nor
    a whole group is ever in one place. A group is dealt over up to SPREAD tasks, each of which gets its queries.
    """
    asked, held = queries.count(), chunks.count()
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-asked * held // TASK_PAIRS))
    spread = min(SPREAD, tasks)
    cells = spread * max(1, -(-held // (CELL_VECTORS * spread)))
    cell = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    v = chunks.select(by, cell("chunk_id", cells).alias("cell"), F.struct(F.col("chunk_id").alias("id"), "dense").alias("v")).withColumn("deal", F.col("cell") % spread)
    v = v.where(F.col(by).isNotNull()).repartition(tasks, by, "deal").groupBy(by, "deal", "cell").agg(F.collect_list("v").alias("chunks"))
    q = queries.select(by, cell("query_id", max(1, -(-asked // CELL_QUERIES))).alias("part"), F.struct(F.col("query_id").alias("id"), "dense").alias("q"))
    q = q.groupBy(by, "part").agg(F.collect_list("q").alias("queries")).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column("queries"), batch.column("chunks")):
                a, b = left.values, right.values
                (x, x_length, x_size), (y, y_length, y_size) = matrix(a.field("dense")), matrix(b.field("dense"))
                width = min(x.shape[1], y.shape[1])
                step = max(1, BATCH_PAIRS // len(b))
                for i in range(0, len(a), step):
                    part = slice(i, i + step)
                    length = np.outer(x_length[part], y_length)
                    some = ~(length <= 0) & (x_size[part, None] >= 0) & (y_size >= 0)
                    with np.errstate(invalid="ignore"):
                        score = np.where(some, rounded(x[part, :width] @ y[:, :width].T / np.where(some, length, 1), digits) + 0.0, 0.0)
                    odd = some & (x_size[part, None] != y_size)
                    n = len(score)
                    yield pa.RecordBatch.from_arrays([a.field("id").take(pa.array(np.repeat(np.arange(i, i + n), len(b)))), b.field("id").take(pa.array(np.tile(np.arange(len(b)), n))), pa.array(score.ravel(), mask=odd.ravel() if odd.any() else None)], names=["query_id", "chunk_id", "score"])

    return v.join(q, [by, "deal"]).select("queries", "chunks").mapInArrow(run, T.StructType(shape_of(queries, chunks).fields[:3]))


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))


def sparse_block(rows: list[Row], ready: index.Index, k: int, digits: int, conditions: dict[str, str], shape: T.StructType) -> DataFrame:
    met = index.found_in(ready, rows, k, conditions, lambda x: rounded(x, digits))
    pairs = met.select(F.col("query_id").cast(shape["query_id"].dataType).alias("query_id"), F.explode(F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("scores").alias("score"))).alias("hit"))
    return best(pairs.select("query_id", F.col("hit.chunk_id").alias("chunk_id"), F.col("hit.score").alias("score")), k)


def indexed(chunks: DataFrame | index.Index, conditions: dict[str, str] | None = None) -> index.Index:
    """An index of chunks that have none, for one search."""
    if isinstance(chunks, index.Index):
        return chunks
    return index.build(chunks.select("chunk_id", "words", *(conditions or {})), shared.fresh(chunks.sparkSession, "index"))


def sparse_search(queries: DataFrame, chunks: DataFrame | index.Index, k: int, digits: int = 4, conditions: dict[str, str] | None = None, block: int = BLOCK_QUERIES) -> DataFrame:
    """queries: query_id, words. chunks: an index, or chunk_id and words. Inner product of weights 1 + ln of the count, through the words that both have."""
    conditions, ready = conditions or {}, indexed(chunks, conditions)
    shape = shape_of(queries, ready.chunks)
    return by_block(queries.select("query_id", "words", *conditions), block, lambda rows: sparse_block(rows, ready, k, digits, conditions, shape), shape)


def scan_block(rows: list[Row], chunks: DataFrame, k: int, digits: int, shape: T.StructType) -> DataFrame:
    """The k best chunks of each query of a block from the chunks' words as they come. A tile has TILE_BYTES of scores, and of products of weights, or one chunk's."""
    names = sorted({w for r in rows for w in r["words"] or () if w is not None})
    place, asked = {w: i for i, w in enumerate(names)}, []
    for q, r in enumerate(rows):
        terms, counts = np.unique(np.array([place[w] for w in r["words"] or () if w is not None], np.int64), return_counts=True)
        asked.append((terms, np.full(len(terms), q), 1 + np.log(counts)))
    term, query, weight = map(np.concatenate, zip(*asked))
    order = np.argsort(term, kind="stable")
    held = np.bincount(term, minlength=len(names))
    block = chunks.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()), held, np.cumsum(held) - held, query[order], weight[order], [r["query_id"] for r in rows]))
    kind = ARROW[shape["query_id"].dataType.typeName()]

    def run(batches):
        known, held, first, query, weight, asked = block.value
        best, id_type = Best(len(asked), k), pa.null()
        for batch in batches:
            chunk_ids, words = batch.column("chunk_id"), batch.column("words")
            ids, id_type = np.array(chunk_ids.to_pylist()), chunk_ids.type
            sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
            # a null word has no place
            code = pc.index_in(words.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            cell, count = np.unique((np.repeat(np.arange(len(sizes)), sizes) * len(known) + code)[code >= 0], return_counts=True)
            if not len(cell):
                continue
            of, code = np.divmod(cell, len(known))
            own = 1 + np.log(count)
            work = np.cumsum(np.maximum(np.bincount(of, held[code], minlength=len(ids)), len(asked)))
            low = 0
            while low < len(ids):
                done = work[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(work, done + TILE_BYTES // 8, "right")))
                a, b = np.searchsorted(of, (low, high))
                n = held[code[a:b]]
                spots = index.ragged(first[code[a:b]], n)
                cells = np.repeat((of[a:b] - low) * len(asked), n) + query[spots]
                sums = np.bincount(cells, weight[spots] * np.repeat(own[a:b], n), minlength=(high - low) * len(asked)).reshape(-1, len(asked))
                best.add(0, np.where(sums > 0, rounded(sums, digits), -np.inf).T, ids[low:high])
                low = high
        for q, own in enumerate(asked):
            if best.ids[q] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(best.scores[q]), kind), pa.array(best.ids[q].tolist(), id_type), pa.array(best.scores[q])], names=["query_id", "chunk_id", "score"])

    return best(chunks.select("chunk_id", "words").mapInArrow(run, T.StructType(shape.fields[:3])), k)


def sparse_scan(queries: DataFrame, chunks: DataFrame, k: int, digits: int = 4, block: int = BLOCK_QUERIES) -> DataFrame:
    """As sparse_search, for lists that are made once: chunks (chunk_id, words) are read as they come, once a block of queries, and no index is built of them; k rows a query and task are shuffled."""
    shape = shape_of(queries, chunks)
    return by_block(queries.select("query_id", "words"), block, lambda rows: scan_block(rows, chunks, k, digits, shape), shape)


def scaled(leg: DataFrame, how: str) -> DataFrame:
    if how == "none":
        return leg
    if how == "atan":
        return leg.withColumn("score", F.atan("score") * 2 / F.lit(3.141592653589793))
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return leg.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def weighted_fusion(dense: DataFrame, sparse: DataFrame, k: int = C.COARSE_K, weights: tuple[float, float] = (C.DENSE_WEIGHT, C.SPARSE_WEIGHT), scale: str = "none", digits: int = 6) -> DataFrame:
    """Both legs' scores, weighted and added; a chunk that a leg lacks has 0 there."""
    a = scaled(dense, scale).select("query_id", "chunk_id", F.col("score").alias("d"))
    b = scaled(sparse, scale).select("query_id", "chunk_id", F.col("score").alias("s"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    total = F.coalesce("d", F.lit(0.0)) * weights[0] + F.coalesce("s", F.lit(0.0)) * weights[1]
    return best(both.select("query_id", "chunk_id", F.round(total, digits).alias("score")), k)


def rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = C.COARSE_K, constant: int = C.RRF_K, digits: int = 8) -> DataFrame:
    """1 / (constant + rank) of each leg, added."""
    both = dense.select("query_id", "chunk_id", "rank").union(sparse.select("query_id", "chunk_id", "rank"))
    return best(both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (constant + F.col("rank"))), digits).alias("score")), k)


def ordered_chunks(chunks: DataFrame, condition: Column, most: int = 10_000, file: str = "file_path") -> DataFrame:
    """Each file's chunks in reading order with their place, the first most of every file; null numbers count as 0."""
    reading = [F.coalesce("page_num", F.lit(0)), F.coalesce("chunk_index", F.lit(0)), F.col("chunk_id")]
    rows = chunks.where(condition).withColumn("place", F.row_number().over(Window.partitionBy(file).orderBy(*reading)))
    return rows.where(F.col("place") <= most).orderBy(file, "place")


def of_prefix(prefixes: list[str], key: str = "file_hash") -> Column:
    """Whether a file's hash begins with one of the prefixes."""
    return reduce(lambda a, b: a | b, (F.startswith(key, F.lit(p)) for p in prefixes), F.lit(False))


def across_domains(queries: DataFrame, chunks: DataFrame | index.Index, k: int, most: int = 3) -> DataFrame:
    """queries: query_id, words, domains. chunks: chunk_id, words, domain. A search of its own in each of the first domains: query_id, turn, domain, chunk_id, score, rank."""
    asked = queries.select(F.col("query_id").alias("of"), "words", F.posexplode(F.slice("domains", 1, most)).alias("turn", "domain"))
    asked = asked.withColumn("query_id", F.concat_ws(" ", F.col("of").cast("string"), "domain"))
    found = sparse_search(asked, chunks, k, conditions={"domain": "equal"})
    return found.join(asked.drop("words"), "query_id").drop("query_id").withColumnRenamed("of", "query_id")


#: What a query's analysis may ask of a chunk.
CONDITIONS = {"domain": "equal", "category": "equal", "voltage_level": "equal", "publish_level": "equal", "discipline": "equal", "equipment_type": "equal", "year": "equal", "is_drawing": "equal", "doc_number": "contains"}


def with_domain(analyzed: DataFrame, manual: str | Column) -> DataFrame:
    """A domain given by hand holds where the analysis finds none."""
    given = F.lit(manual) if isinstance(manual, str) else manual
    return analyzed.withColumn("domain", F.coalesce("domain", given))


def ready_for(analyzed: DataFrame, chunks: DataFrame | index.Index) -> tuple[index.Index, dict[str, str]]:
    """An index of the chunks, and the conditions that queries and chunks both know."""
    columns = chunks.chunks.columns if isinstance(chunks, index.Index) else chunks.columns
    has = {c: kind for c, kind in CONDITIONS.items() if c in columns and c in analyzed.columns}
    if not isinstance(chunks, index.Index):
        chunks = index.build(chunks, shared.fresh(chunks.sparkSession, "index"))
    return chunks, has


def hybrid_block(rows: list[Row], ready: index.Index, k: int, has: dict[str, str], weights: tuple[float, float], shape: T.StructType) -> DataFrame:
    return weighted_fusion(dense_block(rows, ready.chunks, 2 * k, 4, has, shape), sparse_block(rows, ready, 2 * k, 4, has, shape), k, weights)


def hybrid_search(analyzed: DataFrame, chunks: DataFrame | index.Index, encode, k: int = C.COARSE_K, text: str = "expanded_query", weights: tuple[float, float] = (C.DENSE_WEIGHT, C.SPARSE_WEIGHT), block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, chunk_id, score and rank of the k best chunks of each query by both legs, among those that its conditions leave.

    analyzed: query_id, text and the columns of CONDITIONS that chunks have too. chunks: an index, or chunk_id, dense, words. encode(df, key, text) adds dense and words.
    """
    ready, has = ready_for(analyzed, chunks)
    asked = encode(analyzed.select("query_id", text, *has), "query_id", text).select("query_id", "dense", "words", *has)
    shape = shape_of(asked, ready.chunks)
    return by_block(asked, block, lambda rows: hybrid_block(rows, ready, k, has, weights, shape), shape)


def by_number(numbers: DataFrame, chunks: DataFrame | index.Index, encode, k: int = 100, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """numbers: query_id, doc_number. Chunks whose number holds the asked one, the best k by both legs with the number as the query."""
    return hybrid_search(numbers.withColumn("query", F.col("doc_number")), chunks, encode, k, "query", weights)


def full_search(analyzed: DataFrame, chunks: DataFrame | index.Index, encode, coarse_k: int = C.COARSE_K, fine_k: int = C.FINE_K, block: int = BLOCK_QUERIES, scorer=None) -> DataFrame:
    """The coarse list of hybrid_search with the chunks' columns, reranked: analyzed also has query. Adds what rerank adds.

    scorer: of pairs.py's form, for pairs of a query's own words and a chunk; without one the fused score is the pair's.
    """
    ready, has = ready_for(analyzed, chunks)
    told = {"query": "query", "domain": "asked_domain", "voltage_level": "asked_voltage"}
    asked = encode(analyzed.select("query_id", "query", "expanded_query", *has, *(c for c in told if c not in has and c != "query")), "query_id", "expanded_query")
    shape = shape_of(asked, ready.chunks)
    known = T.StructType([T.StructField("query_id", shape["query_id"].dataType), *(T.StructField(n, T.StringType()) for n in told.values())])
    rows_of = ready.chunks.drop("segment", "row", "part", "dense", *(() if scorer else ("words",)))

    def search(rows: list[Row]) -> DataFrame:
        """The block's analysis goes on as it is instead of being made again."""
        coarse = hybrid_block(rows, ready, coarse_k, has, (C.DENSE_WEIGHT, C.SPARSE_WEIGHT), shape)
        mine = ready.spark.createDataFrame([(r["query_id"], *(r[c] for c in told)) for r in rows], known)
        own = rows_of
        if rows:  # written, as it is asked twice: which chunks are found, then how well
            coarse = shared.written(coarse, shared.fresh(ready.spark, "coarse"))
            own = shared.narrowed(rows_of, coarse, "chunk_id")
        hits = coarse.join(F.broadcast(mine), "query_id").join(own, "chunk_id")
        if scorer is None:
            return rerank.rerank(hits, fine_k, digits=8)
        scored = scorer(hits, mine.select("query_id", words("query").alias("words")), ready)
        return rerank.rerank(scored, fine_k, digits=10, score="pair_score")

    return by_block(asked, block, search, search([]).schema)
