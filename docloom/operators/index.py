"""An inverted index at rest: chunks in segments, and of each term its chunks in blocks with their largest count.

A segment is SEGMENT chunks at most; its chunks have numbers from 0 on. `chunks` holds them with all their columns;
`postings` has a row for each term of a segment: the chunks' numbers and counts, cut into blocks of RANGE chunk numbers, and
the largest count of each block. It is made by one shuffle, of (segment, term, chunk) with counts. Adding chunks makes new
segments and leaves the old ones as they are.

A search reads the postings of its own terms only. In a segment, a block of chunk numbers can't score more than the sum of
its terms' largest weights; blocks are scored from the highest bound down as long as that reaches the score of the k-th
chunk so far. Segments are searched in two waves: the k-th scores of the first bound the second.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources import shared

#: Chunks of a segment, and of a block of it; more segments than WAVE are searched in two waves, of which the first has one in WAVE.
SEGMENT, RANGE, WAVE = 2_048, 32, 32
ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
POSTINGS = "segment long, term string, rows array<int>, counts array<int>, ranges array<int>, tops array<int>, sizes array<int>"


def numbered(chunks: DataFrame, segment: int = SEGMENT, first: int = 0) -> DataFrame:
    """chunks with segment and row; fixed only once written."""

    def run(batches):
        base, n = first + (TaskContext.get().partitionId() << 24), 0
        for batch in batches:
            at = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + at // segment), pa.array((at % segment).astype(np.int32))], names=[*batch.schema.names, "segment", "row"])

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType())]))


def counted(batches: Iterable[pa.RecordBatch]):
    """segment, row and words of chunks -> segment, term, row and count."""
    for batch in batches:
        words = batch.column("words")
        sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
        flat = words.flatten().dictionary_encode()
        code = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        of, kinds = np.repeat(np.arange(len(sizes)), sizes)[code >= 0], max(1, len(flat.dictionary))
        cell, count = np.unique(of * kinds + code[code >= 0], return_counts=True)
        of = pa.array(cell // kinds)
        yield pa.RecordBatch.from_arrays([batch.column("segment").take(of), flat.dictionary.take(pa.array(cell % kinds)), batch.column("row").take(of), pa.array(count.astype(np.int32))], names=["segment", "term", "row", "n"])


def packed(batches: Iterable[pa.RecordBatch]):
    """Sorted by segment, term and row -> rows of POSTINGS. The last term of a batch waits for the next one."""

    def pack(table: pa.Table):
        seg, row, n = (table.column(c).combine_chunks().to_numpy() for c in ("segment", "row", "n"))
        term = table.column("term").combine_chunks()
        code = term.dictionary_encode().indices.to_numpy()
        new = np.flatnonzero(np.append(True, (np.diff(seg) != 0) | (np.diff(code) != 0)))
        block = row // RANGE
        cut = np.union1d(np.flatnonzero(np.diff(block, prepend=-1)), new)
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.append(ends, len(values)).astype(np.int32)), pa.array(values.astype(np.int32)))
        at = np.searchsorted(cut, new)
        yield pa.RecordBatch.from_arrays([pa.array(seg[new]), term.take(pa.array(new)), lists(new, row), lists(new, n), lists(at, block[cut]), lists(at, np.maximum.reduceat(n, cut)), lists(at, np.diff(np.append(cut, len(row))))], names=["segment", "term", "rows", "counts", "ranges", "tops", "sizes"])

    rest: pa.Table | None = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        rest = own if rest is None else pa.concat_tables([rest, own])
        if not rest.num_rows:
            continue
        last = (rest.column("segment")[-1], rest.column("term")[-1])
        same = pc.and_(pc.equal(rest.column("segment"), last[0]), pc.equal(rest.column("term"), last[1])).to_numpy()
        done = rest.num_rows - int(same.sum())
        if done:
            yield from pack(rest.slice(0, done))
            rest = rest.slice(done)
    if rest is not None and rest.num_rows:
        yield from pack(rest)


class Index:
    """An index in a folder. chunks: all columns, and segment and row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.chunks, self.postings = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings")
        self._segments: int | None = None

    @property
    def segments(self) -> int:
        if self._segments is None:
            self._segments = self.spark.read.parquet(f"{self.path}/built").first()["segments"]
        return self._segments

    def add(self, chunks: DataFrame, segment: int = SEGMENT) -> "Index":
        """Chunks of the same columns as new segments; the old ones aren't read."""
        last = self.chunks.agg(F.max("segment")).first()[0]
        return _grow(chunks.select(*(c for c in self.chunks.columns if c not in ("segment", "row", "part"))), self.path, segment, 0 if last is None else last + 1)


def _grow(chunks: DataFrame, path: str, segment: int, first: int) -> Index:
    spark = chunks.sparkSession
    part = shared.fresh(spark, "part").rsplit("-", 1)[-1]
    # numbers of chunks are fixed by the table that they are written to; each addition is a folder of its own
    known = shared.written(numbered(chunks, segment, first), f"{path}/chunks/part={part}")
    rows = known.select("segment", "row", "words").mapInArrow(counted, "segment long, term string, row int, n int")
    ordered = rows.repartition("segment", "term").sortWithinPartitions("segment", "term", "row")
    ordered.mapInArrow(packed, POSTINGS).write.option("compression", "zstd").parquet(f"{path}/postings/part={part}")
    out = Index(spark, path)
    out.chunks.agg(F.countDistinct("segment").alias("segments")).write.mode("overwrite").parquet(f"{path}/built")
    return out


def build(chunks: DataFrame, path: str, segment: int = SEGMENT) -> Index:
    """chunks: chunk_id, words (array<string>) and what else searches want of a chunk. Null words are none."""
    return _grow(chunks, path, segment, 0)


def opened(spark: SparkSession, path: str) -> Index | None:
    """The index in a folder, if one was built to its end there."""
    return Index(spark, path) if shared.exists(spark, f"{path}/built") else None


def masks(conditions: list[tuple[str, str, list]], column, n: int) -> list[np.ndarray | None]:
    """Of each query, which of n chunks its conditions leave (None: all). conditions: column, kind, and each query's value (null: none). column(name): an Arrow array."""
    out: list[np.ndarray | None] = [None] * (len(conditions[0][2]) if conditions else 0)
    for name, kind, wanted in conditions:
        if not any(w is not None for w in wanted):
            continue
        coded = column(name).dictionary_encode()
        code, values, fits = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), {}
        for q, w in enumerate(wanted):
            if w is None:
                continue
            if w not in fits:
                # the last place stands for null
                fits[w] = np.array([w in v if kind == "contains" else v == w for v in values] + [False])[code]
            out[q] = fits[w] if out[q] is None else out[q] & fits[w]
    return out


def pushed(rows: list[Row], conditions: dict[str, str], most: int = 200) -> Column | None:
    """What every query of a block asks of a chunk, as a filter that reaches the scan."""
    found: Column | None = None
    for name, kind in conditions.items():
        wanted = {r[name] for r in rows}
        if rows and None not in wanted and len(wanted) <= most:
            one = F.col(name).isin(sorted(wanted)) if kind == "equal" else _any(F.contains(F.col(name), F.lit(w)) for w in sorted(wanted))
            found = one if found is None else found & one
    return found


def _any(tests: Iterable[Column]) -> Column:
    out: Column | None = None
    for t in tests:
        out = t if out is None else out | t
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Segment:
    """Postings of a segment, for the terms of a block of queries."""

    def __init__(self, table: pa.Table, known: pa.Array):
        self.term = pc.index_in(table.column("term").combine_chunks(), value_set=known).to_numpy(zero_copy_only=False)
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.rows, self.ranges, self.sizes = flat("rows"), flat("ranges"), flat("sizes")
        self.weights, self.tops = 1 + np.log(flat("counts")), 1 + np.log(flat("tops"))
        self.blocks = pc.list_value_length(table.column("ranges").combine_chunks()).to_numpy(zero_copy_only=False)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.place = np.full(len(known), -1)
        self.place[self.term] = np.arange(len(self.term))
        self.n_ranges = int(self.ranges.max()) + 1 if len(self.ranges) else 0

    def best(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, fits: np.ndarray | None, k: int, least: float, score) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Row numbers and scores of a query's k best chunks and those equal to the last, blocks in all, blocks scored. ids: of rows, None where there is no chunk; least: a score that no worse one needs to reach."""
        own = self.place[terms]
        weights, own = weights[own >= 0], own[own >= 0]
        at = ragged(self.first[own], self.blocks[own])
        per = np.repeat(weights, self.blocks[own])
        bound = np.bincount(self.ranges[at], self.tops[at] * per, minlength=self.n_ranges)
        if fits is not None:
            some = np.zeros(self.n_ranges * RANGE, bool)
            some[: len(fits)] = fits[: len(some)]
            bound[~some.reshape(-1, RANGE).any(axis=1)] = 0
        order = np.argsort(-bound, kind="stable")[: int((bound > 0).sum())]
        total, done, found, scores = len(order), 0, np.zeros(0, np.int64), np.zeros(0)
        step = max(4, 2 * -(-k // RANGE))
        while done < total:
            order = order[: done + int((bound[order[done:]] >= least - 1e-3).sum())]
            now = order[done : done + step]
            if not len(now):
                break
            chosen = np.zeros(self.n_ranges, bool)
            chosen[now] = True
            use = chosen[self.ranges[at]]
            spots = ragged(self.begin[at[use]], self.sizes[at[use]])
            sums = np.bincount(self.rows[spots], self.weights[spots] * np.repeat(per[use], self.sizes[at[use]]), minlength=len(ids))
            good = sums > 0
            if fits is not None:
                good[: len(fits)] &= fits
            rows = np.flatnonzero(good)
            value = score(sums[rows])
            keep = (value >= least) & (value > 0)
            found, scores = np.append(found, rows[keep]), np.append(scores, value[keep])
            if len(scores) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                least, keep = max(least, kth), scores >= kth
                found, scores = found[keep], scores[keep]
            elif len(scores) == k:
                least = max(least, float(scores.min()))
            done, step = done + len(now), 4 * step
        return found, scores, total, done


def found_in(index: Index, rows: list[Row], k: int, conditions: dict[str, str], score) -> DataFrame:
    """For a block of queries (query_id, words and the columns of conditions): query_id, chunk_ids and scores of the best k of each segment, and its blocks in all and scored."""
    spark = index.spark
    names = sorted({w for r in rows for w in r["words"] or ()})
    place, known = {w: i for i, w in enumerate(names)}, pa.array(names, pa.string())
    asked = []
    for r in rows:
        terms, counts = np.unique(np.array([place[w] for w in r["words"] or ()], np.int64), return_counts=True)
        asked.append((terms, 1 + np.log(counts)))
    types = {f.name: f.dataType for f in index.chunks.schema.fields}
    with_id = next((type(r["query_id"]) for r in rows if r["query_id"] is not None), int)
    q_type = T.StringType() if with_id is str else T.LongType()
    shape = T.StructType([T.StructField("query_id", q_type), T.StructField("chunk_ids", T.ArrayType(types["chunk_id"])), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("blocks", T.LongType()), T.StructField("scored", T.LongType())])
    arrow = pa.schema([("query_id", ARROW[q_type.typeName()]), ("chunk_ids", pa.list_(ARROW[types["chunk_id"].typeName()])), ("scores", pa.list_(pa.float64())), ("blocks", pa.int64()), ("scored", pa.int64())])
    wanted = [(c, kind, [r[c] for r in rows]) for c, kind in conditions.items()]
    must = pushed(rows, conditions)
    chunks = index.chunks.select("segment", "row", "chunk_id", *conditions)
    chunks = chunks if must is None else chunks.where(must)
    terms = spark.createDataFrame([(n,) for n in names], "term string")
    postings = index.postings.drop("part")
    postings = postings.where(F.col("term").isin(names)) if 0 < len(names) <= 100 else postings.join(F.broadcast(terms), "term", "left_semi").select(*postings.columns)
    if must is not None:
        # few segments hold what is asked for: at most one row a segment
        postings = postings.join(F.broadcast(chunks.select("segment").distinct()), "segment", "left_semi")
    block = spark.sparkContext.broadcast((asked, known, wanted, [r["query_id"] for r in rows]))

    def search(least):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            asked, known, wanted, q_ids = block.value
            out = {c: [] for c in arrow.names}
            if left.num_rows and right.num_rows:
                segment = Segment(left, known)
                at = right.column("row").to_numpy()
                n = max(int(at.max()) + 1, int(segment.rows.max()) + 1)
                ids = np.full(n, None, object)
                ids[at] = right.column("chunk_id").to_pylist()
                here = np.zeros(n, bool)
                here[at] = True

                where = np.full(n, -1)
                where[at] = np.arange(len(at))
                spots = pa.array(where, mask=where < 0)

                def column(name):
                    return right.column(name).combine_chunks().take(spots)

                fits = masks(wanted, column, n) or [None] * len(asked)
                whole = here.all()
                for q, (terms, weights) in enumerate(asked):
                    mine = fits[q] if whole else here if fits[q] is None else fits[q] & here
                    spots, scores, total, done = segment.best(terms, weights, ids, mine, k, least[q] if least else -np.inf, score)
                    if total:
                        order = sorted(range(len(spots)), key=lambda i: (-scores[i], ids[spots[i]]))[:k]
                        for c, v in zip(arrow.names, (q_ids[q], [ids[spots[i]] for i in order], [float(scores[i]) for i in order], total, done)):
                            out[c].append(v)
            return pa.table(out, schema=arrow)

        return run

    def wave(test: Column | None, least) -> DataFrame:
        a, b = (postings, chunks) if test is None else (postings.where(test), chunks.where(test))
        return a.groupBy("segment").cogroup(b.groupBy("segment")).applyInArrow(search(least), shape)

    if index.segments <= WAVE:
        return wave(None, None)
    early = F.pmod(F.xxhash64("segment"), F.lit(WAVE)) == 0
    first = shared.written(wave(early, None), shared.fresh(spark, "wave"))
    kth = F.get(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), k - 1)
    met = {r["query_id"]: r["kth"] for r in first.groupBy("query_id").agg(kth.alias("kth")).where("kth IS NOT NULL").collect()}
    least = [met.get(r["query_id"], -np.inf) for r in rows] if len({r["query_id"] for r in rows}) == len(rows) else None
    return first.unionByName(wave(~early, least))
