"""Token ids as binary files whose document boundaries are Elias-Fano coded.

Documents go to the files in ascending id order (null ids first; equal ids by a digest of their text). A file is
    magic b"ELFT", width of an id (u1), 3 zero bytes, task u4, number within the task u4, documents u8, of them without id u8, ids u8
    Elias-Fano coded ends of the documents, Elias-Fano coded document ids (each less the first, which stands in front),
    the ids of all documents, little-endian
and a line feed, written by Spark's own writer: its commit protocol keeps files of lost or repeated tasks out,
and it reaches any file system that Spark does. An end takes 2 + log2(ids a document) bits, where a table takes 64.

The query reads each file once, and learns where its documents stand from select() on the coded ends.

Defined results: null and empty texts have the end id alone; a text of any length is one document, and a file that it fills over its
bound ends with it; repeated rows give repeated rows; an empty table gives no file and no row; further columns of the input are not read.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare, strings, table
from .pieces import CONTROL_CUT, PieceCache, load_tokenizer, without_blanks

MAGIC = b"ELFT"
HEAD = "<4sB3xIIQQQ"
FILE_IDS, FILE_DOCS, READ_DOCS = 1 << 22, 1 << 18, 4_096
#: Bytes of a block of the upper bit string and blocks of a span: a block's count is 16 bits, a span's 64.
BLOCK, SPAN = 64, 127
#: Places of a byte's ones: byte, number of the one -> bit.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
ONES = BITS.sum(axis=1)
NTH = np.argsort(1 - BITS, axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A sequence of integers that doesn't fall, in at most 2 + log2(largest / count) bits each.

    The low bits of each value stand side by side; the rest is a bit string in which the one of value i stands at
    (value >> low) + i. A directory counts the ones before each block of BLOCK bytes from the start of its span, and
    before each span, some 4 % of the bit string; select() goes by span, block and byte, so access() reads one block
    for each value that it's asked for.
    """

    HEAD = "<QBQ"

    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray):
        self.n, self.low, self.lower, self.upper = n, low, lower, upper  # bytes
        whole = len(upper) // BLOCK
        counts = np.zeros(-(-len(upper) // BLOCK), np.uint32)
        for i in range(0, whole, 4096):
            j = min(whole, i + 4096)
            counts[i:j] = ONES[upper[i * BLOCK : j * BLOCK]].reshape(-1, BLOCK).sum(axis=1)
        if whole < len(counts):
            counts[whole] = ONES[upper[whole * BLOCK :]].sum()
        spans = range(0, len(counts), SPAN)
        self.spans = np.cumsum([0] + [int(counts[i : i + SPAN].sum()) for i in spans])[:-1].astype(np.uint64)
        self.blocks = np.concatenate([np.cumsum(counts[i : i + SPAN]) - counts[i : i + SPAN] for i in spans] or [counts]).astype(np.uint16)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        if low:
            bits = np.empty((n, low), np.uint8)
            for b in range(low):
                bits[:, b] = (values >> np.uint64(b)) & np.uint64(1)
            lower = np.packbits(bits.ravel(), bitorder="little")
        else:
            lower = np.zeros(0, np.uint8)
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        upper[places] = 1
        return cls(n, low, lower, np.packbits(upper, bitorder="little"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th ones, counted from 0."""
        span = np.searchsorted(self.spans, i.astype(np.uint64), side="right") - 1
        left = i - self.spans[span].astype(np.int64)
        first, past = span * SPAN, np.minimum((span + 1) * SPAN, len(self.blocks))
        while (past - first > 1).any():  # the last block with no more ones before it than are left
            mid = (first + past) // 2
            up = (self.blocks[mid] <= left) & (past - first > 1)
            first, past = np.where(up, mid, first), np.where(up | (past - first <= 1), past, mid)
        left = left - self.blocks[first]
        at = first[:, None] * BLOCK + np.arange(BLOCK)
        here = np.where(at < len(self.upper), self.upper[np.minimum(at, len(self.upper) - 1)], 0)
        sums = np.cumsum(ONES[here], axis=1, dtype=np.int64)
        byte = (sums <= left[:, None]).sum(axis=1)
        row = np.arange(len(i))
        left = left - np.where(byte > 0, sums[row, byte - 1], 0)
        return at[row, byte] * 8 + NTH[here[row, byte], left]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values of these numbers."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self.select(i) - i).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        first = i * self.low
        at = first[:, None] // 8 + np.arange(9)
        window = np.where(at < len(self.lower), self.lower[np.minimum(at, len(self.lower) - 1)], 0).astype(np.uint64)
        shift = (first % 8).astype(np.uint64)[:, None]
        # nine bytes hold the low bits, wherever in a byte they begin
        parts = np.where(np.arange(9) < 8, (window << (np.arange(9, dtype=np.uint64) % 8 * np.uint64(8))), 0)
        word = np.bitwise_or.reduce(parts, axis=1) >> shift[:, 0]
        spill = np.where(shift[:, 0] > 0, window[:, 8] << (np.uint64(64) - np.maximum(shift[:, 0], np.uint64(1))), np.uint64(0))
        return high | ((word | spill) & np.uint64((1 << self.low) - 1))

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little")).astype(np.uint64)
        high = (places - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        if not self.low:
            return high
        bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low).astype(np.uint64)
        return high | (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def dump(self) -> bytes:
        return struct.pack(self.HEAD, self.n, self.low, len(self.upper)) + self.lower.tobytes() + self.upper.tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low, size = struct.unpack_from(cls.HEAD, data, at)
        at += struct.calcsize(cls.HEAD)
        part = -(-n * low // 8)
        lower, upper = np.frombuffer(data, np.uint8, part, at), np.frombuffer(data, np.uint8, size, at + part)
        return cls(n, low, lower, upper), at + part + size


def dump_file(task: int, number: int, doc_ids: list, tokens: list[bytes], width: int) -> bytes:
    """doc_ids: ascending, nulls first. tokens: each document's ids."""
    ends = np.cumsum([len(t) // width for t in tokens])
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    gaps = known.astype(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF)
    head = struct.pack(HEAD, MAGIC, width, task, number, len(tokens), len(tokens) - len(known), int(ends[-1]) if len(ends) else 0)
    return b"".join([head, EliasFano.of(ends).dump(), struct.pack("<q", first), EliasFano.of(gaps).dump(), *tokens])


class TokenFile:
    """A file's documents by number, without reading the others."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.width, self.task, self.number, self.n_docs, self.n_null, self.n_ids = struct.unpack_from(HEAD, view, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.load(view, struct.calcsize(HEAD))
        first = struct.unpack_from("<q", view, at)[0]
        self.gaps, at = EliasFano.load(view, at + 8)
        self.first, self.ids = first, np.frombuffer(view, f"<u{self.width}", self.n_ids, at)

    def doc_ids(self, first: int, past: int) -> list:
        """Ids of the documents from first on, before past."""
        nulls = max(0, min(past, self.n_null) - first)
        known = self.gaps.access(np.arange(max(first, self.n_null), max(past, self.n_null)) - self.n_null)
        return [None] * nulls + (known + np.uint64(self.first & 0xFFFFFFFFFFFFFFFF)).astype(np.int64).tolist()

    def bounds(self, first: int, past: int) -> np.ndarray:
        """Where in ids the documents from first on begin, and where the last before past ends."""
        ends = self.ends.access(np.arange(max(0, first - 1), past)).astype(np.int64)
        return ends if first else np.concatenate([[0], ends])

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds(i, i + 1)
        return self.ids[start:end]


@functools.lru_cache(maxsize=1)
def worker_cache(path: str) -> PieceCache:
    """One in a Python worker, whatever number of tasks it runs."""
    return PieceCache(load_tokenizer(path), without_blanks, cut=CONTROL_CUT, word_end="</w>")


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> None:
    """Encode text and write the files to folder. Range partitions keep the order; a task starts a new file each file_ids ids or FILE_DOCS documents."""

    def pack(batches):
        cache = worker_cache(tokenizer)
        library = cache.tokenizer
        width = 2 if library.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        kind, end = f"<u{width}", b"" if end_id is None else end_id.to_bytes(width, "little")
        task, number, ids, tokens, size = TaskContext.get().partitionId(), 0, [], [], 0

        def blob():
            return pa.RecordBatch.from_arrays([pa.array([dump_file(task, number, ids, tokens, width)], pa.binary())], names=["value"])

        for batch in batches:
            texts = strings(batch.column(1))
            for i, found in zip(batch.column(0).to_pylist(), cache.encoded(texts)):
                ids.append(i)
                tokens.append(found.astype(kind).tobytes() + end)
                size += len(tokens[-1])
                if size >= file_ids * width or len(ids) >= FILE_DOCS:
                    yield blob()
                    number, ids, tokens, size = number + 1, [], [], 0
        if tokens:
            yield blob()

    prepare(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    tie = F.xxhash64("t")
    ranged = docs.repartitionByRange(F.col("i").asc_nulls_first(), tie).sortWithinPartitions(F.col("i").asc_nulls_first(), tie)
    ranged.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def read_token_files(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files in folder; each file is read once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")

    def documents(batches):
        for batch in batches:
            for x in batch.column(0):
                f = TokenFile(x.as_py())
                for first in range(0, f.n_docs, READ_DOCS):
                    past = min(f.n_docs, first + READ_DOCS)
                    bounds = f.bounds(first, past)
                    wide = f.ids[bounds[0] : bounds[-1]].astype("<u4")
                    crcs = [zlib.crc32(wide[a:b]) for a, b in zip(bounds - bounds[0], bounds[1:] - bounds[0])]
                    own = [pa.array([k] * (past - first), pa.int64()) for k in (f.task, f.number)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(f.doc_ids(first, past), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], names=["task", "number", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = scratch.write(files.mapInArrow(documents, "task long, number long, doc_id long, local long, n_tokens long, ids_crc32 long"), "rows")
    # ids before a task: one row for each task; ids before a file in its task: a window in the task
    manifest = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("ids"))
    before, total = [], 0
    for r in manifest.groupBy("task").agg(F.sum("ids").alias("ids")).orderBy("task").collect():
        before.append((r["task"], total))
        total += r["ids"]
    bases = manifest.withColumn("inner", F.sum("ids").over(Window.partitionBy("task").orderBy("number")) - F.col("ids"))
    bases = bases.join(spark.createDataFrame(before, "task long, before long"), "task").select("task", "number", (F.col("before") + F.col("inner")).alias("base"))
    return rows.join(bases, ["task", "number"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    folder = scratch.path("files")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_token_files(spark, folder, scratch)
