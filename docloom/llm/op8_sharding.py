"""Sharding by a minimax contiguous partition.

Groups of equal texts are atomic, and stand in the order of a 64 bit hash of the text. The smallest capacity with
which the groups, cut greedily, fit in the shards is found by binary search; then the groups are cut, each cut as
near to an equal share as that capacity allows.

The groups' sizes stay distributed. The driver sees sums over ranges of hashes: RANGES at first, and then, for
those ranges alone in which a cut can fall, sums over ever finer ranges, down to single groups. A range in which
no cut can fall counts as atomic without loss, so the capacity is the one of the groups themselves.

Law 'bytes' holds. Defined results: a null text is the empty one (its crc32 is 0, its size the 8 bytes of each
row); a null id stays null; repeated rows are rows of one group; with fewer groups than shards some shards
stay empty; an empty table gives no rows; a very long text is one row, and may fill a shard by itself; further columns
aren't read. Texts of equal hash count as one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SHARDS = 24
ROW_BYTES = 8
#: Bits of the hash in the first ranges, and how many more each finer look takes.
BITS, MORE_BITS = 14, 8
#: Rows of a shard are numbered in so many parts.
PARTS = 256


class Ranges:
    """Ranges of hashes in order: first hash, bytes, groups and largest group of each."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        rows = sorted(rows)
        self.first = [r[0] for r in rows]
        self.size = np.array([r[1] for r in rows], dtype=object)
        self.groups = np.array([r[2] for r in rows], np.int64)
        self.largest = max((r[3] for r in rows), default=0)
        self.ends = np.cumsum(np.array([r[1] for r in rows], np.int64))
        self.starts = self.ends - self.size.astype(np.int64) if rows else self.ends
        self.total = int(self.ends[-1]) if rows else 0

    def cuts(self, capacity: int, shards: int, fluid: bool) -> list[int]:
        """Where the greedy cuts fall, in bytes. fluid: ranges of several groups can be cut anywhere."""
        out, at = [], 0
        for _ in range(shards):
            if at >= self.total:
                break
            i = int(np.searchsorted(self.ends, at + capacity, side="right"))
            if i == len(self.ends):
                at = self.total
            elif fluid and self.groups[i] > 1:
                at += capacity
            else:
                at = int(self.starts[i]) if self.starts[i] > at else at
            out.append(at)
        return out

    def smallest(self, shards: int, fluid: bool) -> int:
        low = max(-(-self.total // shards), self.largest if fluid else int(max(self.size, default=0)))
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            cuts = self.cuts(middle, shards, fluid)
            if not self.total or cuts and cuts[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open(self, shards: int) -> list[int]:
        """Ranges of several groups in which a cut of the best partition of the groups can fall."""
        low, high = self.smallest(shards, True), self.smallest(shards, False)
        if not self.total:
            return []
        windows = list(zip(self.cuts(low, shards, False), self.cuts(high, shards, True)))
        windows += [(self.total * s // shards,) * 2 for s in range(1, shards)]
        inside = np.zeros(len(self.ends), bool)
        for a, b in windows:
            inside |= (self.ends > min(a, b)) & (self.starts < max(a, b) + 1)
        return np.flatnonzero(inside & (self.groups > 1)).tolist()


def balanced(ranges: Ranges, shards: int, capacity: int) -> list[int]:
    """First range of each shard but the first: as near to equal shares as shards of that capacity can be."""
    edges = np.concatenate([[0], ranges.ends]).astype(np.int64)
    least, at = [], ranges.total  # from the end: where each shard must have begun at the latest
    for _ in range(shards - 1):
        at = int(edges[np.searchsorted(edges, at - capacity, side="left")])
        least.append(at)
    out, start = [], 0
    for s, need in zip(range(1, shards), reversed(least)):
        low = int(np.searchsorted(edges, max(need, start), side="left"))
        high = int(np.searchsorted(edges, start + capacity, side="right")) - 1
        ideal = ranges.total * s // shards
        near = int(np.searchsorted(edges, ideal, side="left"))
        near = min((j for j in (near - 1, near) if 0 <= j < len(edges)), key=lambda j: (abs(int(edges[j]) - ideal), j))
        cut = min(max(near, low), max(low, high))
        out.append(cut)
        start = int(edges[cut])
    return out


def cut_hashes(groups: DataFrame, shards: int, bits: int = BITS, more_bits: int = MORE_BITS) -> tuple[list[int], int]:
    """groups: h, size. First hash of each shard but the first (the largest long behind the last group), and the capacity."""

    def sums(df: DataFrame, b: int) -> list[tuple[int, int, int, int]]:
        part = F.shiftright("h", 64 - b) if b < 64 else F.col("h")
        rows = df.groupBy(part.alias("part")).agg(F.min("h").alias("first"), F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most"))
        return [(r["first"], r["size"], r["n"], r["most"]) for r in rows.collect()]

    known = [(r, bits) for r in sums(groups, bits)]
    while True:
        known.sort()
        ranges = Ranges([r for r, _ in known])
        todo = set(ranges.open(shards))
        if not todo:
            break
        kept = [x for i, x in enumerate(known) if i not in todo]
        for b in sorted({known[i][1] for i in todo}):
            prefixes = [known[i][0][0] >> (64 - b) for i in todo if known[i][1] == b]
            finer = min(64, b + more_bits)
            kept += [(r, finer) for r in sums(groups.where(F.shiftright("h", 64 - b).isin(prefixes)), finer)]
        known = kept
    capacity = ranges.smallest(shards, False)
    cuts = [ranges.first[i] if i < len(ranges.first) else 2**63 - 1 for i in balanced(ranges, shards, capacity)]
    return cuts, capacity


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shard_of(h: Column, cuts: list[int]) -> Column:
    """How many cuts stand at or before the hash."""
    return sum((F.when(h >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def shard(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), text_hash(text).alias("h"))
    scratch = Scratch(df.sparkSession, "sharding")
    rows = scratch.write(rows, "sizes")
    groups = scratch.write(rows.groupBy("h").agg(F.sum("size").alias("size")), "groups")
    cuts, _ = cut_hashes(groups, shards)
    scratch.drop(groups)
    dealt = rows.withColumn("shard", shard_of(F.col("h"), cuts)).withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)).cast("int"))
    # slots: rows before a part (shards x parts counts), then a number within the part
    counts = dealt.groupBy("shard", "part").count().orderBy("shard", "part").collect()
    before, base = {}, []
    for r in counts:
        base.append((r["shard"], r["part"], before.get(r["shard"], 0)))
        before[r["shard"]] = before.get(r["shard"], 0) + r["count"]
    bases = df.sparkSession.createDataFrame(base, "shard int, part int, base long")
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "h"))
    numbered = dealt.withColumn("number", number).join(F.broadcast(bases), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
