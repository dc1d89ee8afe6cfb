"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when num / den of the union of their distinct word shingles is shared. Texts of equal sets are one
class, and classes alone are compared.

Order a set by hash. Of two linked sets, the first p + l - 1 elements of each, p = n - ceil(n * num / den) + 1, share at
least the smaller l (the l-prefix bound). Each class hands out its first m = p + p // 4 + 16 elements. They meet in ranges of hashes,
where those of one class alone fall away, and each of the rest learns how many classes hold it. A class's prefix is
then lengthened by its cost: by one for each heavy element in it (held by more than HEAVY classes), and by the
logarithm of the number of candidates that its other elements bring. Its l grows as much. With l over the number of
heavy elements, a link must show in an element that isn't heavy, so the join on elements runs over those alone, and a pair is
verified only if it shares enough of them.

Classes so full of heavy elements that their m elements don't suffice (large groups of near copies) are first compared with one
pivot for each heavy element and length; what links falls into one component. Classes that share heavy elements, directly or
through others, are a family; those outside its largest component are compared with all of it, blocks of whole sets
against blocks, as products of 0/1 matrices. So every link between components is found, no pair of a family becomes a
row, and what the pivot has linked costs what it has rows.

Verification counts the whole sets' intersection. Sets aren't kept: texts are hashed again, those alone whose id is in a bitmap of
16 bits an id, 2**BITMAP_BITS (8 MB) at most; more ids than that only let more texts through. They are hashed by a second function that is
independent of the first: what the first took for equal by chance falls away. Texts are one class if 128 bits of a digest
of their sets agree, and for sets of one shingle of the words themselves.

Defined results: null, empty and blank texts have no shingles, and their own id as component; very long texts are whole, their set is
in memory once; rows without id have no component and link with nothing; repeated ids are rows of their own; an empty table gives no
rows; further columns aren't read, and one_of_each hands them on whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare, table, unused, utf8
from .shingles import Shingler, plain

WORDS, NUM, DEN = 4, 85, 100
HEAVY = 32
BITMAP_BITS, BUCKET = 26, 32_768
CHUNK_DOCS, RANGE_ELEMENTS, BLOCK_CLASSES = 4_096, 500_000, 512
#: Classes of a heavy element that one task may meet.
SALT_CLASSES = 512


def prefix(n, num: int, den: int):
    """p of a set of n (Python or numpy integers)."""
    return n - -(-n * num // den) + 1


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """docs: doc_id, text, h. doc_id, h, n, k1 and k2 (of the class) and first, the first m elements."""

    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            texts = utf8(batch.column(1))
            sets = shingler.sets(texts)
            first = [s[: min(len(s), (p := prefix(len(s), num, den)) + p // 4 + 16)].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), *class_keys(texts, sets), pa.array(first, pa.binary())], names=["doc_id", "h", "n", "k1", "k2", "first"])

    return docs.mapInArrow(run, "doc_id long, h long, n long, k1 long, k2 long, first binary")


def class_keys(texts: list[bytes], sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits of each text's set, as two columns."""
    keys = [hashlib.blake2b(s.tobytes() + (plain(t) if len(s) == 1 else b""), digest_size=16).digest() for t, s in zip(texts, sets)]
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def shared_elements(classes: DataFrame, ranges: int) -> DataFrame:
    """el, cid, n, pos and df for each of the classes' first elements that several classes hold.

    Elements travel as arrays, those of one range of hashes and up to CHUNK_DOCS classes in a row.
    """
    shift = np.uint64(64 - (ranges - 1).bit_length()) if ranges > 1 else np.uint64(63)
    wide = 1 if ranges > 1 else 0

    def deal(batches):
        cids, sizes, firsts = [], [], []

        def rows():
            counts = np.fromiter((len(f) // 8 for f in firsts), np.int64, len(firsts))
            els = np.frombuffer(b"".join(firsts), np.uint64)
            doc = np.repeat(np.arange(len(firsts)), counts)
            pos = np.arange(len(els)) - np.repeat(np.cumsum(counts) - counts, counts)
            part = (els >> shift).astype(np.int64) * wide
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange((1 << (64 - int(shift))) + 1)) if wide else np.array([0, len(els)])
            own, n = np.array(cids, np.int64), np.array(sizes, np.int64)
            out = []
            for r in np.flatnonzero(np.diff(cut)):
                at = order[cut[r] : cut[r + 1]]
                here, local = np.unique(doc[at], return_inverse=True)
                out.append((int(r), own[here].tobytes(), n[here].astype(np.uint32).tobytes(), els[at].tobytes(), local.astype(np.uint16).tobytes(), pos[at].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32())] + [pa.array([o[i] for o in out], pa.binary()) for i in range(1, 6)], names=["part", "cids", "ns", "els", "local", "pos"])

        for batch in batches:
            cids += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
            firsts += batch.column(2).to_pylist()
            if len(cids) >= CHUNK_DOCS or sum(map(len, firsts)) > 1 << 24:
                yield rows()
                cids, sizes, firsts = [], [], []
        if cids:
            yield rows()

    def meet(tables: pa.Table) -> pa.Table:
        cids, ns, els, pos = [], [], [], []
        for r in range(len(tables)):
            local = np.frombuffer(tables["local"][r].as_py(), np.uint16)
            cids.append(np.frombuffer(tables["cids"][r].as_py(), np.int64)[local])
            ns.append(np.frombuffer(tables["ns"][r].as_py(), np.uint32)[local])
            els.append(np.frombuffer(tables["els"][r].as_py(), np.uint64))
            pos.append(np.frombuffer(tables["pos"][r].as_py(), np.uint32))
        els = np.concatenate(els)
        order = np.argsort(els, kind="stable")
        els = els[order]
        new = np.concatenate([[True], els[1:] != els[:-1]])
        df = np.diff(np.append(np.flatnonzero(new), len(els)))
        df = df[np.cumsum(new) - 1]
        keep = df > 1
        at = order[keep]
        return pa.table({"el": els[keep].view(np.int64), "cid": np.concatenate(cids)[at], "n": np.concatenate(ns)[at].astype(np.int64), "pos": np.concatenate(pos)[at].astype(np.int64), "df": df[keep].astype(np.int64)})

    dealt = classes.select("cid", "n", "first").mapInArrow(deal, "part int, cids binary, ns binary, els binary, local binary, pos binary")
    return dealt.groupBy("part").applyInArrow(meet, "el long, cid long, n long, pos long, df long")


def adapted(shared: DataFrame, num: int, den: int, heavy: int) -> DataFrame:
    """The elements in each class's prefix: el, cid, n, heavy, and of the class df, need (its l), h (heavy ones), cold (others), hot (whether it takes part with heavy ones)."""
    own = Window.partitionBy("cid")
    rows = shared.withColumn("heavy", (F.col("df") > heavy).cast("int")).withColumn("p", (F.col("n") - F.expr(f"(n * {num} + {den - 1}) DIV {den}") + 1))
    rows = rows.withColumn("m", F.least("n", F.col("p") + F.expr("p DIV 4") + 16))
    rows = rows.withColumn("rest", F.col("pos") - F.sum("heavy").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("rest", F.coalesce("rest", "pos")).withColumn("all_heavy", F.sum("heavy").over(own))
    rows = rows.withColumn("spare", F.col("m") - F.col("all_heavy") - F.col("p"))
    cost = F.sum(F.when((F.col("heavy") == 0) & (F.col("rest") < F.col("p")), F.col("df") - 1).otherwise(0)).over(own)
    rows = rows.withColumn("more", F.when(F.col("spare") < 0, 0).otherwise(F.least(F.col("spare"), F.floor(F.log2(cost + 1.0)))))
    rows = rows.withColumn("dense", F.col("spare") < 0).where(F.col("dense") | (F.col("rest") < F.col("p") + F.col("more")))
    rows = rows.withColumn("h", F.sum("heavy").over(own)).withColumn("cold", F.count("*").over(own) - F.col("h"))
    rows = rows.withColumn("need", F.when(F.col("dense"), F.col("m") - F.col("p") + 1).otherwise(1 + F.col("h") + F.col("more")))
    hot = F.col("dense") | (F.col("need") >= F.least(F.col("n") * 0.7, F.col("p") * 0.2 + 16))
    return rows.select("el", "cid", "n", F.col("heavy").cast("boolean").alias("heavy"), "df", "need", "h", "cold", hot.alias("hot"))


def near_length(num: int, den: int) -> str:
    return f"least(a_n, b_n) * {den} >= greatest(a_n, b_n) * {num}"


def side(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.select("el", *(F.col(c).alias(f"{name}_{c}") for c in columns))


def cold_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    cold = rows.where("NOT heavy")
    columns = ("cid", "n", "need", "h")
    pairs = side(cold, "a", *columns).join(side(cold, "b", *columns), "el").where(f"a_cid < b_cid AND {near_length(num, den)}")
    counted = pairs.groupBy("a_cid", "b_cid").agg(F.count("*").alias("c"), *(F.first(f"{s}_{c}").alias(f"{s}_{c}") for s in "ab" for c in ("need", "h")))
    return counted.where("c + least(a_h, b_h) >= least(a_need, b_need)").select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"))


def with_pivot(rows: DataFrame, pivots: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to pivots (one row for each value of keys). Both have df, by which a heavy element's rows are dealt into salts."""
    salts = F.ceil(F.col("df") / SALT_CLASSES).cast("int")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(9)), salts).cast("int")).drop("df")
    return dealt.join(pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("df"), [*keys, "salt"])


def pivot_pairs(hot: DataFrame, num: int, den: int) -> DataFrame:
    """hot: el, cid, n, df. Each class with the first class of each of its elements in its band of lengths, and in the band below."""
    band = hot.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))))
    pivots = band.groupBy("el", "band").agg(F.min(F.struct("cid", "n")).alias("first"), F.max("df").alias("df")).select("el", "band", F.col("first.cid").alias("a_cid"), F.col("first.n").alias("a_n"), "df")
    members = band.select("el", F.explode(F.array("band", F.col("band") - 1)).alias("band"), "cid", F.col("n").alias("b_n"), "df")
    pairs = with_pivot(members, pivots, ["el", "band"]).where(f"a_cid <> cid AND {near_length(num, den)}")
    return pairs.select(F.least("a_cid", "cid").alias("a"), F.greatest("a_cid", "cid").alias("b")).distinct()


def families(hot: DataFrame, labels: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """cid, family, band, comp and left for classes that share heavy elements, directly or through others, with a class of another component.

    band: of its length; linked sets are one band apart at most. left: outside the family's largest component.
    """
    first = hot.groupBy("el").agg(F.min("cid").alias("first"), F.max("df").alias("df"))
    edges = with_pivot(hot.select("el", "cid", "df"), first, ["el"]).where("cid <> first").select(F.col("cid").alias("a"), F.col("first").alias("b")).distinct()
    family = components(edges, scratch).withColumnRenamed("label", "family")
    placed = hot.select("cid", "n").distinct().join(family, "cid").join(labels, "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")
    largest = placed.groupBy("family", "comp").count().groupBy("family").agg(F.max(F.struct("count", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1").select("family", F.col("most.comp").alias("most"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)))
    return placed.join(largest, "family").select("cid", "family", band.alias("band"), "comp", (F.col("comp") != F.col("most")).alias("left"))


def block_links(num: int, den: int):
    """Links between two blocks of sets, of those that connect components as yet apart: no more than there are sets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            a, b = ([np.frombuffer(x.as_py(), np.uint64) for x in t.column("els")] for t in (left, right))
            shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
            at = []
            for sets in (a, b):
                whole = np.concatenate(sets)
                column = np.searchsorted(shared, whole)
                column[column == len(shared)] = 0
                good = shared[column] == whole if len(shared) else np.zeros(len(whole), bool)
                at.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[good], column[good]))
            both = np.zeros((len(a), len(b)), np.float32)
            for c in range(0, len(shared), 4096):
                x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
                for (row, column), m in zip(at, (x, y)):
                    here = (column >= c) & (column < c + 4096)
                    m[row[here], column[here] - c] = 1
                both += x @ y.T
            sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
            whole = np.rint(both).astype(np.int64)
            home: dict[int, int] = {}

            def root(c: int) -> int:
                while home.get(c, c) != c:
                    c = home[c]
                return c

            ca, cb = left.column("comp").to_pylist(), right.column("comp").to_pylist()
            ia, ib = left.column("cid").to_pylist(), right.column("cid").to_pylist()
            for i, j in zip(*np.nonzero(den * whole >= num * (sizes - whole))):
                x, y = root(ca[i]), root(cb[j])
                if x != y:
                    home[x] = y
                    found.append((ia[i], ib[j]))
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    return run


def family_links(placed: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch, rows: int = BLOCK_CLASSES) -> DataFrame:
    """placed: as families gives it. sets: cid, els. Links that connect components of a family.

    Each band of a family is dealt into blocks by hash. The classes outside the largest component meet all blocks of
    the bands near their own, block against block, and no pair of them ever becomes a row.
    """
    counts = placed.groupBy("family", "band").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    dealt = placed.join(counts, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("blocks")).cast("int")).join(sets, "cid")
    lefts = placed.where("left").select("family", "band").distinct()
    outer = counts.join(lefts, ["family", "band"]).select("family", F.col("band").alias("l_band"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("l_block"))
    inner = counts.select("family", F.col("band").alias("r_band"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("r_block"))
    pairs = scratch.write(outer.join(inner, "family").where("abs(l_band - r_band) <= 1"), "blocks")
    keys = ["family", "l_band", "l_block", "r_band", "r_block"]

    def part(side: str, chosen: DataFrame) -> DataFrame:
        rows_ = chosen.select(F.col("family").alias("family"), F.col("band").alias(f"{side}_band"), F.col("block").alias(f"{side}_block"), "cid", "comp", "els")
        joined = rows_.join(pairs, ["family", f"{side}_band", f"{side}_block"])
        return joined.select(*(F.col(k).alias(k) for k in keys), *(F.col(c).alias(c) for c in ("cid", "comp", "els")))

    return part("l", dealt.where("left")).groupBy(keys).cogroup(part("r", dealt).groupBy(keys)).applyInArrow(block_links(num, den), "a long, b long")


def bits_for(rows: DataFrame) -> int:
    """Bits of a bitmap of so many rows: 16 for each, in whole buckets, 2**BITMAP_BITS at most. The driver holds no more than the rows ask for."""
    return min(1 << BITMAP_BITS, max(BUCKET, 1 << (16 * rows.count() - 1).bit_length()))


def bit_of(doc_id: str, size: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(size))


def bitmap(ids: DataFrame, size: int) -> bytes:
    """ids: doc_id. The bit of each id set: size / 8 bytes."""
    # the functions count bits from 1
    bit = bit_of("doc_id", size) + 1
    parts = ids.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in parts:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def whole_sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """wanted: cid, distinct. cid and els, all elements of its set by the second hash, sorted."""
    spark = docs.sparkSession
    wanted = scratch.write(classes.select("cid", "k1", "k2", "min_id").join(wanted, "cid"), "wanted")
    size = bits_for(wanted)
    bits = spark.sparkContext.broadcast(bitmap(wanted.select(F.col("min_id").alias("doc_id")), size))

    def sets(batches):
        first, second = Shingler(k), Shingler(k, seed=1)
        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            bit = batch.column(1).to_numpy()
            texts = [t for t, b in zip(utf8(batch.column(0)), (known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1) if b and t.strip()]
            if texts:
                yield pa.RecordBatch.from_arrays([*class_keys(texts, first.sets(texts)), pa.array([s.tobytes() for s in second.sets(texts)], pa.binary())], names=["k1", "k2", "els"])

    hashed = docs.where("doc_id IS NOT NULL").select("text", bit_of("doc_id", size).alias("bit")).mapInArrow(sets, "k1 long, k2 long, els binary").dropDuplicates(["k1", "k2"])
    return hashed.join(wanted.select("k1", "k2", "cid"), ["k1", "k2"]).select("cid", "els")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """pairs: a, b. Those that link, by their whole sets."""
    hashed = whole_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), classes, k, scratch)

    def count(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both * den >= num * (len(x) + len(y) - both):
                    rows.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

    both = pairs.join(hashed.select(F.col("cid").alias("b"), F.col("els").alias("b_els")), "b").join(hashed.select(F.col("cid").alias("a"), F.col("els").alias("a_els")), "a")
    return both.select("a", "b", "a_els", "b_els").mapInArrow(count, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """cid and label, the least cid of its component, for all that have a link: least labels of neighbours, then labels of labels, until nothing changes."""
    edges = scratch.write(links.union(links.select("b", "a")).distinct().toDF("cid", "other"), "edges")
    labels = scratch.write(edges.groupBy("cid").agg(F.least(F.col("cid"), F.min("other")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("cid").alias("other"), "label"), "other").groupBy("cid").agg(F.min("label").alias("near"))
        step = labels.join(near, "cid").select("cid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("cid").alias("label"), F.col("label").alias("further"))
        new = scratch.write(step.join(jump, "label").select("cid", "old", F.least("label", "further").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not changed:
            scratch.drop(edges)
            return labels.select("cid", "label")
        labels = new.drop("old")
        scratch.paths[id(labels)] = labels, scratch.paths.pop(id(new))[1]


def linked(docs: DataFrame, scratch: Scratch, k: int = WORDS, num: int = NUM, den: int = DEN, heavy: int = HEAVY, range_elements: int = RANGE_ELEMENTS) -> DataFrame:
    """docs: doc_id (long), text, h. doc_id, h, n_shingles, component_id and component of every row.

    component tells components apart, also where their least ids are equal; it is null where a row can't link.
    """
    prepare(docs.sparkSession)
    signed = scratch.write(signatures(docs, k, num, den).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("min_id"), F.max("n").alias("n"), F.min("row").alias("row"))
    # numbers of rows and classes are fixed by the tables that they are written to
    known = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    firsts = scratch.write(known.select("cid", "n", "row").join(signed.select("row", "first"), "row").drop("row"), "firsts")
    narrow = scratch.write(signed.select("doc_id", "h", "n", "k1", "k2"), "rows")
    scratch.drop(signed)
    elements = firsts.agg(F.sum(F.octet_length("first"))).first()[0] or 0
    rows = scratch.write(adapted(shared_elements(firsts, max(1, -(-(elements // 8) // range_elements))), num, den, heavy), "prefixes")
    scratch.drop(firsts)
    hot = scratch.write(rows.where("heavy AND hot").select("el", "cid", "n", "df"), "hot")
    pairs = scratch.write(cold_pairs(rows, num, den).union(pivot_pairs(hot, num, den)).distinct(), "pairs")
    scratch.drop(rows)
    links = scratch.write(verified(docs, pairs, known, k, num, den, scratch), "links")
    scratch.drop(pairs)
    labels = components(links, scratch)
    apart = scratch.write(families(hot, labels, num, den, scratch), "families")
    scratch.drop(hot)
    if apart.limit(1).count():
        more = family_links(apart, whole_sets(docs, apart.select("cid").distinct(), known, k, scratch), num, den, scratch)
        labels = components(links.union(more), scratch)
    scratch.drop(links, apart)
    least = labels.join(known.select("cid", "min_id"), "cid").groupBy("label").agg(F.min("min_id").alias("least"))
    least = labels.join(least, "label").select("cid", "label", "least")
    homes = known.select("cid", "min_id", "k1", "k2").join(least, "cid", "left").select("k1", "k2", F.coalesce("least", "min_id").alias("home"), F.coalesce("label", "cid").alias("component"))
    joined = narrow.join(homes, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("home"))
    return joined.select("doc_id", "h", F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).alias("component"))


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))


def join_components(df: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, heavy: int = HEAVY, doc_id: str = "doc_id", text: str = "text", range_elements: int = RANGE_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    scratch = Scratch(df.sparkSession, "ngram")
    return linked(keyed(df, doc_id, text), scratch, k, num, den, heavy, range_elements).select("doc_id", "n_shingles", "component_id")


def without(df: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """df without the rows whose keys are a row of gone. Only rows whose bit is set in a bitmap of gone (8 MB at most) are shuffled; the others pass."""
    ours, (bucket, bits, maybe), size = gone.columns, unused(df, "bucket", "bits", "maybe"), bits_for(gone)
    bit = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(size)) + 1
    marked = bit([F.col(c) for c in ours])
    bitmap_ = gone.groupBy(F.bitmap_bucket_number(marked).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(marked)).alias(bits))
    place = F.bitmap_bit_position(bit(keys))
    byte = F.conv(F.hex(F.substr(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    looked = df.join(F.broadcast(bitmap_), F.bitmap_bucket_number(bit(keys)) == F.col(bucket), "left").withColumn(maybe, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    same = reduce(lambda a, b: a & b, (k == F.col(c) for k, c in zip(keys, ours)))
    asked = looked.where(maybe).select(*df.columns).join(gone, same, "left_anti")
    return looked.where(~F.col(maybe)).select(*df.columns).unionByName(asked)


def one_of_each(df: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df but those of a component that aren't its first by id (and text, where an id repeats). Rows that can't link stay."""
    scratch, row = Scratch(df.sparkSession, "ngram"), ["doc_id", "h"]
    found = scratch.write(linked(keyed(df, doc_id, text), scratch, k, num, den).where("component IS NOT NULL").select("component", *row), "components")
    # rows are known by id and text, never by their place in a scan
    first = found.groupBy("component").agg(F.min(F.struct(*row)).alias("first")).select("component", *(F.col(f"first.{c}").alias(c) for c in row))
    gone = found.join(first, ["component", *row], "left_anti").select(*row).distinct()
    gone_id, gone_h, one_h = unused(df, "gone_id", "gone_h", "one_h")
    gone = scratch.write(gone.toDF(gone_id, gone_h), "gone")
    again = scratch.write(found.groupBy(*row).count().where("count > 1").select(*row).toDF(gone_id, gone_h).join(gone, [gone_id, gone_h], "left_anti"), "again")
    scratch.drop(found)
    same = (F.col(doc_id) == F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_h))
    kept = without(df, gone, [F.col(doc_id).cast("long"), F.xxhash64(text)])
    if not again.limit(1).count():
        return kept
    once = kept.join(again, same, "left_semi").withColumn(one_h, F.xxhash64(text)).dropDuplicates([doc_id, one_h]).drop(one_h)
    return kept.join(again, same, "left_anti").unionByName(once)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), u AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
g AS (
  SELECT r, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS gram
  FROM u WINDOW o AS (PARTITION BY r ORDER BY i)
), s AS (
  SELECT DISTINCT r, gram FROM g WHERE gram IS NOT NULL
  UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS both FROM s a JOIN s b ON a.gram = b.gram AND a.r <> b.r GROUP BY a.r, b.r),
e AS (
  SELECT i.a, i.b FROM i JOIN n x ON x.r = i.a JOIN n y ON y.r = i.b JOIN d p ON p.r = i.a JOIN d q ON q.r = i.b
  WHERE 100 * i.both >= 85 * (x.n + y.n - i.both) AND p.doc_id IS NOT NULL AND q.doc_id IS NOT NULL
), reach(r, o) AS (
  SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.o
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r)
LEFT JOIN (SELECT reach.r, min(x.doc_id) AS component_id FROM reach JOIN d x ON x.r = reach.o GROUP BY reach.r) c USING (r)
"""
