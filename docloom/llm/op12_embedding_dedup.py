"""Near duplicates of embeddings: product quantisation behind inverted lists, exact cosines at the end.

Only vectors of the same label (and length) are compared, as unit vectors x; a cosine of t is a distance of
reach = sqrt(2 - 2 t).

* Exact copies are one class with its number of rows: a vector that many rows share is one row in all that follows.
* Coarse lists: centroids of each label by k-means over a sample (SAMPLE rows of all at most, as expected), one for LIST
  classes, LISTS of all at most. Every class is a member of its nearest list.
* Probes: a class also visits each list whose border with its own is within PROBE of it. Two vectors in reach lie on both
  sides of a border with distances that add up to reach at most, and the nearer one visits: with PROBE = reach / 2 no pair
  is ever missed. Vectors in reach rarely lie straight across a border, and 0.1 (reach / 2 is 0.187) missed none of the
  139,978 pairs of one label of 5,681 vectors with 16 to 256 lists, at less than half of the visits; tests measure recall.
* Residuals (x less its centroid) are coded by SPLITS subspaces of CODES words each, fitted on a sample of CODED classes.
  A visitor's table of distances to the words gives its distance to each coded member by look-ups. What that falls short is
  at most the member's own coding error, which is stored: a pair is passed over only if it can't be in reach.
* Cosines of the pairs left are computed in double precision.

Lists are compared in cells of CELL members by CELL visitors (or an 8192th of all classes, where that is more), so that no
task depends on how large a list is; pairs never become rows: a cell returns for each class its number of links, and the
least class that it reaches within the cell. Work within a list grows with the square of its members, as there may be so
many links. Classes meet their rows in a join by hash; the at most 1,024 classes of more than a 1,024th of all rows are
broadcast instead.

Null, zero and non-finite vectors, null labels and null ids link with nothing (a null id: component and kept null).
Rows that repeat an id are vectors of their own. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, prepare, table
from .op5_ngram_join import components

#: Least cosine of a link; how near a border makes a visit.
COSINE, PROBE = 0.93, 0.1
#: Classes a list, lists of all labels, rows of the sample that they are fitted on.
LIST, LISTS, SAMPLE = 24, 4_096, 65_536
#: Subspaces, words of each, and classes that the words are fitted on.
SPLITS, CODES, CODED = 16, 256, 4_096
CELL, HEAVY = 256, 1_024
ROUNDS, SLACK = 8, 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def means(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of the rows of x (fewer, if there are fewer rows), the same for the same rows in the same order."""
    c = x[np.random.default_rng(0).permutation(len(x))[:k]].astype(np.float64)
    for _ in range(ROUNDS):
        own = np.concatenate([(x[i : i + 4096] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        c[own[order[first]]] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return c


class Index:
    """Centroids by (label, length) and words by length. A label without centroids has one list around 0."""

    def __init__(self, lists: dict[tuple[int, int], np.ndarray], probe: float):
        self.lists, self.probe, self.words = lists, probe, {}
        self.apart = {g: np.sqrt(np.maximum(((c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * c @ c.T), 1e-18)) for g, c in lists.items()}

    def placed(self, group: tuple[int, int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors: their own list, and whether they visit each list."""
        c = self.lists.get(group)
        if c is None:
            return np.zeros(len(x), np.int64), np.zeros((len(x), 1), bool)
        d = (c * c).sum(axis=1) - 2 * x @ c.T
        own = d.argmin(axis=1)
        rows = np.arange(len(x))
        visits = d - d[rows, own][:, None] <= 2 * self.probe * self.apart[group][own]
        visits[rows, own] = False
        return own, visits

    def residuals(self, group: tuple[int, int], x: np.ndarray, own: np.ndarray) -> np.ndarray:
        c = self.lists.get(group)
        return x if c is None else x - c[own]

    def fit_words(self, samples: dict[int, np.ndarray]) -> None:
        for n, x in samples.items():
            self.words[n] = [means(x[:, part], CODES) for part in self.parts(n)]

    @staticmethod
    def parts(n: int) -> list[slice]:
        edges = np.linspace(0, n, min(SPLITS, n) + 1).astype(int)
        return [slice(a, b) for a, b in zip(edges, edges[1:])]

    def words_of(self, n: int) -> list[np.ndarray]:
        """A length without a sample has one word, 0: its members' errors are their lengths."""
        return self.words.get(n) or [np.zeros((1, p.stop - p.start)) for p in self.parts(n)]

    def coded(self, n: int, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each is from what they say."""
        codes, left = [], np.zeros(len(r))
        for part, w in zip(self.parts(n), self.words_of(n)):
            d = (w * w).sum(axis=1) - 2 * r[:, part] @ w.T
            code = d.argmin(axis=1)
            codes.append(code)
            left += ((r[:, part] - w[code]) ** 2).sum(axis=1)
        return np.array(codes, np.uint8).T, np.sqrt(left)

    def near(self, n: int, r: np.ndarray, codes: np.ndarray, errors: np.ndarray, reach: float) -> np.ndarray:
        """Visitors' residuals x members: whether the coded distance allows a pair in reach."""
        total = np.zeros((len(r), len(codes)), np.float32)
        for m, (part, w) in enumerate(zip(self.parts(n), self.words_of(n))):
            y = r[:, part]
            tables = (y * y).sum(axis=1)[:, None] + (w * w).sum(axis=1) - 2 * y @ w.T
            total += np.take(tables.astype(np.float32), codes[:, m], axis=1)
        return total <= (reach + errors + SLACK).astype(np.float32) ** 2 * np.float32(1 + 1e-5) + np.float32(1e-5)


def matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), n)


def groups_of(batch: pa.RecordBatch):
    """Of a batch with label and dim: each (label, dim) with its row numbers."""
    label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
    order = np.lexsort((dim, label))
    if len(order):
        cut = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(dim[order]) != 0)) + 1
        for rows in np.split(order, cut):
            yield (int(label[rows[0]]), int(dim[rows[0]])), rows


def fitted(classes: DataFrame, n: int, probe: float, lists: int, per_list: int) -> Index:
    """n: number of classes. What comes to the driver: centroids (lists at most) and CODED classes."""
    share = F.least(F.floor(F.col("count") / per_list), F.greatest(F.lit(1), F.floor(F.col("count") * lists / n))).cast("int")
    sizes = F.broadcast(classes.groupBy("label", "dim").count().select("label", "dim", share.alias("k")).where("k > 1"))
    place = F.pmod(F.xxhash64("cid", F.lit("sample")), F.lit(1 << 30))
    sample = classes.where(place < int((1 << 30) * min(1.0, SAMPLE / max(1, n)))).join(sizes, ["label", "dim"]).select("label", "dim", "k", "cid", "embedding")

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cid")
        label, dim, k = (rows.column(c)[0].as_py() for c in ("label", "dim", "k"))
        c = means(unit(matrix(rows.column("embedding").combine_chunks(), dim)), k)
        return pa.table({"label": pa.array([label], pa.int64()), "dim": pa.array([dim], pa.int32()), "centroids": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})

    found = sample.groupBy("label", "dim").applyInArrow(fit, "label long, dim int, centroids array<double>").collect()
    index = Index({(r.label, r.dim): np.array(r.centroids).reshape(-1, r.dim) for r in found}, probe)
    residuals: dict[int, list[np.ndarray]] = {}
    coded = classes.where(place < int((1 << 30) * min(1.0, CODED / max(1, n)))).select("label", "dim", "cid", "embedding").orderBy("cid").toArrow()
    for group, rows in groups_of(coded.combine_chunks().to_batches()[0]) if coded.num_rows else ():
        x = unit(matrix(coded.column("embedding").combine_chunks().take(pa.array(rows)), group[1]))
        residuals.setdefault(group[1], []).append(index.residuals(group, x, index.placed(group, x)[0]))
    index.fit_words({n: np.concatenate(xs) for n, xs in residuals.items()})
    return index


def indexed(classes: DataFrame, index: Index) -> DataFrame:
    """classes with list (their own), visits, codes and error."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            own, error, codes, visits = np.zeros(n, np.int32), np.zeros(n), [b""] * n, [[]] * n
            for group, rows in groups_of(batch):
                x = unit(matrix(batch.column("embedding").take(pa.array(rows)), group[1]))
                mine, near = shared.value.placed(group, x)
                own[rows] = mine
                code, error[rows] = shared.value.coded(group[1], shared.value.residuals(group, x, mine))
                for row, c, v in zip(rows.tolist(), code, near):
                    codes[row], visits[row] = c.tobytes(), np.flatnonzero(v).tolist()
            new = [pa.array(own), pa.array(visits, pa.list_(pa.int32())), pa.array(codes, pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "list", "visits", "codes", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{kinds}, list int, visits array<int>, codes binary, error double")


def least_reached(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """links: rows a x rows b. Of each row the least number that it is connected with inside."""
    x, y = a.copy(), b.copy()
    big = np.iinfo(np.int64).max
    while True:
        p = np.minimum(x, np.where(links, y, big).min(axis=1, initial=big))
        q = np.minimum(y, np.where(links, p[:, None], big).min(axis=0, initial=big))
        p = np.minimum(p, np.where(links, q, big).min(axis=1, initial=big))
        if (p == x).all() and (q == y).all():
            return x, y
        x, y = p, q


def cell_links(index: Index, rows: pa.Table, cosine: float) -> pa.Table:
    """One cell: members and visitors of a list. cid, n (rows that it links with), home (a class that it is connected with)."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    label, dim, at = (rows.column(c)[0].as_py() for c in ("label", "dim", "at"))
    member = rows.column("member").to_numpy()
    x = unit(matrix(rows.column("embedding").combine_chunks(), dim))
    cid, mult, own = (rows.column(c).to_numpy() for c in ("cid", "mult", "list"))
    visits = rows.column("visits").to_pylist()
    ms, vs = np.flatnonzero(member), np.flatnonzero(~member)
    count, homes = np.zeros(len(cid), np.int64), []
    codes = np.frombuffer(b"".join(c for c in rows.column("codes").to_pylist() if c), np.uint8).reshape(len(ms), -1) if len(ms) else np.zeros((0, 1), np.uint8)
    error = rows.column("error").to_numpy()
    lists = np.unique(own[vs])
    for i in range(0, len(ms), CELL):
        m = ms[i : i + CELL]
        # a pair whose members visit each other's lists is met in both: it counts in the lesser list
        back = np.array([np.isin(lists, visits[r]) for r in m]).reshape(len(m), len(lists))
        for j in range(0, len(vs), CELL):
            v = vs[j : j + CELL]
            maybe = index.near(dim, index.residuals((label, dim), x[v], np.full(len(v), at)), codes[i : i + CELL], error[m], reach)
            same = own[v] == at
            maybe &= np.where(same[:, None], cid[v][:, None] > cid[m], ~(back[:, np.searchsorted(lists, own[v])].T & (own[v] < at)[:, None]))
            r, c = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            if not len(r):
                continue
            links = maybe[np.ix_(r, c)] & (x[v[r]] @ x[m[c]].T >= cosine)
            count[v[r]] += links @ mult[m[c]]
            count[m[c]] += links.T @ mult[v[r]]
            for who, least in zip((v[r], m[c]), least_reached(links, cid[v[r]], cid[m[c]])):
                other = least != cid[who]
                homes.append(np.stack([cid[who][other], least[other]]))
    seen = np.flatnonzero(count)
    pairs = np.concatenate(homes, axis=1) if homes else np.zeros((2, 0), np.int64)
    nothing = lambda k: pa.nulls(k, pa.int64())
    return pa.table({"cid": pa.concat_arrays([pa.array(cid[seen]), pa.array(pairs[0])]), "n": pa.concat_arrays([pa.array(count[seen]), nothing(pairs.shape[1])]), "home": pa.concat_arrays([nothing(len(seen)), pa.array(pairs[1])])})


def cells(placed: DataFrame, n: int, cell: int) -> DataFrame:
    """Members and visitors of each list, dealt to its cells: place (a, b) has the members of part a and the visitors of part b."""
    most = max(cell, n // 8192)
    every = placed.select("label", "dim", F.explode(F.concat(F.array("list"), "visits")).alias("at"), F.col("list"))
    # at most 8,192 lists by members, and as many as visits make of that
    wide = every.groupBy("label", "dim", "at").agg(F.count("*").alias("v"), F.count_if(F.col("at") == F.col("list")).alias("m")).where(F.col("v") > most)
    parts = F.broadcast(wide.select("label", "dim", "at", F.ceil(F.col("m") / most).cast("int").alias("ma"), F.ceil(F.col("v") / most).cast("int").alias("vb")))
    one = lambda c: F.coalesce(c, F.lit(1))
    key, named = F.xxhash64("cid"), ["label", "dim", "at"]
    members = placed.withColumn("at", F.col("list")).join(parts, named, "left").withColumns({"a": F.pmod(key, one("ma")).cast("int"), "b": F.explode(F.sequence(F.lit(0), one("vb") - 1)), "member": F.lit(True)})
    guests = placed.withColumn("at", F.explode(F.concat(F.array("list"), "visits"))).join(parts, named, "left").withColumns({"b": F.pmod(key, one("vb")).cast("int"), "a": F.explode(F.sequence(F.lit(0), F.greatest(one("ma"), F.lit(1)) - 1)), "member": F.lit(False)})
    wanted = [*named, "a", "b", "member", "cid", "mult", "list", "visits", "codes", "error", "embedding"]
    return members.select(wanted).unionByName(guests.select(wanted)).withColumn("codes", F.when(F.col("member"), F.col("codes")))


def links_of(df: DataFrame, cosine: float = COSINE, probe: float | None = PROBE, cell: int = CELL, lists: int = LISTS, per_list: int = LIST) -> DataFrame:
    """df: vec_id long, embedding (array of numbers), label. vec_id, n_links, component_id, kept of every row. probe None: no pair is missed."""
    prepare(df.sparkSession)
    scratch = Scratch(df.sparkSession, "dedup")
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    hashes = [F.xxhash64("label", x).alias("h1"), F.xxhash64(x, F.lit("second"), "label").alias("h2")]
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding"))
    known = rows.where(fine).select("vec_id", "label", "embedding", *hashes)
    found = known.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("mult"), F.min("vec_id").alias("least"))
    # numbers of classes are fixed by the table that they are written to
    classes = scratch.write(found.withColumns({"dim": F.size("embedding"), "cid": F.monotonically_increasing_id()}), "classes")
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("mult"), F.lit(0))).first()
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    index = fitted(classes, n, reach / 2 if probe is None else probe, lists, per_list)
    placed = scratch.write(indexed(classes.select("cid", "label", "dim", "embedding", "mult"), index), "placed")
    shared = df.sparkSession.sparkContext.broadcast(index)
    pairs = cells(placed, n, cell).groupBy("label", "dim", "at", "a", "b").applyInArrow(lambda t: cell_links(shared.value, t, cosine), "cid long, n long, home long")
    met = scratch.write(pairs, "links")
    scratch.drop(placed)
    counts = met.where("n IS NOT NULL").groupBy("cid").agg(F.sum("n").alias("n"))
    labels = components(met.where("home IS NOT NULL").select(F.col("cid").alias("a"), F.col("home").alias("b")), scratch)
    heads = labels.join(classes.select("cid", "least"), "cid")
    heads = heads.select("cid", "label").join(heads.groupBy("label").agg(F.min("least").alias("head")), "label").drop("label")
    own = classes.select("cid", "h1", "h2", "mult", "least").join(counts, "cid", "left").join(heads, "cid", "left")
    homes = scratch.write(own.select("h1", "h2", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("head", "least").alias("component_id")), "homes")
    scratch.drop(met)
    asked = rows.select("vec_id", *(F.when(fine, h).alias(name) for h, name in zip(hashes, ("h1", "h2"))))
    # a class of more than a 1,024th of all rows is one of 1,024 at most
    heavy = F.col("mult") * HEAVY > int(total)
    few = F.broadcast(homes.where(heavy).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("n_links").alias("fn"), F.col("component_id").alias("fc")))
    marked = asked.join(few, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    done = marked.where("fn IS NOT NULL").select("vec_id", F.col("fn").alias("n_links"), F.col("fc").alias("component_id"))
    rest = marked.where("fn IS NULL").select("vec_id", "h1", "h2")
    alone = rest.where("h1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    others = rest.where("h1 IS NOT NULL").join(homes.where(~heavy), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return done.unionByName(alone).unionByName(others).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_of(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), u AS (
  SELECT r, vec_id, label, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS s FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0
), e AS (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r AND a.s > 0 AND b.s > 0
  WHERE list_dot_product(a.x, b.x) / (a.s * b.s) >= 0.93
), reach(r, o) AS (SELECT r, r FROM v UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.o),
c AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.o GROUP BY reach.r)
SELECT v.vec_id, CAST(count(e.b) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN e ON e.a = v.r GROUP BY v.r, v.vec_id, c.component_id
"""
