"""The versioned store: both tables change together, once, or not at all."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import registry
from docloom.sources import shared
from docloom.sources import store as st

CHUNK, FILE = "file_hash string, chunk_id string, text string", "file_hash string, original_path string, stored_path string, file_name string, status string, chunks_count long, error_message string, updated_at string, reindex_count long"


def hashed(i):
    return f"{i:02x}" + "0" * 62


@pytest.fixture
def store(spark):
    files = spark.createDataFrame([(hashed(i), f"/in/{i}" if i != 3 else "", "/up/3" if i == 3 else None, f"f{i}", "completed", 2, "", "d1", 0) for i in range(6)], FILE)
    chunks = spark.createDataFrame([(hashed(i), f"{i}_{j}", f"text {i} {j}") for i in range(6) for j in range(2)], CHUNK)
    out = st.Store(spark, shared.fresh(spark, "store"), {st.CHUNKS: chunks.schema, st.REGISTRY: files.schema}, splits=1)
    assert out.read(st.CHUNKS).count() == 0 and out.put("a", chunks, files) == 1
    return out


def told(store, version=None):
    return sorted((r.file_hash[:2], r.status, r.chunks_count, r.reindex_count) for r in store.read(st.REGISTRY, version).collect()), sorted(r.chunk_id for r in store.read(st.CHUNKS, version).collect())


def plan(spark, store, ids, present):
    asked = spark.createDataFrame([(i,) for i in ids], "identifier string")
    return registry.reindexed(asked, store.read(st.REGISTRY), spark.createDataFrame(present, "path string, content_hash string"))


def words_as_chunks(texts):
    return texts.select("file_hash", F.posexplode(F.split("text", " ")).alias("n", "text")).select("file_hash", F.concat_ws("_", F.substring("file_hash", 1, 2), "n").alias("chunk_id"), "text")


def test_reindex_shows_at_once_and_once(spark, store):
    asked = plan(spark, store, [hashed(1), "f3", hashed(4), "nobody", hashed(9)], [("/in/1", hashed(1)), ("/up/3", hashed(3))])
    assert sorted((r.identifier[:2], r.status) for r in asked.collect()) == [("01", "pending"), ("04", "failed"), ("09", "failed"), ("f3", "pending"), ("no", "failed")]
    texts = spark.createDataFrame([(hashed(1), "a b c"), (hashed(4), "x")], "file_hash string, text string")
    before = told(store)
    assert store.reindex("r", asked, texts, words_as_chunks, F.lit("d2")) == 2 == store.reindex("r", asked, texts, words_as_chunks, F.lit("d3"))
    files, chunks = told(store)
    assert files == [("00", "completed", 2, 0), ("01", "completed", 3, 1), ("02", "completed", 2, 0), ("03", "failed", 0, 1), ("04", "completed", 2, 0), ("05", "completed", 2, 0)]
    assert chunks == ["01_0", "01_1", "01_2", "0_0", "0_1", "2_0", "2_1", "4_0", "4_1", "5_0", "5_1"]
    assert told(store, 1) == before


def test_a_crash_leaves_the_old_version(spark, store, monkeypatch):
    before = told(store)

    def crash(_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_publish", crash)
    with pytest.raises(RuntimeError):
        store.delete("gone", spark.createDataFrame([(hashed(0),)], "file_hash string"), F.lit("d2"))
    monkeypatch.undo()
    assert told(store) == before and store.latest() == 1
    assert store.delete("gone", spark.createDataFrame([(hashed(0),)], "file_hash string"), F.lit("d2")) == 2
    files, chunks = told(store)
    assert files[0] == ("00", "deleted", 0, 0) and "0_0" not in chunks and len(chunks) == 10
    assert store.vacuum(1) > 0 and told(store) == (files, chunks)


def test_two_changes_at_once(spark, store, monkeypatch):
    other, publish, first = store.__class__(spark, store.path, store.schemas, splits=1), store._publish, []

    def late(manifest):
        if not first:
            first.append(1)
            other.delete("other", spark.createDataFrame([(hashed(5),)], "file_hash string"), F.lit("d2"))
        publish(manifest)

    monkeypatch.setattr(store, "_publish", late)
    assert store.delete("mine", spark.createDataFrame([(hashed(2),), (hashed(5),)], "file_hash string"), F.lit("d3")) == 3
    files, chunks = told(store)
    assert [f[1] for f in files] == ["completed", "completed", "deleted", "completed", "completed", "deleted"] and len(chunks) == 8


def test_untouched_buckets_stay_where_they_are(spark, store):
    store.delete("one", spark.createDataFrame([(hashed(2),)], "file_hash string"), F.lit("d2"))
    old, new = store.manifest(1)[st.CHUNKS], store.manifest(2)[st.CHUNKS]
    assert "2" not in new and {b: f for b, f in old.items() if b != "2"} == new


def test_paths_of_files(spark):
    rows = spark.createDataFrame([("a", "/in/a", "/up/a", "completed"), ("b", "", "/up/b", "completed"), ("c", None, "", "failed"), ("d", "/in/d", "/up/d", "completed"), ("e", "/in/e", "/up/e", "pending")], "file_hash string, original_path string, stored_path string, status string").withColumn("updated_at", F.lit("x"))
    there = spark.createDataFrame([("/in/a",), ("/up/b",), ("/up/d",)], "path string")
    assert sorted(r.file_hash for r in registry.orphans(rows, there).collect()) == ["c", "d"]
    assert {r.file_hash: r.file_exists for r in registry.listing(rows, there).collect()} == {"a": True, "b": True, "c": None, "d": False, "e": False}
    assert [r.file_hash for r in registry.removable(rows, rows, "/in", there).collect()] == ["a"]
