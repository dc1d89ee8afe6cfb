"""Texts over 50,000 characters are split at separators as shorter ones are."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from docloom import config as C
from docloom.operators import chunking
from docloom.plans import ingest


def recursive(text, size, overlap, depth=0):
    """The split by its definition, part by part."""
    if len(text) <= size:
        return [text]
    mark = C.SEPARATORS[depth]
    if not mark:
        return [text[a:b] for a, b in chunking.spans(0, len(text), size, overlap)]
    out, held = [], ""
    for part in text.split(mark):
        longer = held + (mark if held else "") + part
        if len(longer) <= size:
            held = longer
            continue
        out += [held] if held else []
        out += recursive(part, size, overlap, depth + 1) if len(part) > size else []
        held = part if len(part) <= size else ""
    out += [held] if held else []
    return [p if i == 0 else f"{out[i - 1][-overlap:]}\n{p}" for i, p in enumerate(out)]


def prose(rng, size):
    return "".join(rng.choice(["甲" * rng.randrange(1, 90), "乙。", "丙；", "word ", "\n", "\n\n", "\n\n\n", ". ", "，", "x" * rng.randrange(1, 2000)]) for _ in range(size // 100))


def test_long_texts_are_split_at_separators():
    rng = random.Random(4)
    for text in ["\n\n".join(["a" * 1000] * 60), "x" * 60_000, "a b " * 20_000, *(prose(rng, 300_000) for _ in range(5))]:
        assert len(text) > C.FORCE_CHARS
        assert chunking.split(text) == recursive(text, C.CHUNK_CHARS, C.CHUNK_OVERLAP)


def test_a_long_text_equals_sql(spark, tmp_path):
    rng = random.Random(5)
    texts = ["\n\n".join(f"{i} " + "a" * 1000 for i in range(60)), "\n".join("b" * 700 + "。" for _ in range(90)), "x" * 60_000, "short", prose(rng, 60_000)]
    assert sum(len(t) > C.FORCE_CHARS for t in texts) == 4
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(t) for t in texts]}), tmp_path / "documents.parquet")
    got = ingest.chk_semantic(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(ingest.SQL["chk_semantic"])
    assert sorted(map(tuple, got.collect())) == sorted(want.project(", ".join(got.columns)).fetchall())
    assert got.where("doc_id = 0 AND chunk_text RLIKE '^[0-9]+ a'").count() == 1 and got.where("doc_id = 0").count() == 60
