"""Chunking: whole documents, pages, windows, and the recursive split by separators."""

from __future__ import annotations

import bisect
import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import config as C
from docloom.functions import text as t


def strategy(chars: Column, pages: Column) -> Column:
    return F.when(chars < C.FULL_CHARS, "full_document").when(pages <= C.SINGLE_PAGES, "single_page").otherwise("semantic")


def windows(length: Column, size: int, overlap: int) -> Column:
    """1-based starts of windows of size characters, overlap in common, until the end is reached."""
    step = size - overlap
    last = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step + 1)


def forced_split(df: DataFrame, text: str = "text", size: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """A row for each window: chunk_index, chunk_text. An empty text has none."""
    starts = windows(F.length(text), size, overlap)
    rows = df.where(F.length(text) > 0).select("*", F.posexplode(starts).alias("chunk_index", "chunk_start"))
    return rows.withColumn("chunk_text", F.expr(f"substring(`{text}`, chunk_start, {size})")).drop("chunk_start")


def spans(low: int, high: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """The windows of a range."""
    last = max(0, -(-(high - low - size) // (size - overlap)))
    return [(at, min(at + size, high)) for at in range(low, low + last * (size - overlap) + 1, size - overlap)] if high > low else []


def parts(text: str, low: int, high: int, mark: str) -> tuple[list[int], list[int]]:
    """Begins and ends of what stands between the marks of a range."""
    marks = [m.start() for m in re.finditer(re.escape(mark), text[low:high])]
    return [low, *(low + m + len(mark) for m in marks)], [*(low + m for m in marks), high]


def leaves(text: str, size: int, overlap: int, force: int | None = None) -> list[tuple[int, int, tuple[int, ...]]]:
    """Ranges of at most size characters in order, each with the numbers of the ranges that were cut to get it.

    A range that is too long is cut at the marks of its depth, however long it is: from a part that isn't empty as far as
    size reaches, which a search over the parts' ends tells; a part that is too long by itself is cut on at the next
    depth's marks. force: ranges over so many characters go through windows instead.
    """
    todo, out, numbers = [(0, len(text), ())], [], itertools.count()
    while todo:
        low, high, above = todo.pop()
        mark = C.SEPARATORS[len(above)] if len(above) < len(C.SEPARATORS) else ""
        if high - low <= size:
            out.append((low, high, above))
        elif not mark or (force is not None and high - low > force):
            out += [(a, b, above) for a, b in spans(low, high, size, overlap)]
        else:
            begins, ends = parts(text, low, high, mark)
            own, cut, i = (*above, next(numbers)), [], 0
            while i < len(ends):
                if begins[i] < ends[i]:
                    reach = max(i, bisect.bisect_right(ends, begins[i] + size, i) - 1)
                    cut.append((begins[i], ends[reach], own))
                    i = reach
                i += 1
            todo += reversed(cut)
    return out


def split(text: str, size: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP, force: int | None = None) -> list[str]:
    """Pieces of at most size characters, packed at the coarsest separators that do; each but the first of a range is led by the end of the piece before it, once for each depth that both are of."""
    found = leaves(text, size, overlap, force)
    out = [text[a:b] for a, b, _ in found]
    for depth in reversed(range(max((len(above) for *_, above in found), default=0))) if overlap > 0 else ():
        same = [False, *(len(a) > depth and a[: depth + 1] == b[: depth + 1] for (*_, a), (*_, b) in zip(found, found[1:]))]
        out = [f"{out[k - 1][-overlap:]}\n{piece}" if same[k] else piece for k, piece in enumerate(out)]
    return out


def semantic_chunks(df: DataFrame, text: str = "text", size: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP, cut=lambda whole: [whole], force: int | None = None) -> DataFrame:
    """A row for each piece that isn't blank, with df's columns but text: chunk_index (blank pieces keep theirs), total_chunks (all pieces), chunk_text.

    cut: cuts a text into parts that are split each by itself. force: as leaves has it.
    """
    kept = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(text)).to_pylist()
            at, index, total, out = [], [], [], []
            for i, whole in enumerate(rows):
                pieces = [piece for part in cut(whole or "") for piece in split(part, size, overlap, force)]
                for k, piece in enumerate(pieces):
                    if piece.strip():
                        at.append(i)
                        index.append(k)
                        total.append(len(pieces))
                        out.append(piece.strip())
            others = batch.select([f.name for f in kept]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*others.columns, pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(out, pa.string())], names=[*(f.name for f in kept), "chunk_index", "total_chunks", "chunk_text"])

    more = [T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("chunk_text", T.StringType())]
    return df.mapInArrow(run, T.StructType([*kept, *more]))


def text_chunks(df: DataFrame, text: str = "text", key: str = "file_hash") -> DataFrame:
    """Chunks of plain texts: whole under FULL_CHARS characters, else by the recursive split. Adds chunk_id and chunk_strategy."""
    short = df.where(F.length(text) < C.FULL_CHARS)
    whole = short.withColumns({"chunk_index": F.lit(0), "total_chunks": F.lit(1), "chunk_text": t.strip(F.col(text)), "chunk_strategy": F.lit("full_document")}).drop(text)
    parts = semantic_chunks(df.where(F.length(text) >= C.FULL_CHARS), text).withColumn("chunk_strategy", F.lit("semantic"))
    return whole.unionByName(parts).withColumn("chunk_id", F.concat_ws("_", key, "chunk_index"))


def page_chunks(pages: DataFrame, key: str = "file_hash") -> DataFrame:
    """pages: key, file_name, page_num, text. Ids go by page number, indexes by page number less one; a blank page bears its name."""
    named = F.when(F.col("text") != "", F.col("text")).otherwise(F.concat(F.lit("[第"), F.col("page_num").cast("string"), F.lit("页] "), F.col("file_name")))
    total = pages.groupBy(key).agg(F.count("*").cast("int").alias("total_chunks"))
    rows = pages.join(total, key)
    return rows.select(key, "page_num", F.concat_ws("_", key, "page_num").alias("chunk_id"), (F.col("page_num") - 1).alias("chunk_index"), "total_chunks", named.alias("chunk_text"), F.length("text").alias("char_count"), F.lit("single_page").alias("chunk_strategy"))


def drawing_text(text: Column, code: Column, name: Column) -> Column:
    return F.when(text != "", text).otherwise(F.concat(F.lit("[CAD图纸] "), F.coalesce(code, F.lit("")), F.lit(" "), F.coalesce(name, F.lit(""))))


def paragraph_batches(text: str, most: int = 30_000) -> list[str]:
    """Paragraphs of a very long text, joined up to fewer than most characters."""
    out, held, size = [], [], 0
    for p in text.split("\n\n"):
        if held and size + len(p) >= most:
            out.append("\n\n".join(held))
            held, size = [], 0
        held.append(p)
        size += len(p) + 2
    return out + (["\n\n".join(held)] if held else [])


def numbered(chunks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Chunks of several parts of a file under one numbering: chunk_index, total_chunks and chunk_id anew, in the parts' order."""
    own = Window.partitionBy(key)
    rows = chunks.withColumn("chunk_index", F.row_number().over(own.orderBy(*order)) - 1).withColumn("total_chunks", F.count("*").over(own).cast("int"))
    return rows.withColumn("chunk_id", F.concat_ws("_", key, "chunk_index"))


def long_text_chunks(df: DataFrame, text: str = "text", key: str = "file_hash", most: int = 100_000) -> DataFrame:
    """Texts over most characters: paragraphs in batches, each split by itself (one of over FORCE_CHARS by windows), under one numbering."""
    long = df.where(F.length(text) > most).select(key, text)
    return numbered(semantic_chunks(long, text, cut=paragraph_batches, force=C.FORCE_CHARS).withColumnRenamed("chunk_index", "place"), key, ["place"]).drop("place")


def scan_rule(pages: DataFrame, key: str = "doc", first: int = 15, share: float = 0.7, few: int = 50) -> DataFrame:
    """pages: key, page_num, char_count. Whether a document is scanned: most of its first pages, or over half of all pages, have few characters."""
    low = F.col("char_count") < few
    early = F.col("page_num") <= first
    counts = pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(low).alias("low"), F.count_if(early).alias("early"), F.count_if(early & low).alias("early_low"))
    sampled = (F.col("early") > 0) & (F.col("early_low") >= F.lit(share) * F.col("early"))
    return counts.select(key, "pages", F.when(sampled, F.col("pages")).otherwise(F.col("low")).alias("needs_ocr"), (sampled | (F.col("low") * 2 > F.col("pages"))).alias("is_scanned"), F.when(sampled, "sampled").otherwise("full").alias("parse_mode"))


def merge_ocr(pages: DataFrame, ocr: DataFrame, keys: list[str]) -> DataFrame:
    """pages: keys, text. ocr: keys, ocr_text. What is read stands behind what a page has; such a page needs no more reading."""
    merged = pages.join(ocr, keys, "left")
    text = F.when(F.col("ocr_text").isNull(), F.col("text")).when(t.strip(F.col("text")) != "", F.concat(F.col("text"), F.lit("\n"), F.col("ocr_text"))).otherwise(F.col("ocr_text"))
    return merged.withColumn("merged", text).select(*keys, F.col("merged").alias("text"), F.length("merged").alias("char_count"), (F.col("ocr_text").isNull() & (F.length("merged") < 50)).alias("needs_ocr"))
