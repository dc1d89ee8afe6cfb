"""Files as tables: a recursive scan, and text of office formats by the standard library alone."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import config as C
from docloom.functions import text as t
from docloom.sources import pdf


def scan(spark: SparkSession, folder: str, formats: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """path, file_name, extension, size, modified, content and file_hash of all files below folder (of some formats, at most limit)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = t.basename(F.col("path"))
    rows = files.select("path", name.alias("file_name"), t.extension(name).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    rows = rows.where(F.col("extension").isin(*formats)) if formats else rows
    if limit:  # paths alone are put in order, then contents are read of those that stay
        rows = rows.join(F.broadcast(rows.select("path").orderBy("path").limit(limit)), "path", "left_semi")
    return rows.withColumn("file_hash", F.sha2("content", 256))


def tag(node) -> str:
    return node.tag.rpartition("}")[2]


def texts(node, name: str) -> str:
    return "".join(x.text or "" for x in node.iter() if tag(x) == name)


def docx(data: bytes) -> str:
    """Paragraphs, then tables: a line [表格N], and cells joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    lines = [texts(p, "t") for p in body if tag(p) == "p"]
    for n, table in enumerate((x for x in body if tag(x) == "tbl"), 1):
        rows = [" | ".join(texts(c, "t").strip() for c in row if tag(c) == "tc") for row in table if tag(row) == "tr"]
        lines += [f"[表格{n}]", *rows]
    return "\n".join(x for x in lines if x.strip())


def xlsx(data: bytes) -> str:
    """[Sheet: name], and rows that aren't blank, cells joined by bars; sheets a blank line apart."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [texts(s, "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if tag(x) == "sheet"):
            target = rels[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
            lines = [f"[Sheet: {sheet.get('name')}]"]
            for row in (x for x in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if tag(x) == "row"):
                cells = []
                for c in row:
                    value = texts(c, "v") or texts(c, "t")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                if any(x.strip() for x in cells):
                    lines.append(" | ".join(cells))
            out.append("\n".join(lines))
    return "\n\n".join(out)


def pptx(data: bytes) -> str:
    """Texts of shapes; slides, by number, a blank line apart."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        pages = ["\n".join(x for p in ElementTree.fromstring(z.read(n)).iter() if tag(p) == "p" and (x := texts(p, "t"))) for n in slides]
    return "\n\n".join(p for p in pages if p)


def wps(data: bytes) -> str:
    """Text nodes, where the file is a zip of XML; else runs of UTF-16."""
    if data[:2] != b"PK":
        return raw_utf16(data)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = [x.text for n in sorted(z.namelist()) if n.endswith(".xml") for x in ElementTree.fromstring(z.read(n)).iter() if tag(x) == "t" and x.text]
    return "\n".join(parts)


def lenient(raw: bytes, gbk_first: bool) -> str:
    """Bytes as GBK or UTF-8, whichever of the two comes first without a fault; else as UTF-8 with gaps."""
    for encoding in ("gbk", "utf-8") if gbk_first else ("utf-8", "gbk"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def gbk_fonts(resources: bytes) -> set[bytes]:
    """Ids of the fonts whose name says that their texts are GBK."""
    fonts = re.findall(rb"<(?:\w+:)?Font\s+([^>]+)>", resources)
    named = [(re.search(rb'\bID="(\d+)"', f), re.search(rb'FontName="([^"]*)"', f)) for f in fonts]
    marked = lambda name: any(m in name for m in ("GBK", "_gbk", "GB2312", "gb2312", "\ufffd"))
    return {i[1] for i, n in named if i and n and marked(lenient(n[1], True))}


def ofd(data: bytes) -> str:
    """Text codes of each page's content, pages in the order of their names (Page_10 before Page_2), a blank line apart.

    A text whose font's name says GBK is read as such first, others as UTF-8 first.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(z.namelist())
        gbk: set[bytes] = set().union(*(gbk_fonts(z.read(n)) for n in names if n.endswith("PublicRes.xml")))
        pages = []
        for n in (x for x in names if x.endswith("Content.xml")):
            font, found = b"", []
            for f, code in re.findall(rb"<(?:\w+:)?TextObject\b[^>]*?\bFont=\"(\d+)\"|<(?:\w+:)?TextCode[^>]*>([^<]*)<", z.read(n)):
                font = f or font
                if code:
                    found.append(html.unescape(lenient(code, font in gbk)))
            pages.append("\n".join(found))
    return "\n\n".join(p for p in pages if p)


RUN = f"[{C.PLAUSIBLE}]{{4,}}"


def raw_utf16(data: bytes) -> str:
    """Runs of four and more plausible characters, of more than six, of which over a twentieth are Han."""
    runs = re.findall(RUN, data.decode("utf-16-le", "ignore"))
    return "\n".join(x for x in runs if len(x) > 6 and sum("一" <= c <= "鿿" for c in x) > 0.05 * len(x))


def plausible_runs(decoded: Column) -> Column:
    """As raw_utf16, of text that is decoded already."""
    runs = F.regexp_extract_all(decoded, F.lit(f"(?U){RUN}"), F.lit(0))
    return F.array_join(F.filter(runs, lambda x: (F.length(x) > 6) & (F.regexp_count(x, F.lit("[一-鿿]")) > F.length(x) * 0.05)), "\n")


def plain(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


PARSERS: dict[str, Callable[[bytes], str]] = {".pdf": pdf.text, ".docx": docx, ".xlsx": xlsx, ".pptx": pptx, ".wps": wps, ".ofd": ofd, ".doc": raw_utf16, ".txt": plain, ".md": plain}


def parsed(files: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """files with text and error. A format without a parser has neither; what can't be read has its error, and the rest goes on. More parsers (PDF, OCR) can be given."""
    known = PARSERS | (parsers or {})
    fields = [*files.schema.fields, T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]

    def run(batches):
        for batch in batches:
            kinds, data = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("extension", "content"))
            out: list[tuple[str | None, str | None]] = []
            for kind, content in zip(kinds, data):
                if kind not in known:
                    out.append((None, None))
                    continue
                try:
                    out.append((known[kind](content or b""), None))
                except Exception as e:  # one file's fault is that file's alone
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=[f.name for f in fields])

    return files.mapInArrow(run, T.StructType(fields))


def recognised(df: DataFrame, result: str) -> DataFrame:
    """result: what a recogniser of page images returned, as JSON, in either of its shapes: objects of rec_texts and rec_scores, or lists of [box, [text, confidence]].

    Adds ocr_text (lines joined) and lines (text, confidence to four digits, bbox as a flat array of rounded numbers, empty in the first shape); lines that don't fit are left out.
    """
    shape = "struct<text:string,confidence:double,bbox:array<bigint>>"
    new = F.from_json(result, "array<struct<rec_texts:array<string>,rec_scores:array<double>>>")[0]
    first = F.get_json_object(result, "$[0]")
    named = F.get_json_object(result, "$[0].rec_texts").isNotNull()
    flat = F.transform(new["rec_texts"], lambda x, i: F.struct(x.alias("text"), F.round(F.coalesce(F.get(new["rec_scores"], i), F.lit(0.0)), 4).alias("confidence"), F.array().cast("array<bigint>").alias("bbox")))
    old = F.from_json(first, "array<array<string>>")
    box = lambda line: F.transform(F.flatten(F.from_json(F.get(line, 0), "array<array<double>>")), lambda v: F.bround(v).cast("bigint"))
    told = lambda line: F.from_json(F.get(line, 1), "array<string>")
    listed = F.transform(old, lambda x: F.struct(F.get(told(x), 0).alias("text"), F.round(F.get(told(x), 1).try_cast("double"), 4).alias("confidence"), box(x).alias("bbox")))
    lines = F.when(named, flat.cast(f"array<{shape}>")).otherwise(F.filter(listed.cast(f"array<{shape}>"), lambda x: x["confidence"].isNotNull() & x["bbox"].isNotNull()))
    lines = F.coalesce(F.filter(lines, lambda x: (x["text"] != "") | ~named), F.array().cast(f"array<{shape}>"))
    return df.withColumn("lines", lines).withColumn("ocr_text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))


def dispatch(extension: Column) -> Column:
    """How a format is read; null for those that give no chunks."""
    return F.when(extension == ".pdf", "pdf").when(extension.isin(".txt", ".md"), "plain").when(extension.isin(".xls", ".xlsx"), "sheet").when(extension.isin(".ppt", ".pptx"), "slides").when(extension.isin(".doc", ".docx", ".wps"), "word").when(extension == ".ofd", "ofd")


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON files, one row each, ids as text."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("questions").alias("q")).select("q.*").withColumn("id", F.col("id").cast("string"))


def visible_html(page: Column) -> Column:
    """Text of a page: no scripts, styles or tags, white space as single blanks."""
    bare = F.regexp_replace(page, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return t.strip(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


