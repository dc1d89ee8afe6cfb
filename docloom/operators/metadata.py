"""Metadata from paths and file names (first match wins), and the text that it becomes for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import config as C
from docloom.functions import text as t


def path_metadata(df: DataFrame, path: str = "relative_path") -> DataFrame:
    """domain, category, subcategory, path_depth and path_year. The file's own name counts as a part, as category too."""
    parts = F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")
    years = F.filter(parts, lambda p: p.rlike(r"(?U)^(19|20)\d{2}$"))
    return df.withColumns({
        "domain": F.when(F.get(parts, 0).isin(*C.DOMAINS), F.get(parts, 0)), "category": F.get(parts, 1), "subcategory": F.get(parts, 2),
        "path_depth": F.size(parts) - 1, "path_year": F.get(years, 0).cast("int"),
    })


def region(name: Column) -> Column:
    return F.when(t.contains_any(name, ["福州", "榕"]), "福州").when(t.contains_any(name, ["福建", "闽"]), "福建").otherwise(C.NATIONWIDE)


def voltage(c: Column, strict: bool = False) -> Column:
    """Not strict, a level also matches inside a larger number (110kV is 10kV), as the order of the patterns has it."""
    levels = {k: [rf"(?<!\d){p}" for p in ps] for k, ps in C.VOLTAGES.items()} if strict else C.VOLTAGES
    return t.first_label(c, levels, ignore_case=True)


def doc_number(c: Column, fixed: bool = False) -> Column:
    """fixed: also GB/T and DL/T, and an underscore or a blank before the number."""
    return t.first_match(c, [p.replace("[/T]?\\s*", "(?:/T)?[\\s_]*") for p in C.DOC_NUMBERS] if fixed else C.DOC_NUMBERS)


def filename_metadata(df: DataFrame, name: str = "file_name", fixed: bool = False) -> DataFrame:
    """doc_number, publish_level, voltage_level, discipline, equipment_type, year, region and drawing_code.

    A drawing code fills discipline and voltage where the name gives none; its letters and digits equal a key of the
    map only if fixed (the first three characters then count).
    """
    c = F.col(name)
    drawing = t.u(C.DRAWING_CODE)
    group = lambda i: t.blank_to_null(F.regexp_extract(c, drawing, i))
    code = F.substring(group(3), 1, 3) if fixed else group(3)
    known = F.create_map(*(F.lit(x) for kv in C.DRAWING_DISCIPLINES.items() for x in kv))
    return df.withColumns({
        "doc_number": doc_number(c, fixed),
        "publish_level": t.first_label(c, C.PUBLISH_LEVELS),
        "voltage_level": F.coalesce(voltage(c, fixed), F.concat(group(1), F.lit("kV"))),
        "discipline": F.coalesce(t.first_label(c, C.DISCIPLINES), known[code]),
        "equipment_type": t.first_label(c, C.EQUIPMENT),
        "year": t.blank_to_null(F.regexp_extract(c, r"(?U)((?:19|20)\d{2})", 1)).cast("int"),
        "region": region(c),
        "drawing_code": group(0),
    })


def format_class(df: DataFrame, name: str = "file_name", path: str = "relative_path") -> DataFrame:
    """extension, is_drawing, is_archive and format_group; a PDF is a drawing by words of its path."""
    ext = t.extension(F.col(name))
    group = F.lit("other")
    for label, extensions in C.FORMATS.items():
        group = F.when(ext.isin(*extensions), F.lit(label)).otherwise(group)
    return df.withColumns({
        "extension": ext, "format_group": group, "is_archive": ext.isin(*C.FORMATS["archive"]),
        "is_drawing": ext.isin(*C.FORMATS["drawing"]) | ((ext == ".pdf") & t.contains_any(F.lower(F.col(path)), C.DRAWING_PATHS)),
    })


def ingest_metadata(df: DataFrame, given: dict[str, str] | None = None, consistent: bool = False) -> DataFrame:
    """What ingest stores: what is given, else the path's, else an empty text. Drawings are .dwg and .dxf alone unless consistent."""
    given = given or {}
    df = filename_metadata(path_metadata(df))
    for name in ("domain", "category"):
        df = df.withColumn(name, F.coalesce(t.blank_to_null(F.lit(given.get(name, ""))), F.col(name), F.lit("")))
    if consistent:
        return format_class(df)
    ext = t.extension(F.col("file_name"))
    drawing = ext.isin(".dwg", ".dxf")
    return df.withColumns({"extension": ext, "is_drawing": drawing, "is_archive": F.lit(False), "format_group": F.when(drawing, "drawing").otherwise("document")})


def upload_name(df: DataFrame, name: str = "file_name") -> DataFrame:
    """accepted (by extension) and stored_name (blanks become underscores)."""
    return df.withColumns({"accepted": t.extension(F.col(name)).isin(*C.UPLOAD_FORMATS), "stored_name": F.replace(F.col(name), F.lit(" "), F.lit("_"))})


#: Names of the parts of the retrieval text, and their columns.
LABELS = [("专业域", "domain"), ("文档类目", "category"), ("文件编号", "doc_number"), ("发布层级", "publish_level"), ("电压等级", "voltage_level"), ("专业类型", "discipline"), ("设备类型", "equipment_type"), ("地域", "region"), ("年份", "year"), ("图号", "drawing_code")]


def metadata_text(df: DataFrame) -> Column:
    parts = []
    for label, column in LABELS:
        value = F.col(column)
        present = (value != 0) if dict(df.dtypes)[column] in ("int", "bigint") else (value != "")
        parts.append(F.when(present, F.concat(F.lit(f"{label}:"), value.cast("string"))))
    return F.concat_ws(" | ", *parts)


def embedding_text(df: DataFrame, text: str = "text") -> DataFrame:
    """meta_text, and embedding_text: [meta] text, or the text alone."""
    df = df.withColumn("meta_text", metadata_text(df))
    return df.withColumn("embedding_text", F.when(F.col("meta_text") != "", F.concat(F.lit("["), F.col("meta_text"), F.lit("] "), F.col(text))).otherwise(F.col(text)))


def stored_chunk(df: DataFrame) -> DataFrame:
    """Nulls as the vector table stores them: texts empty, numbers 0, region nationwide, project_stage always empty."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "string":
            out[name] = F.coalesce(t.blank_to_null(F.col(name)), F.lit(C.NATIONWIDE if name == "region" else ""))
        elif kind in ("int", "bigint"):
            out[name] = F.coalesce(F.col(name), F.lit(0)).cast(kind)
        elif kind == "boolean":
            out[name] = F.coalesce(F.col(name), F.lit(False))
    return df.withColumns(out).withColumn("project_stage", F.lit(""))
