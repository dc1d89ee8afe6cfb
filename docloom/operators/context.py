"""Context for a language model: headers, one chunk a file, whole documents, and what an answer shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import config as C
from docloom.functions import text as t

#: Parts of a result's header, and their columns.
HEADER = [("编号", "doc_number"), ("域", "domain"), ("类目", "category"), ("电压", "voltage_level"), ("发布", "publish_level")]


def result_text() -> Column:
    """【header】 and the chunk's text below it."""
    named = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    parts = [named("文件", F.when(F.col("file_path") != "", t.basename(F.col("file_path")))), *(named(n, F.col(c)) for n, c in HEADER), F.when(F.col("page_num") != 0, F.concat(F.lit("页码: "), F.col("page_num").cast("string")))]
    header = F.concat_ws(" | ", *parts)
    return F.concat(F.when(header != "", F.concat(F.lit("【"), header, F.lit("】"))).otherwise(""), F.lit("\n"), F.col("text"))


def in_order(column: str, rank: str, separator: str) -> Column:
    """The group's values of a column by rank, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank, column))), lambda x: x[column]), separator)


def first_of_file(results: DataFrame, most: int = C.FINE_K) -> DataFrame:
    """Of a query's first results, the first of each file (of each chunk, without a file)."""
    key = F.coalesce(t.blank_to_null(F.col("file_path")), F.col("chunk_id"))
    own = Window.partitionBy("query_id", key).orderBy("rank")
    return results.where(F.col("rank") <= most).withColumn("turn", F.row_number().over(own)).where("turn = 1").drop("turn")


def context(results: DataFrame, most: int = C.FINE_K) -> DataFrame:
    """query_id and context. At most `most` results of a query come together."""
    return first_of_file(results, most).withColumn("part", result_text()).groupBy("query_id").agg(in_order("part", "rank", "\n\n").alias("context"))


def full_documents(chunks: DataFrame, key: str = "file_hash") -> DataFrame:
    """key and document: the chunks of a file in reading order, with a line for each new page, between rulers."""
    page = F.coalesce("page_num", F.lit(0))
    rows = chunks.withColumns({"page": page, "at": F.coalesce("chunk_index", F.lit(0))})
    before = Window.partitionBy(key).orderBy("page", "at", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.max("page").over(before))
    marked = F.when((F.col("page") > 0) & (F.col("page") > F.coalesce("last", F.lit(-1))), F.concat(F.lit("\n--- 第 "), F.col("page").cast("string"), F.lit(" 页 ---\n")))
    part = F.concat_ws("\n", marked, F.when(t.strip(F.col("text")) != "", F.col("text")))
    rows = rows.withColumns({"part": part, "silent": marked.isNull() & (t.strip(F.col("text")) == "")})
    told = F.sort_array(F.collect_list(F.when(~F.col("silent"), F.struct("page", "at", "chunk_id", "part"))))
    ruler = "=" * 60
    pages = F.max("page")
    head = F.concat(F.lit(f"\n\n{ruler}\n【完整文档: "), F.first("file_name"), F.lit("】（共 "), F.count("*").cast("string"), F.lit(" 个片段"), F.when(pages > 0, F.concat(F.lit(", "), pages.cast("string"), F.lit(" 页"))).otherwise(""), F.lit(f"）\n{ruler}\n"))
    return rows.groupBy(key).agg(head.alias("head"), F.array_join(F.transform(told, lambda x: x["part"]), "\n").alias("body")).select(key, F.concat_ws("\n", "head", t.blank_to_null(F.col("body")), F.lit(f"\n{ruler}\n")).alias("document"))


def shortened(document: Column, most: int = C.FULL_DOCUMENT_CHARS) -> Column:
    n = F.length(document)
    head, middle, end = C.CUT_NOTICE
    notice = F.concat(F.lit(head), n.cast("string"), F.lit(f"{middle}{most}{end}"))
    return F.when(n > most, F.concat(F.substring(document, 1, most), notice)).otherwise(document)


def series_key(name: Column) -> Column:
    """What files of a series share in their names; null without one."""
    return F.when(name.contains("会议材料之"), F.lit("会议材料之")).otherwise(t.blank_to_null(F.regexp_extract(name, r"(?U)第[一二三四五六七八九十\d]+[章节部分篇]", 0)))


def supplements(results: DataFrame, matched: DataFrame, most: int = C.FINE_K, kept: int = 2) -> DataFrame:
    """matched: query_id, match_path, match_name. Further files of a query's results, but for the matched one and its series: the first two."""
    rows = first_of_file(results.where(F.col("file_path") != ""), most).join(matched, "query_id")
    series = series_key(F.col("match_name"))
    same = series.isNotNull() & series.eqNullSafe(series_key(t.basename(F.col("file_path"))))
    order = Window.partitionBy("query_id").orderBy("rank")
    return rows.where((F.col("file_path") != F.col("match_path")) & ~same).withColumn("place", F.row_number().over(order)).where(F.col("place") <= kept)


def injected(documents: DataFrame, supplementary: DataFrame) -> DataFrame:
    """documents: query_id, match_name, document. The document, the instruction to keep to it, and its supplements."""
    extra = supplementary.withColumn("part", result_text()).groupBy("query_id").agg(in_order("part", "place", "\n\n").alias("extra"))
    told = F.concat(F.lit(C.ONLY_THIS[0]), F.col("match_name"), F.lit(C.ONLY_THIS[1]))
    rule = "─" * 40
    note = F.when(F.col("extra").isNotNull(), F.lit(f"\n{rule}\n{C.SUPPLEMENTS}\n{rule}\n"))
    return documents.join(extra, "query_id", "left").select("query_id", F.concat_ws("\n\n", shortened(F.col("document")), told, note, "extra").alias("context"))


def focused(text: Column, query: Column) -> Column:
    """Without a registry: text led by the hint to keep to the file of a meeting paper that the query names by number, if the text has one."""
    number = F.coalesce(t.blank_to_null(F.regexp_extract(query, f"(?U)(\\d{{2}})\\s*会议材料之[一二三四五六七八九十]+", 1)), t.blank_to_null(F.regexp_extract(query, r"(?U)(\d+)\s*(?:会议材料|材料)", 1)))
    named = F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"\\d+[^.]*{C.MEETING_FILE}"), F.lit(0)), lambda m: F.when(F.instr(m, number) > 0, F.substr(m, F.instr(m, number)))), lambda m: m.isNotNull()), 0)
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.concat(F.lit("文件: "), number)) & F.contains(x, F.lit("会议材料"))), 0)
    name = F.coalesce(named, t.strip(line))
    head, tail = C.FOCUS.split("{name}")
    return F.when(name.isNotNull(), F.concat(F.lit(head), name, F.lit(tail), text)).otherwise(text)


def with_fallback(injected_: DataFrame, results: DataFrame) -> DataFrame:
    """query_id and context: that of the injected document; where there is none, the results' own."""
    own = context(results).withColumnRenamed("context", "plain")
    return own.join(injected_, "query_id", "full_outer").select("query_id", F.coalesce("context", "plain").alias("context"), F.col("context").isNotNull().alias("injected"))


def bounded(value: Column, kind: str) -> Column:
    """A request's number: its default without one, null where it is out of bounds."""
    least, most, default = C.BOUNDS[kind]
    return F.when(value.isNull(), default).when(value.between(least, most), value)


def previews(results: DataFrame, most: int = 500) -> DataFrame:
    return results.withColumn("preview", t.cut(F.col("text"), most))


def sources(results: DataFrame, most: int = 10) -> DataFrame:
    """query_id and sources: distinct paths of the first results, in order."""
    return first_of_file(results.where(F.col("file_path") != ""), most).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"]).alias("sources"))


def citations(answer: Column) -> Column:
    """Distinct contents of 【】, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit("【([^】]+)】"), F.lit(1))))


def without_thoughts(answer: Column) -> Column:
    return F.regexp_replace(answer, r"(?s)<think>.*?</think>\s*", "")


def prompt(query_type: Column, query: Column, text: Column, templates: dict[str, str], default: str) -> Column:
    """The type's template with {context} and {query} filled in."""
    form = F.lit(templates[default])
    for kind, template in templates.items():
        form = F.when(query_type == kind, F.lit(template)).otherwise(form)
    return F.replace(F.replace(form, F.lit("{context}"), text), F.lit("{query}"), query)


def flattened(messages: DataFrame) -> DataFrame:
    """conv_id and prompt: messages in order, in chat markup, open for the assistant."""
    part = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("content"), F.lit("<|im_end|>\n"))
    return messages.withColumn("part", part).groupBy("conv_id").agg(F.concat(in_order("part", "turn", ""), F.lit("<|im_start|>assistant\n")).alias("prompt"))
