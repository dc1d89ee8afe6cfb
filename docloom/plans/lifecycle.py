"""Queries over a file's life: removing, reading again, details, buckets, recognised pages, requests and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import config as C
from docloom.operators import context, conversation, registry
from docloom.plans import fixtures as x
from docloom.operators.chunking import forced_split
from docloom.sources import readers, shared, sinks
from docloom.sources.store import CHUNKS, REGISTRY, Store

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- the registry

#: Identifiers of every kind: a hash, a path (of present and absent files), a name, an unknown word, an unknown hash.
IDENTIFIERS = """ids AS (SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN upper(file_hash) WHEN 1 THEN original_path WHEN 2 THEN file_name WHEN 3 THEN 'nothing ' || doc_id ELSE sha256('x' || doc_id) END AS identifier FROM registry),
there AS (SELECT original_path AS path, sha256('content ' || doc_id) AS content_hash FROM registry WHERE doc_id % 3 = 0)"""


def identifiers(s, d):
    rows, i = x.registry(s, d), F.col("doc_id")
    kinds = F.when(i % 5 == 0, F.upper("file_hash")).when(i % 5 == 1, F.col("original_path")).when(i % 5 == 2, F.col("file_name")).when(i % 5 == 3, F.concat(F.lit("nothing "), i.cast("string"))).otherwise(F.sha2(F.concat(F.lit("x"), i.cast("string")), 256))
    present = rows.where("doc_id % 3 = 0").select(F.col("original_path").alias("path"), F.sha2(F.concat(F.lit("content "), i.cast("string")), 256).alias("content_hash"))
    return rows, rows.select(kinds.alias("identifier")).distinct(), present


RESOLVED = f"""{x.REGISTRY}, {IDENTIFIERS}, pa AS (SELECT original_path, min(file_hash) AS h FROM registry GROUP BY ALL), na AS (SELECT file_name, min(file_hash) AS h FROM registry GROUP BY ALL),
res AS (SELECT identifier, CASE WHEN regexp_full_match(identifier, '[0-9a-fA-F]{{64}}') THEN lower(identifier) ELSE coalesce(there.content_hash, pa.h, na.h) END AS file_hash FROM ids LEFT JOIN there ON path = identifier LEFT JOIN pa ON original_path = identifier LEFT JOIN na ON na.file_name = identifier)"""


@query(f"WITH {RESOLVED} SELECT identifier, file_hash FROM res")
def reg_resolved_present(s, d):
    rows, ids, present = identifiers(s, d)
    return registry.resolved(ids, rows, present)


@query(f"""WITH {RESOLVED}, j AS (SELECT res.identifier, res.file_hash, r.file_hash AS own, coalesce(nullif(r.original_path, ''), nullif(r.stored_path, '')) AS p FROM res LEFT JOIN registry r ON r.file_hash = res.file_hash)
SELECT identifier, j.file_hash, coalesce(p, '') AS path, CASE WHEN own IS NOT NULL AND there.path IS NOT NULL THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN j.file_hash IS NULL THEN '{C.NOT_REGISTERED}' WHEN own IS NULL THEN '{C.REGISTRATION_LOST}' WHEN there.path IS NULL THEN '{C.SOURCE_GONE}' ELSE '' END AS error_message FROM j LEFT JOIN there ON there.path = j.p""")
def reg_reindexed(s, d):
    rows, ids, present = identifiers(s, d)
    return registry.reindexed(ids, rows, present)


WINDOWS = "CASE WHEN length({0}) > 0 THEN CAST(greatest(ceil((length({0}) - 1536) / 1344.0), 0) AS BIGINT) + 1 ELSE 0 END"
HALF = "substring(text, 1, CAST(length(text) // 2 AS BIGINT))"


def stored_files(s, d):
    """A store of all files and their windows, at its first version."""
    rows = x.registry(s, d)
    chunked = lambda t: forced_split(t).select("file_hash", F.concat_ws("_", "file_hash", "chunk_index").alias("chunk_id"), F.col("chunk_text").alias("text"))
    texts = x.files(s, d).select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text"), 256).alias("file_hash"), "text")
    rows = rows.select("file_hash", "original_path", "stored_path", "file_name", "status", F.lit(0).cast("long").alias("chunks_count"), "error_message", "updated_at", "reindex_count")
    chunks = chunked(texts)
    store = Store(s, shared.fresh(s, "files"), {CHUNKS: chunks.schema, REGISTRY: rows.schema}, buckets=16, splits=1)
    store.put("first", chunks, rows)
    return store, rows, texts, chunked


@query(f"""WITH {x.REGISTRY}, two AS (SELECT doc_id, file_hash, status, {WINDOWS.format('text')} AS n, {WINDOWS.format(HALF)} AS half, doc_id % 3 = 0 AND original_path <> '' AS again, length(text) AS l, length({HALF}) AS hl FROM registry JOIN documents USING (doc_id))
SELECT 1 AS version, file_hash, status, n AS chunks, l + 192 * greatest(n - 1, 0) AS chars, 0 AS reindexed FROM two UNION ALL
SELECT 2, file_hash, CASE WHEN again THEN 'completed' ELSE status END, CASE WHEN again THEN half ELSE n END, CASE WHEN again THEN hl + 192 * greatest(half - 1, 0) ELSE l + 192 * greatest(n - 1, 0) END, CASE WHEN again THEN 1 ELSE 0 END FROM two""")
def reg_reindex(s, d):
    """A third of the files is deleted and processed again, their texts being half as long by now; the store before and after."""
    store, rows, texts, chunked = stored_files(s, d)
    third = texts.where("doc_id % 3 = 0")
    present = rows.join(third.select("file_hash"), "file_hash", "left_semi").where("original_path <> ''").select(F.col("original_path").alias("path"), F.col("file_hash").alias("content_hash"))
    plan = registry.reindexed(third.select(F.col("file_hash").alias("identifier")), rows, present)
    halves = third.withColumn("text", F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    store.reindex("half", plan, halves, chunked, F.lit("2024-02-01"))
    store.reindex("half", plan, halves, chunked, F.lit("2024-02-01"))
    shown = None
    for version in (1, store.latest()):
        chunks = store.read(CHUNKS, version).groupBy("file_hash").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
        part = store.read(REGISTRY, version).join(chunks, "file_hash", "left").select(F.lit(version).alias("version"), "file_hash", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("chars", F.lit(0)).alias("chars"), F.col("reindex_count").cast("int").alias("reindexed"))
        shown = part if shown is None else shown.unionByName(part)
    return shown


@query(f"WITH {x.REGISTRY}, {x.PRESENT} SELECT file_hash, path FROM (SELECT file_hash, {x.OWN_PATH} AS path FROM registry) SEMI JOIN present USING (path) WHERE starts_with(path, '/in/1')")
def reg_removable(s, d):
    rows = x.registry(s, d)
    return registry.removable(rows, rows, "/in/1", x.present(rows))


@query(f"WITH {x.REGISTRY} SELECT doc_id, status FROM registry WHERE status <> 'completed' AND file_name IN (SELECT file_name FROM registry WHERE status = 'failed')")
def reg_not_parsed(s, d):
    rows = x.registry(s, d)
    named = rows.where("status = 'failed'").select("file_name").distinct()
    return registry.by_state(rows, False, rows.join(named, "file_name", "left_semi")).select("doc_id", "status")


@query(f"""WITH {x.REGISTRY}, page AS (SELECT * FROM registry ORDER BY updated_at DESC, file_hash LIMIT 1000), k AS (SELECT *, file_hash AS identifier FROM page UNION ALL SELECT *, file_name FROM page),
f AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY updated_at DESC, file_hash) AS n FROM k WHERE identifier IN (SELECT file_name FROM registry UNION SELECT file_hash FROM registry WHERE doc_id % 2 = 0)) SELECT identifier, doc_id, status, updated_at FROM f WHERE n = 1""")
def reg_details(s, d):
    rows = x.registry(s, d)
    asked = rows.select(F.col("file_name").alias("identifier")).union(rows.where("doc_id % 2 = 0").select("file_hash"))
    return registry.details(asked, rows).select("identifier", "doc_id", "status", "updated_at")


# --- sinks and sources


@query(f"WITH {x.REGISTRY} SELECT bucket, count(*) AS chunks, count(DISTINCT file_hash) AS files FROM (SELECT file_hash, (strpos('0123456789abcdef', substr(file_hash, 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(file_hash, 2, 1)) - 1 AS bucket FROM registry) GROUP BY bucket")
def snk_buckets(s, d):
    rows = x.registry(s, d).withColumn("bucket", sinks.bucket(F.col("file_hash")))
    return rows.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("chunks"), F.countDistinct("file_hash").alias("files"))


STRINGS = ", ".join(f"{c}" if c in ("chunk_id", "file_path", "domain", "category") else f"coalesce({c}, '') AS {c}" for c in ("chunk_id", "file_path", "domain", "category", "doc_number", "publish_level", "voltage_level"))


@query(f"WITH {x.CHUNKS} SELECT {STRINGS}, '' AS discipline, '{C.NATIONWIDE}' AS region, 0 AS year, coalesce(page_num, 0) AS page_num, is_drawing FROM chunks")
def snk_chunk_rows(s, d):
    return sinks.as_chunks(x.chunks(s, d)).select("chunk_id", "file_path", "domain", "category", "doc_number", "publish_level", "voltage_level", "discipline", "region", "year", "page_num", "is_drawing")


@query("SELECT doc_id, text || 'ö' AS text, CAST(NULL AS VARCHAR) AS error FROM documents")
def src_plain_text(s, d):
    """Text files with a byte that isn't UTF-8 in them."""
    content = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("ö"), "UTF-8"))
    files = x.table(s, d, "documents").select("doc_id", F.lit(".txt").alias("extension"), content.alias("content"))
    return readers.parsed(files).select("doc_id", "text", "error")


#: White space beyond RE2's own.
BLANKS = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RUNS = "regexp_extract_all(t, '[" + C.PLAUSIBLE.replace("'", "''").replace("\\s", BLANKS) + "]{4,}')"


@query(f"WITH r AS (SELECT doc_id, {x.pick_sql(x.ANSWERS, 'doc_id')} || '＠' || text || '＃' || {x.pick_sql(x.QUESTIONS, 'doc_id')} AS t FROM documents) SELECT doc_id, array_to_string(list_filter({RUNS}, lambda c: length(c) > 6 AND len(regexp_extract_all(c, '[一-鿿]')) > length(c) * 0.05), chr(10)) AS runs FROM r")
def src_plausible_runs(s, d):
    i = F.col("doc_id")
    return x.table(s, d, "documents").select("doc_id", readers.plausible_runs(F.concat(x.pick(x.ANSWERS, i), F.lit("＠"), "text", F.lit("＃"), x.pick(x.QUESTIONS, i))).alias("runs"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' WHEN text <> '' OR turn % 3 = 1 THEN text || chr(10) || 'end' ELSE 'end' END AS ocr_text, CASE WHEN turn % 3 = 2 THEN 0 WHEN text <> '' OR turn % 3 = 1 THEN 2 ELSE 1 END AS n_lines,
CASE WHEN turn % 3 = 2 THEN NULL ELSE 0.75::DOUBLE END AS last_confidence, CASE WHEN turn % 3 = 1 THEN '1,2,3,4' WHEN turn % 3 = 0 THEN '' END AS last_box FROM conversations""")
def src_recognised(s, d):
    """Results of recognisers in both shapes, and one that is empty."""
    new = F.to_json(F.array(F.struct(F.array("text", F.lit("end")).alias("rec_texts"), F.array(F.lit(0.5), F.lit(0.75)).alias("rec_scores"))))
    line = lambda text, score: F.concat(F.lit("[[[1.2, 2.0], [3.4, 3.6]], "), F.to_json(F.array(text)).substr(F.lit(1), F.length(F.to_json(F.array(text))) - 1), F.lit(f", {score}]]"))
    old = F.concat(F.lit("[["), line(F.col("text"), 0.5), F.lit(", [1, 2, 3], "), line(F.lit("end"), 0.75004), F.lit("]]"))
    pages = x.table(s, d, "conversations").withColumn("result", F.when(F.col("turn") % 3 == 0, new).when(F.col("turn") % 3 == 1, old).otherwise("[]"))
    last = F.element_at("lines", -1)
    found = readers.recognised(pages, "result").select("conv_id", "turn", "ocr_text", F.size("lines").alias("n_lines"), F.when(F.size("lines") > 0, F.element_at("lines", F.greatest(F.size("lines"), F.lit(1)))).alias("last"))
    return found.select("conv_id", "turn", "ocr_text", "n_lines", F.col("last.confidence").alias("last_confidence"), F.array_join(F.transform("last.bbox", lambda v: v.cast("string")), ",").alias("last_box"))


# --- requests and conversations


def cases(bounds: tuple[int, int, int], c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN {bounds[2]} WHEN {c} BETWEEN {bounds[0]} AND {bounds[1]} THEN {c} END"


@query(f"SELECT doc_id, {', '.join(f'CAST({cases(b, chr(110))} AS BIGINT) AS {k}_k' for k, b in C.BOUNDS.items())} FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id * 13 % 1500 - 3 END AS n FROM documents)")
def api_bounds(s, d):
    i = F.col("doc_id")
    rows = x.table(s, d, "documents").select("doc_id", F.when(i % 7 != 0, i * 13 % 1500 - 3).alias("n"))
    return rows.select("doc_id", *(context.bounded(F.col("n"), k).cast("long").alias(f"{k}_k") for k in C.BOUNDS))


PAPERS = ["01会议材料之一2022年.docx", "02会议材料之二2023年.docx", "文件: 02 关于会议材料的说明", "变电站设计规范.pdf"]
PAPER_QUESTIONS = ["01会议材料之一 的内容", "02会议材料之三讲了什么", "2 会议材料", "01材料", "设计规范", "35 材料"]
NUMBER = "coalesce(nullif(regexp_extract(q, '([0-9]{2})\\s*会议材料之[一二三四五六七八九十]+', 1), ''), nullif(regexp_extract(q, '([0-9]+)\\s*(?:会议材料|材料)', 1), ''))"


@query(f"""WITH t AS (SELECT doc_id, {x.pick_sql(PAPERS, 'doc_id')} || chr(10) || {x.pick_sql(PAPERS, 'doc_id // 4')} AS c, {x.pick_sql(PAPER_QUESTIONS, 'doc_id // 3')} AS q FROM documents), n AS (SELECT *, {NUMBER} AS num FROM t),
m AS (SELECT *, list_filter(list_transform(regexp_extract_all(c, '[0-9]+[^.]*{C.MEETING_FILE}'), lambda v: CASE WHEN strpos(v, num) > 0 THEN substr(v, strpos(v, num)) END), lambda v: v IS NOT NULL)[1] AS a, list_filter(string_split(c, chr(10)), lambda l: contains(l, '文件: ' || num) AND contains(l, '会议材料'))[1] AS b FROM n)
SELECT doc_id, CASE WHEN coalesce(a, trim(b)) IS NOT NULL THEN replace('{C.FOCUS.replace(chr(10), "|")}', '|', chr(10)) ELSE '' END AS hint, coalesce(a, trim(b)) AS name FROM m""")
def ctx_focused(s, d):
    i = F.col("doc_id")
    rows = x.table(s, d, "documents").select("doc_id", F.concat(x.pick(PAPERS, i), F.lit("\n"), x.pick(PAPERS, F.floor(i / 4))).alias("c"), F.concat(x.pick(PAPER_QUESTIONS, F.floor(i / 3))).alias("q"))
    told = rows.withColumn("whole", context.focused(F.col("c"), F.col("q")))
    head, tail = C.FOCUS.split("{name}")
    hint = F.substr("whole", F.lit(1), F.length("whole") - F.length("c"))
    name = F.when(hint != "", F.substr(hint, F.lit(len(head) + 1), F.length(hint) - len(head) - len(tail)))
    return told.select("doc_id", F.when(hint != "", F.concat(F.substr(hint, F.lit(1), F.lit(len(head))), F.lit("{name}"), F.right(hint, F.lit(len(tail))))).otherwise("").alias("hint"), name.alias("name"))


@query("SELECT substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) AS conv_id, source AS title, 'now' AS created_at, 'now' AS updated_at FROM documents")
def cv_created(s, d):
    return conversation.created(x.table(s, d, "documents").select(F.col("doc_id").alias("request"), F.col("source").alias("title")), F.lit("now"))


def turns(s, d):
    return x.table(s, d, "conversations").withColumnRenamed("text", "content")


@query("SELECT conv_id, count(*) AS messages, string_agg(role || ':' || text, '|' ORDER BY turn) AS whole FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels) GROUP BY conv_id")
def cv_got(s, d):
    asked = x.table(s, d, "labels").select(F.col("doc_id").alias("conv_id"))
    return conversation.got(turns(s, d), asked).select("conv_id", "messages", F.array_join(F.transform("turns", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("whole"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def cv_deleted(s, d):
    return conversation.deleted(turns(s, d), x.table(s, d, "labels").select(F.col("doc_id").alias("conv_id")).distinct()).select("conv_id", "turn")


KEYWORDS = ["the", "er", "承载力"]
BLOCK = "'intro<details><summary> chunk ' || item_id || ' </summary>' || chr(10) || '```' || chr(10) || text || chr(10) || '```</details><details><summary>none</summary></details>'"


@query(f"""WITH r AS (SELECT item_id AS question_id, text AS code FROM benchmark) SELECT question_id, 1 AS place, 'chunk ' || question_id AS summary, substring(regexp_replace(code, '^\\s+|\\s+$', '', 'g'), 1, 400) AS excerpt, list_filter({x.literal(KEYWORDS)}, lambda k: contains(code, k)) AS keywords FROM r UNION ALL SELECT question_id, 2, 'none', '', []::VARCHAR[] FROM r""")
def ev_excerpts(s, d):
    report = F.concat(F.lit("intro<details><summary> chunk "), F.col("item_id").cast("string"), F.lit(" </summary>\n```\n"), "text", F.lit("\n```</details><details><summary>none</summary></details>"))
    return sinks.excerpts(x.table(s, d, "benchmark").select(F.col("item_id").alias("question_id"), report.alias("report")), "report", KEYWORDS)
