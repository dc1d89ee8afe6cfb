"""Queries over files: sources, metadata, chunks and the registry."""

from __future__ import annotations


from pyspark.sql import functions as F

from docloom import config as C
from docloom.functions import text as t
from docloom.operators import chunking, layout, metadata, registry
from docloom.plans import fixtures as x
from docloom.sources import readers, shared

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def case(c: str, labels: dict[str, list[str]], flags: str = "") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {x.literal('|'.join(f'(?:{p})' for p in ps))}{flags}) THEN {x.literal(k)}" for k, ps in labels.items()) + " END"


def first(c: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {x.literal(p)}), '')" for p in patterns) + ")"


EXT = "lower(regexp_extract(file_name, '[^.](\\.[^.]*)$', 1))"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LIST = lambda words: "(" + ", ".join(map(x.literal, words)) + ")"


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def src_content_hash(s, d):
    return registry.identified(x.table(s, d, "documents"), "text").select("doc_id", "file_hash")


@query(f"WITH {x.FILES} SELECT doc_id, file_name FROM files WHERE {EXT} IN {LIST(C.CLI_FORMATS)}")
def src_cli_formats(s, d):
    return x.files(s, d).where(t.extension(F.col("file_name")).isin(*C.CLI_FORMATS)).select("doc_id", "file_name")


@query(f"""WITH {x.FILES} SELECT doc_id, CASE WHEN e = '.pdf' THEN 'pdf' WHEN e IN ('.txt', '.md') THEN 'plain' WHEN e IN ('.xls', '.xlsx') THEN 'sheet' WHEN e IN ('.ppt', '.pptx') THEN 'slides'
  WHEN e IN ('.doc', '.docx', '.wps') THEN 'word' WHEN e = '.ofd' THEN 'ofd' END AS reader FROM (SELECT *, {EXT} AS e FROM files)""")
def src_dispatch(s, d):
    return x.files(s, d).select("doc_id", readers.dispatch(t.extension(F.col("file_name"))).alias("reader"))


@query(f"WITH {x.FILES} SELECT doc_id, {EXT} IN {LIST(C.UPLOAD_FORMATS)} AS accepted, replace(file_name, ' ', '_') AS stored_name FROM files")
def src_upload(s, d):
    return metadata.upload_name(x.files(s, d)).select("doc_id", "accepted", "stored_name")


@query("""WITH p AS (SELECT conv_id AS doc, turn + 1 AS page_num, length(text) AS n FROM conversations),
c AS (SELECT doc, count(*) AS pages, count_if(n < 150) AS low, count_if(page_num <= 15) AS early, count_if(page_num <= 15 AND n < 150) AS early_low FROM p GROUP BY doc)
SELECT doc, pages, CASE WHEN s THEN pages ELSE low END AS needs_ocr, s OR low * 2 > pages AS is_scanned, CASE WHEN s THEN 'sampled' ELSE 'full' END AS parse_mode
FROM (SELECT *, CAST(early > 0 AND early_low >= 0.7::DOUBLE * early AS BOOLEAN) AS s FROM c)""")
def src_scan_rule(s, d):
    return chunking.scan_rule(x.table(s, d, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page_num"), F.length("text").alias("char_count")), few=150)


@query("""SELECT a.conv_id, a.turn, CASE WHEN o IS NULL THEN a.text WHEN trim(a.text) <> '' THEN a.text || chr(10) || o ELSE o END AS text,
  CAST(length(CASE WHEN o IS NULL THEN a.text WHEN trim(a.text) <> '' THEN a.text || chr(10) || o ELSE o END) AS INTEGER) AS char_count, o IS NULL AND length(a.text) < 50 AS needs_ocr
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS text, CASE WHEN turn % 3 = 0 THEN 'read ' || turn END AS o FROM conversations) a""")
def src_ocr_merge(s, d):
    pages = x.table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")).alias("text"))
    read = pages.where("turn % 3 = 0").select("conv_id", "turn", F.concat(F.lit("read "), F.col("turn").cast("string")).alias("ocr_text")).distinct()
    return chunking.merge_ocr(pages, read, ["conv_id", "turn"])


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def src_html_text(s, d):
    return x.table(s, d, "pages").select("page_id", readers.visible_html(F.col("html")).alias("text"))


@query(f"""WITH {x.FILES} SELECT doc_id, CASE WHEN p[1] IN {LIST(C.DOMAINS)} THEN p[1] END AS domain, p[2] AS category, p[3] AS subcategory, CAST(len(p) - 1 AS INTEGER) AS path_depth,
  CAST(list_filter(p, lambda q: regexp_full_match(q, '(19|20)[0-9]{{2}}'))[1] AS INTEGER) AS path_year FROM (SELECT doc_id, string_split(relative_path, '/') AS p FROM files)""")
def meta_path(s, d):
    return metadata.path_metadata(x.files(s, d)).select("doc_id", "domain", "category", "subcategory", "path_depth", "path_year")


DRAWING = x.literal(C.DRAWING_CODE)
FILENAME = f"""{first("file_name", C.DOC_NUMBERS)} AS doc_number, {case("file_name", C.PUBLISH_LEVELS)} AS publish_level,
  coalesce({case("file_name", C.VOLTAGES, ", 'i'")}, nullif(regexp_extract(file_name, {DRAWING}, 1), '') || 'kV') AS voltage_level,
  coalesce({case("file_name", C.DISCIPLINES)}, CASE regexp_extract(file_name, {DRAWING}, 3) {" ".join(f"WHEN {x.literal(k)} THEN {x.literal(v)}" for k, v in C.DRAWING_DISCIPLINES.items())} END) AS discipline,
  {case("file_name", C.EQUIPMENT)} AS equipment_type, CAST(nullif(regexp_extract(file_name, '((?:19|20)[0-9]{{2}})', 1), '') AS INTEGER) AS year,
  CASE WHEN regexp_matches(file_name, '福州|榕') THEN '福州' WHEN regexp_matches(file_name, '福建|闽') THEN '福建' ELSE '全国' END AS region, nullif(regexp_extract(file_name, {DRAWING}), '') AS drawing_code"""
META = ["doc_number", "publish_level", "voltage_level", "discipline", "equipment_type", "year", "region", "drawing_code"]


@query(f"WITH {x.FILES} SELECT doc_id, {FILENAME} FROM files")
def meta_filename(s, d):
    return metadata.filename_metadata(x.files(s, d)).select("doc_id", *META)


FORMAT = "CASE " + " ".join(f"WHEN {EXT} IN {LIST(v)} THEN '{k}'" for k, v in C.FORMATS.items()) + " ELSE 'other' END"
IS_DRAWING = f"({EXT} IN {LIST(C.FORMATS['drawing'])} OR ({EXT} = '.pdf' AND regexp_matches(lower(relative_path), {x.literal('|'.join(C.DRAWING_PATHS))})))"


@query(f"WITH {x.FILES} SELECT doc_id, {EXT} AS extension, {FORMAT} AS format_group, {EXT} IN {LIST(C.FORMATS['archive'])} AS is_archive, {IS_DRAWING} AS is_drawing FROM files")
def meta_format(s, d):
    return metadata.format_class(x.files(s, d)).select("doc_id", "extension", "format_group", "is_archive", "is_drawing")


INGEST = f"""{x.FILES}, ingest AS (
  SELECT doc_id, text, {FILENAME}, CASE WHEN p[1] IN {LIST(C.DOMAINS)} THEN p[1] ELSE '' END AS domain, coalesce(p[2], '') AS category, {EXT} IN ('.dwg', '.dxf') AS is_drawing, CASE WHEN {EXT} IN ('.dwg', '.dxf') THEN 'drawing' ELSE 'document' END AS format_group
  FROM (SELECT *, string_split(relative_path, '/') AS p FROM files))"""


@query(f"WITH {INGEST} SELECT doc_id, domain, category, {', '.join(META)}, is_drawing, format_group FROM ingest")
def meta_ingest(s, d):
    return metadata.ingest_metadata(x.files(s, d)).select("doc_id", "domain", "category", *META, "is_drawing", "format_group")


MTEXT = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} <> {'0' if c == 'year' else repr('')} THEN '{n}:' || {c} END" for n, c in metadata.LABELS) + ")"


@query(f"WITH {INGEST} SELECT doc_id, {MTEXT} AS meta_text, CASE WHEN {MTEXT} <> '' THEN '[' || {MTEXT} || '] ' || text ELSE text END AS embedding_text FROM ingest")
def meta_text(s, d):
    return metadata.embedding_text(metadata.ingest_metadata(x.files(s, d))).select("doc_id", "meta_text", "embedding_text")


@query(f"""WITH {INGEST} SELECT doc_id, domain, category, {", ".join(f"coalesce({c}, 0) AS {c}" if c == "year" else f"coalesce(nullif({c}, ''), '{C.NATIONWIDE if c == 'region' else ''}') AS {c}" for c in META)}, is_drawing, '' AS project_stage FROM ingest""")
def snk_stored_chunk(s, d):
    return metadata.stored_chunk(metadata.ingest_metadata(x.files(s, d)).select("doc_id", "domain", "category", *META, "is_drawing"))


@query("SELECT doc_id, CASE WHEN n_chars < 1500 THEN 'full_document' WHEN doc_id % 3 + 1 <= 1 THEN 'single_page' ELSE 'semantic' END AS chunk_strategy FROM documents")
def chk_strategy(s, d):
    return x.table(s, d, "documents").select("doc_id", chunking.strategy(F.col("n_chars"), F.col("doc_id") % 3 + 1).alias("chunk_strategy"))


@query(f"SELECT doc_id, sha256(text) || '_0' AS chunk_id, {STRIP.format('text')} AS chunk_text, CAST(length({STRIP.format('text')}) AS INTEGER) AS char_count FROM documents WHERE length(text) < 1500")
def chk_full_document(s, d):
    rows = chunking.text_chunks(x.files(s, d)).where("chunk_strategy = 'full_document'")
    return rows.select("doc_id", "chunk_id", "chunk_text", F.length("chunk_text").alias("char_count"))


@query("""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS file_hash, 'f' || conv_id AS file_name, CAST(turn + 1 AS INTEGER) AS page_num, CASE WHEN turn % 4 = 0 THEN '' ELSE text END AS text FROM conversations)
SELECT file_hash, page_num, file_hash || '_' || page_num AS chunk_id, page_num - 1 AS chunk_index, CAST(count(*) OVER (PARTITION BY file_hash) AS INTEGER) AS total_chunks, CASE WHEN text <> '' THEN text ELSE '[第' || page_num || '页] ' || file_name END AS chunk_text,
  CAST(length(text) AS INTEGER) AS char_count, 'single_page' AS chunk_strategy FROM p""")
def chk_pages(s, d):
    c = x.table(s, d, "conversations")
    return chunking.page_chunks(c.select(F.col("conv_id").cast("string").alias("file_hash"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file_name"), (F.col("turn") + 1).cast("int").alias("page_num"), F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("text")).alias("text")))


@query(f"WITH {x.CHUNKS} SELECT doc_id, chunk_index, text AS chunk_text FROM chunks")
def chk_forced_windows(s, d):
    return chunking.forced_split(x.table(s, d, "documents")).select("doc_id", "chunk_index", "chunk_text")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def split_sql(units: str, size: int = C.CHUNK_CHARS, overlap: int = C.CHUNK_OVERLAP, force: int | None = None) -> str:
    """CTEs that split the rows of units (uid, t) by separators, level by level: pieces (uid, k from 1, n, t) come out as l0.
    force: units over so many characters go through windows instead.

    A level packs the parts of a unit from left to right, a row for each part; parts that are too long are the next level's
    units, and their pieces take their place.
    """
    levels, out = range(len(C.SEPARATORS)), [f"u0 AS (SELECT uid, t FROM {units})"]
    for i in levels:
        mark = C.SEPARATORS[i]
        windowed = str(not mark).lower() if force is None else f"({str(not mark).lower()} OR length(t) > {force})"
        out.append(f"b{i} AS (SELECT uid, t, length(t) <= {size} AS short, length(t) > {size} AND {windowed} AS forced FROM u{i})")
        if mark:
            out.append(f"p{i} AS (SELECT uid, string_split(t, {quoted(mark)}) AS parts FROM b{i} WHERE NOT short AND NOT forced)")
            longer = f"CASE WHEN held <> '' THEN held || {quoted(mark)} || parts[i + 1] ELSE parts[i + 1] END"
            out.append(f"""s{i} AS (SELECT uid, parts, 0 AS i, '' AS held, NULL::VARCHAR AS done, NULL::VARCHAR AS long FROM p{i} UNION ALL
  SELECT uid, parts, i + 1, CASE WHEN length({longer}) <= {size} THEN {longer} WHEN length(parts[i + 1]) <= {size} THEN parts[i + 1] ELSE '' END,
    CASE WHEN length({longer}) > {size} THEN nullif(held, '') END, CASE WHEN length({longer}) > {size} AND length(parts[i + 1]) > {size} THEN parts[i + 1] END FROM s{i} WHERE i < len(parts))""")
            out.append(f"u{i + 1} AS (SELECT uid || '.' || i AS uid, long AS t FROM s{i} WHERE long IS NOT NULL)")
    for i in reversed(levels):
        windows = f"SELECT uid, g + 1 AS k, 0 AS m, substring(t, g * {size - overlap} + 1, {size}) AS t FROM (SELECT uid, t, unnest(range(CAST(greatest(ceil((length(t) - {size}) / {size - overlap}.0), 0) AS BIGINT) + 1)) AS g FROM b{i} WHERE forced)"
        rows = [f"SELECT uid, 1 AS k, 0 AS m, t FROM b{i} WHERE short", windows]
        packed = ""
        if C.SEPARATORS[i]:
            packed = f"""e{i} AS (SELECT uid, 2 * i AS k, 0 AS m, done AS t FROM s{i} WHERE done IS NOT NULL UNION ALL SELECT uid, 2 * i + 2, 0, held FROM s{i} WHERE i = len(parts) AND held <> ''
  UNION ALL SELECT s{i}.uid, 2 * s{i}.i + 1, l{i + 1}.k, l{i + 1}.t FROM s{i} JOIN l{i + 1} ON l{i + 1}.uid = s{i}.uid || '.' || s{i}.i WHERE s{i}.long IS NOT NULL),
q{i} AS (SELECT uid, k, m, coalesce(right(lag(t) OVER (PARTITION BY uid ORDER BY k, m), {overlap}) || chr(10), '') || t AS t FROM e{i}), """
            rows.append(f"SELECT uid, k, m, t FROM q{i}")
        out.append(f"{packed}l{i} AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY k, m) AS k, count(*) OVER (PARTITION BY uid) AS n, t FROM ({' UNION ALL '.join(rows)}))")
    return ",\n".join(out)


@query(f"""WITH RECURSIVE {x.FILES}, units AS (SELECT CAST(doc_id AS VARCHAR) AS uid, text AS t FROM files WHERE length(text) >= {C.FULL_CHARS}), {split_sql('units')}
SELECT doc_id, file_hash || '_0' AS chunk_id, 0 AS chunk_index, 1 AS total_chunks, {STRIP.format('text')} AS chunk_text, 'full_document' AS chunk_strategy FROM files WHERE length(text) < {C.FULL_CHARS} UNION ALL
SELECT doc_id, file_hash || '_' || (k - 1), CAST(k - 1 AS INTEGER), CAST(n AS INTEGER), {STRIP.format('t')}, 'semantic' FROM l0 JOIN files ON uid = CAST(doc_id AS VARCHAR) WHERE {STRIP.format('t')} <> ''""")
def chk_semantic(s, d):
    """The recursive split; golden and property tests stand for an oracle."""
    return chunking.text_chunks(x.files(s, d)).select("doc_id", "chunk_id", "chunk_index", "total_chunks", "chunk_text", "chunk_strategy")


@query(f"""WITH {x.FILES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '[CAD图纸] ' || coalesce(nullif(regexp_extract(file_name, {DRAWING}), ''), '') || ' ' || file_name END AS chunk_text FROM files""")
def chk_drawing(s, d):
    rows = metadata.filename_metadata(x.files(s, d))
    return rows.select("doc_id", chunking.drawing_text(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.col("drawing_code"), F.col("file_name")).alias("chunk_text"))


ALL = "doc_id, file_hash, file_name, status, domain"


@query(f"WITH {x.REGISTRY} SELECT {ALL} FROM registry WHERE status = 'completed'")
def reg_by_status(s, d):
    return registry.by_status(x.registry(s, d)).select(*ALL.split(", "))


@query(f"WITH {x.REGISTRY} SELECT {ALL} FROM registry WHERE status = 'completed' AND file_name ILIKE '%gb%2008%'")
def reg_name_like(s, d):
    return registry.by_name(x.registry(s, d), "gb%2008").select(*ALL.split(", "))


@query(f"WITH {x.REGISTRY} SELECT {ALL} FROM registry WHERE status = 'completed' AND file_name = 'noext~32'")
def reg_name_exact(s, d):
    return registry.by_name(x.registry(s, d), "noext~32", exact=True).select(*ALL.split(", "))


@query(f"WITH {x.REGISTRY} SELECT count(*) AS files FROM registry WHERE status = 'completed'")
def reg_count(s, d):
    return registry.by_status(x.registry(s, d)).agg(F.count("*").alias("files"))


@query(f"""WITH {x.REGISTRY}, {x.PRESENT}, page AS (SELECT * FROM registry WHERE domain = '配电' ORDER BY updated_at DESC, file_hash LIMIT 50 OFFSET 20)
SELECT {ALL}, updated_at, CASE WHEN {x.OWN_PATH} IS NOT NULL THEN {x.OWN_PATH} IN (SELECT path FROM present) END AS file_exists FROM page""")
def reg_listing(s, d):
    rows = x.registry(s, d)
    return registry.listing(rows, x.present(rows), domain="配电", limit=50, offset=20).select(*ALL.split(", "), "updated_at", "file_exists")


SUMS = "count(*) AS files, CAST(coalesce(sum(chunks_count), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(chars_count), 0) AS BIGINT) AS chars"


@query(f"WITH {x.REGISTRY} SELECT 'status' AS section, status AS name, {SUMS} FROM registry GROUP BY status UNION ALL SELECT 'domain', domain, {SUMS} FROM registry WHERE status = 'completed' GROUP BY domain UNION ALL SELECT 'total', '', {SUMS} FROM registry")
def reg_summary(s, d):
    return registry.summary(x.registry(s, d))


@query(f"WITH {x.REGISTRY}, {x.PRESENT} SELECT {ALL} FROM registry WHERE status NOT IN ('deleted', 'pending', 'processing') AND NOT EXISTS (SELECT 1 FROM present WHERE path = {x.OWN_PATH})")
def reg_orphans(s, d):
    rows = x.registry(s, d)
    return registry.orphans(rows, x.present(rows)).select(*ALL.split(", "))


@query(f"WITH {x.REGISTRY} SELECT doc_id, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'processing' THEN '' ELSE error_message END AS error_message FROM registry")
def reg_recovered(s, d):
    return registry.recovered(x.registry(s, d)).select("doc_id", "status", "error_message")


@query(f"""WITH {x.REGISTRY}, i AS (SELECT CASE doc_id % 4 WHEN 0 THEN upper(file_hash) WHEN 1 THEN original_path WHEN 2 THEN file_name ELSE 'nothing' || doc_id END AS identifier FROM registry)
SELECT i.identifier, CASE WHEN regexp_full_match(i.identifier, '[0-9a-fA-F]{{64}}') THEN lower(i.identifier) ELSE coalesce((SELECT min(file_hash) FROM registry r WHERE r.original_path = i.identifier), (SELECT min(file_hash) FROM registry r WHERE r.file_name = i.identifier)) END AS file_hash FROM i""")
def reg_resolved(s, d):
    rows, k = x.registry(s, d), F.col("doc_id") % 4
    asked = rows.select(F.when(k == 0, F.upper("file_hash")).when(k == 1, F.col("original_path")).when(k == 2, F.col("file_name")).otherwise(F.concat(F.lit("nothing"), F.col("doc_id").cast("string"))).alias("identifier"))
    return registry.resolved(asked, rows)


@query(f"WITH {x.REGISTRY} SELECT doc_id, file_hash FROM registry WHERE file_hash NOT IN (SELECT file_hash FROM registry WHERE status = 'completed')")
def reg_to_ingest(s, d):
    rows = x.registry(s, d)
    return registry.to_ingest(rows, rows).select("doc_id", "file_hash")


@query(f"""WITH {x.FILES}, f AS (SELECT CASE WHEN p[1] IN {LIST(C.DOMAINS)} THEN p[1] END AS domain, e AS extension, g FROM (SELECT string_split(relative_path, '/') AS p, {EXT} AS e, {FORMAT} AS g FROM files))
SELECT 'domain' AS section, coalesce(domain, '未分类') AS name, count(*) AS files FROM f GROUP BY ALL UNION ALL (SELECT 'extension', extension, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, extension LIMIT 15) UNION ALL SELECT 'format', g, count(*) FROM f GROUP BY ALL""")
def reg_walk_stats(s, d):
    return registry.walk_stats(metadata.format_class(metadata.path_metadata(x.files(s, d))))


@query(f"""WITH {x.REGISTRY}, {x.PRESENT}, f AS (SELECT domain, category, coalesce({x.OWN_PATH} IN (SELECT path FROM present), false) AS e FROM registry)
SELECT domain, category, count(*) AS files, count_if(NOT e) AS missing FROM f GROUP BY ROLLUP (domain, category)""")
def reg_tree(s, d):
    rows = x.registry(s, d)
    marked = rows.join(x.present(rows).withColumn("there", F.lit(True)), registry.path_of() == F.col("path"), "left").withColumn("file_exists", F.coalesce("there", F.lit(False)))
    return registry.tree(marked).select("domain", "category", "files", F.col("missing").cast("long").alias("missing"))


@query(f"WITH {x.REGISTRY} SELECT {ALL} FROM registry WHERE status <> 'deleted' AND (contains(lower(file_name), 'gb') OR contains(lower(coalesce(doc_number, '')), 'gb'))")
def reg_shown(s, d):
    return registry.shown(x.registry(s, d), words=" GB ").select(*ALL.split(", "))


STATES = {"click": "processing", "view": "pending", "purchase": "completed", "signup": "failed", "logout": "deleted"}


@query(f"""WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS events FROM events)
SELECT user_id, event_type AS last_event, events, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())} ELSE 'pending' END AS status FROM l WHERE n = 1""")
def reg_folded_events(s, d):
    return registry.folded(x.table(s, d, "events"), "user_id", "event_type", "ts", STATES, "event_id")


@query(f"WITH {x.REGISTRY} SELECT count(*) AS total, count_if(status = 'completed') AS success, count(*) - count_if(status = 'completed') AS failed, round(count_if(status = 'completed') / count(*), 4) AS success_rate FROM registry")
def reg_batch_result(s, d):
    return registry.batch_result(x.registry(s, d))


@query(f"""WITH {x.REGISTRY}, p AS (SELECT * FROM registry WHERE status IN ('pending', 'failed', 'completed'))
SELECT 'start' AS event, '' AS file_hash, count(*) AS n FROM p UNION ALL SELECT 'file_start', file_hash, 1 FROM p UNION ALL SELECT CASE WHEN status = 'failed' THEN 'file_error' ELSE 'file_done' END, file_hash, 1 FROM p UNION ALL SELECT 'done', '', count_if(status <> 'failed') FROM p""")
def reg_recovery_log(s, d):
    return registry.recovery_log(x.registry(s, d))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1")
def snk_latest(s, d):
    rows = x.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return registry.latest(rows.withColumn("seq", F.struct("l_linenumber", "l_partkey", "l_quantity")), "l_orderkey").drop("seq")


@query(f"""WITH {x.REGISTRY}, c AS (SELECT file_hash, CASE WHEN doc_id % 2 = 0 THEN 'completed' END AS status, CASE WHEN doc_id % 6 = 0 THEN 99 END AS chunks_count FROM registry WHERE doc_id % 3 = 0 UNION ALL SELECT 'new', 'completed', 5)
SELECT file_hash, r.file_name, coalesce(c.status, r.status) AS status, CAST(coalesce(c.chunks_count, r.chunks_count) AS BIGINT) AS chunks_count, CASE WHEN c.status = 'completed' THEN '' ELSE r.error_message END AS error_message,
  CAST(coalesce(r.reindex_count, 0) + CASE WHEN c.status = 'completed' AND r.status = 'completed' THEN 1 ELSE 0 END AS BIGINT) AS reindex_count, CASE WHEN c.file_hash IS NOT NULL THEN 'now' ELSE r.updated_at END AS updated_at
FROM registry r FULL JOIN c USING (file_hash)""")
def snk_upsert(s, d):
    rows = x.registry(s, d)
    new = rows.where("doc_id % 3 = 0").select("file_hash", F.when(F.col("doc_id") % 2 == 0, "completed").alias("status"), F.when(F.col("doc_id") % 6 == 0, 99).cast("long").alias("chunks_count"))
    new = new.union(s.createDataFrame([("new", "completed", 5)], "file_hash string, status string, chunks_count long"))
    return registry.upsert(rows, new, F.lit("now")).select("file_hash", "file_name", "status", "chunks_count", "error_message", "reindex_count", "updated_at")


@query(f"WITH {x.CHUNKS} SELECT chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def snk_deleted(s, d):
    return registry.deleted(x.chunks(s, d), x.table(s, d, "labels").where("toxic = 1"), "doc_id").select("chunk_id")




@query(f"""WITH {x.FILES}, parts AS (SELECT doc_id, 0 AS part, text AS t FROM files UNION ALL SELECT doc_id, 1, 'read ' || text FROM files),
w AS (SELECT doc_id, part, t, unnest(range(CAST(greatest(ceil((length(t) - 1536) / 1344.0), 0) AS BIGINT) + 1)) AS i FROM parts WHERE length(t) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, i) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, substring(t, i * 1344 + 1, 1536) AS chunk_text FROM w""")
def chk_progressive(s, d):
    files = x.files(s, d)
    parts = files.select("doc_id", F.lit(0).alias("part"), "text").union(files.select("doc_id", F.lit(1), F.concat(F.lit("read "), "text")))
    rows = chunking.forced_split(parts).withColumnRenamed("chunk_index", "place")
    return chunking.numbered(rows, "doc_id", ["part", "place"]).select("doc_id", "chunk_index", "total_chunks", "chunk_text")


#: Paragraphs of long texts in batches, a row for each paragraph.
BATCHES = """pg AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM files WHERE length(text) > 15000),
ba AS (SELECT doc_id, parts, 0 AS i, 0 AS batch, CAST(0 AS BIGINT) AS size FROM pg UNION ALL
  SELECT doc_id, parts, i + 1, CASE WHEN size > 0 AND size + length(parts[i + 1]) >= 30000 THEN batch + 1 ELSE batch END, CASE WHEN size > 0 AND size + length(parts[i + 1]) >= 30000 THEN 0 ELSE size END + length(parts[i + 1]) + 2 FROM ba WHERE i < len(parts)),
units AS (SELECT doc_id || ' ' || batch AS uid, string_agg(parts[i], chr(10) || chr(10) ORDER BY i) AS t FROM ba WHERE i > 0 GROUP BY doc_id, batch)"""


@query(f"""WITH RECURSIVE {x.FILES}, {BATCHES}, {split_sql('units', force=C.FORCE_CHARS)}, r AS (SELECT file_hash, split_part(uid, ' ', 2)::INT AS batch, k, {STRIP.format('t')} AS chunk_text FROM l0 JOIN files ON split_part(uid, ' ', 1) = CAST(doc_id AS VARCHAR) WHERE {STRIP.format('t')} <> ''),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_hash ORDER BY batch, k) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY file_hash) AS INTEGER) AS total_chunks FROM r) SELECT file_hash, file_hash || '_' || chunk_index AS chunk_id, chunk_index, total_chunks, chunk_text FROM o""")
def chk_long_texts(s, d):
    """Very long texts in batches of paragraphs; the bound is lowered to the length of the longest here."""
    return chunking.long_text_chunks(x.files(s, d).drop("n_chars"), most=15_000).select("file_hash", "chunk_id", "chunk_index", "total_chunks", "chunk_text")


@query(f"WITH {x.REGISTRY} SELECT {ALL} FROM registry WHERE file_hash IN (SELECT file_hash FROM registry WHERE doc_id % 50 = 0)")
def reg_by_hash(s, d):
    rows = x.registry(s, d)
    return registry.by_hash(rows, rows.where("doc_id % 50 = 0")).select(*ALL.split(", "))


@query(f"WITH {x.REGISTRY} SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'deleted' ELSE status END AS status, CASE WHEN doc_id % 50 = 0 THEN CAST(0 AS BIGINT) ELSE chunks_count END AS chunks_count, CASE WHEN doc_id % 50 = 0 THEN 'now' ELSE updated_at END AS updated_at FROM registry")
def reg_removed(s, d):
    rows = x.registry(s, d)
    return registry.removed(rows, rows, rows.where("doc_id % 50 = 0"), F.lit("now"))[0].select("doc_id", "status", "chunks_count", "updated_at")


@query(f"""WITH {x.REGISTRY}, have AS (SELECT file_hash, '/x/' || file_name AS file_path FROM registry WHERE doc_id % 3 = 0),
ask AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN file_hash END AS file_hash, '/x/' || file_name AS file_path, file_name FROM registry)
SELECT query_id, coalesce((SELECT min(h.file_hash) FROM have h WHERE h.file_hash = ask.file_hash), (SELECT min(h.file_hash) FROM have h WHERE h.file_path = ask.file_path), (SELECT min(r.file_hash) FROM registry r JOIN have h USING (file_hash) WHERE r.status = 'completed' AND '/x/' || r.file_name = '/x/' || regexp_extract(ask.file_path, '[^/]*$'))) AS file_hash FROM ask""")
def ctx_document_of(s, d):
    rows = x.registry(s, d)
    have = rows.where("doc_id % 3 = 0").select("file_hash", F.concat(F.lit("/x/"), "file_name").alias("file_path"))
    asked = rows.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 2 == 0, F.col("file_hash")).alias("file_hash"), F.concat(F.lit("/x/"), "file_name").alias("file_path"))
    return registry.document_of(asked, rows, have)


# --- layout blocks: every word of the documents on pages of a heading over two columns of paragraphs


#: Bytes of documents as stored whose words are put in order by one task: half a million words or so.
PART = 2 << 20


def page_words(s, d):
    """240 words a page; a paragraph has 4 to 8 lines, by document and column. Documents are dealt before they become words, so the words stand by page without a shuffle of their own."""
    i, p = F.col("i"), F.col("i") % 240
    q = p - 6
    column = F.when(p < 6, 0).otherwise(F.floor(q / 117))
    line, place = F.floor(q % 117 / 6), F.when(p < 6, p).otherwise(q % 117 % 6)
    top = F.when(p < 6, 50).otherwise(80 + line * 12 + 14 * F.floor(line / (4 + (F.col("doc_id") + column) % 5)))
    left = 50 + column * 270 + place * 40
    texts = x.table(s, d, "documents").select("doc_id", "text").repartition(shared.parts(s, f"{d}/documents.parquet", PART), "doc_id")
    rows = texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("i", "text"))
    rows = rows.select("doc_id", (F.floor(i / 240) + 1).cast("int").alias("page_num"), F.col("i").alias("seq"), left.alias("x0"), top.alias("y0"), (left + 30 + F.length("text") % 8).alias("x1"), (top + 10).alias("y1"), "text")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")})


PAGE_WORDS = """pw AS (SELECT doc_id, i, word, i % 240 AS p, i % 240 - 6 AS q FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents))),
pc AS (SELECT *, CASE WHEN p < 6 THEN 0 ELSE q // 117 END AS col, q % 117 // 6 AS line, CASE WHEN p < 6 THEN p ELSE q % 117 % 6 END AS place FROM pw),
pl AS (SELECT *, CASE WHEN p < 6 THEN 50 ELSE 80 + line * 12 + 14 * (line // (4 + (doc_id + col) % 5)) END::DOUBLE AS y0, (50 + col * 270 + place * 40)::DOUBLE AS x0 FROM pc),
c0 AS (SELECT doc_id, CAST(i // 240 + 1 AS INTEGER) AS page_num, i AS seq, x0, y0, x0 + 30 + length(word) % 8 AS x1, y0 + 10 AS y1, word, median(CAST(10 AS DOUBLE)) OVER (PARTITION BY doc_id, i // 240) AS height, []::INTEGER[] AS region FROM pl)"""


def cut_sql(n: int, low: str, high: str, least: float) -> str:
    own = f"(PARTITION BY doc_id, page_num, region ORDER BY {low}, {high}, seq"
    return f"""c{n} AS (SELECT * EXCLUDE (fresh) REPLACE (list_append(region, CAST(sum(fresh) OVER {own} ROWS UNBOUNDED PRECEDING) AS INTEGER)) AS region)
  FROM (SELECT *, CASE WHEN {low} - max({high}) OVER {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > height * {least}::DOUBLE THEN 1 ELSE 0 END AS fresh FROM c{n - 1}))"""


CUTS = ", ".join(cut_sql(n, *(("y0", "y1", layout.BELOW) if n % 2 else ("x0", "x1", layout.BESIDE))) for n in range(1, 2 * layout.ROUNDS + 1))
IN_REGION = "OVER (PARTITION BY doc_id, page_num, region ORDER BY y0, y1, seq"


@query(f"""WITH {PAGE_WORDS}, {CUTS}, nl AS (SELECT *, CASE WHEN (y0 + y1) / 2 > max(y1) {IN_REGION} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM c{2 * layout.ROUNDS}),
ln AS (SELECT *, sum(fresh) {IN_REGION} ROWS UNBOUNDED PRECEDING) AS no FROM nl), li AS (SELECT doc_id, page_num, region, no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(word, ' ' ORDER BY x0, seq) AS text FROM ln GROUP BY ALL),
bl AS (SELECT doc_id, page_num, region, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(count(*) AS INTEGER) AS n_lines, string_agg(text, chr(10) ORDER BY no) AS text FROM li GROUP BY ALL)
SELECT doc_id, page_num, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY region) AS INTEGER) AS block_no, x0, y0, x1, y1, n_lines, text, CAST(0 AS INTEGER) AS block_type FROM bl""")
def src_layout(s, d):
    return layout.blocks(page_words(s, d), ["doc_id", "page_num"])
