"""Queries that run a stream over a table to its end, and their SQL over the table as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import config as C
from docloom.operators import chunking, registry
from docloom.plans import fixtures as x
from docloom.plans.retrieval import SQL as RETRIEVAL
from docloom.sources import shared
from docloom.streaming import conversations, pages, progress, status

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def streamed(s, d, name: str):
    """A table's files as a stream; the pattern makes one file as good as a folder of them."""
    table = x.table(s, d, name)
    return s.readStream.schema(table.schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/{name}.parque[t]")


@query(RETRIEVAL["cv_folded"])
def stream_conversations(s, d):
    """Conversations folded turn by turn as a stream."""
    out = shared.fresh(s, "conversations")
    conversations.written(streamed(s, d, "conversations").withColumnRenamed("text", "content"), out, f"{out}-checkpoint", 300).awaitTermination()
    return conversations.read(s, out).select("conv_id", "kept", "summary", "total_tokens", "compressions")


#: Which status an event asks for.
ASKED = {"signup": "pending", "view": "processing", "purchase": "completed", "error": "failed", "click": "deleted"}
PATIENCE, LATE = 2 * 3600, 3600


def allowed(status_: str, asked: str) -> str:
    return "CASE " + status_ + " " + " ".join(f"WHEN '{k}' THEN {asked} IN ({', '.join(repr(v) for v in vs)})" for k, vs in C.TRANSITIONS.items()) + " END"


@query(f"""WITH RECURSIVE w AS (SELECT epoch_ms(max(ts)) - {LATE * 1000} AS wm FROM events),
e AS (SELECT user_id, epoch_us(ts) AS tm, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ASKED.items())} END AS asked, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
due AS (SELECT e.* FROM e, w WHERE tm < wm * 1000 UNION ALL SELECT user_id, (SELECT wm * 1000 FROM w), NULL, count(*) FILTER (WHERE tm < (SELECT wm * 1000 FROM w)) + 1 FROM e GROUP BY user_id),
st AS (SELECT DISTINCT user_id, 0::BIGINT AS n, '' AS status, 0::BIGINT AS since, 0 AS accepted, 0 AS rejected, 0 AS recovered FROM e UNION ALL
  SELECT user_id, n, CASE WHEN ok THEN asked ELSE status END, CASE WHEN ok THEN tm ELSE since END, accepted + CASE WHEN ok THEN 1 ELSE 0 END, rejected + CASE WHEN asked IS NOT NULL AND NOT ok THEN 1 ELSE 0 END, recovered
  FROM (SELECT *, asked IS NOT NULL AND {allowed("status", "asked")} AS ok FROM (
    SELECT st.user_id, due.n, due.tm, due.asked, CASE WHEN back THEN 'pending' ELSE status END AS status, CASE WHEN back THEN since + {PATIENCE * 1000000} ELSE since END AS since, accepted, rejected, recovered + CASE WHEN back THEN 1 ELSE 0 END AS recovered
    FROM (SELECT st.*, due.tm AS next_at, status = 'processing' AND since + {PATIENCE * 1000000} < due.tm AS back FROM st JOIN due ON due.user_id = st.user_id AND due.n = st.n + 1) st JOIN due ON due.user_id = st.user_id AND due.n = st.n + 1)))
SELECT st.user_id, status, accepted::BIGINT AS accepted, rejected::BIGINT AS rejected, recovered::BIGINT AS recovered, (SELECT count(*) FROM e, w WHERE e.user_id = st.user_id AND tm >= wm * 1000) AS waiting
FROM st JOIN (SELECT user_id, max(n) AS n FROM due GROUP BY user_id) USING (user_id, n)""")
def stream_statuses(s, d):
    """Statuses of files from a stream of events, as of the watermark: an hour before the last event."""
    out = shared.fresh(s, "statuses")
    asked = F.create_map(*(F.lit(v) for kv in ASKED.items() for v in kv))[F.col("event_type")]
    events = streamed(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", asked.alias("asked"))
    status.written(events, out, f"{out}-checkpoint", f"{PATIENCE} s", f"{LATE} seconds").awaitTermination()
    return status.read(s, out).select(F.col("key").alias("user_id"), "status", "accepted", "rejected", "recovered", "waiting")


MERGED = """SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS INTEGER) AS page_num, CASE WHEN o IS NULL THEN own WHEN trim(own) <> '' THEN own || chr(10) || o ELSE o END AS text, o IS NOT NULL AS was_read
FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS own, CASE WHEN turn % 3 = 0 THEN 'read ' || turn END AS o FROM conversations)"""


@query(f"""WITH m AS ({MERGED}), t AS (SELECT *, CAST(count(*) OVER (PARTITION BY file) AS INTEGER) AS total_chunks FROM m)
SELECT file, page_num, CASE WHEN text <> '' THEN text ELSE '[第' || page_num || '页] ' || file END AS chunk_text, length(text)::INTEGER AS char_count, NOT was_read AND length(text) < 50 AS needs_ocr, total_chunks, file || '_' || page_num AS chunk_id FROM t""")
def stream_pages(s, d):
    """Pages and readings of files from two streams; each file's pages as chunks, once it is complete."""
    out = shared.fresh(s, "pages")
    table = x.table(s, d, "conversations")
    counts = table.groupBy("conv_id").agg(F.count("*").cast("int").alias("pages"))
    turn, at = F.col("turn"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id"))
    file, page = F.col("conv_id").cast("string").alias("file"), (turn + 1).cast("int").alias("page_num")
    own = streamed(s, d, "conversations").join(counts, "conv_id").select(file, page, F.when(turn % 2 == 0, "").otherwise(F.col("text")).alias("text"), "pages", (turn % 3 == 0).alias("waits"), at.alias("ts"))
    readings = streamed(s, d, "conversations").where(turn % 3 == 0).select(file, page, F.concat(F.lit("read "), turn.cast("string")).alias("ocr_text"), at.alias("ts"))
    pages.written(own, readings, out, f"{out}-checkpoint", "1 hour").awaitTermination()
    rows = pages.read(s, out)
    chunks = chunking.page_chunks(rows.withColumn("file_name", F.col("file")), "file")
    return chunks.join(rows.select("file", "page_num", "needs_ocr"), ["file", "page_num"]).select("file", "page_num", "chunk_text", "char_count", "needs_ocr", "total_chunks", "chunk_id")


TTL = 300


@query(f"""WITH v AS (SELECT DISTINCT ts AS refreshed FROM events WHERE event_type = 'signup'), q AS (SELECT event_id AS query_id, ts FROM events WHERE event_type = 'view')
SELECT query_id, epoch_us(refreshed) AS refreshed, CASE WHEN refreshed IS NULL THEN true ELSE (epoch_us(q.ts) - epoch_us(refreshed)) / 1000000.0::DOUBLE > {TTL} END AS stale FROM q ASOF LEFT JOIN v ON q.ts >= v.refreshed""")
def fn_snapshots(s, d):
    """The version of the registry that answers each query; versions are kept five minutes."""
    events = x.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    versions = events.where("event_type = 'signup'").select(F.col("ts").alias("refreshed"))
    asked = events.where("event_type = 'view'").select(F.col("event_id").alias("query_id"), "ts")
    return registry.snapshots(versions, asked, TTL).select("query_id", F.unix_micros("refreshed").alias("refreshed"), "stale")


@query("""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS job, event_id, event_type <> 'error' AS good, 2 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
e AS (SELECT job, n - 1 AS seq, 'file_start' AS event, '{"file_name":"f' || event_id || '"}' AS body FROM f UNION ALL SELECT job, n, CASE WHEN good THEN 'file_done' ELSE 'file_error' END, '{"file_name":"f' || event_id || '"}' FROM f)
SELECT job, seq, event, body FROM e WHERE seq > CAST(job AS BIGINT) % 7""")
def stream_progress(s, d):
    """Two progress events a processed file, numbered for each job by a stream, replayed from behind a number of each job."""
    out = shared.fresh(s, "progress")
    body = F.to_json(F.struct(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_name")))
    files = streamed(s, d, "events").select(F.col("user_id").cast("string").alias("job"), "event_id", "event_type", body.alias("body"))
    halves = F.posexplode(F.array(F.lit("file_start"), F.when(F.col("event_type") == "error", "file_error").otherwise("file_done"))).alias("half", "event")
    events = files.select("job", "event_id", "body", halves).select("job", (F.col("event_id") * 2 + F.col("half")).alias("at"), "event", "body")
    progress.written(events, out, f"{out}-checkpoint").awaitTermination()
    behind = x.table(s, d, "events").select(F.col("user_id").cast("string").alias("job"), (F.col("user_id") % 7).alias("seq")).distinct()
    return progress.replayed(s, out, behind).select("job", "seq", "event", "body")
