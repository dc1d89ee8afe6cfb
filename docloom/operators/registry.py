"""The file registry: latest-wins merges, lookups, summaries and life-cycle steps over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import config as C
from docloom.functions import text as t


def latest(df: DataFrame, key: str = "file_hash", seq: str = "seq") -> DataFrame:
    """Of each key the row that came last: what inserting with replacement leaves."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), seq).alias("row")).select("row.*")


def upsert(registry: DataFrame, changes: DataFrame, now: Column, key: str = "file_hash") -> DataFrame:
    """changes: key and some of the registry's columns, one row a key. What isn't null overwrites; completed clears the error; a file that was completed before counts one more reindexing."""
    given = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in given), F.lit(True).alias("_changed"))
    both = registry.join(new, key, "full_outer")
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in given else F.col(c) for c in registry.columns}
    changed = F.coalesce(F.col("_changed"), F.lit(False))
    if "status" in given:
        done = F.col("_status") == "completed"
        out["error_message"] = F.when(changed & done, F.lit("")).otherwise(out["error_message"])
        out["reindex_count"] = F.coalesce(out["reindex_count"], F.lit(0)) + F.when(changed & done & (F.col("status") == "completed"), 1).otherwise(0)
    out["updated_at"] = F.when(changed, now).otherwise(F.col("updated_at"))
    return both.select(*(out[c].alias(c) for c in registry.columns))


def deleted(chunks: DataFrame, hashes: DataFrame, key: str = "file_hash") -> DataFrame:
    """The chunks that are left."""
    return chunks.join(hashes.select(key), key, "left_anti")


def by_status(registry: DataFrame, status: str = "completed") -> DataFrame:
    return registry.where(F.col("status") == status).orderBy("file_name", "file_hash")


def by_name(registry: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """Completed files of that name, or whose name holds it (letters of either case; % and _ are wild)."""
    done = registry.where(F.col("status") == "completed")
    return done.where(F.col("file_name") == name) if exact else done.where(F.col("file_name").ilike(f"%{name}%"))


def path_of() -> Column:
    """Where a file is looked for: its original path, or the stored one where that is empty; null without either."""
    return F.coalesce(t.blank_to_null(F.col("original_path")), t.blank_to_null(F.col("stored_path")))


def listing(registry: DataFrame, present: DataFrame, status: str | None = None, domain: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page, latest first. present: path of files that exist; file_exists is null where no path is known."""
    rows = registry
    rows = rows.where(F.col("status") == status) if status else rows
    rows = rows.where(F.col("domain") == domain) if domain else rows
    page = rows.orderBy(F.desc("updated_at"), "file_hash").offset(offset).limit(limit)
    there = present.select(F.col("path").alias("own_path"), F.lit(True).alias("there")).distinct()
    found = page.withColumn("own_path", path_of()).join(there, "own_path", "left")
    return found.withColumn("file_exists", F.when(F.col("own_path").isNotNull(), F.coalesce("there", F.lit(False)))).drop("own_path", "there")


def summary(registry: DataFrame) -> DataFrame:
    """Counts by status, and of completed files by domain, with sums: section, name, files, chunks, chars."""
    sums = [F.count("*").alias("files"), F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("chars_count"), F.lit(0)).alias("chars")]
    done = registry.where("status = 'completed'")
    status = registry.groupBy(F.col("status").alias("name")).agg(*sums).select(F.lit("status").alias("section"), "*")
    domain = done.groupBy(F.col("domain").alias("name")).agg(*sums).select(F.lit("domain").alias("section"), "*")
    total = registry.agg(*sums).select(F.lit("total").alias("section"), F.lit("").alias("name"), "*")
    return status.unionByName(domain).unionByName(total)


def orphans(registry: DataFrame, present: DataFrame) -> DataFrame:
    """Files that should be there and aren't. present: path of files that exist; a file without a path is missing."""
    rows = registry.where(~F.col("status").isin("deleted", "pending", "processing")).withColumn("own_path", path_of())
    return rows.join(present.select(F.col("path").alias("own_path")), "own_path", "left_anti").drop("own_path")


def recovered(registry: DataFrame) -> DataFrame:
    """What a crash left in processing waits again."""
    stuck = F.col("status") == "processing"
    return registry.withColumns({"status": F.when(stuck, "pending").otherwise(F.col("status")), "error_message": F.when(stuck, "").otherwise(F.col("error_message"))})


def resolved(identifiers: DataFrame, registry: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """identifiers: identifier. Its file: a hash of 64 hexadecimal digits; else the content's hash of a present file of that path (present: path, content_hash); else a path or a name of the registry (the least hash of several)."""
    done = registry.select("file_hash", "original_path", "file_name")
    asked = identifiers.withColumn("is_hash", F.col("identifier").rlike("^[0-9a-fA-F]{64}$"))
    by_path = done.groupBy("original_path").agg(F.min("file_hash").alias("by_path"))
    names = done.groupBy("file_name").agg(F.min("file_hash").alias("by_name"))
    rows = asked.join(by_path, asked["identifier"] == by_path["original_path"], "left").join(names, asked["identifier"] == names["file_name"], "left")
    there = F.lit(None).cast("string")
    if present is not None:
        rows, there = rows.join(present, F.col("identifier") == F.col("path"), "left"), F.col("content_hash")
    return rows.select("identifier", F.when(F.col("is_hash"), F.lower("identifier")).otherwise(F.coalesce(there, "by_path", "by_name")).alias("file_hash"))


def to_ingest(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content isn't completed yet."""
    return files.join(registry.where("status = 'completed'").select("file_hash"), "file_hash", "left_anti")


def walk_stats(files: DataFrame, most: int = 15) -> DataFrame:
    """Counts by domain, by the most frequent extensions and by format: section, name, files."""
    count = lambda section, c: files.groupBy(c.alias("name")).agg(F.count("*").alias("files")).select(F.lit(section).alias("section"), "*")
    extensions = count("extension", F.col("extension")).orderBy(F.desc("files"), "name").limit(most)
    return count("domain", F.coalesce("domain", F.lit("未分类"))).unionByName(extensions).unionByName(count("format", F.col("format_group")))


def tree(files: DataFrame) -> DataFrame:
    """Counts and missing files of each category, each domain (category null) and in all (both null)."""
    return files.rollup("domain", "category").agg(F.count("*").alias("files"), F.count_if(~F.col("file_exists")).alias("missing"))


def shown(registry: DataFrame, status: str | None = None, domain: str | None = None, words: str = "") -> DataFrame:
    """What a list shows: of a status, or all not deleted; with words in name or number."""
    rows = registry.where(F.col("status") == status if status else F.col("status") != "deleted")
    rows = rows.where(F.col("domain") == domain) if domain else rows
    w = words.strip().lower()
    return rows.where(F.contains(F.lower("file_name"), F.lit(w)) | F.contains(F.lower(F.coalesce("doc_number", F.lit(""))), F.lit(w))) if w else rows


def folded(events: DataFrame, key: str, kind: str, ts: str, states: dict[str, str], tie: str) -> DataFrame:
    """Each key's state: that of its latest event."""
    state = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))
    return events.groupBy(key).agg(F.max_by(kind, F.struct(ts, tie)).alias("last_event"), F.count("*").alias("events")).withColumn("status", F.coalesce(state[F.col("last_event")], F.lit(C.STATUSES[0])))


def batch_result(results: DataFrame) -> DataFrame:
    """success, failed and success_rate of results (0 of none)."""
    good = F.count_if(F.col("status") == "completed")
    return results.agg(F.count("*").alias("total"), good.alias("success"), (F.count("*") - good).alias("failed"), F.when(F.count("*") > 0, F.round(good / F.count("*"), 4)).otherwise(0.0).alias("success_rate"))


def recovery_log(registry: DataFrame) -> DataFrame:
    """Events that recovering pending files tells of, in order: start, each file's start and end, done."""
    pending = registry.where("status IN ('pending', 'failed', 'completed')")
    start = pending.agg(F.count("*").alias("n")).select(F.lit("start").alias("event"), F.lit("").alias("file_hash"), "n")
    each = pending.select(F.explode(F.array(F.lit("file_start"), F.when(F.col("status") == "failed", "file_error").otherwise("file_done"))).alias("event"), "file_hash", F.lit(1).cast("long").alias("n"))
    done = pending.agg(F.count_if(F.col("status") != "failed").alias("n")).select(F.lit("done").alias("event"), F.lit("").alias("file_hash"), "n")
    return start.unionByName(each).unionByName(done)


def identified(df: DataFrame, content: str) -> DataFrame:
    return df.withColumn("file_hash", F.sha2(F.col(content), 256))


def at_eight(ts: Column) -> tuple[Column, Column]:
    """An instant as ISO text and for display, eight hours east of UTC."""
    local = F.from_utc_timestamp(ts, "+08:00")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")), F.date_format(local, "yyyy-MM-dd HH:mm")


def by_hash(registry: DataFrame, hashes: DataFrame) -> DataFrame:
    return registry.join(hashes.select("file_hash").distinct(), "file_hash", "left_semi")


def removed(registry: DataFrame, chunks: DataFrame, hashes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The registry with these files marked deleted, and the chunks that are left."""
    gone = by_hash(registry, hashes).select("file_hash", F.lit("deleted").alias("status"), F.lit(0).cast("long").alias("chunks_count"))
    return upsert(registry, gone, now), deleted(chunks, hashes)


def document_of(asked: DataFrame, registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked: query_id, file_hash, file_path. The hash whose chunks make the document: the given one, else that of the path's chunks, else that of a completed file of its name. Null for none."""
    have = chunks.select("file_hash").distinct()
    by_path = chunks.groupBy("file_path").agg(F.min("file_hash").alias("path_hash"))
    named = registry.where("status = 'completed'").join(have, "file_hash", "left_semi").groupBy("file_name").agg(F.min("file_hash").alias("name_hash"))
    rows = asked.join(have.withColumnRenamed("file_hash", "own"), F.col("file_hash") == F.col("own"), "left").join(by_path, "file_path", "left")
    rows = rows.join(named, t.basename(F.col("file_path")) == F.col("file_name"), "left")
    return rows.select("query_id", F.coalesce("own", "path_hash", "name_hash").alias("file_hash"))


def stored_name(name: Column, taken: Column, epoch: int) -> Column:
    """A name that is taken gets the time before its extension."""
    return F.when(taken, F.concat(t.stem(name), F.lit(f"_{epoch}"), F.coalesce(t.blank_to_null(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)), F.lit("")))).otherwise(name)


def by_state(registry: DataFrame, parsed: bool | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """Files of these hashes, parsed or not; without a condition it isn't asked for."""
    rows = registry if hashes is None else by_hash(registry, hashes)
    return rows if parsed is None else rows.where((F.col("status") == "completed") == F.lit(parsed))


def details(identifiers: DataFrame, registry: DataFrame, most: int = 1000) -> DataFrame:
    """identifiers: identifier, a hash or a name. Of each the first that fits among the latest `most` files, with a column identifier; none: no row."""
    page = registry.orderBy(F.desc("updated_at"), "file_hash").limit(most)
    keys = page.select("*", F.explode(F.array_distinct(F.array("file_hash", "file_name"))).alias("identifier"))
    found = keys.join(identifiers.select("identifier").distinct(), "identifier", "left_semi")
    order = Window.partitionBy("identifier").orderBy(F.desc("updated_at"), "file_hash")
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def removable(registry: DataFrame, hashes: DataFrame, uploads: str, present: DataFrame) -> DataFrame:
    """file_hash and path of the files that removing may delete: those below uploads that exist (present: path)."""
    rows = by_hash(registry, hashes).select("file_hash", path_of().alias("path")).where(F.startswith("path", F.lit(uploads)))
    return rows.join(present.select("path"), "path", "left_semi").select("file_hash", "path")


def reindexed(identifiers: DataFrame, registry: DataFrame, present: DataFrame) -> DataFrame:
    """identifiers: identifier. present: path, content_hash of files that exist. What reindexing does with each: file_hash, path, status (pending: removed and to be read again) and error_message."""
    files = registry.select(F.col("file_hash").alias("own"), path_of().alias("path"))
    rows = resolved(identifiers, registry, present).join(files, F.col("file_hash") == F.col("own"), "left").join(present.select("path", F.lit(True).alias("there")), "path", "left")
    error = F.when(F.col("file_hash").isNull(), C.NOT_REGISTERED).when(F.col("own").isNull(), C.REGISTRATION_LOST).when(F.col("there").isNull(), C.SOURCE_GONE)
    return rows.select("identifier", "file_hash", F.coalesce("path", F.lit("")).alias("path"), F.when(error.isNull(), "pending").otherwise("failed").alias("status"), F.coalesce(error, F.lit("")).alias("error_message"))


def snapshots(versions: DataFrame, queries: DataFrame, ttl: int) -> DataFrame:
    """Which version of the registry answers each query, where a version is kept ttl seconds and then read anew.

    versions: refreshed (a timestamp). queries: query_id, ts. A query is answered by the last version before it (or at it): age in
    seconds, and stale where it is older than ttl, so that the query has to refresh. Null before the first one. Both sides are
    put into slots of ttl seconds; a slot carries the last version before it, so that a query looks at its own slot alone.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / (ttl * 1_000_000))
    moments = versions.select(F.col("refreshed").cast("timestamp").alias("refreshed")).where("refreshed IS NOT NULL").distinct()
    lasts = moments.groupBy(slot(F.col("refreshed")).alias("slot")).agg(F.max("refreshed").alias("last"))
    asked = queries.withColumn("ts", F.col("ts").cast("timestamp"))
    # slots that are asked for and those that have a version, in order: not rows, but one for each ttl of time
    slots = lasts.select("slot", "last").unionByName(asked.select(slot(F.col("ts")).alias("slot")).distinct().withColumn("last", F.lit(None).cast("timestamp"))).groupBy("slot").agg(F.max("last").alias("last"))
    before = slots.withColumn("before", F.max("last").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).select("slot", "before")
    # within a slot versions and queries are read in the order of time, a version before queries of its moment
    both = asked.select("*", slot(F.col("ts")).alias("slot"), F.lit(None).cast("timestamp").alias("own")).unionByName(moments.select(F.col("refreshed").alias("ts"), slot(F.col("refreshed")).alias("slot"), F.col("refreshed").alias("own")), allowMissingColumns=True)
    seen = both.withColumn("kind", F.col("own").isNotNull()).withColumn("own", F.max("own").over(Window.partitionBy("slot").orderBy("ts", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)))
    rows = seen.where("NOT kind").join(before, "slot", "left").withColumn("refreshed", F.coalesce("own", "before")).drop("slot", "before", "own", "kind")
    age = (F.unix_micros("ts") - F.unix_micros("refreshed")) / 1_000_000
    return rows.withColumn("age", age).withColumn("stale", F.when(F.col("refreshed").isNull(), True).otherwise(F.col("age") > ttl))
