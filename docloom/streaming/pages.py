"""Pages of files and what recognisers read off them, as two streams that meet in a state by file.

A file tells with each page how many pages it has, and which of them wait for a recogniser. When all its pages and all readings
that they wait for are there, the file is published once: each page with its own text and what was read. A file that
isn't complete a given time after its last row, by the watermark of the slower stream, is published as it is, by a timer;
what comes later publishes it again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.streaming.index import on_disk

FOUND = "file string, page_num int, text string, char_count int, needs_ocr boolean, complete boolean, edition int"


def met(text: str, read: str | None) -> str:
    """What is read stands behind what a page has."""
    return text if read is None else f"{text}\n{read}" if text.strip() else read


class Meeting(StatefulProcessor):
    def __init__(self, patience_ms: int, few: int):
        self.patience, self.few = patience_ms, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "pages int, edition int, latest long")
        self.pages = handle.getMapState("pages", "page int", "text string, waits boolean")
        self.read = handle.getMapState("read", "page int", "text string")

    def _publish(self, key, complete: bool) -> pd.DataFrame:
        pages, edition, latest = self.head.get()
        self.head.update((pages, edition + 1, latest))
        read = {k[0]: v[0] for k, v in self.read.iterator()}
        rows = [(k[0], met(text, read.get(k[0])), k[0] in read) for k, (text, _) in sorted(self.pages.iterator())]
        out = pd.DataFrame(rows, columns=["page_num", "text", "was_read"])
        out["char_count"] = out["text"].str.len()
        out["needs_ocr"] = ~out.pop("was_read").astype(bool) & (out["char_count"] < self.few)
        return out.assign(file=key[0], complete=complete, edition=edition + 1)[[c.split()[0] for c in FOUND.split(", ")]]

    def _timer(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, edition, latest = self.head.get() if self.head.exists() else (0, 0, 0)
        changed = False
        for pdf in rows:
            for kind, page, text, pages, waits, at in zip(pdf["kind"], pdf["page_num"].tolist(), pdf["text"], pdf["pages"].tolist(), pdf["waits"], pdf["ms"].tolist()):
                latest, place = max(latest, at), self.pages if kind == "page" else self.read
                value = (text or "", bool(waits)) if kind == "page" else (text or "",)
                # a row that is there already publishes nothing again
                changed |= not place.containsKey((page,)) or tuple(place.getValue((page,))) != value
                place.updateValue((page,), value)
                total = max(total, int(pages)) if kind == "page" else total
        self.head.update((total, edition, latest))
        known = {k[0]: v[1] for k, v in self.pages.iterator()}
        if not changed:
            return
        if total and len(known) >= total and all(self.read.containsKey((p,)) for p, waits in known.items() if waits):
            self._timer(None)
            yield self._publish(key, True)
        else:
            self._timer(latest + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if sum(1 for _ in self.pages.keys()):
            yield self._publish(key, False)

    def close(self) -> None:
        pass


def meeting(pages: DataFrame, readings: DataFrame, patience: str, late: str = "1 hour", few: int = 50) -> DataFrame:
    """pages (a stream): file, page_num, text, pages (of the file), waits (for a reading), ts. readings (another): file, page_num, ocr_text, ts. Rows of FOUND, an edition of a file at a time."""
    left = pages.select("file", F.col("page_num").cast("int"), "text", F.col("pages").cast("int"), "waits", F.col("ts").cast("timestamp").alias("ts"), F.lit("page").alias("kind"))
    right = readings.select("file", F.col("page_num").cast("int"), F.col("ocr_text").alias("text"), F.lit(0).alias("pages"), F.lit(False).alias("waits"), F.col("ts").cast("timestamp").alias("ts"), F.lit("read").alias("kind"))
    both = left.withWatermark("ts", late).unionByName(right.withWatermark("ts", late)).where("file IS NOT NULL AND page_num IS NOT NULL")
    ms = int(pd.Timedelta(patience) // pd.Timedelta(milliseconds=1))
    return both.withColumn("ms", F.unix_millis("ts")).groupBy("file").transformWithStateInPandas(statefulProcessor=Meeting(ms, few), outputStructType=FOUND, outputMode="Update", timeMode="EventTime")


def written(pages: DataFrame, readings: DataFrame, out: str, checkpoint: str, patience: str, late: str = "1 hour"):
    """Publishes what there is and ends. A batch has a folder of its own, so doing it again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with on_disk(pages.sparkSession):
        return meeting(pages, readings, patience, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    """The last edition of each file."""
    found = spark.read.schema(FOUND).parquet(f"{out}/batch=*")
    last = F.max("edition").over(Window.partitionBy("file"))
    return found.withColumn("last", last).where("edition = last").drop("last")
