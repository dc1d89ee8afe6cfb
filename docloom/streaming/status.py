"""The status of files as a state machine over a stream of events.

Events are applied in the order of their times, once the watermark has passed them, so that the order of arrival doesn't
matter. What the present status doesn't allow is rejected and counted. A file that is in processing without an end for a
given time waits again, by a timer. A key's state is one row that goes to Python along with its events and comes back once
a batch, however many events wait.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom import config as C
from docloom.streaming.index import on_disk

FOUND = "key long, status string, since long, accepted long, rejected long, recovered long, waiting long"
#: at, id and asked are of the events that wait, in order.
STATE = "status string, since long, accepted long, rejected long, recovered long, at array<long>, id array<long>, asked array<string>"


def applied(status: str, since: int, events: list[tuple[int, str]], until: int, patience: int) -> tuple[str, int, int, int, int]:
    """Status and since when, and how many events were accepted, rejected, and recoveries made. events: time and status asked for, in order. until: the time by now."""
    accepted = rejected = recovered = 0
    for at, asked in [*events, (until, "")]:
        if status == "processing" and since + patience < at:
            status, since, recovered = "pending", since + patience, recovered + 1
        if asked and asked in C.TRANSITIONS.get(status, ()):
            status, since, accepted = asked, at, accepted + 1
        elif asked:
            rejected += 1
    return status, since, accepted, rejected, recovered


def machine(patience: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What a batch does to one key. Times are microseconds; patience is how long a file may be in processing."""

    def advance(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, since, *counts, at, ids, asked = state.get if state.exists else ("", 0, 0, 0, 0, [], [], [])
        parked = dict(zip(zip(at, ids), asked))
        for pdf in rows:
            parked.update(zip(zip(pdf["micros"].tolist(), pdf["id"].tolist()), pdf["asked"].tolist()))
        events, until = sorted(parked), state.getCurrentWatermarkMs() * 1000
        n = bisect_left(events, (until,))
        status, since, *more = applied(status, since, [(e[0], parked[e]) for e in events[:n]], until, patience)
        counts, events = [a + b for a, b in zip(counts, more)], events[n:]
        state.update((status, since, *counts, [e[0] for e in events], [e[1] for e in events], [parked[e] for e in events]))
        # one timer at a time: the next event's, or the end of patience
        wakes = [e[0] for e in events[:1]] + ([since + patience] if status == "processing" else [])
        if wakes:
            # it runs out once the watermark is past it
            state.setTimeoutTimestamp(max(min(wakes) // 1000, 1))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "since": [since], "accepted": [counts[0]], "rejected": [counts[1]], "recovered": [counts[2]], "waiting": [len(events)]})

    return advance


def statuses(events: DataFrame, patience: str, late: str = "1 hour") -> DataFrame:
    """events (a stream): key, id (unique), ts, asked (a status). A row of FOUND whenever a key's events or status change."""
    micros = int(pd.Timedelta(patience) // pd.Timedelta(microseconds=1))
    timed = events.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), "asked").where("asked IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return timed.withColumn("micros", F.unix_micros("ts")).groupBy("key").applyInPandasWithState(machine(micros), FOUND, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest(found: DataFrame) -> DataFrame:
    """The last state of each key: what was done only grows, and then less waits."""
    done = F.col("accepted") + F.col("rejected") + F.col("recovered")
    order = Window.partitionBy("key").orderBy(F.desc(done), F.desc("waiting"))
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def written(events: DataFrame, out: str, checkpoint: str, patience: str, late: str = "1 hour"):
    """Applies what there is and ends. A batch has a folder of its own, so doing it again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with on_disk(events.sparkSession):
        return statuses(events, patience, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    return latest(spark.read.schema(FOUND).parquet(f"{out}/batch=*"))
