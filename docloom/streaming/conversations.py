"""Conversations as a stream of turns: what is kept of each, its summary and tokens, are the stream's state.

A turn that comes before its predecessor is parked until that comes, so the result doesn't hang on the order of arrival or on
how the input is cut into batches; a turn that was there already changes nothing. A conversation costs what is kept and
parked of it, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom import config as C
from docloom.operators.conversation import estimate
from docloom.streaming.index import on_disk

FOUND = "conv_id long, kept int, summary string, total_tokens long, compressions int, turns long, parked int"


def points(role: str, content: str) -> str | None:
    """What a turn leaves in a summary."""
    if role == "user":
        return f"用户询问: {content[:100]}"
    told = [s for s in map(str.strip, content.replace("；", "。").split("。")[:3]) if len(s) > 10]
    return "回答要点: " + "; ".join(told[:2]) if told else None


class Folding(StatefulProcessor):
    """next: number of the turn that is waited for. kept: the turns that stand as they came; parked: those that came too soon."""

    def __init__(self, limit: float, keep: int = C.KEPT_MESSAGES, lines: int = 20):
        self.limit, self.keep, self.lines = limit, keep, lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, total long, times int, summary string")
        self.turns = handle.getMapState("turns", "turn long", "role string, content string, tokens long")
        self.parked = handle.getMapState("parked", "turn long", "role string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, total, times, summary = self.state.get() if self.state.exists() else (0, 0, 0, "")
        for pdf in rows:
            for turn, role, content in zip(pdf["turn"].tolist(), pdf["role"], pdf["content"]):
                if turn >= following:
                    self.parked.updateValue((turn,), (role or "", content or ""))
        kept = {k[0]: tuple(v) for k, v in self.turns.iterator()}
        had = set(kept)
        while self.parked.containsKey((following,)):
            role, content = self.parked.getValue((following,))
            self.parked.removeKey((following,))
            kept[following] = (role, content, estimate(content))
            total += kept[following][2]
            following += 1
            old = sorted(kept)[: -self.keep] if total > self.limit else []
            if old:
                gone = [kept.pop(turn) for turn in old]
                summary = "\n".join([line for role, content, _ in gone if (line := points(role, content)) is not None][: self.lines])
                total, times = total + estimate(summary) - sum(n for _, _, n in gone), times + 1
        for turn in had - kept.keys():
            self.turns.removeKey((turn,))
        for turn in kept.keys() - had:
            self.turns.updateValue((turn,), kept[turn])
        self.state.update((following, total, times, summary))
        waiting = sum(1 for _ in self.parked.keys())
        yield pd.DataFrame({"conv_id": [key[0]], "kept": [len(kept)], "summary": [summary], "total_tokens": [total], "compressions": [times], "turns": [following], "parked": [waiting]})

    def close(self) -> None:
        pass


def folding(turns: DataFrame, limit: float = C.CONTEXT_TOKENS * C.COMPRESS_AT) -> DataFrame:
    """turns (a stream): conv_id, turn (from 0 on, without gaps in the end), role, content. A row of FOUND whenever a conversation changes."""
    narrow = turns.select("conv_id", "turn", "role", "content")
    return narrow.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Folding(limit), outputStructType=FOUND, outputMode="Update", timeMode="None")


def latest(found: DataFrame) -> DataFrame:
    """The last state of each conversation: states grow by turns, and by what came at all."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turns"), F.desc("parked"))
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def written(turns: DataFrame, out: str, checkpoint: str, limit: float):
    """Folds what there is and ends. A batch has a folder of its own, so doing it again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with on_disk(turns.sparkSession):
        return folding(turns, limit).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    return latest(spark.read.schema(FOUND).parquet(f"{out}/batch=*"))
