"""Conversations as a table of turns: estimates, titles, compression, and what a model is sent."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import config as C
from docloom.functions import text as t
from docloom.operators.context import in_order


def tokens(text: Column) -> Column:
    """Two tokens for three Han characters, one for four others, rounded down."""
    han = F.regexp_count(text, F.lit("[一-鿿]"))
    return F.floor(han / 1.5 + (F.length(text) - han) / 4).cast("int")


def overview(messages: DataFrame) -> DataFrame:
    """conv_id, messages, tokens, title (of the first user message) and preview (of the last)."""
    user = F.col("role") == "user"
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.sum(tokens(F.col("content"))).alias("total_tokens"),
        F.min_by(F.when(user, F.col("content")), F.when(user, F.col("turn"))).alias("first"), F.max_by("content", "turn").alias("last"),
    ).select("conv_id", "messages", "total_tokens", F.coalesce(t.cut(F.col("first"), 30), F.lit("新对话")).alias("title"), t.cut(F.col("last"), 50).alias("preview"))


def running(messages: DataFrame, limit: float = C.CONTEXT_TOKENS * C.COMPRESS_AT) -> DataFrame:
    """Each turn's tokens, the sum so far, and whether it is over the limit."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("tokens", tokens(F.col("content")))
    rows = rows.withColumn("total", F.sum("tokens").over(w))
    return rows.withColumn("over", F.col("total") > limit)


def summary_line() -> Column:
    """What a turn leaves in a summary; null for nothing."""
    sentences = F.slice(F.split(F.replace(F.col("content"), F.lit("；"), F.lit("。")), "。"), 1, 3)
    points = F.slice(F.filter(F.transform(sentences, t.strip), lambda s: F.length(s) > 10), 1, 2)
    return F.when(F.col("role") == "user", F.concat(F.lit("用户询问: "), F.substring("content", 1, 100))).when(F.size(points) > 0, F.concat(F.lit("回答要点: "), F.array_join(points, "; ")))


def placed(messages: DataFrame) -> DataFrame:
    """from_end: 1 for a conversation's last turn."""
    return messages.withColumn("from_end", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))


def compressed(messages: DataFrame, keep: int = C.KEPT_MESSAGES, lines: int = 20) -> DataFrame:
    """conv_id and summary of all but the last turns, the first lines of it."""
    old = placed(messages).where(F.col("from_end") > keep).withColumn("line", summary_line()).where(F.col("line").isNotNull())
    order = Window.partitionBy("conv_id").orderBy("turn")
    kept = old.withColumn("n", F.row_number().over(order)).where(F.col("n") <= lines)
    return kept.groupBy("conv_id").agg(in_order("line", "turn", "\n").alias("summary"))


def context_messages(messages: DataFrame, keep: int = C.KEPT_MESSAGES) -> DataFrame:
    """The summary as a system message (turn -1), and the last turns."""
    recent = placed(messages).where(F.col("from_end") <= keep).select("conv_id", "turn", "role", "content")
    head = F.concat(F.lit("[历史对话摘要] 以下是之前讨论的要点:\n"), F.col("summary"))
    return compressed(messages, keep).select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), head.alias("content")).unionByName(recent)


def chat_request(history: DataFrame, asked: DataFrame, system: str) -> DataFrame:
    """conv_id and messages: the system's, all turns but the last, and the question with its context (asked: conv_id, content)."""
    last = Window.partitionBy("conv_id")
    kept = history.withColumn("end", F.max("turn").over(last)).where("turn < end").select("conv_id", "turn", "role", "content")
    first = history.select("conv_id").distinct().select("conv_id", F.lit(-2).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    own = asked.select("conv_id", F.lit(2**62).cast("long").alias("turn"), F.lit("user").alias("role"), "content")
    rows = first.unionByName(kept).unionByName(own)
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"], m["content"])).alias("messages"))


def estimate(text: str) -> int:
    han = sum("一" <= c <= "鿿" for c in text)
    return int(han / 1.5 + (len(text) - han) / 4)


def fold(turns: list[tuple[str, str]], limit: float, keep: int = C.KEPT_MESSAGES, merge: bool = False) -> tuple[list[tuple[str, str]], str, int, int]:
    """Turns one after another, compressed whenever they are over the limit: turns kept, summary, tokens, compressions. merge keeps the former summary's lines."""
    kept: list[tuple[str, str]] = []
    summary, total, times = "", 0, 0
    for role, content in turns:
        kept.append((role, content))
        total += estimate(content)
        if total <= limit or len(kept) <= keep:
            continue
        old, kept = kept[:-keep], kept[-keep:]
        lines = summary.split("\n") if merge and summary else []
        for r, c in old:
            if r == "user":
                lines.append(f"用户询问: {c[:100]}")
            elif points := [s.strip() for s in c.replace("；", "。").split("。")[:3] if len(s.strip()) > 10]:
                lines.append("回答要点: " + "; ".join(points[:2]))
        summary = "\n".join(lines[:20])
        total += estimate(summary) - sum(estimate(c) for _, c in old)
        times += 1
    return kept, summary, total, times


def folded(messages: DataFrame, limit: float = C.CONTEXT_TOKENS * C.COMPRESS_AT, merge: bool = False) -> DataFrame:
    """State of each conversation after its last turn; a conversation is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        kept, summary, total, times = fold(list(zip(pdf["role"], pdf["content"])), limit, merge=merge)
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "kept": [len(kept)], "summary": [summary], "total_tokens": [total], "compressions": [times]})

    return messages.groupBy("conv_id").applyInPandas(run, "conv_id long, kept int, summary string, total_tokens long, compressions int")


def listed(conversations: DataFrame, updated: str = "updated_at") -> DataFrame:
    return conversations.orderBy(F.desc(updated), "conv_id")


def created(asked: DataFrame, now: Column) -> DataFrame:
    """asked: request (unique), title. conv_id of twelve hexadecimal digits, title, created_at and updated_at of new conversations."""
    return asked.select(F.substring(F.sha2(F.col("request").cast("string"), 256), 1, 12).alias("conv_id"), "title", now.alias("created_at"), now.alias("updated_at"))


def got(messages: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """Overview and all messages, in order, of these conversations; an unknown id gives no row."""
    mine = messages.join(conv_ids.select("conv_id").distinct(), "conv_id", "left_semi")
    turns = mine.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"], m["content"])).alias("turns"))
    return overview(mine).join(turns, "conv_id")


def deleted(messages: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """The messages that are left."""
    return messages.join(conv_ids.select("conv_id"), "conv_id", "left_anti")
