"""Blocks of a page's text by recursive cuts at gaps, from the boxes of its words.

A region is cut where no word stands for more than a gap, from top to bottom, then from left to right, and so on until
neither way finds a gap. Gaps are measured in the page's median word height. A cut of all regions of all pages is one pass
of windows: what starts further than the gap behind the furthest end of all before it begins a new part. Words that stand
in a row are put together before. Words are shuffled once, and not at all where they stand by page (or by a part of its keys) already; every later window parts
pages further and so finds them in place. Blocks are made in the same stage, and only pages that aren't through go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.sources import shared

#: Least gaps between blocks above each other and beside each other, in median word heights; cuts of both ways before a look whether any is left.
BELOW, BESIDE, ROUNDS = 1.0, 1.5, 3


def runs(words: DataFrame, keys: list[str], beside: float) -> DataFrame:
    """keys, x0, y0, x1, y1, seq (the first), words (x0, seq, text) of stretches of words of equal height and place with no gap between them, and the median height of their page's words.

    No cut ever parts such a stretch, so cuts handle it as one. Words that have no box or are blank are left out. One sort
    serves both windows.
    """
    ends = {"x0": F.least("x0", "x1"), "y0": F.least("y0", "y1"), "x1": F.greatest("x0", "x1"), "y1": F.greatest("y0", "y1")}
    rows = words.where("x0 + y0 + x1 + y1 IS NOT NULL AND NOT isnan(x0 + y0 + x1 + y1)").where(t.strip(F.col("text")) != "")
    rows = rows.select(*keys, "seq", *(c.cast("double").alias(n) for n, c in ends.items()), "text")
    page = Window.partitionBy(*keys).orderBy("y0", "y1", "x0", "x1", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("height", F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).over(page))
    own = Window.partitionBy(*keys, "y0", "y1").orderBy("x0", "x1", "seq")
    gap = F.col("x0") - F.max("x1").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(gap > F.col("height") * beside, 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    told = F.collect_list(F.struct("x0", "seq", "text")).alias("words")
    return rows.groupBy(*keys, "y0", "y1", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("seq").alias("seq"), F.first("height").alias("height"), told).drop("run")


def cut(rows: DataFrame, keys: list[str], low: str, high: str, gap: Column) -> DataFrame:
    """rows with the number of each run's part, from 0, behind its region's path."""
    order = Window.partitionBy(*keys, "region").orderBy(low, high, "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a window can't stand in another one
    fresh = rows.withColumn("fresh", F.when(F.col(low) - F.max(high).over(before) > gap, 1).otherwise(0))
    part = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return fresh.withColumn("part", part).withColumn("region", F.concat("region", F.array("part"))).drop("fresh", "part")


def told(rows: DataFrame, keys: list[str], depth: int, hold: bool) -> DataFrame:
    """A row for each region: keys, block_no, box, n_lines, text, region, deep (the last two of its page's cuts found something), and its runs, of pages that are deep unless all are to be held."""
    found = (F.element_at("region", depth) > 0) | (F.element_at("region", depth - 1) > 0)
    rows = rows.withColumn("deep", F.max(found).over(Window.partitionBy(*keys)))
    own = Window.partitionBy(*keys, "region").orderBy("y0", "y1", "seq")
    new = F.when((F.col("y0") + F.col("y1")) / 2 > F.max("y1").over(own.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    lines = rows.withColumn("fresh", new).withColumn("line", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    text = F.array_join(F.sort_array(F.flatten(F.collect_list("words")))["text"], " ")
    # nulls aren't collected
    held = F.collect_list(F.when(F.lit(hold) | F.col("deep"), F.struct("x0", "y0", "x1", "y1", "seq", "height", "words")))
    lines = lines.groupBy(*keys, "deep", "region", "line").agg(*box, text.alias("text"), held.alias("runs"))
    text = F.array_join(F.sort_array(F.collect_list(F.struct("line", "text")))["text"], "\n")
    whole = lines.groupBy(*keys, "deep", "region").agg(*box, F.count("*").cast("int").alias("n_lines"), text.alias("text"), F.flatten(F.collect_list("runs")).alias("runs"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("region"))
    return whole.select(*keys, number.alias("block_no"), "x0", "y0", "x1", "y1", "n_lines", "text", "region", "deep", "runs")


def parted(words: DataFrame, keys: list[str], below: float, beside: float, rounds: int, hold: bool) -> DataFrame:
    """Regions as told that no cut parts. Deep pages take further passes, as many as they need; what is through isn't read again."""
    rows = runs(words, keys, beside).withColumn("region", F.array().cast("array<int>"))
    done, depth = None, 0
    while True:
        for _ in range(rounds):
            rows = cut(rows, keys, "y0", "y1", F.col("height") * below)
            rows = cut(rows, keys, "x0", "x1", F.col("height") * beside)
            depth += 2
        made = shared.written(told(rows, keys, depth, hold), shared.fresh(words.sparkSession, "regions"))
        done = made.where("NOT deep") if done is None else done.unionByName(made.where("NOT deep"))
        if not made.where("deep").head(1):
            return done
        rows = made.where("deep").select(*keys, "region", F.inline("runs"))


def regions(words: DataFrame, keys: list[str], below: float = BELOW, beside: float = BESIDE, rounds: int = ROUNDS) -> DataFrame:
    """Runs of words with region, the path of parts that leads to their block."""
    return parted(words, keys, below, beside, rounds, True).select(*keys, "region", F.inline("runs"))


def blocks(words: DataFrame, keys: list[str], below: float = BELOW, beside: float = BESIDE, rounds: int = ROUNDS) -> DataFrame:
    """words: keys (of a page), seq (its words' order), x0, y0, x1, y1, text. keys, block_no (reading order, from 1), x0, y0, x1, y1, n_lines, text, block_type (0).

    A line is words whose middle isn't below all before it; its words go by x, lines are joined by line breaks. Words without
    a whole box or text are in no block, a page of such words has none. Boxes given from high to low are turned round.
    Equal boxes go by seq.
    """
    whole = parted(words, keys, below, beside, rounds, False)
    return whole.select(*keys, "block_no", "x0", "y0", "x1", "y1", "n_lines", "text", F.lit(0).alias("block_type"))
