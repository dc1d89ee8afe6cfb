"""Streams give what the batch form gives, however the input is cut, and after a restart."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from docloom import config as C
from docloom.operators import conversation, registry
from docloom.sources import shared
from docloom.streaming import conversations, progress, status
from docloom.streaming import pages as streamed_pages


def test_turns_in_any_order_and_after_a_restart(spark):
    rng = random.Random(3)
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["问题是什么？", "这是一个足够长的回答要点内容。还有第二句也足够长的话；短。", "word " * rng.randrange(40)])) for c in range(9) for t in range(rng.randrange(1, 25))]
    whole = spark.createDataFrame(turns, "conv_id long, turn long, role string, content string")
    rng.shuffle(turns)
    source, out = shared.fresh(spark, "turns"), shared.fresh(spark, "out")
    cuts = [0, 1, 40, 60, len(turns)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        # turns that came before come again
        part = spark.createDataFrame(turns[a:b] + turns[:a:7], whole.schema)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(source)
        conversations.written(stream, out, f"{out}-checkpoint", 120).awaitTermination()
        if i == 1:
            known = {(c, t) for c, t, _, _ in turns[:b]}
            for r in conversations.read(spark, out).collect():
                mine = {t for c, t in known if c == r.conv_id}
                following = next(n for n in range(99) if n not in mine)
                assert (r.turns, r.parked) == (following, len([t for t in mine if t > following]))
    want = conversation.folded(whole, 120)
    got = conversations.read(spark, out)
    assert got.where("parked > 0").count() == 0 and got.where("compressions > 0").count() > 0
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_machine_by_hand():
    minute = 60_000_000
    asked = [(1, "processing"), (2, "pending"), (3, "completed"), (4, "processing"), (5, "processing"), (99, "completed")]
    assert status.applied("", 0, [(t * minute, a) for t, a in asked], 100 * minute, 30 * minute) == ("pending", 34 * minute, 2, 4, 1)
    assert status.applied("", 0, [(0, "pending"), (1, "processing")], 30 * minute, 30 * minute) == ("processing", 1, 2, 0, 0)
    assert status.applied("deleted", 5, [], 10**12, minute) == ("deleted", 5, 0, 0, 0)


def test_events_out_of_order_and_after_a_restart(spark):
    rng, begin = random.Random(4), datetime(2024, 1, 1)
    events = sorted((begin + timedelta(seconds=rng.randrange(86_400), microseconds=rng.randrange(10**6)), i, rng.randrange(6), rng.choice(C.STATUSES)) for i in range(600))
    late = [e for e in events]
    for i in range(0, len(late) - 8, 8):  # within the hour that the watermark waits
        part = late[i : i + 8]
        rng.shuffle(part)
        late[i : i + 8] = part
    schema = "ts timestamp, id long, key long, asked string"
    source, out = shared.fresh(spark, "events"), shared.fresh(spark, "out")
    for a, b in ((0, 150), (150, 420), (420, 600)):
        spark.createDataFrame(late[a:b], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        status.written(stream, out, f"{out}-checkpoint", "40 minutes", "1 hour").awaitTermination()
    mark = int((max(e[0] for e in events) - timedelta(hours=1) - begin) / timedelta(milliseconds=1)) * 1000
    since_begin = lambda t: (t - begin) // timedelta(microseconds=1)
    zero = spark.sql("SELECT unix_micros(timestamp'2024-01-01 00:00:00')").first()[0]
    want = []
    for key in range(6):
        mine = [(since_begin(t), i, a) for t, i, k, a in events if k == key]
        due = [(t, a) for t, _, a in mine if t < mark]
        state, since, *counts = status.applied("", -zero, due, mark, 40 * 60 * 10**6)
        want.append((key, state, since + zero, *counts, len(mine) - len(due)))
    got = sorted(map(tuple, status.read(spark, out).collect()))
    assert got == want and sum(r[5] for r in got) > 0 and sum(r[4] for r in got) > 0 and sum(r[6] for r in got) > 0


class OneRow:
    """A key's state as the machine sees it; counts how often it is written."""

    def __init__(self):
        self.get, self.exists, self.mark, self.updates, self.timer = None, False, 0, 0, None

    def update(self, row):
        self.get, self.exists, self.updates = row, True, self.updates + 1

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        assert at >= self.mark and at > 0
        self.timer = at


def test_a_batch_writes_a_key_once_however_many_events_wait():
    rng, second = random.Random(6), 1_000_000
    events = [(i * second + 500, i, rng.choice(C.STATUSES)) for i in range(3000)]
    state, advance, found = OneRow(), status.machine(90 * second), []
    for a, b, mark in ((0, 1800, 0), (1700, 3000, 1500), (0, 0, 2400)):
        part = events[a:b]
        rng.shuffle(part)
        state.mark, state.timer = mark * 1000, None
        rows = [pd.DataFrame(part[i : i + 700], columns=["micros", "id", "asked"]) for i in range(0, len(part), 700)]
        (row,) = [r for pdf in advance((7,), iter(rows), state) for r in pdf.itertuples(index=False)]
        found.append(row)
    want = status.applied("", 0, [(t, a) for t, _, a in events[:2400]], 2400 * second, 90 * second)
    # an event of second 1500 and 500 microseconds isn't due at second 1500; 100 events came twice
    assert state.updates == 3 and [r.waiting for r in found] == [1800, 1500, 600] and tuple(found[-1][1:6]) == want and found[-1].key == 7
    # the timer runs out when the watermark is past it: the next event, or the end of patience before that
    assert state.timer == 2400 * 1000 and state.get[5] == [t for t, _, _ in events[2400:]]


def test_events_without_a_key_have_a_state_of_their_own(spark):
    begin, minute = datetime(2024, 1, 1), timedelta(minutes=1)
    events = [(begin + i * minute, i, i % 30 or None, C.STATUSES[i * 7 % len(C.STATUSES)]) for i in range(90)]
    source, out = shared.fresh(spark, "events"), shared.fresh(spark, "out")
    schema = "ts timestamp, id long, key long, asked string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(source)
    status.written(spark.readStream.schema(schema).parquet(source), out, f"{out}-checkpoint", "30 minutes").awaitTermination()
    got = {r.key: r.accepted + r.rejected + r.waiting for r in status.read(spark, out).collect()}
    assert got == {None: 3} | {k: 3 for k in range(1, 30)}


def test_settings_are_as_before(spark):
    from docloom.streaming.index import PROVIDER, on_disk

    before = spark.conf.get(PROVIDER, None)
    with on_disk(spark):
        assert "RocksDB" in spark.conf.get(PROVIDER)
    assert spark.conf.get(PROVIDER, None) == before and spark.range(3).agg(F.sum("id")).first()[0] == 3


def test_pages_and_readings_in_any_order(spark):
    rng, at = random.Random(8), datetime(2024, 1, 1)
    pages = [(f"f{f}", p, "own text" if (f + p) % 2 else " ", 4, (f + p) % 3 == 0, at) for f in range(8) for p in range(1, 5)]
    reads = [(f, p, f"read {f} {p}", at) for f, p, _, _, waits, _ in pages if waits]
    missing = ("f5", 2)
    pages = [r for r in pages if (r[0], r[1]) != missing]
    want = sorted((f, p, streamed_pages.met(text, f"read {f} {p}" if waits else None), f != "f5") for f, p, text, _, waits, _ in pages)
    rng.shuffle(pages)
    rng.shuffle(reads)
    ps, rs, out = shared.fresh(spark, "pages"), shared.fresh(spark, "reads"), shared.fresh(spark, "out")
    schemas = "file string, page_num int, text string, pages int, waits boolean, ts timestamp", "file string, page_num int, ocr_text string, ts timestamp"
    # the watermark is the lesser of both streams': a late row of each lets the timer of the file that stays incomplete run out
    end = [("end", 1, "x", 1, False, at + timedelta(hours=5))]
    for a, b, c, e in ((0, 9, 0, 0), (9, 20, 0, 6), (20, 99, 6, 99)):
        spark.createDataFrame(pages[a:b] + pages[:a:5] + (end if b == 99 else []), schemas[0]).coalesce(1).write.mode("append").parquet(ps)
        spark.createDataFrame(reads[c:e] + ([("end", 1, "y", at + timedelta(hours=5))] if b == 99 else []), schemas[1]).coalesce(1).write.mode("append").parquet(rs)
        streams = [spark.readStream.schema(k).option("maxFilesPerTrigger", 1).parquet(p) for k, p in zip(schemas, (ps, rs))]
        streamed_pages.written(*streams, out, f"{out}-checkpoint", "2 hours").awaitTermination()
    got = [r for r in streamed_pages.read(spark, out).collect() if r.file != "end"]
    assert sorted((r.file, r.page_num, r.text, r.complete) for r in got) == want
    assert {r.edition for r in got} == {1} and all(r.needs_ocr == (r.char_count < 50 and "read" not in r.text) for r in got)


def test_progress_after_a_restart_in_the_middle_of_a_batch(spark):
    source, out = shared.fresh(spark, "progress"), shared.fresh(spark, "out")
    schema = "job string, at long, event string, body string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: progress.written(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), out, f"{out}-checkpoint").awaitTermination()
    write([("a", 2, "x", "1"), ("a", 1, "x", "0"), ("b", 9, "y", "0")])
    run()
    batch = [("a", 1, "x", "2"), ("c", 1, "z", "0"), ("a", 5, "x", "3")]
    # the batch's events are out, but the stream doesn't know it when it starts again
    progress.appended(spark.createDataFrame(batch, schema), out, 1)
    write(batch)
    run()
    write([("a", 1, "x", "4")])
    run()
    assert sorted(map(tuple, progress.replayed(spark, out).select("job", "seq", "body").collect())) == [("a", i + 1, str(i)) for i in range(5)] + [("b", 1, "0"), ("c", 1, "0")]
    behind = spark.createDataFrame([("a", 3), ("c", 1)], "job string, seq long")
    assert sorted(r.seq for r in progress.replayed(spark, out, behind).collect()) == [4, 5]
    (line,) = progress.as_stream_text(progress.replayed(spark, out).where("job = 'b'")).collect()
    assert line.line == "id: 1\nevent: y\ndata: 0\n\n"
    files = spark.createDataFrame([("j", "f1", "completed", 3, None), ("j", "f2", "failed", 0, "e" * 300)], "job string, file_name string, status string, chunks long, error string")
    events = sorted((r.at, r.event, len(r.body)) for r in progress.told(files, ["file_name"]).collect())
    assert [e[:2] for e in events] == [(0, "file_start"), (1, "file_done"), (2, "file_start"), (3, "file_error")] and events[3][2] < 240


def test_snapshots_by_all_pairs(spark):
    rng, begin = random.Random(5), datetime(2024, 1, 1)
    moments = [begin + timedelta(seconds=rng.randrange(4000)) for _ in range(12)] + [None]
    asked = [(i, begin + timedelta(seconds=rng.randrange(-50, 5000)) if i % 9 else moments[0]) for i in range(80)]
    got = registry.snapshots(spark.createDataFrame([(m,) for m in moments], "refreshed timestamp"), spark.createDataFrame(asked, "query_id int, ts timestamp"), 300).collect()
    for r in got:
        last = max((m for m in moments if m is not None and m <= r.ts), default=None)
        assert r.refreshed == last and r.stale == (last is None or (r.ts - last).total_seconds() > 300)
    assert len(got) == 80
