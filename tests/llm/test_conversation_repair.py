"""Operator 13 against a search over all edits, and against a plain scan of each conversation."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from docloom.llm import op13_conversation_repair as thirteen
from docloom.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def all_edits(turns):
    """turns: (role, text, fault). The least (cost, letters) of all edits with at most two inserts at a place."""
    best = None
    inserts = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    for gaps in itertools.product(inserts, repeat=len(turns) + 1):
        for choice in itertools.product("KuaD", repeat=len(turns)):
            roles, letters, cost, ok = list(gaps[0]), "I" * len(gaps[0]), 5 * len(gaps[0]), True
            for (role, _, fault), c, gap in zip(turns, choice, gaps[1:]):
                ok &= c == "D" or fault not in (1, 2)
                cost += {"K": 0, "D": 2}.get(c, 1) + (5 if c != "D" and fault == 3 else 0) + 5 * len(gap)
                letters += ("R" if c in "ua" else c) + "I" * len(gap)
                roles += [] if c == "D" else [role[:1] or "?" if c == "K" else c]
                roles += gap
            if ok and re.fullmatch("(s?(ua)+)?", "".join(roles)) and (best is None or (cost, letters) < best):
                best = cost, letters
    return best


def plain(rows):
    """What the query says of the rows of one conversation, by a search over (turn, state)."""
    live = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind:
            live += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in live:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
        seen.add((role, text))
    turns = [t for t, _, _ in live if t is not None]
    first = [r[:1] for _, r, _ in live]
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, letters, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(live) and state in (0, 3):
            break
        nxt = {"u": 2, "a": 3}
        fits = lambda c: c == "u" and state in (0, 1, 3) or c == "a" and state == 2 or c == "s" and state == 0
        for c, name in (("u", "user"), ("a", "assistant")):
            if fits(c):
                heapq.heappush(heap, (cost + 5, letters + "I", i, nxt[c], (*lines, f"{name}:")))
        if i < len(live):
            _, role, text = live[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, state, lines))
            if faults[i] in (0, 3):
                more = 5 if faults[i] else 0
                if role and fits(role[0]):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, {"s": 1, **nxt}[role[0]], (*lines, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if fits(c):
                        heapq.heappush(heap, (cost + more + 1, letters + "R", i + 1, nxt[c], (*lines, f"{name}:{text}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (rows[0][0], gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def wanted(rows):
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(tuple(r))
    return sorted(map(plain, of.values()), key=str)


def made(rng, convs, longest):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u"], ["Yes.", "no", "Why? ", " ", "", "So!\n", "1. a", "b", "c.", "d?", "e"]
    return [(c if c != 3 else None, None if rng.random() < 0.05 else t, rng.choices(roles, [9, 8, 2, 1, 1, 1, 1])[0], rng.choice(texts) + (str(rng.randrange(60)) if rng.random() < 0.5 else "") if rng.random() < 0.9 else None) for c in range(convs) for t in range(rng.randrange(longest))]


def test_matrices_equal_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 2, 3, 3):
        turns = [(rng.choice(["user", "assistant", "system", "tool", ""]), "x", rng.choice([0, 0, 0, 1, 3])) for _ in range(n)]
        kinds = thirteen.kinds_of([r for r, _, _ in turns], [f for _, _, f in turns])
        assert thirteen.ending(thirteen.scanned(kinds))[:2] == all_edits(turns), turns


def test_product_is_associative():
    rng = random.Random(6)
    for _ in range(100):
        a, b, c = ("".join(rng.choice("suaoSUAOd") for _ in range(rng.randint(0, 9))) for _ in range(3))
        p = thirteen.product
        x, y, z = map(thirteen.scanned, (a, b, c))
        assert p(p(x, y), z) == p(x, p(y, z)) == thirteen.scanned(a + b + c)


@pytest.mark.parametrize("rows", [2, 5, 2_048])
def test_blocks_of_any_size(spark, rows):
    table = made(random.Random(7), 12, 90)
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    found, chunks = thirteen.repaired(thirteen.damaged(df), Scratch(spark, "repair"), rows=rows)
    sums = {r.conv_id: r.repaired_sha256 for r in thirteen.hashed(chunks).collect()}
    got = [(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sums[r.conv_id]) for r in found.collect()]
    assert sorted(got, key=str) == wanted(table)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, thirteen.op13_conversation_repair(spark, sf).collect()), key=str) == wanted(rows)


def test_odd_and_empty_tables(spark, tmp_path):
    rows = [(None, None, None, None), (1, 0, "user", "x" * 300_000 + "."), (1, 0, "user", "Yes."), (1, 0, "user", "Yes."), (1, 1, "assistant", "No."), (2, None, "s", "a?"), (2, None, "u", "b?"), (2, None, "a", "b?")]
    rows += [(50 + i, 0, "user", "Dropped or not.") for i in range(60)]
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", AUDIT string").write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert sorted(map(tuple, thirteen.op13_conversation_repair(spark, f"{tmp_path}/a").collect()), key=str) == wanted(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert thirteen.op13_conversation_repair(spark, f"{tmp_path}/b").collect() == []
