"""Repair of the structure of conversations: a min-plus scan over 4x4 matrices.

A conversation is well formed when the initials of its roles read (s?(ua)+)?. Edits of a turn: keep it (K, 0), give it the
role user or assistant (R, 1), delete it (D, 2; the only one for a blank or repeated turn); anywhere an empty turn of user
or assistant may be inserted (I, 5). A truncated turn that stays costs 5 more. The cheapest edits are asked for, of equal
ones those whose letters are least in ASCII.

What may follow is told by four states: nothing yet, after system, after user, after assistant. A turn is a 4x4 matrix of
(cost, letters), behind the closure of all inserts; matrices are multiplied by adding costs, joining letters and taking
the least. Two paths over the same turns between the same states with equal costs never are a prefix of one another (the
longer one would have more inserts), so that the least of joined letters is the join of the least: the product is
associative. A conversation within a task is one product. One that goes over ends of tasks, or over BLOCK_ROWS turns or
BLOCK_BYTES, is cut into blocks; their matrices are multiplied in a tree of FAN branches, the states between blocks go
back down, and each block repairs its own turns. No task holds more than a block's texts; the matrices of a conversation
are 16 strings of a letter an edit, as its result itself has one.

Turns are sorted by turn (nulls first), role and text, in ranges over (conversation, turn, role, 64 letters of the text), so
that one conversation may hold any share of the rows. Null roles and texts are one blank, in a null id's or turn's damage
too; null conversations are one conversation. A role without letters, or with another initial than s, u or a, can't be
kept. Repeated rows are turns (the second one is a duplicate); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare, table

#: Turns and bytes of a block, at most (one turn may be longer); matrices that one task multiplies.
BLOCK_ROWS, BLOCK_BYTES, FAN = 2_048, 8 << 20, 32
#: Costs of the edits.
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after system, user, assistant. From which states a turn of an initial may follow, and the state behind it.
FROM, TO = {"s": (0,), "u": (0, 1, 3), "a": (2,)}, {"s": 1, "u": 2, "a": 3}
STATES, BLANKS = range(4), " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, CUT = range(4)
COUNTS = ["n", "blank", "duplicate", "truncated", "illegal"]
SHAPE = f"conv_id long, part int, seq int, whole boolean, {', '.join(c + ' long' for c in COUNTS)}, low long, high long, turns long, first string, last string, cost long, audit string, repaired string, lines long, roles array<string>, texts array<string>, prints array<binary>"


def least(entries):
    return min((e for e in entries if e is not None), default=None)


def product(a, b):
    """a, then b: matrices of (cost, letters) or None, by rows."""
    return tuple(least((x[0] + y[0], x[1] + y[1]) for k in STATES if (x := a[4 * i + k]) is not None and (y := b[4 * k + j]) is not None) for i in STATES for j in STATES)


def step_matrix(moves: dict[tuple[int, int], tuple[int, str]]):
    return tuple(moves.get((i, j)) for i in STATES for j in STATES)


ONE = step_matrix({(i, i): (0, "") for i in STATES})
#: Inserted turns: from a user's to an assistant's, else to a user's. Nowhere do more than two pay.
INSERTED = step_matrix({(i, 3 if i == 2 else 2): (INSERT, "I") for i in STATES})


def either(a, b):
    return tuple(least((x, y)) for x, y in zip(a, b))


CLOSURE = either(ONE, either(INSERTED, product(INSERTED, INSERTED)))


@lru_cache(None)
def turn_matrix(kind: str):
    """kind: the initial that may be kept (o: none), upper case where the turn is truncated; d: must go."""
    moves = {(i, i): (DELETE, "D") for i in STATES}
    if kind != "d":
        more, own = (TRUNCATED if kind.isupper() else 0), kind.lower()
        for role in "ua":
            moves |= {(i, TO[role]): (RETYPE + more, "R") for i in FROM[role]}
        for i in FROM.get(own, ()):
            moves[i, TO[own]] = min(moves.get((i, TO[own]), (99, "")), (more, "K"))
    return product(CLOSURE, step_matrix(moves))


@lru_cache(1 << 15)
def short_product(kinds: str):
    return scanned(kinds)


def scanned(kinds: str):
    """The product of the turns' matrices, halves first; short stretches of like turns are worked out once."""
    if len(kinds) < 2:
        return turn_matrix(kinds) if kinds else ONE
    half = len(kinds) // 2
    halves = (short_product if len(kinds) <= 16 else scanned), kinds[:half], kinds[half:]
    return product(halves[0](halves[1]), halves[0](halves[2]))


def faults_of(roles: list[str], texts: list[str], known: set[int] = frozenset()) -> list[int]:
    """The first fault of each turn; known: numbers of turns that occur in a former block."""
    seen, out = set(), []
    for i, (role, text) in enumerate(zip(roles, texts)):
        body = text.rstrip(BLANKS)
        if not body:
            out.append(BLANK)
        elif i in known or (role, text) in seen:
            out.append(DUPLICATE)
        else:
            out.append(FINE if body[-1] in ".!?" else CUT)
        seen.add((role, text))
    return out


def kinds_of(roles: list[str], faults: list[int]) -> str:
    out = []
    for role, fault in zip(roles, faults):
        own = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out.append("d" if fault in (BLANK, DUPLICATE) else own.upper() if fault == CUT else own)
    return "".join(out)


def replay(letters: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """Lines of the repaired turns: the state tells which role an R or I is."""
    lines, turn = [], iter(zip(roles, texts))
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(turn)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == 2 else "user"
        lines.append(f"{role}:{text}")
        state = TO[role[0]]
    return lines


def ending(entries) -> tuple[int, str, int, str]:
    """Of a whole product: cost, letters, the state before the last inserts, and those."""
    ends = [(x[0] + y[0], x[1] + y[1], i, y[1]) for i in STATES if (x := entries[i]) is not None for j in (0, 3) if (y := CLOSURE[4 * i + j]) is not None]
    return min(ends)


class Block:
    """Turns of one conversation in order."""

    def __init__(self, conv_id: int | None, part: int, seq: int, start: bool):
        self.conv_id, self.part, self.seq, self.start = conv_id, part, seq, start
        self.turns: list[int] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.bytes = 0

    def add(self, live: bool, turn: int | None, role: str, text: str) -> None:
        if live:
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text) + len(role)

    def row(self, whole: bool) -> dict:
        faults = faults_of(self.roles, self.texts)
        known = [t for t in self.turns if t is not None]
        first = [r[:1] for r in self.roles]
        out = dict(
            conv_id=self.conv_id, part=self.part, seq=self.seq, whole=whole, n=len(faults), blank=faults.count(BLANK), duplicate=faults.count(DUPLICATE), truncated=faults.count(CUT),
            illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), low=known[0] if known else None, high=known[-1] if known else None, turns=len(set(known)),
            first=first[0] if first else None, last=first[-1] if first else None,
        )
        if whole:
            cost, letters, _, _ = ending(scanned(kinds_of(self.roles, faults)))
            lines = replay(letters, 0, self.roles, self.texts)
            return out | dict(cost=cost, audit=letters, repaired="\n".join(lines), lines=len(lines), roles=None, texts=None, prints=None)
        prints = [None if f in (BLANK, DUPLICATE) else hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for f, r, t in zip(faults, self.roles, self.texts)]
        return out | dict(cost=None, audit=None, repaired=None, lines=None, roles=self.roles, texts=self.texts, prints=prints)


def blocks(turns: DataFrame, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> DataFrame:
    """turns: conv_id, live, turn, role, text in order. Rows of SHAPE: conversations that lie in one task, repaired, and the blocks of others."""
    narrow = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.string()), ("lines", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("prints", pa.list_(pa.binary()))])

    def run(batches):
        part, seq, block, out = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for conv_id, live, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                new = block is None or conv_id != block.conv_id
                if new or len(block.roles) >= rows or block.bytes >= size:
                    if block is not None:
                        out.append(block.row(new and block.start and seq > 1))
                    # the first one of a task may have begun in another
                    seq, block = seq + 1, Block(conv_id, part, seq, new)
                block.add(live, turn, role, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, narrow)
                out = []
        if block is not None:
            yield pa.RecordBatch.from_pylist([block.row(False)], narrow)

    return turns.mapInArrow(run, SHAPE)


SUMS = [c for c in COUNTS if c != "n"]
TREE = f"conv_id long, num long, {', '.join(c + ' long' for c in COUNTS)}, low long, high long, turns long, first string, last string, costs array<long>, letters array<string>, paths array<string>"
ARROW_TREE = pa.schema([("conv_id", pa.int64()), ("num", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string())), ("paths", pa.list_(pa.string()))])


def leaf_rows(batches):
    """Blocks with the numbers of their turns that occur in former blocks: rows of TREE."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            faults = faults_of(r["roles"], r["texts"], set(r["again"] or ()))
            m = scanned(kinds_of(r["roles"], faults))
            out.append(dict(
                conv_id=r["conv_id"], num=r["num"], n=r["n"], blank=faults.count(BLANK), duplicate=faults.count(DUPLICATE), truncated=faults.count(CUT), illegal=r["illegal"], low=r["low"], high=r["high"], turns=r["turns"], first=r["first"], last=r["last"],
                costs=[None if e is None else e[0] for e in m], letters=[None if e is None else e[1] for e in m], paths=[None if e is None else str(k % 4) for k, e in enumerate(m)],
            ))
        yield pa.RecordBatch.from_pylist(out, ARROW_TREE)


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring stretches of a conversation as one."""
    out = {"conv_id": a["conv_id"], "num": a["num"], "n": a["n"] + b["n"]}
    out |= {c: a[c] + b[c] for c in SUMS}
    if a["n"] and b["n"]:
        out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    out |= {"first": a["first"] if a["n"] else b["first"], "last": b["last"] if b["n"] else a["last"]}
    out |= {"low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}
    out["turns"] = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    # the states between blocks go with the letters, which fix them
    x, y = ([None if c is None else (c, s, p) for c, s, p in zip(r["costs"], r["letters"], r["paths"])] for r in (a, b))
    m = [least((p[0] + q[0], p[1] + q[1], p[2] + q[2]) for k in STATES if (p := x[4 * i + k]) and (q := y[4 * k + j])) for i in STATES for j in STATES]
    return out | {"costs": [e and e[0] for e in m], "letters": [e and e[1] for e in m], "paths": [e and e[2] for e in m]}


def tree(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of TREE a conversation, num 0."""

    def merge(rows: pa.Table) -> pa.Table:
        found = sorted(rows.select(ARROW_TREE.names).to_pylist(), key=lambda r: r["num"])
        while len(found) > 1:
            found = [joined(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
        return pa.Table.from_pylist([found[0] | {"num": found[0]["num"] // FAN}], ARROW_TREE)

    level, most = leaves, leaves.agg(F.max("num")).first()[0] or 0
    while most:
        level = scratch.write(level.groupBy("conv_id", F.floor(F.col("num") / FAN).alias("home")).applyInArrow(merge, TREE), "level")
        most //= FAN
    return level


def repaired(turns: DataFrame, scratch: Scratch, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """turns: conv_id long, live boolean, turn long, role, text (no nulls in the last two). live: false for a row that only tells that the conversation exists.

    The first result has conv_id, the counts, cost and audit of every conversation. The second has its repaired turns as
    texts, a role:text a line: conv_id, num, lines, repaired; to be joined in the order of num, without those of no lines.
    """
    prepare(turns.sparkSession)
    keys = ["conv_id", "turn", "role", F.substring("text", 1, 64)]
    ordered = turns.select("conv_id", "live", "turn", "role", "text").repartitionByRange(*keys).sortWithinPartitions("conv_id", "turn", "role", "text")
    all_ = scratch.write(blocks(ordered, rows, size), "blocks")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long").alias("gaps")
    of_whole, parts = all_.where("whole"), all_.where("NOT whole")
    numbers = scratch.write(parts.select("conv_id", "part", "seq", (F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seq")) - 1).cast("long").alias("num")), "numbers")
    place = ["part", "seq"]
    # a turn that occurs in a former block: a block has it once, so no key has more rows than there are blocks
    prints = parts.select(*place, F.posexplode("prints").alias("at", "print")).where("print IS NOT NULL").join(numbers, place)
    former = F.min("num").over(Window.partitionBy("conv_id", "print"))
    again = prints.withColumn("former", former).where("num > former").groupBy(*place).agg(F.collect_list("at").alias("again"))
    cut = scratch.write(parts.drop("prints", "conv_id").join(numbers, place).join(again, place, "left"), "cut")
    asked = [c for c in cut.columns if c not in ("part", "seq", "whole", "cost", "audit", "repaired", "lines")]
    leaves = scratch.write(cut.select(*asked).mapInArrow(leaf_rows, TREE), "leaves")

    def ends(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m = [None if c is None else (c, s) for c, s in zip(r["costs"][:4], r["letters"][:4])]
                cost, letters, state, more = ending(m)
                out.append({k: r[k] for k in ("conv_id", *COUNTS, "low", "high", "turns")} | {"cost": cost, "audit": letters, "path": r["paths"][state], "more": more})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in (*COUNTS, "low", "high", "turns", "cost")), ("audit", pa.string()), ("path", pa.string()), ("more", pa.string())]))

    done = scratch.write(tree(leaves, scratch).mapInArrow(ends, f"conv_id long, {', '.join(c + ' long' for c in COUNTS)}, low long, high long, turns long, cost long, audit string, path string, more string"), "ends")
    state = lambda at: F.substring("path", at, F.lit(1)).cast("int")
    num = F.explode(F.sequence(F.lit(1), F.length("path"))).alias("p")
    steps = done.select("conv_id", "path", "more", num)
    steps = steps.select("conv_id", (F.col("p") - 1).cast("long").alias("num"), F.when(F.col("p") == 1, 0).otherwise(state(F.col("p") - 1)).alias("before"), state(F.col("p")).alias("after"), F.when(F.col("p") == F.length("path"), F.col("more")).otherwise("").alias("more"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["num"] == b["num"])
    own = steps.join(leaves.select("conv_id", "num", "letters"), same(steps, leaves)).select(steps["conv_id"], steps["num"], "before", F.concat(F.get("letters", F.col("before") * 4 + F.col("after")), "more").alias("letters"))
    both = cut.select("conv_id", "num", "roles", "texts").join(own, same(cut, own)).select(cut["conv_id"], cut["num"], "roles", "texts", "before", "letters")

    def texts(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lines = replay(r["letters"], r["before"], r["roles"], r["texts"])
                out.append({"conv_id": r["conv_id"], "num": r["num"], "lines": len(lines), "repaired": "\n".join(lines)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("num", pa.int64()), ("lines", pa.int64()), ("repaired", pa.string())]))

    counts = ["conv_id", gaps, *SUMS, "cost", "audit"]
    chunks = both.mapInArrow(texts, "conv_id long, num long, lines long, repaired string")
    return of_whole.select(*counts).unionByName(done.select(*counts)), of_whole.select("conv_id", F.lit(0).cast("long").alias("num"), "lines", "repaired").unionByName(chunks)


def hashed(chunks: DataFrame) -> DataFrame:
    """conv_id and sha256 of the texts of a conversation, joined by ends of line: chunk after chunk, none but the current one in memory."""

    def run(batches):
        conv, state, begun = None, None, False
        ids, out = [], []
        for batch in batches:
            for conv_id, lines, text in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv_id != conv:
                    if state is not None:
                        ids.append(conv)
                        out.append(state.hexdigest())
                    conv, state, begun = conv_id, hashlib.sha256(), False
                if lines:
                    state.update(("\n" if begun else "").encode() + text.encode())
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])
            ids, out = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "num").select("conv_id", "lines", "repaired").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """The query's damage, by crc32 of conversation and turn: turns are dropped, emptied, truncated, repeated, given to the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))), F.lit(20))
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    is_: dict[int, Column] = {k: F.col("kind") == k for k in range(5)}
    text = F.when(is_[0] | is_[1], "").when(is_[2], F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(is_[3], F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", (~is_[0]).alias("live"), "turn", F.when(is_[4], "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "repair")
    found, chunks = repaired(damaged(table(spark, sf_dir, "conversations")), scratch)
    sums = hashed(chunks)
    rows = found.join(sums, found["conv_id"].eqNullSafe(sums["conv_id"])).drop(sums["conv_id"])
    return rows.select("conv_id", "gaps", *SUMS, "cost", "audit", "repaired_sha256")
