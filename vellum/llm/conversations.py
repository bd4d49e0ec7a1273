"""Conversation structure repair (operator 13).

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: perhaps a system
turn, then user and assistant in turn.  Its rows, in order of turn, go forward through the
four states of that grammar (start, after system, after user, after assistant).  Each state
carries the least (cost, audit string) that leads to it; a row is kept (K, 0), given the other
role (R, 3) or deleted (D, 4), a truncated one that stays costs 3 more, blank rows and
duplicates must go; two insertions (I, 3 each) at most close each layer, more would only lead
back.  Of equal costs the audit that is least in ASCII stays, which is right for prefixes too:
with equal costs none is the other's beginning.

Conversations of up to ``MOST`` rows and ``MOST_CHARS`` characters are dealt by their id and
repaired one after the other.  Longer ones are cut into blocks by their order: what leads from
each state to each other is found block by block, a fold over the blocks chooses the path, and
each block's rows are edited on their own; only the digest reads such a conversation in one
task, as a stream, since SHA-256 is a chain.

Defined results: a null role or text is one space, so a null text is blank; null turns come
first; rows of one turn go by role, then by a hash of the text; null ids are one conversation;
an empty table stays empty; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import in_arrow, sole
from .staging import sendable, stage

#: Rows and characters of a conversation that one step of a task may hold.
MOST = 4096
MOST_CHARS = 8_000_000
#: Rows of a block of a longer one, as a power of two.
BLOCK_BITS = 12
SPACES = " \t\n\x0b\f\r"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, by the state before.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: A row as one character: its initial (or another) times sound, truncated, to be deleted.
INITIALS = "sua?"
SYMBOLS = "abcdefghijkl"

Layer = list[tuple[int, str] | None]


def symbol(initial: str, fault: int) -> str:
    """The character of a row; ``fault``: 0 none, 1 truncated, 2 blank or duplicate."""
    return SYMBOLS[INITIALS.find(initial if initial in ("s", "u", "a") else "?") * 3 + fault]


def closed(layer: Layer) -> Layer:
    """``layer`` with what insertions lead to: a user turn, then an assistant's."""
    for role, to in (("u", USER), ("a", ASSISTANT)):
        ways = [(cost + 3, audit + "I") for cost, audit in (layer[s] for s in AFTER[role] if layer[s])]
        layer[to] = min([*ways, *([layer[to]] if layer[to] else [])], default=None)
    return layer


def step(layer: Layer, row: str) -> Layer:
    """The layer after one more row."""
    k = SYMBOLS.index(row)
    initial, fault = INITIALS[k // 3], k % 3
    out: Layer = [(x[0] + 4, x[1] + "D") if x else None for x in layer]
    if fault < 2:
        ways = [(initial, 0, "K")] if initial in AFTER else []
        for role, cost, mark in [*ways, ("u", 3, "R"), ("a", 3, "R")]:
            for s, to in AFTER[role].items():
                if layer[s]:
                    way = (layer[s][0] + cost + 3 * fault, layer[s][1] + mark)
                    out[to] = min(out[to], way) if out[to] else way
    return closed(out)


def through(layer: Layer, rows: str) -> Layer:
    """The layer after ``rows``."""
    for row in rows:
        layer = step(layer, row)
    return layer


def opened() -> Layer:
    """The layer before the first row."""
    return closed([(0, ""), None, None, None])


@lru_cache(maxsize=100_000)
def cheapest(rows: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    layer = through(opened(), rows)
    return min(x for x in (layer[START], layer[ASSISTANT]) if x)


def path(rows: str) -> tuple[int, str]:
    """The same; short conversations recur and are looked up."""
    return cheapest(rows) if len(rows) <= 64 else cheapest.__wrapped__(rows)


def edited(state: int, edits: str, rows: list[tuple[str, str]], initials: str) -> list[str]:
    """``role:text`` of what the edits leave of ``rows``, from a state of the grammar on."""
    out, at = [], 0
    for edit in edits:
        role, text, initial = "", "", ""
        if edit != "I":
            (role, text), initial = rows[at], initials[at]
            at += 1
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
            initial = role[0]
        state = AFTER[initial][state]
        out.append(f"{role}:{text}")
    return out


def illegal(initials: str) -> int:
    """Neighbours whose initials do not go together."""
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) damaged by a hash of conversation and turn: ``kept`` is false for dropped ones."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(blank("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    fated = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", fate.alias("fate"))
    return fated.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"), (F.col("fate") != 0).alias("kept"))


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blank`` and ``open`` (does not end a sentence)."""
    ended = F.rtrim("text", F.lit(SPACES))
    return rows.select("conv_id", "turn", "role", "text", "copy", (ended == "").alias("blank"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("open"))


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie"), F.asc("copy")]


def _whole(rows: DataFrame) -> DataFrame:
    """The report of conversations that a step may hold; a row without role stands for one that lost all its rows."""

    def report(conv_id, turns: list, held: list[tuple[str, str, bool, bool]]) -> tuple:
        seen: set[tuple[str, str]] = set()
        counts, codes, initials = [0, 0, 0], [], []
        for role, text, blank, open_ in held:
            again = (role, text) in seen
            seen.add((role, text))
            fault = 0 if blank else 1 if again else 2 if open_ else None
            if fault is not None:
                counts[fault] += 1
            initials.append(role[:1] if role[:1] in ("s", "u", "a") else "?")
            codes.append(symbol(initials[-1], {None: 0, 2: 1}.get(fault, 2)))
        cost, audit = path("".join(codes))
        known = {t for t in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        lines = edited(START, audit, [h[:2] for h in held], "".join(initials))
        return conv_id, gaps, *counts, illegal("".join(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("conversations", cheapest.cache_clear)
        now, turns, held, out = None, [], [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            out.clear()
            return batch

        names = [c.split()[0] for c in REPORT.split(", ")]
        for batch in batches:
            for conv, turn, role, text, blank, open_ in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "blank", "open")), strict=True):
                if now != (conv,):
                    if now:
                        out.append(report(now[0], turns, held))
                    now, turns, held = (conv,), [], []
                if role is not None:
                    turns.append(turn)
                    held.append((role, text, blank, open_))
            if out:
                yield flush()
        if now:
            out.append(report(now[0], turns, held))
            yield flush()

    ordered = rows.withColumn("tie", F.xxhash64("text")).repartition("conv_id").sortWithinPartitions(*_order())
    return in_arrow(ordered.drop("tie", "copy"), run, REPORT)


def _long(rows: DataFrame) -> DataFrame:
    """The report of longer conversations, block by block."""
    tied = rows.withColumn("tie", F.xxhash64("text"))
    ordered = tied.repartitionByRange(*_order()).sortWithinPartitions(*_order()).drop("tie", "copy")
    ordered = stage(ordered.withColumn("rid", F.monotonically_increasing_id()), "long")  # as written, numbers stay
    firsts = ordered.groupBy("conv_id", "role", "text").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    initial = F.left("role", F.lit(1))
    fault = F.when(F.col("blank"), 0).when(F.col("first").isNull(), 1).when(F.col("open"), 2).otherwise(3)
    marked = ordered.join(firsts, "rid", "left").select("conv_id", "rid", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), fault.alias("fault"))
    marked = stage(marked.withColumn("block", F.shiftright("rid", BLOCK_BITS)), "marked")
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rid", "initial", "fault"))), lambda x: x[c])
    counts = [F.count_if(F.col("fault") == k).alias(name) for k, name in enumerate(("blank", "duplicate", "truncated"))]
    blocks = marked.groupBy("conv_id", "block").agg(F.array_join(of("initial"), "").alias("initials"), of("fault").alias("faults"), *counts)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for initials, faults in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist(), strict=True):
                codes = "".join(symbol(i, {3: 0, 2: 1}.get(f, 2)) for i, f in zip(initials, faults, strict=True))
                cells.append([None if x is None else {"cost": x[0], "audit": x[1]} for s in range(4) for x in through([(0, "") if k == s else None for k in range(4)], codes)])
            names = ["conv_id", "block", "blank", "duplicate", "truncated", "initials"]
            kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(cells, kind)], [*names, "cells"])

    cells = stage(in_arrow(blocks, matrix, "conv_id long, block long, blank long, duplicate long, truncated long, initials string, cells array<struct<cost:long,audit:string>>"), "cells")

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        start = opened()
        layer = [x and (*x, (None, START, x[1])) for x in start]  # cost, audit, the way: (before, state, edits)
        for row in table.column("cells"):
            m = row.as_py()
            ways: list = [[] for _ in range(4)]
            for s, x in enumerate(layer):
                for t in range(4):
                    if x and (c := m[4 * s + t]):
                        ways[t].append((x[0] + c["cost"], x[1] + c["audit"], (x[2], s, c["audit"])))
            layer = [min(w, key=lambda y: y[:2]) if w else None for w in ways]
        cost, audit, way = min((x for x in (layer[START], layer[ASSISTANT]) if x), key=lambda y: y[:2])
        states, edits = [], []
        while way:
            way, state, own = way
            states.append(state)
            edits.append(own)
        states, edits = states[::-1], edits[::-1]
        states[:2], edits[:2] = [START], [edits[0] + edits[1]]  # insertions before the first row belong to its block
        plan = [{"block": b, "state": s, "edits": e} for b, s, e in zip(table.column("block").to_pylist(), states, edits, strict=True)]
        sums = [sum(table.column(c).to_pylist()) for c in ("blank", "duplicate", "truncated")]
        initials = "".join(table.column("initials").to_pylist())
        kind = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]))
        values = [table.column("conv_id")[0].as_py(), *sums, illegal(initials), cost]
        columns = [*(pa.array([v], pa.int64()) for v in values), pa.array([audit]), pa.array([plan], kind)]
        return pa.Table.from_arrays(columns, ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "plan"])

    folded = stage(cells.groupBy("conv_id").applyInArrow(fold, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, plan array<struct<block:long,state:int,edits:string>>"), "folded")
    plans = folded.select("conv_id", F.explode("plan").alias("p")).select("conv_id", "p.*")
    texts = ordered.withColumn("block", F.shiftright("rid", BLOCK_BITS))

    def chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("rid")
        rows_ = list(zip(left.column("role").to_pylist(), left.column("text").to_pylist(), strict=True))
        plan = right.to_pylist()[0]
        lines = edited(plan["state"], plan["edits"], rows_, "".join(r[:1] or "?" for r, _ in rows_))
        kinds = [pa.array([plan[c]], pa.int64()) for c in ("conv_id", "block")]
        return pa.Table.from_arrays([*kinds, pa.array(["\n".join(lines)])], ["conv_id", "block", "lines"])

    chunks = texts.groupBy("conv_id", "block").cogroup(plans.groupBy("conv_id", "block")).applyInArrow(chunk, "conv_id long, block long, lines string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, empty = None, hashlib.sha256(), True
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([chain.hexdigest()])], ["conv_id", "repaired_sha256"])
        for batch in batches:
            for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if now != (conv,):
                    if now:
                        yield done()
                    now, chain, empty = (conv,), hashlib.sha256(), True
                if lines:
                    chain.update(b"" if empty else b"\n")
                    chain.update(lines.encode())
                    empty = False
        if now:
            yield done()

    digests = in_arrow(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "block"), digest, "conv_id long, repaired_sha256 string")
    turns = ordered.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = folded.drop("plan").alias("f")
    for other in (turns, digests):
        other = other.withColumnRenamed("conv_id", "o_id")
        out = out.join(other, out["conv_id"].eqNullSafe(other["o_id"])).drop("o_id")
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame, most: int = MOST, most_chars: int = MOST_CHARS) -> DataFrame:
    """The report of every conversation in ``rows`` (conv_id, turn, role, text, copy, kept)."""
    sizes = stage(rows.groupBy("conv_id").agg(F.count_if("kept").alias("n"), F.sum(F.when(F.col("kept"), F.char_length("text"))).alias("chars")), "sizes")
    left = _faults(rows.filter("kept"))
    gone = sizes.filter("n = 0").select("conv_id", *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns[1:]])
    long = sizes.filter((F.col("n") > most) | (F.col("chars") > most_chars)).select(F.col("conv_id").alias("long_id"))
    if long.isEmpty():
        return _whole(left.unionByName(gone))
    long = sendable(long)
    split = lambda how: left.join(long, left["conv_id"].eqNullSafe(long["long_id"]), how)
    return _whole(split("left_anti").unionByName(gone)).unionByName(_long(split("left_semi")))


def damaged_and_repaired(rows: DataFrame, most: int = MOST, most_chars: int = MOST_CHARS) -> DataFrame:
    """:func:`repair` of what :func:`damage` makes of ``rows``."""
    return repair(damage(rows), most, most_chars)

