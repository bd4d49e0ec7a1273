"""Plans whose ops build on each other, folded in their order.

An op may name a section that an earlier op has moved or inserted; an insertion is named by
its ``id``, or by ``+`` and its place in the plan.  Sections stand in slots.  A section's slot
among its siblings is its own in the source; one moved after a section gets a new slot below
that section's slot, so it comes after the section and all that was put there earlier, before
the next sibling; an insertion becomes the first child of its anchor, after earlier ones.  A
section takes along what lies in it, whatever brought it there, when it is moved or deleted.
A new level holds for a section and what lay in it in the source.

The slots that a plan knows are numbered in the order of the new outline.  A heading that no
op names comes behind the last such slot before it; of several behind one slot those in the
deeper section come first, then each section's in the order of the source.  So a key has three
numbers, however long the chain.

Only the ops of one plan are folded together, in a task of its project: a plan is one JSON
document, and nothing of the outline is read but the paths of the sections that it names.
The headings get their keys by joins.
"""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.scan import Running
from vellum.operators.inventory import in_order
from vellum.schemas import LEVELS

FOLDED = "project string, kind string, seq int, ord int, key array<int>, file string, file_ord int, gone boolean, problem string, parent int, rank int, depth int, base int, last int"
#: More than the sections that can lie in each other.
DEEP = 1 << 30
TARGETED = ("rename", "merge_up", "relevel", "delete", "move")
ANCHORED = ("move", "insert")


def _play(ops: list[dict]) -> SimpleNamespace:
    """The ops of one plan in turn: sections with another place, slots, deletions and problems."""
    source, files, rank = {}, {}, {}  # parent, file and number of sections around, in the source
    moved: dict[int, dict] = {}  # sections with another place, insertions as negative numbers
    below: dict[int, list[int]] = {}  # slots that came after a slot; those of ops are negative numbers
    under: dict[int, int | None] = {}  # the slot that one of an op came after, none for an insertion's
    firsts: dict[int, list[int]] = {}  # slots of insertions by their anchor
    named: dict[str, int] = {}
    gone: dict[int, int] = {}
    bad: list[tuple[int, str]] = []
    known: dict[int, tuple] = {}  # of a section: the op that has deleted it, and its latest move or that of a section around it
    inner: set[int] = set()  # sections that others lie in, or have lain in

    def up(node: int) -> int | None:
        return moved[node]["parent"] if node in moved else source.get(node)

    def slot(node: int) -> int:
        return moved[node]["slot"] if node in moved else node

    def inherit(node: int, around: tuple) -> tuple:
        """The nearest deletion and the latest move, from those of the section around."""
        dead, late = around
        own = moved.get(node)
        return gone.get(node, dead), own if own and (late is None or own["seq"] > late["seq"]) else late

    def state(node: int) -> tuple:
        way, at = [], node
        while at is not None and at not in known:
            way.append(at)
            at = up(at)
        found = (None, None) if at is None else known[at]
        for n in reversed(way):
            found = known[n] = inherit(n, found)
        return found

    def within(target: int, node: int | None) -> bool:
        if target != node and target not in inner:
            return False
        while node is not None and node != target:
            node = up(node)
        return node is not None

    def find(op: dict, side: str) -> int | None:
        """The section that an op names, unless it is unknown or deleted."""
        name, path = op["id" if side == "t" else "after"], op[f"{side}_path"]
        node = path[-1] if path else named.get(name)
        if node is None or (node < 0 and side == "t" and op["op"] not in ("move", "delete")):
            bad.append((op["seq"], f"unknown id {'null' if name is None else name}"))
            return None
        dead = state(node)[0]
        if dead is not None:
            bad.append((op["seq"], f"depends on op {dead + 1}"))
            return None
        return node

    def changed(node: int) -> None:
        """What is known of a section is so no more, nor what is known of those in it."""
        if node in inner:
            known.clear()
        known.pop(node, None)

    for op in ops:
        for side in ("t", "a"):
            path = op[f"{side}_path"] or []
            for n, (node, parent) in enumerate(zip(path, [None, *path], strict=False)):
                source[node], rank[node] = parent, n
            inner.update(path[:-1])
            if path:
                files[path[-1]] = (op[f"{side}_file"], op[f"{side}_file_ord"])
    for op in ops:
        kind, seq = op["op"], op["seq"]
        target = find(op, "t") if kind in TARGETED else None
        anchor = find(op, "a") if kind in ANCHORED else None
        file = lambda node: late["file"] if (late := state(node)[1]) else files[node]
        if kind == "delete" and target is not None:
            gone[target] = seq
            changed(target)
        elif kind == "move" and target is not None and anchor is not None:
            if within(target, anchor):
                bad.append((seq, "move into its own section"))
            else:
                below.setdefault(slot(anchor), []).append(-seq - 1)
                under[-seq - 1] = slot(anchor)
                moved[target] = {"parent": up(anchor), "slot": -seq - 1, "file": file(anchor), "seq": seq}
                changed(target)
        elif kind == "insert" and anchor is not None:
            firsts.setdefault(anchor, []).append(-seq - 1)
            under[-seq - 1] = None
            moved[-seq - 1] = {"parent": anchor, "slot": -seq - 1, "file": file(anchor), "seq": seq}
            named[op["id"] or f"+{seq + 1}"] = -seq - 1
            inner.add(anchor)
    return SimpleNamespace(source=source, rank=rank, moved=moved, below=below, firsts=firsts, under=under, bad=bad, slot=slot, up=up, state=state, inherit=inherit)


def _problems(played: SimpleNamespace) -> list[dict]:
    return [{"kind": "problem", "seq": seq, "problem": said} for seq, said in played.bad]


def _place(node: int, key: list[int], late: dict, dead: int | None) -> dict:
    place = {"key": key, "file": late["file"][0], "file_ord": late["file"][1], "gone": dead is not None}
    return {"kind": "moved", "ord": node} | place if node > 0 else {"kind": "inserted", "seq": -node - 1} | place


def _fold(ops: list[dict]) -> list[dict]:
    """Problems, and the places that sections have got with their keys in full: that of the parent, a zero, and the slot's own.

    These keys are what the numbers of :func:`_numbered` stand for; a key is as long as a chain.
    """
    played = _play(ops)

    def own(slot: int) -> list[int]:
        upper = played.under.get(slot, 0)
        return [slot] if slot > 0 else [0, -slot] if upper is None else [*own(upper), -slot]

    def key(node: int) -> list[int]:
        above = played.up(node)
        return [*([*key(above), 0] if above is not None else []), *own(played.slot(node))]

    out = _problems(played)
    for node in played.moved:
        dead, late = played.state(node)
        out.append(_place(node, key(node), late, dead))
    return out


def _numbered(ops: list[dict]) -> list[dict]:
    """The same with the numbers of slots in the order of the new outline as keys, and a row for each section of the source that the plan knows."""
    played = _play(ops)
    source, moved, below, firsts = played.source, played.moved, played.below, played.firsts
    out = _problems(played)
    # the slots in the order of the new outline, without recursion: a chain may be as deep as it is long
    stands = {played.slot(node): node for node in (*source, *moved)}
    children: dict[int | None, list[int]] = {}
    for node in sorted(source):
        children.setdefault(source[node], []).append(node)
    nodes = {node: {"kind": "node", "ord": node, "parent": source[node] or 0, "rank": played.rank[node]} for node in source}
    at = 0
    todo: list[tuple] = [("slot", s, 1, (None, None)) for s in reversed(children.get(None, []))]
    while todo:
        what, this, depth, around = todo.pop()
        if what == "last":
            nodes[this]["last"] = at
            continue
        if what == "base":
            if this > 0:
                nodes[this]["base"] = at
            continue
        at += 1
        node = stands.get(this)
        if this > 0:
            todo.append(("last", this, 0, None))
        todo += [("slot", s, depth, around) for s in reversed(below.get(this, []))]
        if node is None:
            continue
        dead, late = inner_state = played.inherit(node, around)
        todo += [("slot", s, depth + 1, inner_state) for s in reversed(children.get(node, []))]
        todo.append(("base", node, 0, None))
        todo += [("slot", s, depth + 1, inner_state) for s in reversed(firsts.get(node, []))]
        if node > 0:
            nodes[node] |= {"key": [at, 0, 0], "depth": depth}
        if node in moved:
            out.append(_place(node, [at, 0, 0], late, dead))
    return out + list(nodes.values())


def fold(ops: DataFrame, headings: DataFrame, around: DataFrame) -> DataFrame:
    """The places and problems of each project's plan; ``around`` are the paths of ``headings``."""
    names = ops.select("project", F.explode(F.array("id", "after")).alias("id")).filter("id is not null").distinct()
    heads = names.join(headings.select("project", "id", "ord", "file", "file_ord"), ["project", "id"])
    path = around.join(heads, ["project", "ord"]).groupBy("project", "id").agg(F.array_sort(F.collect_list("around")).alias("path"), F.first("file").alias("file"), F.first("file_ord").alias("file_ord"))
    side = lambda field, p: path.select("project", F.col("id").alias(field), *[F.col(c).alias(f"{p}_{c}") for c in ("path", "file", "file_ord")])
    known = ops.select("project", "seq", "op", "id", "after").join(side("id", "t"), ["project", "id"], "left").join(side("after", "a"), ["project", "after"], "left")
    columns = [c.split()[0] for c in FOLDED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.bool_(), pa.string(), *[pa.int32()] * 5]

    def run(table: pa.Table) -> pa.Table:
        found = [{"project": table.column("project")[0].as_py()} | r for r in _numbered(table.sort_by("seq").to_pylist())]
        return pa.Table.from_arrays([pa.array([r.get(c) for r in found], k) for c, k in zip(columns, kinds, strict=True)], columns)

    return known.groupBy("project").applyInArrow(run, FOLDED)


def places(folded: DataFrame, ops: DataFrame, headings: DataFrame, around: DataFrame) -> DataFrame:
    """project, ord, key, gone, is_moved, to_file, to_file_ord of every heading: its own slot's, or behind the last known slot before it."""
    moved = folded.filter("kind = 'moved'").select("project", F.col("ord").alias("around"), F.struct("file", "file_ord", "gone").alias("m"))
    nodes = folded.filter("kind = 'node'")
    deleted = ops.filter("op = 'delete'").join(headings.select("project", "id", "ord"), ["project", "id"]).select("project", F.col("ord").alias("around"), F.lit(True).alias("d")).distinct()
    hit = around.join(moved, ["project", "around"], "left").join(deleted, ["project", "around"], "left")
    hit = hit.join(nodes.select("project", F.col("ord").alias("around"), F.struct("key", "rank", "depth", "base").alias("v")), ["project", "around"], "left")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("around"))).alias(c)
    by = hit.groupBy("project", "ord").agg(
        F.max(F.when(F.col("m").isNotNull(), F.col("around"))).alias("at"), last("m"),
        F.max(F.when(F.col("v").isNotNull(), F.col("around"))).alias("node"), last("v"),
        F.max(F.when(F.col("d"), F.col("around"))).alias("gone_at"),
    )
    # the last known slot of each section met on the way through the source, by the number of sections around the slot
    slots = nodes.select("project", "ord", F.struct("parent", "last").alias("slot"), F.col("rank").alias("slot_rank"))
    rows = headings.select("project", "file_ord", "line_no", "ord").join(by, ["project", "ord"]).join(slots, ["project", "ord"], "left")
    met = {f"__s{k}": F.when(F.col("slot_rank") == k, F.col("slot")) for k in range(len(LEVELS))}
    rows = in_order(rows, Running(lasts=met), keep=True)
    within = F.coalesce(F.col("v.rank") + 1, F.lit(0))
    seen = F.coalesce(*[F.when(within == k, F.col(f"__s{k}")) for k in range(len(LEVELS))])
    before = F.when(seen["parent"] == F.coalesce("node", F.lit(0)), seen["last"])
    behind = F.array(F.coalesce(before, "v.base", F.lit(0)), F.lit(DEEP) - F.coalesce("v.depth", F.lit(0)), F.col("ord"))
    key = F.when(F.col("node") == F.col("ord"), F.col("v.key")).otherwise(behind)
    gone = F.coalesce(F.col("gone_at") >= F.coalesce("at", F.lit(0)), F.lit(False)) | F.coalesce("m.gone", F.lit(False))
    return rows.select("project", "ord", key.alias("key"), gone.alias("gone"), F.col("at").isNotNull().alias("is_moved"), F.col("m.file").alias("to_file"), F.col("m.file_ord").alias("to_file_ord"))
