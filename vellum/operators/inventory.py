"""From manuscripts to headings and their statistics.

Numbers, extents and sums of an outline are scans over blocks (:mod:`vellum.functions.scan`),
a block being a stretch of lines of one file: no task holds a whole project or a whole file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, pairwise
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions.roles import RULES, role_of
from vellum.functions.scan import BLOCK_BITS, Running, latest, scan
from vellum.plans.settle import settle
from vellum.schemas import LEVELS, STATS

if TYPE_CHECKING:
    import pyarrow as pa

FILE = ("project", "file")


def split_lines(sections: DataFrame) -> DataFrame:
    """project, file, file_ord, line_no (from 1), line: joined by a line feed they are the text again."""
    return sections.select("project", "file", "file_ord", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select(
        "project", "file", "file_ord", (F.col("at") + 1).alias("line_no"), "line"
    )


def _after(fences: list[tuple[str, bool]], state: str) -> str:
    """The mark of the block that is open behind some fences (mark, bare), '' if none; one that is open before is ``state``."""
    for mark, bare in fences:
        if not state:
            state = mark
        elif bare and mark.startswith(state):
            state = ""
    return state


KEY = (*FILE, "file_ord")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The stretches of a partition that is sorted by them: key, and (line_no, mark, bare) of the fences."""
    at, held = None, []
    for batch in batches:
        keys, fences = [batch.column(c) for c in (*KEY, "stretch")], zip(*(batch.column(c).to_pylist() for c in ("line_no", "mark", "bare")), strict=True)
        other = np.zeros(max(0, batch.num_rows - 1), bool)
        for k in keys:
            other |= np.diff(k.dictionary_encode("encode").indices.to_numpy()) != 0
        bounds = [*([0] if batch.num_rows else []), *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
        for x, y in pairwise(bounds):
            key = tuple(k[x].as_py() for k in keys)
            if key != at:
                if held:
                    yield at, held
                at, held = key, []
            held += islice(fences, y - x)
    if held:
        yield at, held


def _batches(made: Iterator[tuple[tuple, list[tuple]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of each stretch, its key (the first columns) before them."""
    import pyarrow as pa

    n, keys, sizes, rows = len(KEY), [], [], []

    def batch() -> pa.RecordBatch:
        place = pa.array(np.repeat(np.arange(len(keys)), sizes))
        first = [pa.array(c, f.type).take(place) for c, f in zip(zip(*keys, strict=True), schema, strict=False)]
        rest = [pa.array(c, schema.field(n + k).type) for k, c in enumerate(zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays(first + rest, schema=schema)

    for key, new in made:
        keys.append(key[:n])
        sizes.append(len(new))
        rows += new
        if len(rows) >= 20_000:
            yield batch()
            keys, sizes, rows = [], [], []
    if rows:
        yield batch()


def _function(fences: list[tuple[str, bool]]) -> tuple[str, list[dict]]:
    """What some fences do to a state: where they lead from no open block, and which of them close an open one."""
    closing, longest = [], {}
    for n, (mark, bare) in enumerate(fences):
        if bare and len(mark) > longest.get(mark[0], 0):
            longest[mark[0]] = len(mark)
            closing.append({"mark": mark, "then": _after(fences[n + 1 :], "")})
    return _after(fences, ""), closing


def _in_turn(fences: DataFrame, of_stretch: Callable[[int, list[tuple]], list[tuple]], columns: str) -> DataFrame:
    """What ``of_stretch`` makes of the fences of each stretch: the columns of a file, and ``columns``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType([fences.schema[c] for c in KEY] + StructType.fromDDL(columns).fields)
    schema = to_arrow_schema(kind)

    def run(batches):
        return _batches(((at, of_stretch(at[-1], held)) for at, held in _stretches(batches)), schema)

    cut = [*KEY, "stretch"]
    return fences.select(*cut, "line_no", "mark", "bare").repartition(*cut).sortWithinPartitions(*reversed(cut), "line_no").mapInArrow(run, kind)


def fence_states(fences: DataFrame) -> DataFrame:
    """project, file, file_ord, stretch, state: the mark of the block that is open where each stretch of lines with fences begins.

    What a stretch does to a state is a function that is known from its own fences: from no
    open block it leads to one state; a block that is open already is closed by the first bare
    fence of its mark that is long enough, which only longer ones than all before can be the
    first for, so a few fences (the records of each mark) tell all cases.  These functions are
    made in each stretch on its own and applied one after the other by file.
    """
    made = _in_turn(fences, lambda stretch, held: [(stretch, *_function([f[1:] for f in held]))], "stretch int, fresh string, closing array<struct<mark:string,then:string>>")
    listed = F.array_sort(F.collect_list(F.struct("stretch", "fresh", "closing")))
    fold = F.expr(
        """aggregate(fs, named_struct('state', '', 'out', cast(array() as array<struct<stretch:int,state:string>>)),
             (s, f) -> named_struct(
               'state', if(s.state = '', f.fresh, coalesce(try_element_at(filter(f.closing, c -> startswith(c.mark, s.state)), 1).then, s.state)),
               'out', concat(s.out, array(named_struct('stretch', f.stretch, 'state', s.state)))), s -> s.out)"""
    )
    return made.groupBy(*KEY).agg(listed.alias("fs")).select(*KEY, F.explode(fold).alias("x")).select(*KEY, "x.stretch", "x.state")


def _fences(lines: DataFrame) -> DataFrame:
    mark = F.regexp_extract("line", X.FENCE, 1)
    found = lines.filter(F.col("line").rlike(X.FENCE))
    return found.select(*FILE, "file_ord", "line_no", F.shiftright("line_no", BLOCK_BITS).alias("stretch"), mark.alias("mark"), F.col("line").rlike(X.FENCE + "[ \t\r]*$").alias("bare"))


def _walk(_: int, held: list[tuple]) -> list[tuple]:
    """The fences of one stretch in turn: line_no, which of them open a block, and whether one is open behind them.

    A row without ``bare`` comes first, if any: the mark of the block that is open before.
    """
    state, out = "", []
    for line_no, mark, bare in held:
        if bare is None:
            state = mark
            continue
        opens = not state
        if opens:
            state = mark
        elif bare and mark.startswith(state):
            state = ""
        out.append((line_no, opens, state != ""))
    return out


def mark_code(lines: DataFrame, wanted: Column | None = None) -> DataFrame:
    """``lines`` with ``code`` (in a fenced block or a fence itself) and ``opens`` (an opening fence).

    A fence of back-ticks or tildes is closed by one of the same mark that is as long at
    least and has nothing behind it; without one the block lasts to the end of the file.
    Fences are folded by stretches of ``BLOCK_BITS`` lines, from the state that
    :func:`fence_states` gives them, so a file of any length is cut over many tasks.  The
    fences of all lines count; where only the lines ``wanted`` are asked for, no others are
    written down, shuffled or given back.
    """
    if wanted is not None:
        held = settle(lines.filter(wanted | F.col("line").rlike(X.FENCE)))
        found, lines = settle(_fences(held)), held.filter(wanted)
    else:
        found = settle(_fences(lines))
    states = fence_states(found).filter("state <> ''")  # before the first line of a stretch
    begun = found.unionByName(states.select(*KEY, (F.shiftleft("stretch", BLOCK_BITS) - 1).alias("line_no"), "stretch", F.col("state").alias("mark"), F.lit(None).cast("boolean").alias("bare")))
    walked = _in_turn(begun, _walk, "line_no int, opens boolean, inside boolean")
    marks = settle(walked.select(*KEY, "line_no", F.struct("line_no", "opens", "inside").alias("__fence")))
    marked = latest(lines, marks, list(KEY), "__fence")
    is_fence = F.coalesce(F.col("__fence.line_no") == F.col("line_no"), F.lit(False))
    # a fence line is code itself, a closing one too
    return marked.select(*lines.columns, (F.coalesce("__fence.inside", F.lit(False)) | is_fence).alias("code"), (is_fence & F.coalesce("__fence.opens", F.lit(False))).alias("opens"))


def in_order(headings: DataFrame, running: Running, keep: bool = False) -> DataFrame:
    """Running values over the headings of each project, in blocks of ``BLOCK_BITS`` lines."""
    cut = headings.withColumn("__stretch", F.shiftright("line_no", BLOCK_BITS))
    return scan(cut, ["project"], ["file_ord", "__stretch"], ["line_no"], running, keep).drop("__stretch")


def may_head() -> Column:
    """Whether a line is a heading if it is no code."""
    return F.col("line").rlike(X.HEADING)


def find_headings(marked: DataFrame, rules: list = RULES) -> DataFrame:
    """project, file, file_ord, line_no, id, ord, level, title, num, num_style, role."""
    level = X.heading_level(F.col("line"))
    found = marked.filter(~F.col("code") & may_head()).select("project", "file", "file_ord", "line_no", level.alias("level"), X.heading_text(F.col("line")).alias("text"))
    found = found.select("project", "file", "file_ord", "line_no", "level", X.title_of(F.col("text")).alias("title"), X.number_of(F.col("text")).alias("num"))
    found = in_order(found, Running(sums={"ord": F.lit(1)}), keep=True)
    return found.select(
        "project",
        "file",
        "file_ord",
        "line_no",
        F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("id"),
        F.col("ord").cast("int").alias("ord"),
        "level",
        "title",
        "num",
        F.when(F.col("num").isNull(), "none").otherwise("arabic").alias("num_style"),
        role_of(F.col("title"), F.col("level"), rules).alias("role"),
    )


def count_levels(headings: DataFrame) -> DataFrame:
    """project, level, n."""
    return headings.groupBy("project", "level").agg(F.count("*").alias("n"))


def own_body(marked: DataFrame, headings: DataFrame) -> DataFrame:
    """project, file, line_no of each heading with what its own body holds."""
    heads = headings.select(*FILE, "line_no", F.col("line_no").alias("owner"))
    owned = latest(marked.select(*FILE, "line_no", "line", "code", "opens"), heads, [*FILE], "owner")
    body = owned.withColumn("is_head", F.col("owner") == F.col("line_no"))
    text = ~F.col("code") & ~F.col("is_head")
    return (
        body.filter("owner is not null")
        .groupBy(*FILE, F.col("owner").alias("line_no"))
        .agg(
            F.floor(F.sum(F.when(text, X.dollars(F.col("line"))).otherwise(0)) / 2).cast("long").alias("display_eqs"),
            F.sum(F.when(text, X.figures(F.col("line"))).otherwise(0)).cast("long").alias("figures"),
            F.sum(F.col("opens").cast("long")).alias("code_blocks"),
        )
    )


def _extent(headings: DataFrame, keep: bool = False, **more: dict) -> DataFrame:
    """``headings`` with ``subtree_end``, the ord of the next heading that is not below, or one past the last."""
    nexts = {f"__end_{k}": F.when(F.col("level") <= k, F.col("ord")) for k in LEVELS}
    found = in_order(headings, Running(nexts=nexts, **more), keep)
    size = headings.groupBy("project").agg((F.count("*") + 1).alias("__past"))
    own = F.coalesce(*[F.when(F.col("level") == k, F.col(f"__end_{k}")) for k in LEVELS], F.col("__past"))
    return found.join(size, "project").withColumn("subtree_end", own.cast("int")).drop("__past", *nexts)


def with_extent(headings: DataFrame) -> DataFrame:
    """``headings`` with ``subtree_end``."""
    return _extent(headings)


def subtree(headings: DataFrame, own: DataFrame) -> DataFrame:
    """``headings`` with own statistics, subtree_end and sums over the subtree (total_*), by prefix sums."""
    stats = headings.join(own, [*FILE, "line_no"], "left")
    for c in STATS:
        stats = stats.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    sums = _extent(stats, keep=True, sums={f"upto_{c}": F.col(c) for c in STATS})
    ends = sums.select("project", (F.col("ord") + 1).alias("subtree_end"), *[F.col(f"upto_{c}").alias(f"end_{c}") for c in STATS])
    joined = sums.join(ends, ["project", "subtree_end"])
    totals = [(F.col(f"end_{c}") - F.col(f"upto_{c}") + F.col(c)).alias(f"total_{c}") for c in STATS]
    return joined.select(*headings.columns, "subtree_end", *STATS, *totals)


def inventory(sections: DataFrame, rules: list = RULES) -> tuple[DataFrame, DataFrame]:
    """Marked lines and headings with statistics."""
    marked = mark_code(split_lines(sections))
    headings = find_headings(marked, rules)
    return marked, subtree(headings, own_body(marked, headings))
