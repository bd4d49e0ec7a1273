"""Edit plans: parsing, validation and the outline they lead to.

Ops name headings by their id in the source.  A plan is valid as a whole or not at all.  Ops
that depend on each other's result (an anchor that is moved, a target in a deleted part) are
refused, and all valid ops are applied at once by joins and sort keys; a plan that says
``"chained": true`` is folded in the order of its ops instead (:mod:`vellum.plans.chained`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.scan import Running, scan
from vellum.operators.inventory import in_order
from vellum.plans.chained import fold, places
from vellum.plans.settle import settle
from vellum.schemas import LEVELS, OP_KINDS, PLAN


def _read(plans: DataFrame) -> DataFrame:
    """project, p: the plan, with ``_corrupt_record`` set where it is no plan."""
    kind = f"{PLAN}, _corrupt_record string"
    return plans.select("project", F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"), "value")


def _sound() -> Column:
    return F.col("p._corrupt_record").isNull() & F.col("p.ops").isNotNull() & F.coalesce("p.numbering", F.lit("auto")).isin("auto", "keep")


def parse_plan(plans: DataFrame) -> DataFrame:
    """Rows (project, value: JSON) to project, src, numbering, chained, seq and the fields of each op, in order.

    A document that :func:`unreadable` names yields no ops.
    """
    read = _read(plans).filter(_sound())
    ops = read.select("project", "p.src", F.coalesce("p.numbering", F.lit("auto")).alias("numbering"), F.coalesce("p.chained", F.lit(False)).alias("chained"), F.posexplode("p.ops").alias("seq", "o"))
    return ops.select("project", "src", "numbering", "chained", "seq", "o.*")


def unreadable(plans: DataFrame) -> DataFrame:
    """project, seq (null), problem: documents that are no plans."""
    numbering = F.concat(F.lit("unknown numbering "), F.col("p.numbering"))
    said = (
        F.when(F.col("value").isNull() | (F.trim("value") == ""), "empty plan")
        .when(F.col("p._corrupt_record").isNotNull(), "unreadable plan")
        .when(F.col("p.ops").isNull(), "plan without ops")
        .otherwise(numbering)
    )
    return _read(plans).filter(~F.coalesce(_sound(), F.lit(False))).select("project", F.lit(None).cast("int").alias("seq"), said.alias("problem"))


def _target(ops: DataFrame, headings: DataFrame, field: str, prefix: str) -> DataFrame:
    """``ops`` with ord, subtree_end and level of the heading named in ``field``."""
    heads = headings.select("project", F.col("id").alias(field), *[F.col(c).alias(f"{prefix}_{c}") for c in ("ord", "subtree_end", "level", "file", "file_ord")])
    return ops.join(heads, ["project", field], "left")


def resolve(ops: DataFrame, headings: DataFrame) -> DataFrame:
    """``ops`` with the place of their target (t_*) and anchor (a_*)."""
    return _target(_target(ops, headings, "id", "t"), headings, "after", "a")


def paths(headings: DataFrame) -> DataFrame:
    """project, ord, around: each heading with the sections that it lies in, its own included, one a level at most."""
    lasts = {f"__p{k}": F.when(F.col("level") == k, F.struct("ord", "subtree_end")) for k in LEVELS}
    found = in_order(headings.select("project", "file_ord", "line_no", "ord", "level", "subtree_end"), Running(lasts=lasts))
    found = found.select("project", "ord", F.explode(F.array(*lasts)).alias("x")).filter("x.subtree_end > ord")
    return found.select("project", "ord", F.col("x.ord").alias("around"))


def problems(ops: DataFrame, headings: DataFrame, chained: bool = False) -> DataFrame:
    """project, seq, problem: everything that makes a plan invalid, applied at once or as a chain."""
    done = resolve(ops, headings)
    named = F.col("op").isin("rename", "merge_up", "relevel", "delete", "move")
    anchored = F.col("op").isin("move", "insert")
    checks = [
        (~F.coalesce(F.col("op").isin(*OP_KINDS), F.lit(False)), F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))),
        (F.col("op").isin("relevel", "insert") & ~F.coalesce(F.col("level").between(min(LEVELS), max(LEVELS)), F.lit(False)), F.concat(F.lit("illegal level "), F.coalesce(F.col("level").cast("string"), F.lit("null")))),
        ((F.col("op") == "rename") & (F.trim(F.coalesce("new", F.lit(""))) == ""), F.lit("rename without a title")),
        ((F.col("op") == "insert") & (F.trim(F.coalesce("title", F.lit(""))) == ""), F.lit("insert without a title")),
    ]
    alone = [
        (named & F.col("t_ord").isNull(), F.concat(F.lit("unknown id "), F.coalesce("id", F.lit("null")))),
        (anchored & F.col("a_ord").isNull(), F.concat(F.lit("unknown id "), F.coalesce("after", F.lit("null")))),
        ((F.col("op") == "move") & F.col("a_ord").between(F.col("t_ord"), F.col("t_subtree_end") - 1), F.lit("move into its own section")),
    ]
    checks += [] if chained else alone
    simple = done.select("project", "seq", F.explode(F.array_compact(F.array(*[F.when(test, said) for test, said in checks]))).alias("problem"))
    if chained:
        folded = fold(ops, headings, paths(headings))
        return simple.unionByName(folded.filter("kind = 'problem'").select("project", "seq", "problem")).distinct()
    # An op inside a section that another op deletes or moves depends on it: the sections around a point are its path.
    outer = done.filter(F.col("op").isin("delete", "move") & F.col("t_ord").isNotNull())
    outer = outer.select("project", F.col("t_ord").alias("around"), F.col("seq").alias("o_seq"), F.col("op").alias("o_op"))
    point = F.explode(F.array(F.struct(F.col("t_ord").alias("at"), F.lit(False).alias("anchor")), F.struct(F.col("a_ord").alias("at"), F.lit(True).alias("anchor"))))
    points = done.select("project", "seq", "op", point.alias("p")).select("project", "seq", "op", F.col("p.at").alias("ord"), "p.anchor").filter("ord is not null")
    clash = points.join(paths(headings), ["project", "ord"]).join(outer, ["project", "around"])
    clash = clash.filter("seq <> o_seq and (o_op = 'delete' or anchor or op in ('move', 'delete', 'relevel', 'merge_up'))")
    clash = clash.select("project", "seq", F.concat(F.lit("depends on op "), (F.col("o_seq") + 1).cast("string")).alias("problem"))
    twice = done.filter(named).groupBy("project", "id", "op").agg(F.count("*").alias("n"), F.max("seq").alias("seq")).filter("n > 1")
    twice = twice.select("project", "seq", F.lit("same op twice").alias("problem"))
    return simple.unionByName(clash).unionByName(twice).distinct()


def new_outline(headings: DataFrame, ops: DataFrame, numbering: str = "auto", chained: bool = False) -> DataFrame:
    """The outline after valid ops.

    One row a heading, old and new: project, id (null if inserted), ord, state (kept,
    deleted, merged, inserted), new_level, new_title, pos, new_num, target_num (what a
    reference to its old number becomes), out_file, out_file_ord and moved.
    """
    done = resolve(ops, headings)
    by_id = lambda op, *cols: done.filter(F.col("op") == op).groupBy("project", "id").agg(*cols)  # noqa: E731  the last wins
    base = headings.select("project", "id", "ord", "level", "title", "num", "file", "file_ord", "subtree_end")
    base = base.join(by_id("rename", F.max_by("new", "seq").alias("renamed")), ["project", "id"], "left")
    base = base.join(by_id("merge_up", F.count("*").alias("merges")), ["project", "id"], "left")

    around = settle(paths(headings))

    def inner(spans: DataFrame) -> DataFrame:
        """The innermost of ``spans`` (project, around and its columns) that a heading lies in."""
        hit = around.join(spans, ["project", "around"])
        return hit.groupBy("project", "ord").agg(*[F.max_by(c, "around").alias(c) for c in spans.columns[2:]])

    target = [F.col("project"), F.col("t_ord").alias("around")]
    relevelled = done.filter("op = 'relevel'").groupBy("project", "t_ord", "t_level").agg(F.max_by("level", "seq").alias("level"))
    shifts = inner(relevelled.select(*target, (F.col("level") - F.col("t_level")).alias("shift")))
    none = F.lit(None).cast("string")
    inserted = done.filter("op = 'insert'").select("project", "seq", F.col("level").alias("new_level"), F.col("title").alias("new_title"), "a_ord", F.col("a_file").alias("out_file"), F.col("a_file_ord").alias("out_file_ord"))
    if chained:
        folded = settle(fold(ops, headings, around))
        where = places(folded, ops, headings, around)
        put = folded.filter("kind = 'inserted' and not gone").select("project", "seq", "key", F.col("file").alias("out_file"), F.col("file_ord").alias("out_file_ord"))
        inserted = inserted.drop("out_file", "out_file_ord").join(put, ["project", "seq"])
    else:
        gone = inner(done.filter("op = 'delete'").select(*target, F.lit(True).alias("gone")))
        moves = done.filter("op = 'move'").select(*target, F.array(F.col("a_subtree_end") - 1, F.col("seq") + 1).alias("key"), F.col("a_file").alias("to_file"), F.col("a_file_ord").alias("to_file_ord"))
        where = headings.select("project", "ord").join(inner(moves), ["project", "ord"], "left").join(gone, ["project", "ord"], "left")
        key = F.concat(F.coalesce("key", F.array(F.col("ord"), F.lit(0))), F.array("ord"))
        where = where.select("project", "ord", key.alias("key"), F.coalesce("gone", F.lit(False)).alias("gone"), F.col("key").isNotNull().alias("is_moved"), "to_file", "to_file_ord")
        inserted = inserted.withColumn("key", F.array(F.col("a_ord"), F.col("seq") + 1, F.lit(0)))
    out = base.join(where, ["project", "ord"]).join(shifts, ["project", "ord"], "left")
    level = F.least(F.lit(6), F.greatest(F.lit(1), F.col("level") + F.coalesce("shift", F.lit(0)))).cast("int")
    state = F.when(F.col("gone"), "deleted").when(F.col("merges") > 0, "merged").otherwise("kept")
    old = out.select(
        "project", "id", "ord", "num", "title", state.alias("state"), level.alias("new_level"), F.coalesce("renamed", "title").alias("new_title"), "key",
        F.coalesce("to_file", "file").alias("out_file"), F.coalesce("to_file_ord", "file_ord").alias("out_file_ord"), F.col("is_moved").alias("moved"),
    )
    new = inserted.select(
        "project", none.alias("id"), F.lit(None).cast("int").alias("ord"), none.alias("num"), none.alias("title"), F.lit("inserted").alias("state"), "new_level", "new_title", "key",
        "out_file", "out_file_ord", F.lit(False).alias("moved"),
    )
    return numbered(old.unionByName(new), numbering)


def numbered(rows: DataFrame, numbering: str) -> DataFrame:
    """``rows`` in the order of ``key`` by project, with pos, new_num and target_num.

    Rows are dealt by ranges of project and key; each range is a block of a scan, so that
    no task holds a project.  A number counts the headings of its level since the last one
    above it: the sum so far, less that sum at the last one above.
    """
    dealt = rows.repartitionByRange("project", "key").withColumn("__blk", F.spark_partition_id())  # the first scan writes it down
    in_turn = lambda df, running, keep=False: scan(df, ["project"], ["__blk"], ["key"], running, keep)
    live = F.col("state").isin("kept", "inserted")
    lasts = {f"__up{k}": F.when(live & (F.col("new_level") < k), F.col("num").isNotNull()) for k in LEVELS if k > 1}
    own = [c for c in rows.columns if c != "key"]
    rows = in_turn(dealt, Running(sums={"pos": F.lit(1)}, lasts=lasts), keep=True)
    parents = [F.when(F.col("new_level") == k, F.col(f"__up{k}")) for k in LEVELS if k > 1]
    counted = live & F.when(F.col("state") == "inserted", F.coalesce(*parents, F.lit(True))).otherwise(F.col("num").isNotNull())
    rows = rows.withColumn("numbered", counted).withColumn("pos", F.col("pos").cast("int")).drop(*lasts)
    if numbering == "keep":
        rows = rows.withColumn("new_num", F.when(F.col("state") == "kept", F.col("num")))
    else:
        rows = in_turn(rows, Running(sums={f"__n{k}": F.when(F.col("numbered") & (F.col("new_level") == k), 1).otherwise(0) for k in LEVELS}))
        rows = in_turn(rows, Running(lasts={f"__z{k}": F.when(live & (F.col("new_level") < k), F.col(f"__n{k}")) for k in LEVELS}), keep=True)
        parts = F.array(*[(F.col(f"__n{k}") - F.coalesce(F.col(f"__z{k}"), F.lit(0))).cast("string") for k in LEVELS])
        rows = rows.withColumn("new_num", F.when(F.col("numbered"), F.array_join(F.slice(parts, F.lit(1), F.col("new_level")), ".")))
    rows = in_turn(rows, Running(lasts={"absorbed": F.when(live, F.col("new_num"))}))
    target = F.when(F.col("state") == "kept", F.col("new_num")).when(F.col("state") == "merged", F.col("absorbed"))
    return rows.select(*own, "pos", "new_num", target.alias("target_num"))


def outline_diff(headings: DataFrame, outline: DataFrame) -> DataFrame:
    """project, ord, pos, before, after, mark: the two outlines side by side."""
    before = headings.select("project", "id", "ord", F.concat_ws(" ", F.expr("repeat('#', level)"), "num", "title").alias("before"))
    gone = F.col("state").isin("deleted", "merged")
    after = F.when(~gone, F.concat_ws(" ", F.expr("repeat('#', new_level)"), "new_num", "new_title"))
    mark = F.when(F.col("state") == "deleted", "← 删除").when(F.col("state") == "inserted", "← 新增").when(F.col("state") == "merged", "← 并入上节").when(F.col("moved"), "← 移动")
    new = outline.select("project", "id", "pos", after.alias("after"), mark.alias("mark"))
    both = before.join(new, ["project", "id"], "full_outer")
    mark = F.coalesce("mark", F.when(~F.col("before").eqNullSafe(F.col("after")), F.lit("← 修改")))
    return both.select("project", "ord", "pos", "before", "after", mark.alias("mark"))
