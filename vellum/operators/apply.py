"""Applying an outline to lines, and the proof that nothing else changed.

References are looked up in the project's numbers (old to new) all at once, so a chain of
renumberings cannot run into itself.  The numbers that a text refers to are sent to the
executors if they are few; else references travel as rows of their own, joined by project and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions.scan import Running, latest, scan
from vellum.operators.lint import find_references
from vellum.plans.settle import settle

FILE = ["project", "file"]


def number_map(outline: DataFrame) -> DataFrame:
    """project, num, target: what each old number is called now; the first heading of a number counts."""
    kept = outline.filter("num is not null and state in ('kept', 'merged') and target_num is not null")
    return kept.groupBy("project", "num").agg(F.min_by("target_num", "ord").alias("target"))


def with_owner(marked: DataFrame, headings: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``marked`` with the ord of the heading each line belongs to (null before a file's first) and ``is_head``.

    What ``more`` has for a heading (project, ord and its columns) comes with the lines that belong to it.
    """
    heads = headings.select(*FILE, "line_no", "ord")
    heads = heads if more is None else heads.join(more, ["project", "ord"], "left")
    columns = [] if more is None else [c for c in more.columns if c not in ("project", "ord")]
    marks = settle(heads.select(*FILE, "line_no", F.struct("line_no", F.col("ord").alias("owner"), *columns).alias("__own")))
    owned = latest(marked, marks, FILE, "__own")
    is_head = F.coalesce(F.col("__own.line_no") == F.col("line_no"), F.lit(False))
    return owned.select(*marked.columns, "__own.owner", is_head.alias("is_head"), *[f"__own.{c}" for c in columns])


#: How many of the numbers that a text refers to are sent to every executor as maps; a map is read from its beginning.
MAPPED = 2000


def _referred(text: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of ``numbers`` (project, num) that ``text`` refers to."""
    named = text.select("project", F.explode(X.references(F.col("line"))).alias("ref")).select("project", X.reference_number(F.col("ref")).alias("num")).distinct()
    return settle(numbers.join(named, ["project", "num"], "left_semi"))


def renumbered(lines: DataFrame, numbers: DataFrame, text: DataFrame, where: Column) -> DataFrame:
    """``lines`` with ``rewritten``: null, or the line (of those ``where``) in which a reference's number has another name now.

    ``text`` has the lines whose references may count, others too.  Usually a manuscript refers to
    few numbers: they are sent along and no line is shuffled.  With many of them the references are rows,
    joined by project and number.
    """
    used = _referred(text, numbers.select("project", "num", "target"))
    if used.limit(MAPPED + 1).count() <= MAPPED:
        maps = used.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("num", "target"))).alias("__numbers"))
        held = lines.join(F.broadcast(maps), "project", "left").withColumn("__refs", F.when(where & F.col("__numbers").isNotNull(), X.references(F.col("line"))))
        target = F.transform("__refs", lambda r: F.try_element_at("__numbers", X.reference_number(r)))
        held = held.withColumn("__targets", target)
        new = F.zip_with("__refs", "__targets", lambda r, t: F.coalesce(X.renumber(r, t), r))
        rewritten = F.when(F.exists("__targets", lambda t: t.isNotNull()), X.put_references(F.col("line"), new))
        return held.select(*lines.columns, rewritten.alias("rewritten"))
    key = [*FILE, "line_no"]
    refs = lines.filter(where).select(*key, "line", F.posexplode(X.references(F.col("line"))).alias("at", "ref")).withColumn("num", X.reference_number(F.col("ref")))
    found = refs.join(used, ["project", "num"], "left")
    new = F.struct("at", F.when(F.col("target").isNull(), F.col("ref")).otherwise(X.renumber(F.col("ref"), F.col("target"))).alias("new"))
    changed = found.groupBy(*key).agg(F.first("line").alias("line"), F.array_sort(F.collect_list(new)).alias("new"), F.count("target").alias("known")).filter("known > 0")
    changed = changed.select(*key, X.put_references(F.col("line"), F.transform("new", lambda x: x["new"])).alias("rewritten"))
    return lines.join(changed, key, "left").select(*lines.columns, "rewritten")


def rewrite(marked: DataFrame, headings: DataFrame, outline: DataFrame) -> DataFrame:
    """All lines of the new manuscripts: project, file (where it goes), pos, k, old, line, is_head, src_file, src_line.

    ``pos`` is the place of the owning heading (0 before a file's first), ``k`` the order in it.
    """
    place = outline.filter("ord is not null").select("project", "ord", "state", "pos", "out_file", "out_file_ord", "new_level", "new_num", "new_title")
    joined = with_owner(marked, headings, place).filter("state is null or state <> 'deleted'").filter("not (is_head and state = 'merged')")
    joined = renumbered(joined, number_map(outline), marked.filter("not code"), ~F.col("code") & ~F.col("is_head"))
    written = X.written(F.col("new_num"), F.col("new_title"))
    title = F.concat_ws(" ", F.expr("repeat('#', new_level)"), written)
    same = X.heading_text(F.col("line")) == written
    keep_head = same & (X.heading_level(F.col("line")) == F.col("new_level"))
    body = F.coalesce("rewritten", "line")
    line = F.when(F.col("is_head"), F.when(keep_head, F.col("line")).otherwise(title)).otherwise(body)
    old = joined.select(
        "project", F.coalesce("out_file", "file").alias("file"), F.coalesce("out_file_ord", "file_ord").alias("file_ord"), F.coalesce("pos", F.lit(0)).alias("pos"),
        F.col("line_no").alias("k"), F.col("line").alias("old"), line.alias("line"), "is_head", F.col("file").alias("src_file"), F.col("line_no").alias("src_line"),
    )
    added = outline.filter("state = 'inserted'").select("project", F.col("out_file").alias("file"), F.col("out_file_ord").alias("file_ord"), "pos", F.posexplode(F.array(title, F.lit(""))).alias("k", "line"))
    added = added.select("project", "file", "file_ord", "pos", "k", F.lit(None).cast("string").alias("old"), "line", (F.col("k") == 0).alias("is_head"), F.lit(None).cast("string").alias("src_file"), F.lit(None).cast("int").alias("src_line"))
    return old.unionByName(added)


def join_sections(rewritten: DataFrame, sections: DataFrame) -> DataFrame:
    """project, file, text of every output file; a final line feed of the source file stays."""
    # The empty last element of a file that ends in a line feed is put back at the end of the new file.
    ends = sections.select("project", "file", F.col("text").endswith("\n").alias("ends"), F.size(F.split("text", "\n", -1)).alias("n"))
    source = ends.select("project", F.col("file").alias("src_file"), F.col("n").alias("src_line"), F.col("ends").alias("is_end"))
    lines = rewritten.join(source, ["project", "src_file", "src_line"], "left").filter("not coalesce(is_end, false)")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k", "line"))), lambda x: x["line"]), "\n")
    built = ends.join(lines.groupBy("project", "file").agg(text.alias("text")), ["project", "file"], "left")
    return built.select("project", "file", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("ends"), "\n").otherwise("")).alias("text"))


def output_lines(rewritten: DataFrame, marked: DataFrame) -> DataFrame:
    """project, file, file_ord, line_no, line: the output files line by line, as :func:`join_sections` puts them together.

    No file's text is put together for it: lines are dealt by ranges of their place, and counted by a scan.
    """
    files = settle(marked.groupBy(*FILE).agg(F.first("file_ord").alias("file_ord"), F.max("line_no").alias("n")))
    blank = marked.filter("line = ''").select(*FILE, F.col("line_no").alias("n"))
    ends = settle(files.filter("n > 1").join(blank, [*FILE, "n"], "left_semi"))  # a final line feed stays at the end of its file
    source = ends.select("project", F.col("file").alias("src_file"), F.col("n").alias("src_line"))
    columns = [*FILE, "pos", "k", "line"]
    may_end = (F.col("old") == "") & F.col("src_line").isNotNull()
    body = rewritten.filter(~F.coalesce(may_end, F.lit(False))).select(columns).unionByName(rewritten.filter(may_end).join(source, ["project", "src_file", "src_line"], "left_anti").select(columns))
    empty = files.join(body.select(*FILE).distinct(), FILE, "left_anti").select(*FILE, F.lit(0).alias("pos"), F.lit(0).alias("k"), F.lit("").alias("line"))
    last = ends.select(*FILE, F.lit((1 << 31) - 1).alias("pos"), F.lit(0).alias("k"), F.lit("").alias("line"))
    rows = body.unionByName(empty).unionByName(last).select(*FILE, "pos", "k", F.posexplode(F.split("line", "\n", -1)).alias("part", "line"))
    dealt = rows.repartitionByRange(*FILE, "pos", "k", "part").withColumn("__blk", F.spark_partition_id())
    counted = scan(dealt, FILE, ["__blk"], ["pos", "k", "part"], Running(sums={"line_no": F.lit(1)}), keep=True)
    return counted.join(F.broadcast(files.select(*FILE, "file_ord")), FILE).select(*FILE, "file_ord", F.col("line_no").cast("int").alias("line_no"), "line")


def reference_log(rewritten: DataFrame) -> DataFrame:
    """project, file, old, new: every body line whose references changed."""
    return rewritten.filter("not is_head and old <> line").select("project", F.col("src_file").alias("file"), "src_line", "old", F.col("line").alias("new"))


def deleted_warnings(marked: DataFrame, headings: DataFrame, outline: DataFrame) -> DataFrame:
    """project, file, line_no, ref, warn: references from what remains to what is deleted."""
    gone = outline.filter("state = 'deleted'").select("project", "num", "title", "ord")
    left = with_owner(marked, headings, gone.select("project", "ord", F.lit(True).alias("gone"))).filter("gone is null")
    used = _referred(marked.filter("not code"), gone.filter("num is not null").select("project", "num", "title"))
    few = used.limit(SENT + 1).count() <= SENT
    hits = find_references(left).join(F.broadcast(used) if few else used, ["project", "num"])
    return hits.select("project", "file", "line_no", "ref", F.concat_ws(" ", "num", "title").alias("warn"))


#: Parts of a project's lines that are compared by fingerprint, and how many differing ones are sent to every executor.
PARTS = 1024
SENT = 100_000


def drift(rewritten: DataFrame, result: DataFrame) -> DataFrame:
    """project, side, line: body lines that were lost or came up between source and output sections.

    ``rewritten`` are the source lines less deleted sections, with their logged reference
    changes; ``result`` holds the lines of the output as read again (project, line,
    is_head).  Both have to be the same multiset.  Lines are dealt into parts by their hash,
    and each part has a fingerprint: the sums of two 64-bit hashes over its lines, in halves,
    those of the output taken off.  Only parts whose fingerprint isn't zero are compared line
    by line, so no line is shuffled where nothing drifted.
    """
    body = lambda df, n: df.filter("not is_head and trim(line) <> ''").select("project", "line", F.lit(n).alias("n"))
    both = body(rewritten, 1).unionByName(body(result, -1)).withColumn("h", F.xxhash64("line"))
    both = both.withColumn("part", F.pmod("h", F.lit(PARTS)))
    low, high = lambda h: h.bitwiseAND(0xFFFFFFFF), lambda h: F.shiftright(h, 32)
    other = F.xxhash64(F.lit("line"), "line")
    sums = {"n": F.lit(1), "a": low(F.col("h")), "b": high(F.col("h")), "c": low(other), "d": high(other)}
    prints = both.groupBy("project", "part").agg(*[F.sum(F.col("n") * v).alias(f"s_{k}") for k, v in sums.items()])
    differ = settle(prints.filter(" or ".join(f"s_{k} <> 0" for k in sums)).select("project", "part"))
    few = differ.limit(SENT + 1).count() <= SENT
    lines = both.join(F.broadcast(differ) if few else differ, ["project", "part"], "left_semi")
    odd = lines.groupBy("project", "line").agg(F.sum("n").alias("n")).filter("n <> 0")
    copies = F.explode(F.array_repeat(F.when(F.col("n") > 0, "lost").otherwise("new"), F.abs("n").cast("int")))
    return odd.select("project", copies.alias("side"), "line")


def assets(marked: DataFrame) -> DataFrame:
    """project, kind, name, n: labels, figures and display equations outside code."""
    text = marked.filter("not code")
    labels = text.select("project", F.lit("label").alias("kind"), F.explode(F.regexp_extract_all("line", F.lit(X.LABEL), F.lit(1))).alias("name"))
    figures = text.select("project", F.lit("figure").alias("kind"), F.explode(F.regexp_extract_all("line", F.lit(X.FIGURE), F.lit(0))).alias("name"))
    dollars = text.groupBy("project").agg(F.sum(X.dollars(F.col("line"))).alias("n")).select("project", F.lit("equation marks").alias("kind"), F.lit("$$").alias("name"), "n")
    named = labels.unionByName(figures).groupBy("project", "kind", "name").agg(F.count("*").alias("n"))
    return named.unionByName(dollars.filter("n > 0"))


def asset_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """project, kind, name, n_before, n_after where they differ."""
    both = before.withColumnRenamed("n", "n_before").join(after.withColumnRenamed("n", "n_after"), ["project", "kind", "name"], "full_outer")
    return both.na.fill(0, ["n_before", "n_after"]).filter("n_before <> n_after")


def source_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """project, file, sha_before, sha_after of files whose digest differs."""
    both = before.withColumnRenamed("sha", "sha_before").join(after.withColumnRenamed("sha", "sha_after"), ["project", "file"], "full_outer")
    return both.filter("not (sha_before <=> sha_after)")
