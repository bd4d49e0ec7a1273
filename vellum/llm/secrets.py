"""Secret scans by corpus-wide ownership frequency (operator 2), in DataFrame functions only.

Every whole text is searched for base findings (assignments, access keys, hex strings) and
for further candidates, long runs of key characters.  All values are hashed and counted
over the corpus by distinct repositories and owners.  A value that many owners have is a
widely copied example; one that an owner has alone and that looks random is taken for a
live credential.  Base findings always stay; of the other candidates those that are
owner-specific and look live are added as kind ``owned``, unless a base finding overlaps.

The owner is the part of the repository before its first slash.  Positions count code
points from 0, ends are exclusive.

Scale: one pass over the texts leaves gaps and matches only, written to the shared folder;
all later shuffles carry findings.  Counting starts with one row for each value and
repository of a task, so a value that a third of the rows have arrives as a few rows; the
join back to findings can be split by the engine where one value is hot.

Defined results: a null text counts as empty; a null repository counts as no owner; rows
that repeat are scanned each; an empty table has an empty result; an input column called
``spans`` gives way in :func:`scan_secrets` and stays in :func:`hide`, where null texts stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import SENDABLE, stage, without

#: Fixed patterns of the base findings.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Further candidates, and what a text must have for either search to be worth it.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KEYWORD = r"(?i)passw|secret|token|api_?key"
#: Words that mark a value as an example.
EXAMPLE = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567"
KINDS = ("assign", "access", "hex", "owned")


def _found(text: Column, pattern: str, value_group: int, when: Column) -> Column:
    """Gap before each match, its length and its value, as an array of structs."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    full = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.char_length(x))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    return F.when(when, F.arrays_zip(gaps.alias("gap"), full.alias("length"), value.alias("value")))


def _looks_live(value: Column) -> Column:
    """Letters and digits, many different ones, and no word that says example."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (different >= 10) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(EXAMPLE)


def scan_secrets(docs: DataFrame, text: str = "text", repo: str = "source", max_owners: int = 1, carry: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end, sha256, n_docs, n_repos, n_owners, verdict, in order.

    ``carry``: the columns of ``docs`` to keep, all if None.
    """
    base = without(docs, "spans")
    own = [F.col(f"`{c}`") for c in base.columns if carry is None or c in carry]
    whole = F.coalesce(F.col(text), F.lit(""))
    runs, words = whole.rlike(RUN), whole.rlike(KEYWORD)
    scanned = stage(
        base.select(
            F.monotonically_increasing_id().alias("__rid"),
            F.col(repo).alias("__repo"),
            *own,
            _found(whole, ASSIGN, 2, words).alias("__assign"),
            _found(whole, ACCESS, 0, runs & whole.contains("AKIA")).alias("__access"),
            _found(whole, HEX, 0, runs).alias("__hex"),
            _found(whole, RUN, 0, runs).alias("__owned"),
        ),
        "secret-scan",
    )
    rows = None
    for order, kind in enumerate(KINDS):
        one = scanned.select("__rid", "__repo", F.posexplode(f"__{kind}").alias("k", "x")).filter(F.col("x.length").isNotNull())
        upto = Window.partitionBy("__rid").orderBy("k")
        end = F.sum(F.col("x.gap") + F.col("x.length")).over(upto)
        one = one.select(
            "__rid",
            "__repo",
            F.lit(order).alias("order"),
            F.lit(kind).alias("kind"),
            (end - F.col("x.length")).cast("long").alias("start"),
            end.cast("long").alias("end"),
            F.col("x.value").alias("value"),
        )
        one = one.filter(F.char_length("value") >= 6) if kind == "assign" else one
        rows = one if rows is None else rows.unionByName(one)
    rows = stage(
        rows.select("*", F.sha2("value", 256).alias("sha256"), _looks_live(F.col("value")).alias("live")).drop("value"), "secret-finds"
    )

    owner = F.substring_index("__repo", "/", 1)
    by_repo = rows.groupBy("sha256", "__repo").agg(F.count_distinct("__rid").alias("docs"))
    spread = by_repo.groupBy("sha256").agg(
        F.sum("docs").alias("n_docs"), F.count("__repo").alias("n_repos"), F.count_distinct(owner).alias("n_owners")
    )
    verdict = F.when(F.col("n_owners") > max_owners, "copied").when(F.col("live"), "live").otherwise("plain")
    judged = rows.join(spread, "sha256").withColumn("verdict", verdict)
    judged = judged.filter((F.col("kind") != "owned") | (F.col("verdict") == "live"))

    by_place = Window.partitionBy("__rid").orderBy("start", "order", "end")
    is_base = F.col("kind") != "owned"
    ended = F.max(F.when(is_base, F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(is_base, F.col("start"))).over(by_place.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(ended, F.lit(-1)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end"))
    judged = judged.withColumn("clear", clear).filter(is_base | F.col("clear"))
    span = F.struct("start", "order", "end", "kind", "sha256", "n_docs", "n_repos", "n_owners", "verdict")
    spans = judged.groupBy("__rid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    out = scanned.select("__rid", *own).join(spans, "__rid", "left")
    empty = F.array().cast(spans.schema["spans"].dataType)
    return out.withColumn("spans", F.coalesce("spans", empty)).drop("__rid")


def hide(docs: DataFrame, text: str = "text", repo: str = "source", key: str = "doc_id", mark: str = "[secret]", changed: str | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; spans that overlap become one mark.

    ``changed``: the name of a further column that says whether the text is another one now.

    What is found is looked up by id and text hash: only ranges are staged and sent, and
    texts are shuffled only where there are too many ranges to send, those that may hold one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).alias("__id"), F.xxhash64(whole).alias("__hash"), F.col(text).alias("text"), F.col(repo).alias("source"))
    found = scan_secrets(named, carry=("__id", "__hash")).filter(F.size("spans") > 0).dropDuplicates(["__id", "__hash"])
    spans = found.select("__id", "__hash", F.explode("spans").alias("s")).select("__id", "__hash", "s.start", "s.end")
    before = Window.partitionBy("__id", "__hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("opens", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int"))
    upto = Window.partitionBy("__id", "__hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    ranges = spans.withColumn("range", F.sum("opens").over(upto)).groupBy("__id", "__hash", "range").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    ranges = stage(ranges.drop("range"), "secret-ranges")
    marks = ranges.groupBy("__id", "__hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__ranges"))
    held = F.expr(
        f"""concat(array_join(transform(__ranges, (r, i) -> concat(substring(`{text}`, 1 + cast(if(i = 0, 0, __ranges[i - 1].end) as int),
                 cast(r.start - if(i = 0, 0, __ranges[i - 1].end) as int)), '{mark}')), ''), substring(`{text}`, 1 + cast(element_at(__ranges, -1).end as int)))"""
    )
    out = [F.coalesce(held, F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(whole) == F.col("__hash"))
    flag = [F.col("__ranges").isNotNull().alias(changed)] if changed else []
    if ranges.count() <= SENDABLE:
        return docs.join(F.broadcast(marks), same, "left").select(*out, *flag)
    may = whole.rlike(RUN) | whole.rlike(KEYWORD)
    rest = docs.filter(~may).select("*", *([F.lit(False).alias(changed)] if changed else []))
    return docs.filter(may).join(marks.hint("merge"), same, "left").select(*out, *flag).union(rest)
