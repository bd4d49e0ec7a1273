"""Lint of headings in three layers: terminology, roles, structure.

Each rule is a function from frames to findings; :func:`lint` is their union.  Terms are
matched by an equi-join with the parts of a title that are as long as a term, so there is no
nested loop over titles and terms; a dictionary is broadcast only up to ``SMALL`` rows.  With
a term bank a title is segmented: from the left, the longest term of the dictionary, the bank
or the project's own list is cut off at each place, and only what is cut off counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions.roles import REQUIRED
from vellum.operators.corpus import NUMERAL

#: Informal word, standard candidate: a seed of our own.
TERMS = [("软肋", "薄弱环节"), ("抓手", "关键措施"), ("精修", "修正"), ("反推", "反演"), ("印证", "检验"), ("摸底", "现状分析"), ("打通", "衔接")]
SMALL = 10_000
MAX_TITLE = 20


def finding(rule: str, layer: str, msg: Column, *, id: Column | None = None, title: Column | None = None, suggestion: Column | None = None) -> list[Column]:
    """The columns of a finding."""
    none = F.lit(None).cast("string")
    parts = {"id": none if id is None else id, "title": none if title is None else title, "msg": msg, "suggestion": none if suggestion is None else suggestion}
    return [F.col("project"), F.lit(rule).alias("rule"), F.lit(layer).alias("layer"), *[v.cast("string").alias(k) for k, v in parts.items()]]


def term_informal(headings: DataFrame, terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Titles with an informal term and its standard candidate; ``allowed`` (project, term) are kept words."""
    lengths = [r[0] for r in terms.select(F.char_length("informal")).distinct().collect() if r[0]]  # as many as the longest term has characters
    if not lengths:
        lengths = [1]
    cut = lambda n: F.expr(f"if(char_length(title) >= {n}, transform(sequence(1, char_length(title) - {n - 1}), i -> substring(title, i, {n})), cast(array() as array<string>))")
    titles = headings.withColumn("informal", F.explode(F.array_distinct(F.concat(*[cut(n) for n in sorted(lengths)]))))
    few = terms.limit(SMALL + 1).count() <= SMALL
    hits = titles.join(F.broadcast(terms) if few else terms, "informal")
    if allowed is not None:
        kept = allowed.select("project", F.col("term").alias("informal"))
        hits = hits.join(kept, ["project", "informal"], "left_anti")
    msg = F.concat(F.lit("informal term "), "informal", F.lit(", better: "), "standard")
    return hits.select(*finding("term_informal", "term", msg, id=F.col("id"), title=F.col("title"), suggestion=F.col("standard")))


def _lengths(*terms: DataFrame) -> list[int]:
    """The lengths that terms have; as many as the longest has characters at most."""
    both = reduce(DataFrame.unionByName, [t.select(F.char_length("term").alias("n")) for t in terms])
    return sorted(r[0] for r in both.distinct().collect() if r[0])


def segments(headings: DataFrame, dictionary: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """project, id, title, at, term, standard: each title cut from the left, the longest term first.

    ``dictionary`` (term, standard) holds informal terms with their standard and, with null,
    words that are fine; ``own`` (project, term) are further words of a project that are fine.
    Overlapping terms resolve to the one that begins first, of those to the longest.  The
    places where a term stands come from equi-joins, level by level of length, whatever the size of the
    dictionary; a title's few candidates are then folded from left to right.
    """
    entries = dictionary.select("term", "standard").groupBy("term").agg(F.max("standard").alias("standard"))
    lengths = _lengths(entries, own) if own is not None else _lengths(entries)
    titles = headings.select("project", "id", "title")
    part = lambda n: F.expr(f"if(char_length(title) >= {n}, transform(sequence(1, char_length(title) - {n - 1}), i -> struct(i as at, substring(title, i, {n}) as term)), cast(array() as array<struct<at:int,term:string>>))")
    parts = titles.select("*", F.explode(F.concat(*[part(n) for n in lengths or [1]])).alias("p")).select("project", "id", "title", "p.at", "p.term")
    few = entries.limit(SMALL + 1).count() <= SMALL
    found = parts.join(F.broadcast(entries) if few else entries, "term")
    if own is not None:
        found = found.unionByName(parts.join(own.select("project", "term").distinct(), ["project", "term"]).withColumn("standard", F.lit(None).cast("string")))
    # of entries for the same place the longest, a fine word before an informal one
    place = F.struct("at", (-F.char_length("term")).alias("size"), F.col("standard").isNotNull().alias("informal"), "term", "standard")
    held = found.groupBy("project", "id", "title").agg(F.array_sort(F.collect_list(place)).alias("all"))
    cut = F.expr(
        """aggregate(all, named_struct('stop', 1, 'out', slice(all, 1, 0)),
             (s, c) -> if(c.at >= s.stop, named_struct('stop', c.at - c.size, 'out', concat(s.out, array(c))), s), s -> s.out)"""
    )
    return held.select("project", "id", "title", F.explode(cut).alias("c")).select("project", "id", "title", "c.at", "c.term", "c.standard")


def term_segments(headings: DataFrame, terms: DataFrame, bank: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Titles with an informal term that isn't part of a longer known one, and its standard candidate; ``bank`` (term) are known words."""
    informal = terms.select(F.col("informal").alias("term"), "standard")
    known = bank.select("term").filter("term <> ''").join(informal, "term", "left_anti").withColumn("standard", F.lit(None).cast("string"))
    hits = segments(headings, informal.unionByName(known), allowed).filter("standard is not null").select("project", "id", "title", "term", "standard").distinct()
    msg = F.concat(F.lit("informal term "), "term", F.lit(", better: "), "standard")
    return hits.select(*finding("term_informal", "term", msg, id=F.col("id"), title=F.col("title"), suggestion=F.col("standard")))


def title_colon(headings: DataFrame) -> DataFrame:
    """Titles with a colon of either width."""
    hits = headings.filter(F.col("title").rlike(X.COLON))
    return hits.select(*finding("title_colon", "structure", F.lit("title has a colon"), id=F.col("id"), title=F.col("title")))


def title_length(headings: DataFrame, most: int | DataFrame = MAX_TITLE) -> DataFrame:
    """Titles longer than a number of characters, or than the corpus allows for their level (level, max_title)."""
    if isinstance(most, DataFrame):
        hits = headings.join(F.broadcast(most.select("level", "max_title")), "level").filter(F.char_length("title") > F.col("max_title"))  # six levels
    else:
        hits = headings.filter(F.char_length("title") > most)
    msg = F.concat(F.lit("title has "), F.char_length("title").cast("string"), F.lit(" characters"))
    return hits.select(*finding("title_length", "structure", msg, id=F.col("id"), title=F.col("title")))


def find_references(marked: DataFrame) -> DataFrame:
    """project, file, line_no, ref, num, kind of every reference outside code and headings."""
    text = marked.filter(~F.col("code") & ~F.col("line").rlike(X.HEADING))
    refs = text.select("project", "file", "line_no", F.explode(X.references(F.col("line"))).alias("ref"))
    kind = F.when(F.col("ref").contains("章"), "chapter").otherwise("section")
    return refs.select("project", "file", "line_no", "ref", X.reference_number(F.col("ref")).alias("num"), kind.alias("kind"))


def xref_missing(refs: DataFrame, headings: DataFrame) -> DataFrame:
    """References whose number no heading of the project has, once each."""
    missing = refs.join(headings.select("project", "num").distinct(), ["project", "num"], "left_anti").select("project", "ref").distinct()
    return missing.select(*finding("xref_missing", "structure", F.concat(F.lit("no section for "), "ref")))


def skeleton_missing(headings: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Required roles that a project lacks, one finding each."""
    wanted = headings.select("project").distinct().select("project", F.explode(F.array(*map(F.lit, required))).alias("role"))
    missing = wanted.join(headings.select("project", "role").distinct(), ["project", "role"], "left_anti")
    return missing.select(*finding("skeleton_missing", "role", F.concat(F.lit("no section for role "), "role")))


def role_unclear(headings: DataFrame) -> DataFrame:
    """Headings of the first two levels without a role."""
    hits = headings.filter("role is null and level <= 2")
    return hits.select(*finding("role_unclear", "role", F.lit("role is not clear"), id=F.col("id"), title=F.col("title")))


def role_wording(headings: DataFrame, forms: DataFrame) -> DataFrame:
    """Titles that differ from every mainstream wording (role, title) of their role."""
    mainstream = forms.groupBy("role").agg(F.array_sort(F.collect_set("title")).alias("forms"))
    hits = headings.join(mainstream, "role").filter(~F.array_contains("forms", F.col("title")))
    msg = F.concat(F.lit("uncommon wording for role "), "role")
    return hits.select(*finding("role_wording", "role", msg, id=F.col("id"), title=F.col("title"), suggestion=F.array_join("forms", " / ")))


def chapter_pattern(headings: DataFrame, patterns: list[str]) -> DataFrame:
    """Problem chapters whose title is none of the corpus's patterns (numerals as N)."""
    fits = F.regexp_replace("title", NUMERAL, "N").isin(patterns)
    hits = headings.filter((F.col("role") == "problem_chapter") & ~fits)
    return hits.select(*finding("chapter_pattern", "structure", F.lit("problem chapter with an uncommon pattern"), id=F.col("id"), title=F.col("title")))


def lint(marked: DataFrame, headings: DataFrame, terms: DataFrame, allowed: DataFrame | None = None, forms: DataFrame | None = None, most: int | DataFrame = MAX_TITLE, patterns: list[str] | None = None, bank: DataFrame | None = None) -> DataFrame:
    """All findings of all projects."""
    parts = [
        term_informal(headings, terms, allowed) if bank is None else term_segments(headings, terms, bank, allowed),
        title_colon(headings),
        title_length(headings, most),
        xref_missing(find_references(marked), headings),
        skeleton_missing(headings),
        role_unclear(headings),
    ]
    if forms is not None:
        parts.append(role_wording(headings, forms))
    if patterns:
        parts.append(chapter_pattern(headings, patterns))
    return reduce(DataFrame.unionByName, parts)
