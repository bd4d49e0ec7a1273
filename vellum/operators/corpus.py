"""Norms from a corpus of outlines (document, level, title, role)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: What a pattern writes as N.
NUMERAL = "[一二三四五六七八九十0-9]+"


def thresholds(outlines: DataFrame, quantile: float = 0.95) -> DataFrame:
    """level, n, max_title: the title length that this part of the titles of a level keeps to (exact)."""
    length = F.char_length("title")
    return outlines.groupBy("level").agg(F.count("*").alias("n"), F.percentile(length, F.lit(quantile)).alias("max_title"))


def role_forms(outlines: DataFrame, k: int = 3) -> DataFrame:
    """role, title, n, rank: the k most frequent wordings of each role."""
    counts = outlines.filter("role is not null").groupBy("role", "title").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "title"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def chapter_patterns(outlines: DataFrame, k: int = 5) -> DataFrame:
    """pattern, n: problem-chapter titles with their numerals replaced by N, the most frequent first."""
    chapters = outlines.filter("role = 'problem_chapter'")
    counts = chapters.groupBy(F.regexp_replace("title", NUMERAL, "N").alias("pattern")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "pattern").limit(k)


def norms(outlines: DataFrame) -> dict[str, list[dict]]:
    """All norms: six levels, a few wordings a role and a few patterns."""
    parts = {"thresholds": thresholds(outlines).orderBy("level"), "role_forms": role_forms(outlines).orderBy("role", "rank"), "patterns": chapter_patterns(outlines)}
    return {k: [r.asDict() for r in v.collect()] for k, v in parts.items()}


def norms_json(found: dict[str, list[dict]]) -> str:
    """The norms as the lint reads them."""
    return json.dumps(found, ensure_ascii=False, indent=1)


def norms_markdown(found: dict[str, list[dict]]) -> str:
    """The norms for readers."""
    lines = ["# Norms", "", "| level | titles | longest |", "|---|---|---|", *[f"| {r['level']} | {r['n']} | {r['max_title']:g} |" for r in found["thresholds"]]]
    lines += ["", "| role | wording | titles |", "|---|---|---|", *[f"| {r['role']} | {r['title']} | {r['n']} |" for r in found["role_forms"]]]
    return "\n".join([*lines, "", "| chapter pattern | titles |", "|---|---|", *[f"| {r['pattern']} | {r['n']} |" for r in found["patterns"]], ""])
