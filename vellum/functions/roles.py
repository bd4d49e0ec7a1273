"""Semantic roles of headings: an ordered, level-aware rule table.

A heading of level L takes the first rule of its level that matches its title, else the
first rule of level 1 that does and is not bound to its level (``strict_level``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_N = "[一二三四五六七八九十0-9]+"
#: (role, level, pattern, strict_level) in order of priority; a seed of our own.
RULES = [
    ("abstract", 1, r"^摘\s*要$|^[Aa]bstract$", True),
    ("restatement", 1, r"问题(的)?(重述|提出)|[Rr]estatement", False),
    ("problem_chapter", 1, rf"^问题{_N}|^[Pp]roblem [0-9]+", True),
    ("analysis", 1, r"问题(的)?分析", False),
    ("assumptions", 1, r"假设|[Aa]ssumption", False),
    ("notation", 1, r"符号(的)?(说明|约定)|[Nn]otation", False),
    ("sensitivity", 1, r"灵敏度|敏感性|[Ss]ensitivity", False),
    ("evaluation", 1, r"评价|推广|优缺点|[Ee]valuation", False),
    ("conclusion", 1, r"结论|[Cc]onclusion", False),
    ("references", 1, r"参考文献|^[Rr]eferences$", True),
    ("appendix", 1, r"^附录|^[Aa]ppendix", True),
    ("sub_summary", 2, r"小结|[Ss]ummary", False),
    ("sub_analysis", 2, rf"^(问题{_N}(的)?)?分析$|^问题分析$|[Aa]nalysis", False),
    ("sub_model", 2, r"模型.*(建立|构建|求解)|[Mm]odel", False),
    ("sub_validation", 2, r"检验|验证|[Vv]alidation", False),
    ("sub_solution", 2, r"求解|结果|[Rr]esult", False),
    ("background", 2, r"背景|[Bb]ackground", False),
    ("sub_description", 2, r"问题描述|[Dd]escription", False),
]
#: Roles every manuscript should have.
REQUIRED = ["abstract", "assumptions", "evaluation", "references"]


def role_of(title: Column, level: Column, rules: list = RULES) -> Column:
    """The role as a chain of conditions, so that it stays in generated code."""
    own = [F.when((level == at) & title.rlike(pattern), F.lit(role)) for role, at, pattern, _ in rules]
    fallback = [F.when(title.rlike(pattern), F.lit(role)) for role, at, pattern, strict in rules if at == 1 and not strict]
    return F.coalesce(*own, *fallback)


def classify_role(title: str, level: int, rules: list = RULES) -> str | None:
    """The same for one title."""
    for role, at, pattern, _ in rules:
        if at == level and re.search(pattern, title):
            return role
    return next((role for role, at, pattern, strict in rules if at == 1 and not strict and re.search(pattern, title)), None)
