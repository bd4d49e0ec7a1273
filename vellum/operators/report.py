"""JSON and Markdown renderings; a manuscript's outline is small, its text is not gathered here."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.schemas import LEVELS, STATS


def inventory_json(headings: DataFrame) -> str:
    """``headings`` and ``counts`` of one project."""
    rows = headings.orderBy("ord").collect()
    counts: dict[str, int] = defaultdict(int)
    out = []
    for r in rows:
        counts[f"h{r['level']}"] += 1
        own, total = {c: r[c] for c in STATS}, {c: r[f"total_{c}"] for c in STATS}
        out.append({c: r[c] for c in ("id", "title", "level", "num", "num_style", "role")} | {"own_body": own, "subtree": total})
    return json.dumps({"headings": out, "counts": dict(sorted(counts.items()))}, ensure_ascii=False, indent=1)


def lint_json(findings: DataFrame) -> str:
    """``items`` of one project."""
    items = [r.asDict() for r in findings.drop("project").orderBy("layer", "rule", "id", "msg").collect()]
    return json.dumps({"items": items}, ensure_ascii=False, indent=1)


def _documents(rows: DataFrame, file: str, name: str, item: Column, order: list[str], **more: Column) -> DataFrame:
    """project, file, text: a JSON document a project, with its rows as the array ``name``; a project's outline is one document."""
    listed = F.transform(F.array_sort(F.collect_list(F.when(item.isNotNull(), F.struct(*order, item.alias("__item"))))), lambda x: x["__item"])
    held = rows.groupBy("project").agg(listed.alias(name), *[v.alias(k) for k, v in more.items()])
    text = F.to_json(F.struct(name, *more), {"ignoreNullFields": "false"})
    return held.select("project", F.lit(file).alias("file"), text.alias("text"))


def inventory_documents(headings: DataFrame) -> DataFrame:
    """The inventories of all projects, as :func:`inventory_json` has one."""
    total = F.struct(*[F.col(f"total_{c}").alias(c) for c in STATS])
    item = F.struct("id", "title", "level", "num", "num_style", "role", F.struct(*STATS).alias("own_body"), total.alias("subtree"))
    counts = F.struct(*[F.count_if(F.col("level") == k).alias(f"h{k}") for k in LEVELS])
    return _documents(headings, "frame/frame_inventory.json", "headings", item, ["ord"], counts=counts)


def lint_documents(findings: DataFrame, headings: DataFrame) -> DataFrame:
    """The findings of all projects, as :func:`lint_json` has one; a project without any has an empty list."""
    item = F.when(F.col("rule").isNotNull(), F.struct("rule", "layer", "id", "title", "msg", "suggestion"))
    rows = headings.select("project").distinct().join(findings, "project", "left")
    return _documents(rows, "frame/frame_lint.json", "items", item, ["layer", "rule", "id", "msg"])


def problem_documents(problems: DataFrame, plans: DataFrame) -> DataFrame:
    """The problems of all plans; a sound plan has an empty list."""
    item = F.when(F.col("problem").isNotNull(), F.struct((F.col("seq") + 1).alias("op"), "problem"))
    rows = plans.select("project").distinct().join(problems, "project", "left")
    return _documents(rows, "frame/frame_problems.json", "problems", item, ["seq", "problem"])


def lint_markdown(findings: DataFrame, heading: str = "Lint") -> str:
    """Findings by layer."""
    lines = [f"# {heading}", ""]
    by_layer: dict[str, list[str]] = defaultdict(list)
    for r in findings.orderBy("layer", "rule", "id", "msg").collect():
        at = f"`{r['id']}` {r['title']}: " if r["id"] else ""
        by_layer[r["layer"]].append(f"- **{r['rule']}** {at}{r['msg']}" + (f" → {r['suggestion']}" if r["suggestion"] else ""))
    for layer in sorted(by_layer):
        lines += [f"## {layer}", "", *by_layer[layer], ""]
    return "\n".join(lines if by_layer else [*lines, "No findings.", ""])


def _diff_table(diff: DataFrame) -> list[str]:
    rows = sorted(diff.collect(), key=lambda r: (r["pos"] if r["pos"] is not None else 1 << 30, r["ord"] or 0))
    return ["| 前 | 后 | |", "|---|---|---|", *[f"| {r['before'] or ''} | {r['after'] or ''} | {r['mark'] or ''} |" for r in rows]]


def plan_markdown(problems: DataFrame, ops: DataFrame, diff: DataFrame | None) -> str:
    """What a plan does, or why it is refused."""
    lines = ["# Plan", ""]
    bad = problems.orderBy("seq", "problem").collect()
    if bad:
        lines += ["## 问题", "", *[f"- {'' if r['seq'] is None else f'op {r["seq"] + 1}: '}{r['problem']}" for r in bad], ""]
    lines += ["## 操作", "", *[f"- {r['op']} `{r['id'] or r['after']}` {r['why'] or ''}" for r in ops.orderBy("seq").collect()], ""]
    if diff is not None:
        lines += ["## 前后目录对照", "", *_diff_table(diff), ""]
    return "\n".join(lines)


def report_markdown(applied: bool, diff: DataFrame, log: list[dict], warn: list[str], before: int, after: int) -> str:
    """The state of a project after a run."""
    changed = [r for r in diff.filter("mark is not null").orderBy("pos").collect()]
    return "\n".join(
        ["# Report", "", f"状态：{'已应用' if applied else '未应用'}", "", "## 前后对比", "", *_diff_table(diff), ""]
        + ["## 标题变更", "", *[f"- {r['before'] or '—'} → {r['after'] or '—'} {r['mark']}" for r in changed], ""]
        + ["## 引用同步", "", *[f"- {x['old']} → {x['new']}" for x in log], "", *[f"- 请人工处理：{w}" for w in warn], ""]
        + [f"Lint: {before} → {after}", ""]
    )
