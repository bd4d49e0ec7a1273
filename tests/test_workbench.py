"""Whole projects: a handbook of our own with every kind of op, refusals, references and norms."""

import hashlib
import json

import pytest

from vellum import workbench
from vellum.functions.roles import classify_role
from vellum.sources import manuscripts

HANDBOOK = {
    "basin.md": "# 1 Catchment\n\nSee 3.2 节 and 第 4 章.\n\n## 1.1 Rainfall\n\n$$\nr = s\n$$\n\n## 1.2 Soils\n\nLoam holds 3.2 per cent.\n",
    "works.md": "Before any heading.\n\n# 2 Works: old and new\n\nBuilt by hand.\n",
    "pumps.md": (
        "# 3 Pumps\n\n## 3.1 Station\n\n### 3.1.1 Inlet\n\n#### 3.1.1.1 Screen\n\nsteel\n\n### 3.1.2 Outlet\n\n![o](o.png){#fig:o}\n\n"
        "## 3.2 Pressure\n\nUse 3.1.2 节, then 5.5 节.\n\n~~~~ text\n# 9 fenced, 3.2 节\n~~~\nstill fenced\n~~~~\n\n### 3.2.1 Gauge\n\na dial"
    ),
    "losses.md": "# 4 Losses\n\n## 4.1 Leaks\n\ndrip\n\n## 4.2 Theft\n\nat night\n",
    "sources.md": "# References\r\n\r\n[1] Nobody.\r\n",
}
ORDER = list(HANDBOOK)


@pytest.fixture
def handbook(tmp_path):
    root = tmp_path / "handbook"
    (root / "paper/sections").mkdir(parents=True)
    for name, text in HANDBOOK.items():
        (root / "paper/sections" / name).write_bytes(text.encode())
    (root / "paper/paper.yaml").write_text(f"title: Water\nsections: [{', '.join(ORDER)}]\n")
    (root / "frame").mkdir()
    return root


def held(root, name):
    return json.loads((root / "frame" / name).read_text(encoding="utf-8"))


def text(root, name):
    return (root / "frame" / name).read_bytes().decode()


def give(root, ops, numbering="auto", src="paper/sections"):
    (root / "frame/frame_plan.json").write_text(json.dumps({"src": src, "numbering": numbering, "ops": ops}))


def ids():
    """Heading title to id, by hand: the line of each in its file."""
    out, fence = {}, False
    for name, body in HANDBOOK.items():
        for k, line in enumerate(body.split("\n"), 1):
            fence ^= line.startswith("~~~~")
            if line.startswith("#") and not fence:
                out[line.strip("# \r").split(" ", 1)[-1]] = f"{name}:{k}"
    return out


def outline(body):
    fence, out = False, []
    for line in body.split("\n"):
        fence ^= line.startswith("~~~~")
        if line.startswith("#") and not fence:
            out.append(line.rstrip("\r"))
    return out


AT = ids()
OPS = [
    {"op": "insert", "after": AT["Works: old and new"], "level": 2, "title": "Dams", "why": "missing"},
    {"op": "move", "id": AT["Pressure"], "after": AT["Rainfall"], "why": "belongs there"},
    {"op": "insert", "after": AT["Works: old and new"], "level": 2, "title": "Weirs", "why": "missing"},
    {"op": "relevel", "id": AT["Station"], "level": 1, "why": "a chapter"},
    {"op": "merge_up", "id": AT["Outlet"], "why": "short"},
    {"op": "delete", "id": AT["Losses"], "why": "another book"},
    {"op": "rename", "id": AT["Works: old and new"], "new": "Structures", "why": "plain"},
]

#: Titles whose roles are given.
ROLES = [("问题一：模型建立", 1, "problem_chapter"), ("问题一的模型建立与求解", 2, "sub_model"), ("问题一分析", 2, "sub_analysis"), ("模型假设", 2, "assumptions"), ("参考文献", 2, None), ("模型的评价与推广", 1, "evaluation"), ("随便写的标题", 1, None)]
OWN_ROLES = [("摘  要", 1, "abstract"), ("Problem 12", 1, "problem_chapter"), ("Problem 12", 2, None), ("Conclusion", 3, "conclusion"), ("Appendix A", 1, "appendix"), ("A summary", 2, "sub_summary"), ("Weather", 1, None)]


@pytest.mark.parametrize(("title", "level", "role"), ROLES + OWN_ROLES)
def test_roles(title, level, role):
    assert classify_role(title, level) == role


def test_inventory_and_lint(spark, handbook):
    assert workbench.run(spark, str(handbook), strict=True) == 0
    found = held(handbook, "frame_inventory.json")
    assert found["counts"] == {"h1": 5, "h2": 6, "h3": 3, "h4": 1}
    by = {h["title"]: h for h in found["headings"]}
    assert {t: h["id"] for t, h in by.items()} == AT
    assert [h["title"] for h in found["headings"]][:4] == ["Catchment", "Rainfall", "Soils", "Works: old and new"]
    assert by["Rainfall"]["own_body"] == {"display_eqs": 1, "figures": 0, "code_blocks": 0}
    assert by["Pumps"]["own_body"] == {"display_eqs": 0, "figures": 0, "code_blocks": 0} and by["Pumps"]["subtree"] == {"display_eqs": 0, "figures": 1, "code_blocks": 1}
    assert (by["References"]["num"], by["References"]["num_style"], by["References"]["role"]) == (None, "none", "references") and by["Screen"]["num"] == "3.1.1.1"
    items = held(handbook, "frame_lint.json")["items"]
    assert [i["msg"] for i in items if i["rule"] == "xref_missing"] == ["no section for 5.5 节"]  # neither the literal nor the fenced one
    assert [i["title"] for i in items if i["rule"] == "title_colon"] == ["Works: old and new"]
    assert {i["msg"].rpartition(" ")[2] for i in items if i["rule"] == "skeleton_missing"} == {"abstract", "assumptions", "evaluation"}
    assert "title has a colon" in text(handbook, "FRAME_LINT.md")


def test_every_op(spark, handbook, capsys):
    give(handbook, OPS)
    assert workbench.run(spark, str(handbook)) == 0
    preview = text(handbook, "FRAME_PLAN.md")
    assert all(mark in preview for mark in ("← 删除", "← 新增", "← 移动", "← 修改", "← 并入上节")) and not (handbook / "frame/sections").exists()
    before = {n: hashlib.sha256((handbook / "paper/sections" / n).read_bytes()).digest() for n in ORDER}
    assert workbench.run(spark, str(handbook), apply=True, strict=True) == 0
    assert before == {n: hashlib.sha256((handbook / "paper/sections" / n).read_bytes()).digest() for n in ORDER}
    out = {n: text(handbook, f"sections/{n}") for n in ORDER}
    assert outline(out["basin.md"]) == ["# 1 Catchment", "## 1.1 Rainfall", "## 1.2 Pressure", "### 1.2.1 Gauge", "## 1.3 Soils"]
    assert outline(out["works.md"]) == ["# 2 Structures", "## 2.1 Dams", "## 2.2 Weirs"] and out["works.md"].startswith("Before any heading.\n")
    assert outline(out["pumps.md"]) == ["# 3 Pumps", "# 4 Station", "## 4.1 Inlet", "### 4.1.1 Screen"]
    assert out["losses.md"].strip() == "" and out["sources.md"] == HANDBOOK["sources.md"]
    assert "See 1.2 节 and 第 4 章." in out["basin.md"] and "Use 4.1.1 节, then 5.5 节." in out["basin.md"] and "Loam holds 3.2 per cent." in out["basin.md"]
    assert "# 9 fenced, 3.2 节\n~~~\nstill fenced\n~~~~" in out["basin.md"] and "{#fig:o}" in out["pumps.md"]
    result = held(handbook, "frame_apply.json")
    assert result["written"] and result["problems"] == [] == result["verify"]["fail"]
    assert [(r["old"], r["new"]) for r in result["refs"]] == [("See 3.2 节 and 第 4 章.", "See 1.2 节 and 第 4 章."), ("Use 3.1.2 节, then 5.5 节.", "Use 4.1.1 节, then 5.5 节.")]
    assert result["verify"]["warn"] == ["basin.md:3 第 4 章 → 4 Losses"]
    report = text(handbook, "FRAME_REPORT.md")
    assert "已应用" in report and "## 2 Works" not in report and "# 2 Works: old and new → # 2 Structures" in report and "请人工处理：basin.md:3" in report
    assert not [i for i in held(handbook, "frame_lint_after.json")["items"] if i["rule"] == "title_colon"] and "Lint after" in text(handbook, "FRAME_LINT_AFTER.md")
    assert text(handbook, "paper.yaml").startswith("title: Water")


def test_kept_numbers(spark, handbook):
    give(handbook, [op for op in OPS if op["op"] in ("move", "rename", "insert", "delete")], "keep")
    assert workbench.run(spark, str(handbook), apply=True, strict=True) == 0
    assert outline(text(handbook, "sections/basin.md")) == ["# 1 Catchment", "## 1.1 Rainfall", "## 3.2 Pressure", "### 3.2.1 Gauge", "## 1.2 Soils"]
    assert outline(text(handbook, "sections/works.md")) == ["# 2 Structures", "## Dams", "## Weirs"]
    assert held(handbook, "frame_apply.json")["refs"] == []


@pytest.mark.parametrize("mode", ["auto", "keep"])
def test_no_op_changes_nothing(spark, handbook, mode):
    give(handbook, [], mode)
    assert workbench.run(spark, str(handbook), apply=True) == 0
    assert {n: text(handbook, f"sections/{n}") for n in ORDER} == HANDBOOK


BAD = [
    ([{"op": "delete", "id": AT["Pumps"]}, {"op": "rename", "id": AT["Gauge"], "new": "Dial"}], ["op 2: depends on op 1"]),
    ([{"op": "move", "id": AT["Soils"], "after": AT["Screen"]}, {"op": "move", "id": AT["Station"], "after": AT["Catchment"]}], ["op 1: depends on op 2"]),
    ([{"op": "move", "id": AT["Station"], "after": AT["Screen"]}], ["op 1: move into its own section"]),
    ([{"op": "insert", "after": AT["Soils"], "level": 7, "title": "Deep"}, {"op": "merge_up", "id": "pumps.md:2"}], ["op 1: illegal level 7", "op 2: unknown id pumps.md:2"]),
    ([{"op": "rename", "id": AT["Soils"], "new": "Clay"}, {"op": "rename", "id": AT["Soils"], "new": "Sand"}], ["op 2: same op twice"]),
]


@pytest.mark.parametrize(("ops", "said"), BAD)
def test_refusals(spark, handbook, capsys, ops, said):
    give(handbook, ops, "keep")
    assert workbench.run(spark, str(handbook), apply=True, strict=True) == 1
    result = held(handbook, "frame_apply.json")
    assert not result["written"] and result["problems"] == said and "NOT WRITTEN" in capsys.readouterr().out and not (handbook / "frame/sections").exists()


def test_source_folder_of_the_plan(spark, handbook):
    (handbook / "paper/sections").rename(handbook / "drafts")
    give(handbook, [OPS[-1]], src="drafts")
    assert workbench.run(spark, str(handbook), apply=True, strict=True) == 0
    assert outline(text(handbook, "sections/works.md")) == ["# 2 Structures"]


def test_references_and_project_terms(spark, handbook, tmp_path):
    pages = tmp_path / "references"
    pages.mkdir()
    rules = [{"priority": 2, "role": "problem_chapter", "level": 1, "pattern": "^Works|^Pumps", "strict_level": True}, {"priority": 1, "role": "intro", "level": 1, "pattern": "^Catch", "strict_level": False}]
    (pages / "heading_roles.json").write_text(json.dumps(rules))
    (pages / "term_map.json").write_text(json.dumps([{"informal": "Works", "standard": "Structures"}, {"informal": "Pumps", "standard": "Machines"}]))
    norms = {"thresholds": [{"level": 1, "n": 3, "max_title": 9.5}], "role_forms": [{"role": "intro", "title": "Basin", "n": 4, "rank": 1}], "patterns": [{"pattern": "Pumps", "n": 2}]}
    (pages / "FRAME_NORMS.json").write_text(json.dumps(norms))
    (handbook / "frame/FRAME_TERMS.json").write_text(json.dumps({"terms": [{"term": "Pumps"}]}))
    assert workbench.run(spark, str(handbook), references=str(pages)) == 0
    items = held(handbook, "frame_lint.json")["items"]
    said = lambda rule: sorted((i["title"], i["suggestion"]) for i in items if i["rule"] == rule)
    assert said("term_informal") == [("Works: old and new", "Structures")]
    assert said("role_wording") == [("Catchment", "Basin")]
    assert said("chapter_pattern") == [("Works: old and new", None)]
    assert said("title_length") == [("References", None), ("Works: old and new", None)]


def test_norms_from_outlines(spark, tmp_path):
    """From PDF documents (a stub reads their outlines) and from a table of outlines alike."""
    titles = [(1, "Problem 1 Flow"), (1, "Problem 2 Flow"), (1, "Problem 3 Cost"), (2, "Model of heat"), (2, "Model of heat"), (1, "Conclusion")]
    (tmp_path / "pdf").mkdir()
    for k in range(2):
        (tmp_path / f"pdf/{k}.pdf").write_text("\n".join(f"{level}|{title}" for level, title in titles[k * 3 : k * 3 + 3]))

    def toc(content):
        return [(int(line.split("|")[0]), line.split("|")[1]) for line in content.decode().split("\n")]

    pdf = manuscripts.read_pdf_outlines(spark, str(tmp_path / "pdf"), toc)
    rows = [{"file": f"{k // 3}.pdf", "level": level, "title": title} for k, (level, title) in enumerate(titles)]
    (tmp_path / "outline_corpus.json").write_text(json.dumps(rows))
    listed = manuscripts.read_outlines(spark, str(tmp_path / "outline_corpus.json"))
    assert sorted(map(tuple, pdf.collect())) == sorted(map(tuple, listed.collect()))
    for k, outlines in enumerate((pdf, listed)):
        out = tmp_path / f"norms{k}"
        workbench.build_norms(spark, outlines, str(out))
        found = json.loads((out / "FRAME_NORMS.json").read_text())
        assert [(r["level"], r["n"], r["max_title"]) for r in found["thresholds"]] == [(1, 4, 14.0), (2, 2, 13.0)]
        assert [(r["role"], r["title"], r["n"]) for r in found["role_forms"] if r["role"] == "sub_model"] == [("sub_model", "Model of heat", 2)]
        assert [(r["pattern"], r["n"]) for r in found["patterns"]] == [("Problem N Flow", 2), ("Problem N Cost", 1)]
        assert "| Problem N Flow | 2 |" in (out / "FRAME_NORMS.md").read_text()
