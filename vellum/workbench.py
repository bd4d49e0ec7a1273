"""Whole runs over a project folder, and their command line.

    python -m vellum.workbench PROJECT             inventory and lint; with a plan, its preview
    python -m vellum.workbench PROJECT --apply     apply the plan, lint again, report
    python -m vellum.workbench ROOT --all          the same for all projects in ROOT, in one job
    python -m vellum.workbench OUT --norms CORPUS  FRAME_NORMS.json and .md from outlines

``--references DIR`` names a folder that may hold ``heading_roles.json``, ``term_map.json``,
``term_bank.json`` and ``FRAME_NORMS.json``; rules, terms and norms come from there instead of
our seeds.  Words of the bank are fine, and so are informal terms within them.

Nothing is written below ``frame/sections`` unless the plan has no problem and no body line
is lost; source files are never written.
"""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.roles import RULES, role_of
from vellum.operators import apply as A
from vellum.operators import corpus as C
from vellum.operators import inventory as I
from vellum.operators import lint as L
from vellum.operators import report as R
from vellum.plans import outline as P
from vellum.plans.settle import settle
from vellum.sources import manuscripts as S


class Norms:
    """Rules, terms and norms of a folder, or our seeds; all of them are pages."""

    def __init__(self, spark: SparkSession, folder: str | None) -> None:
        path = lambda name: f"{folder.rstrip('/')}/{name}" if folder and S.exists(spark, f"{folder.rstrip('/')}/{name}") else None
        rules, terms, norms, bank = path("heading_roles.json"), path("term_map.json"), path("FRAME_NORMS.json"), path("term_bank.json")
        self.bank = S.read_term_bank(spark, bank) if bank else spark.createDataFrame([], "term string")
        self.rules = S.read_rules(spark, rules) if rules else RULES
        self.terms = S.read_terms(spark, terms) if terms else spark.createDataFrame(L.TERMS, "informal string, standard string")
        self.forms, self.most, self.patterns = None, L.MAX_TITLE, None
        if norms:
            held = json.loads(S.read_text(spark, norms))
            self.forms = spark.createDataFrame([(r["role"], r["title"]) for r in held["role_forms"]], "role string, title string")
            self.most = spark.createDataFrame([(r["level"], float(r["max_title"])) for r in held["thresholds"]], "level int, max_title double")
            self.patterns = [r["pattern"] for r in held["patterns"]]


    def lint(self, marked: DataFrame, headings: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """All findings under these rules, terms and norms."""
        return L.lint(marked, headings, self.terms, allowed, self.forms, self.most, self.patterns, self.bank)


def _said(row) -> str:
    """A problem as it is listed."""
    return row["problem"] if row["seq"] is None else f"op {row['seq'] + 1}: {row['problem']}"


def _source(plan: str) -> str | None:
    """The folder of sections that a plan names; a document that is no plan names none."""
    try:
        held = json.loads(plan)
    except ValueError:
        return None
    return held.get("src") if isinstance(held, dict) else None


class Project:
    """The frames of one project; headings are read by every step and kept."""

    def __init__(self, spark: SparkSession, root: str, references: str | None = None) -> None:
        self.spark, self.root, self.frame = spark, root.rstrip("/"), f"{root.rstrip('/')}/frame"
        self.name = self.root.rpartition("/")[2]
        self.references = Norms(spark, references)
        plan = f"{self.frame}/frame_plan.json"
        self.src = (S.exists(spark, plan) and _source(S.read_text(spark, plan))) or "paper/sections"
        self.sections = S.read_sections(spark, self.root, self.src).cache()
        marked, headings = I.inventory(self.sections, self.references.rules)
        self.marked, self.headings = settle(marked), settle(headings)
        self.outline: DataFrame | None = None

    def write(self, name: str, text: str) -> None:
        S.write_text(self.spark, f"{self.frame}/{name}", text)

    def lint(self, marked: DataFrame, headings: DataFrame) -> DataFrame:
        return self.references.lint(marked, headings, S.read_project_terms(self.spark, self.root))

    def read_only(self) -> DataFrame:
        """Inventory and lint."""
        self.write("frame_inventory.json", R.inventory_json(self.headings))
        findings = self.findings = settle(self.lint(self.marked, self.headings))
        self.write("frame_lint.json", R.lint_json(findings))
        self.write("FRAME_LINT.md", R.lint_markdown(findings))
        return findings

    def plan(self, preview: bool = True) -> tuple[DataFrame, list[str], dict]:
        """Ops, their problems, and how the plan wants to be applied (numbering, chained)."""
        document = S.read_plan(self.spark, f"{self.frame}/frame_plan.json", self.name)
        ops = settle(P.parse_plan(document))
        first = ops.select("numbering", "chained").first()
        mode = first.asDict() if first else {}
        found = settle(P.unreadable(document).unionByName(P.problems(ops, self.headings, mode.get("chained", False))))
        bad = [_said(r) for r in found.orderBy("seq", "problem").collect()]
        diff = None if bad else P.outline_diff(self.headings, P.new_outline(self.headings, ops, **mode))
        if preview:
            self.write("FRAME_PLAN.md", R.plan_markdown(found, ops, diff))
        return ops, bad, mode

    def apply(self) -> dict:
        """Apply the plan: validate, rewrite, prove, then write."""
        ops, bad, mode = self.plan(preview=False)
        result: dict = {"written": False, "problems": bad, "verify": {"fail": [], "warn": []}, "refs": []}
        if not bad:
            outline = self.outline = settle(P.new_outline(self.headings, ops, **mode))
            before = S.digests(self.spark, self.root, self.src).collect()
            lines = settle(A.rewrite(self.marked, self.headings, outline))
            built = settle(A.join_sections(lines, self.sections))
            order = self.sections.select("project", "file", "file_ord")
            again = built.join(order, ["project", "file"])
            marked = settle(I.mark_code(I.split_lines(again)))
            heads = I.find_headings(marked, self.references.rules).select("project", "file", "line_no", F.lit(True).alias("is_head"))
            found = marked.join(heads, ["project", "file", "line_no"], "left").withColumn("is_head", F.coalesce("is_head", F.lit(False)))
            fail = [f"{r['side']}: {r['line']}" for r in A.drift(lines, found).collect()]
            gone = A.with_owner(self.marked, self.headings).join(outline.filter("state = 'deleted'").select("project", F.col("ord").alias("owner")), ["project", "owner"], "left_anti")
            fail += [f"{r['kind']} {r['name']}: {r['n_before']} → {r['n_after']}" for r in A.asset_changes(A.assets(gone), A.assets(marked)).collect()]
            fail += [f"source changed: {r['file']}" for r in S.digests(self.spark, self.root, self.src).collect() if r not in before]
            result["verify"] = {"fail": fail, "warn": sorted({f"{r['file']}:{r['line_no']} {r['ref']} → {r['warn']}" for r in A.deleted_warnings(self.marked, self.headings, outline).collect()})}
            result["refs"] = [{"file": r["file"], "old": r["old"], "new": r["new"]} for r in A.reference_log(lines).orderBy("file", "src_line").collect()]
            if not fail:
                S.write_sections(built, f"{self.frame}/sections")
                S.write_text(self.spark, f"{self.frame}/paper.yaml", S.read_text(self.spark, f"{self.root}/paper/paper.yaml"))
                result["written"] = True
        self.write("frame_apply.json", json.dumps(result, ensure_ascii=False, indent=1))
        return result

    def after(self, result: dict) -> None:
        """Lint of the output and the report."""
        sections = S.read_sections(self.spark, self.root, src="frame/sections", manifest="frame/paper.yaml").cache()
        marked, headings = I.inventory(sections, self.references.rules)
        findings = settle(self.lint(settle(marked), settle(headings)))
        self.write("frame_lint_after.json", R.lint_json(findings))
        self.write("FRAME_LINT_AFTER.md", R.lint_markdown(findings, "Lint after"))
        diff = P.outline_diff(self.headings, self.outline)
        before = self.findings.count()
        self.write("FRAME_REPORT.md", R.report_markdown(result["written"], diff, result["refs"], result["verify"]["warn"], before, findings.count()))


def build_norms(spark: SparkSession, outlines: DataFrame, out: str, references: str | None = None) -> None:
    """FRAME_NORMS.json and FRAME_NORMS.md from outlines (file, level, title)."""
    titles = outlines.withColumn("role", role_of(F.col("title"), F.col("level"), Norms(spark, references).rules))
    found = C.norms(settle(titles))
    S.write_text(spark, f"{out}/FRAME_NORMS.json", C.norms_json(found))
    S.write_text(spark, f"{out}/FRAME_NORMS.md", C.norms_markdown(found))


def run_all(spark: SparkSession, root: str, apply: bool = False, strict: bool = False, references: str | None = None) -> int:
    """The same for all projects in ``root``: every step is one job over all of them.

    Each project gets ``frame_inventory.json``, ``frame_lint.json`` and, with a plan,
    ``frame_problems.json``; with ``apply`` the sections of those projects whose plan has no
    problem and whose body lines all stay are written, others keep their old output.
    """
    refs = Norms(spark, references)
    sections = settle(S.read_projects(spark, root))
    marked, headings = I.inventory(sections, refs.rules)
    marked, headings = settle(marked), settle(headings)
    outputs = [R.inventory_documents(headings), R.lint_documents(settle(refs.lint(marked, headings, None)), headings)]
    plans = settle(S.read_plans(spark, root))
    ops = settle(P.parse_plan(plans))
    problems = [P.unreadable(plans)]
    for chained in (False, True):
        own = ops.filter(F.col("chained") == chained)
        problems.append(P.problems(own, headings, chained))
    bad = settle(reduce(DataFrame.unionByName, problems))
    outputs.append(R.problem_documents(bad, plans))
    S.write_files(reduce(DataFrame.unionByName, outputs), root)
    if apply:
        _apply_all(spark, root, refs, sections, marked, headings, ops.join(bad.select("project").distinct(), "project", "left_anti"))
    return int(strict and not bad.isEmpty())


def _apply_all(spark: SparkSession, root: str, refs: Norms, sections: DataFrame, marked: DataFrame, headings: DataFrame, ops: DataFrame) -> None:
    """Rewrite, prove and write the projects of ``ops``."""
    parts = []
    for numbering in ("auto", "keep"):
        for chained in (False, True):
            own = settle(ops.filter((F.col("numbering") == numbering) & (F.col("chained") == chained)))
            if not own.isEmpty():
                parts.append(P.new_outline(headings.join(own.select("project").distinct(), "project", "left_semi"), own, numbering, chained))
    if not parts:
        return
    outline = settle(reduce(DataFrame.unionByName, parts))
    of = lambda df: df.join(outline.select("project").distinct(), "project", "left_semi")
    marked, headings, sections = of(marked), of(headings), of(sections)
    lines = settle(A.rewrite(marked, headings, outline))
    built = settle(A.join_sections(lines, sections))
    again = settle(I.mark_code(I.split_lines(built.join(sections.select("project", "file", "file_ord"), ["project", "file"]))))
    heads = I.find_headings(again, refs.rules).select("project", "file", "line_no", F.lit(True).alias("is_head"))
    found = again.join(heads, ["project", "file", "line_no"], "left").withColumn("is_head", F.coalesce("is_head", F.lit(False)))
    gone = A.with_owner(marked, headings).join(outline.filter("state = 'deleted'").select("project", F.col("ord").alias("owner")), ["project", "owner"], "left_anti")
    lost = A.drift(lines, found).select("project").unionByName(A.asset_changes(A.assets(gone), A.assets(again)).select("project"))
    S.write_folders(built.join(settle(lost.distinct()), "project", "left_anti"), root, "frame/sections")


def run(spark: SparkSession, root: str, apply: bool = False, strict: bool = False, references: str | None = None) -> int:
    """The exit code of a run."""
    project = Project(spark, root, references)
    project.read_only()
    planned = S.exists(spark, f"{project.frame}/frame_plan.json")
    if not apply:
        bad = project.plan()[1] if planned else []
        return int(strict and bool(bad))
    if not planned:
        print("no frame/frame_plan.json: NOT WRITTEN")
        return int(strict)
    result = project.apply()
    if not result["written"]:
        print("NOT WRITTEN", *result["problems"], *result["verify"]["fail"], sep="\n- ")
        return 1
    project.after(result)
    return 0


def main(args: list[str] | None = None) -> int:
    """Command line."""
    parser = argparse.ArgumentParser(description="Inventory, lint, plan and apply the outline of a manuscript.")
    parser.add_argument("project")
    parser.add_argument("--apply", action="store_true")
    parser.add_argument("--strict", action="store_true")
    parser.add_argument("--all", action="store_true", help="the folder holds projects")
    parser.add_argument("--references")
    parser.add_argument("--norms", metavar="CORPUS")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("workbench").config("spark.ui.enabled", "false").getOrCreate()
    if given.norms:
        build_norms(spark, S.read_outlines(spark, given.norms), given.project, given.references)
        return 0
    return (run_all if given.all else run)(spark, given.project, given.apply, given.strict, given.references)


if __name__ == "__main__":
    sys.exit(main())
