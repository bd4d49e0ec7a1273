"""Titles that begin like a number, and the catalog's steps at any size."""

import random

from vellum import queries as Q
from vellum.operators import apply as A
from vellum.operators import inventory as I
from vellum.plans import chained
from vellum.plans import outline as P
from vellum.plans import settle as T
from vellum.sources import adapters as S


def test_titles_that_begin_like_a_number(spark, tmp_path):
    pages = [(3, "56.187.231.175 Keit"), (6, "2024 in brief"), (9, "&#53; five"), (12, "5G nets"), (4, "10.0.0.1 host")]
    spark.createDataFrame([(k, f"<h1>{t}</h1>") for k, t in pages], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {int(r["id"].split(".")[0]): (r["title"], r["num"], r["num_style"]) for r in Q.inv_num_style(spark, str(tmp_path)).collect()}
    assert got == {k: (t, None, "none") if k % 3 == 0 else (t, f"{k}.{k % 4}", "arabic") for k, t in pages}
    # a plan that keeps or writes such a title leads to the same outline when it is read again
    sections = spark.createDataFrame([("p", "a.md", 0, "# &#50;024 in brief\n\n## Plain\n")], "project string, file string, file_ord int, text string")
    marked = I.mark_code(I.split_lines(sections))
    heads = I.with_extent(I.find_headings(marked))
    ops = spark.createDataFrame([("p", 0, "rename", "a.md:3", None, None, None, "7 wonders", None)], "project string, seq int, op string, id string, after string, level int, title string, new string, why string")
    lines = A.rewrite(marked, heads, P.new_outline(heads, ops))
    built = A.join_sections(lines, sections).join(sections.select("project", "file", "file_ord"), ["project", "file"])
    assert built.first()["text"] == "# &#50;024 in brief\n\n## &#55; wonders\n"
    again = I.find_headings(I.mark_code(I.split_lines(built)))
    assert [(r["title"], r["num"]) for r in again.orderBy("ord").collect()] == [("2024 in brief", None), ("7 wonders", None)]


def test_chained_places_against_full_keys(spark):
    """Random chains: the order by numbers of slots is that of the keys in full, which grow with a chain."""
    rng, heads, ops, want = random.Random(3), [], [], {}
    for p in range(60):
        paths, stack, levels = {}, [], [1] + [rng.randint(1, 4) for _ in range(13)]
        for k, n in enumerate(levels, 1):
            stack = [x for x in stack if levels[x - 1] < n] + [k]
            paths[f"x.md:{k}"] = list(stack)
        names, plan = list(paths), []
        for seq in range(rng.randint(2, 12)):
            op = {"seq": seq, "op": rng.choice(["move", "move", "move", "insert", "insert", "delete"]), "id": rng.choice(names), "after": rng.choice(names)}
            if op["op"] == "insert":
                op["id"] = f"n{seq}"
                names.append(op["id"])
            plan.append(op | {"t_path": paths.get(op["id"]), "a_path": paths.get(op["after"]), "t_file": "x.md", "t_file_ord": 0, "a_file": "x.md", "a_file_ord": 0})
        while bad := {r["seq"] for r in chained._fold(plan) if r["kind"] == "problem"}:
            plan = [o for o in plan if o["seq"] not in bad]
        found = chained._fold(plan)
        put = {r["ord"]: r for r in found if r["kind"] == "moved"}
        keys = {("i", r["seq"]): r["key"] for r in found if r["kind"] == "inserted" and not r["gone"]}
        for k in range(1, 15):
            path = paths[f"x.md:{k}"]
            at = max((x for x in path if x in put), default=0)
            below = [y for x in path if x > at for y in (0, x)]
            keys[("h", k)] = [*put[at]["key"], *below] if at else below[1:]
        want[f"p{p:02}"] = [f"n{k}" if kind == "i" else f"h{k}" for kind, k in sorted(keys, key=keys.get)]
        ends = [next((j for j in range(k + 1, 15) if levels[j - 1] <= levels[k - 1]), 15) for k in range(1, 15)]
        heads += [(f"p{p:02}", "x.md", 0, k, f"x.md:{k}", k, levels[k - 1], f"h{k}", None, ends[k - 1]) for k in range(1, 15)]
        ops += [(f"p{p:02}", o["seq"], o["op"], o["id"], o["after"], 2 if o["op"] == "insert" else None, f"n{o['seq']}", None) for o in plan]
    headings = spark.createDataFrame(heads, "project string, file string, file_ord int, line_no int, id string, ord int, level int, title string, num string, subtree_end int")
    plans = spark.createDataFrame(ops, "project string, seq int, op string, id string, after string, level int, title string, new string")
    got = {}
    for r in P.new_outline(headings, plans, chained=True).orderBy("project", "pos").collect():
        got.setdefault(r["project"], []).append(r["new_title"])
    assert got == want


def test_a_long_chain_has_short_keys():
    """Keys of a chain grew with its length, and so with its square in all; they were sampled to the driver."""
    n = 4000
    ops = [{"seq": k, "op": "insert" if k % 3 == 1 else "move", "id": f"n{k}" if k % 3 == 1 else f"x.md:{k + 3}", "after": "x.md:2" if k == 0 else f"n{k - 1}" if k % 3 == 2 else f"x.md:{k + 2}"} for k in range(n)]
    path = lambda name: [1, int(name[5:])] if name.startswith("x.md") else None
    ops = [o | {"t_path": path(o["id"]), "a_path": path(o["after"]), "t_file": "x.md", "t_file_ord": 0, "a_file": "x.md", "a_file_ord": 0} for o in ops]
    found = [r for r in chained._numbered(ops) if r["kind"] in ("moved", "inserted")]
    assert len(found) == n and {len(r["key"]) for r in found} == {3} and not any(r["kind"] == "problem" for r in found)


def test_headings_do_not_carry_the_lines_along(spark, monkeypatch):
    """What only asks for headings wrote down and sorted all lines of the catalog (report_changes, plan_outline_diff, apply_insert, apply_relevel)."""
    sizes = []

    def settle(df):
        kept = T.settle(df)
        sizes.append(kept.count())
        return kept

    for module in (Q, I, S):
        monkeypatch.setattr(module, "settle", settle)
    folder = "/root/testdata/sf0.001"
    lines = S.catalog_lines(spark, folder, keep=False).count()
    headings = Q._headings(spark, folder).select("project", "id", "ord", "level", "title", "num", "role")
    assert sizes and max(sizes) < 0.9 * lines
    whole = Q._catalog(spark, folder)[1].select(headings.columns)
    assert max(sizes) == lines and sorted(headings.collect()) == sorted(whole.collect())


def test_marks_of_wanted_lines_only(spark, monkeypatch):
    """Blocks that are open over many stretches, in files of several batches: lines that are asked for alone are marked as among all."""
    monkeypatch.setattr(I, "BLOCK_BITS", 3)
    rng, kinds = random.Random(5), ["# a", "```", "````", "``` x", "~~~", "text", "## b", "text"]
    rows = [("p", f"{f}.md", f, n, rng.choice(kinds)) for f in range(30) for n in range(1, rng.randint(2, 60))]
    lines = spark.createDataFrame(rows, "project string, file string, file_ord int, line_no int, line string")
    want, state = {}, {}
    for _, file, _, n, line in rows:
        open_, fence = state.get(file, ""), line.lstrip("#").split(" ")[0] if line[0] in "`~" else ""
        if fence and not open_:
            state[file] = fence
        elif fence and " " not in line and fence.startswith(open_):
            state[file] = ""
        want[file, n] = bool(open_ or fence)
    whole = {(r["file"], r["line_no"]): r["code"] for r in I.mark_code(lines).collect()}
    some = {(r["file"], r["line_no"]): r["code"] for r in I.mark_code(lines, I.may_head()).collect()}
    assert whole == want and some == {(f, n): want[f, n] for _, f, _, n, line in rows if line[0] == "#"}
