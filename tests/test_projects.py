"""Many projects in one job, output that is replaced as a whole, plans that are none, chained plans, term banks and damaged documents."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from vellum import workbench
from vellum.functions.scan import Running, scan
from vellum.operators import apply as A
from vellum.operators import inventory as I
from vellum.operators import lint as L
from vellum.plans import chained
from vellum.plans import outline as P
from vellum.sources import manuscripts

PAPERS = {
    "tides": ({"b.md": "# 1 Tides\n\nSee 2.1 节.\n", "a.md": "# 2 Moon\n\n## 2.1 Pull\n\nstrong", "z.md": "# Notes\n"}, "title: T\nsections:\n  - b.md\n  - a.md\n"),
    "wind": ({"a.md": "# 1 Wind: a start\n\n```\n# no\n```\n", "b.md": "# 2 Mills\n\n## 2.1 Sails\n\n## 2.2 Gears\n"}, "title: W\nsections: [b.md, a.md]\n"),
    "rain": ({"only.md": "# 1 Rain\n\nwet\n\n## 1.1 Drops\n\n## 1.2 Clouds\n"}, None),
}


@pytest.fixture
def shelf(tmp_path):
    for name, (files, manifest) in PAPERS.items():
        folder = tmp_path / "shelf" / name / "paper/sections"
        folder.mkdir(parents=True)
        for file, text in files.items():
            (folder / file).write_bytes(text.encode())
        if manifest:
            (folder.parent / "paper.yaml").write_text(manifest)
        (tmp_path / "shelf" / name / "frame").mkdir()
    return tmp_path / "shelf"


def plan(shelf, name, text):
    (shelf / name / "frame/frame_plan.json").write_text(text if isinstance(text, str) else json.dumps(text))


def test_projects_have_their_own_order(spark, shelf):
    rows = manuscripts.read_projects(spark, f"{shelf}/")
    got = {(r["project"], r["file_ord"]): (r["file"], r["text"]) for r in rows.collect()}
    order = {"tides": ["b.md", "a.md", "z.md"], "wind": ["b.md", "a.md"], "rain": ["only.md"]}
    assert got == {(p, k): (f, PAPERS[p][0][f]) for p, files in order.items() for k, f in enumerate(files)}
    one = manuscripts.read_sections(spark, str(shelf / "wind"))
    assert sorted(map(tuple, one.collect())) == sorted(("wind", f, k, PAPERS["wind"][0][f]) for k, f in enumerate(order["wind"]))


def test_all_projects_in_one_run(spark, shelf):
    plan(shelf, "tides", {"ops": [{"op": "move", "id": "a.md:1", "after": "b.md:1"}, {"op": "rename", "id": "a.md:3", "new": "Draw"}]})
    plan(shelf, "wind", {"ops": [{"op": "delete", "id": "none.md:1"}]})
    plan(shelf, "rain", {"chained": True, "numbering": "keep", "ops": [{"op": "move", "id": "only.md:5", "after": "only.md:7"}, {"op": "insert", "id": "new", "after": "only.md:5", "level": 3, "title": "Mist"}]})
    (shelf / "wind/frame/sections").mkdir()
    (shelf / "wind/frame/sections/a.md").write_text("old")
    assert workbench.run_all(spark, str(shelf), apply=True, strict=True) == 1
    held = lambda p, f: json.loads((shelf / p / "frame" / f).read_text())
    assert held("tides", "frame_inventory.json")["counts"] == {"h1": 3, "h2": 1, "h3": 0, "h4": 0, "h5": 0, "h6": 0}
    assert [h["title"] for h in held("wind", "frame_inventory.json")["headings"]] == ["Mills", "Sails", "Gears", "Wind: a start"]
    assert held("wind", "frame_inventory.json")["headings"][3]["subtree"] == {"display_eqs": 0, "figures": 0, "code_blocks": 1}
    assert [i["title"] for i in held("wind", "frame_lint.json")["items"] if i["rule"] == "title_colon"] == ["Wind: a start"]
    assert held("wind", "frame_problems.json")["problems"] == [{"op": 1, "problem": "unknown id none.md:1"}] and held("rain", "frame_problems.json")["problems"] == []
    out = lambda p, f: (shelf / p / "frame/sections" / f).read_bytes().decode()
    assert out("tides", "b.md") == "# 1 Tides\n\nSee 2.1 节.\n# 2 Moon\n\n## 2.1 Draw\n\nstrong\n" and out("tides", "a.md") == "" and out("tides", "z.md") == "# Notes\n"
    assert out("wind", "a.md") == "old" and not (shelf / "wind/frame/sections/b.md").exists()
    assert out("rain", "only.md") == "# 1 Rain\n\nwet\n\n## 1.2 Clouds\n## 1.1 Drops\n\n### Mist\n\n"


def test_one_project_reads_as_in_the_batch(spark, shelf):
    assert workbench.run_all(spark, str(shelf)) == 0
    batch = {p: [json.loads((shelf / p / "frame" / f).read_text()) for f in ("frame_inventory.json", "frame_lint.json")] for p in PAPERS}
    for p in PAPERS:
        assert workbench.run(spark, str(shelf / p)) == 0
        alone = [json.loads((shelf / p / "frame" / f).read_text()) for f in ("frame_inventory.json", "frame_lint.json")]
        assert alone[0]["headings"] == batch[p][0]["headings"] and alone[0]["counts"] == {k: v for k, v in batch[p][0]["counts"].items() if v}
        key = lambda i: json.dumps(i, sort_keys=True)
        assert sorted(alone[1]["items"], key=key) == sorted(batch[p][1]["items"], key=key)


def test_a_failed_write_leaves_the_old_output(spark, tmp_path):
    rows = [("one", "a.md", "new a"), ("one", "b.md", "new b\n"), ("two", "c.md", "new c")]
    frame = lambda more: spark.createDataFrame(rows + more, "project string, file string, text string").repartition(3)
    for p, f in (("one", "gone.md"), ("two", "c.md")):
        (tmp_path / p / "frame/sections").mkdir(parents=True)
        (tmp_path / p / "frame/sections" / f).write_text("old")
    state = lambda: {str(x.relative_to(tmp_path)): x.read_text() for x in tmp_path.rglob("*") if x.is_file() and ".crc" not in x.name}
    before = state()
    for broken in ([("two", "d.md", None)], [("one", "a.md", "twice")], [("two", "no/such/folder.md", "x")]):
        with pytest.raises(Exception):  # noqa: B017, PT011
            manuscripts.write_folders(frame(broken), str(tmp_path), "frame/sections")
        assert state() == before
        assert not [x for x in tmp_path.rglob(".sections-*")]
    manuscripts.write_folders(frame([]), f"file://{tmp_path}", "frame/sections")
    assert state() == {"one/frame/sections/a.md": "new a", "one/frame/sections/b.md": "new b\n", "two/frame/sections/c.md": "new c"}


def test_small_files_are_replaced_in_one_step(spark, tmp_path):
    path = tmp_path / "x.json"
    for text in ("first", "second é\n"):
        manuscripts.write_text(spark, str(path), text)
        assert path.read_text() == text
    assert [x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")] == ["x.json"]


BAD = {
    "unreadable plan": ['{"ops": [{"op": "rename"', '{"ops": 5}', "[1", '{"ops": [{"op": "insert", "level": "two"}]}', "no json"],
    "plan without ops": ["{}", '{"src": "x"}', '{"ops": null}'],
    "unknown numbering roman": ['{"numbering": "roman", "ops": []}'],
    "empty plan": ["", "  ", None],
}


def test_documents_that_are_no_plans(spark):
    rows = [(f"{said}|{k}", text) for said, texts in BAD.items() for k, text in enumerate(texts)] + [("good", '{"ops": []}'), ("full", '{"ops": [{"op": "delete", "id": "a:1", "more": 1}], "other": 2}')]
    plans = spark.createDataFrame(rows, "project string, value string")
    assert {r["project"]: r["problem"] for r in P.unreadable(plans).collect()} == {p: p.split("|")[0] for p, _ in rows if "|" in p}
    assert [(r["project"], r["op"], r["chained"]) for r in P.parse_plan(plans).collect()] == [("full", "delete", False)]


def test_an_unreadable_plan_is_refused(spark, shelf, capsys):
    plan(shelf, "wind", '{"ops": [{"op": "delete", ')
    assert workbench.run(spark, str(shelf / "wind"), apply=True, strict=True) == 1
    assert "NOT WRITTEN" in capsys.readouterr().out and not (shelf / "wind/frame/sections").exists()
    assert json.loads((shelf / "wind/frame/frame_apply.json").read_text())["problems"] == ["unreadable plan"]


def tree(levels):
    """A project with a heading a line, of these levels."""
    return "\n".join(f"{'#' * n} h{k}" for k, n in enumerate(levels, 1))


def plain_chain(levels, ops):
    """Titles in order and those deleted, by lists: the tree is built and each op done on it."""
    children, parent, stack = {0: []}, {}, [(0, 0)]
    for k, n in enumerate(levels, 1):
        while stack[-1][1] >= n:
            stack.pop()
        parent[k] = stack[-1][0]
        children[parent[k]].append(k)
        children[k] = []
        stack.append((k, n))
    behind, heads, gone, bad, names = {}, {}, set(), [], {}

    def dead(x):
        while x:
            if x in gone:
                return True
            x = parent[x]
        return False

    for seq, op in enumerate(ops):
        find = lambda name: names.get(name) if not name.startswith("x.md:") else int(name[5:])
        target = find(op["id"]) if op["op"] != "insert" else None
        anchor = find(op["after"]) if op["op"] != "delete" else None
        wrong = (op["op"] != "insert" and (target is None or target not in children or dead(target))) or (op["op"] != "delete" and (anchor is None or anchor not in children or dead(anchor)))
        up = anchor
        while not wrong and op["op"] == "move" and up:
            wrong, up = up == target, parent[up]
        if wrong:
            bad.append(seq)
            continue
        if op["op"] == "delete":
            gone.add(target)
        elif op["op"] == "insert":
            names[op["id"]] = new = f"n{seq}"
            children[new], parent[new] = [], anchor
            children[anchor].insert(heads.get(anchor, 0), new)
            heads[anchor] = heads.get(anchor, 0) + 1
            behind[new] = []
        else:
            if target in children[parent[target]][: heads.get(parent[target], 0)]:
                heads[parent[target]] -= 1
            children[parent[target]].remove(target)
            parent[target] = parent[anchor]
            own = children[parent[anchor]]
            at = own.index(anchor) + 1
            # after all that an op has put behind the anchor and behind that in turn, where it still stands there
            chain = lambda x: {x}.union(*[chain(y) for y in behind.get(x, [])])  # noqa: E731, B023
            while at < len(own) and own[at] in chain(anchor):
                at += 1
            if anchor in own[: heads.get(parent[anchor], 0)]:
                heads[parent[anchor]] += 1
            own.insert(at, target)
            for others in behind.values():
                if target in others:
                    others.remove(target)
            behind[target] = []
            behind.setdefault(anchor, []).append(target)

    def walk(x):
        return [y for c in children[x] for y in ([c, *walk(c)] if c not in gone else [])]

    return walk(0), bad


@pytest.mark.parametrize("seed", range(4))
def test_chains_against_lists(seed):
    """Random chains, folded by keys and by lists; sections that were put behind one that has left go with neither."""
    rng = random.Random(seed)
    for _ in range(200):
        levels = [1] + [rng.randint(1, 3) for _ in range(9)]
        names, ops, used = [f"x.md:{k}" for k in range(1, 11)], [], set()
        for seq in range(rng.randint(1, 7)):
            kind = rng.choice(["move", "move", "insert", "delete"])
            op = {"op": kind, "id": rng.choice(names), "after": rng.choice(names)}
            if kind == "insert":
                op["id"] = f"new{seq}"
                names.append(op["id"])
            elif kind == "move":
                if op["id"] in used:
                    continue  # a section that moves twice leaves what was put behind it
                used.add(op["id"])
            ops.append(op)
        if any(o["op"] == "move" and any(p["op"] == "move" and p["after"] == o["id"] for p in ops[:k]) for k, o in enumerate(ops)):
            continue
        paths, stack = {}, []
        for k, n in enumerate(levels, 1):
            stack = [x for x in stack if levels[x - 1] < n] + [k]
            paths[f"x.md:{k}"] = list(stack)
        rows = [{"seq": s, **o, "t_path": paths.get(o["id"]), "a_path": paths.get(o["after"]), "t_file": "x.md", "t_file_ord": 0, "a_file": "x.md", "a_file_ord": 0} for s, o in enumerate(ops)]
        found = chained._fold(rows)
        put = {r["ord"]: r for r in found if r["kind"] == "moved"}
        keys = {f"n{r['seq']}": tuple(r["key"]) for r in found if r["kind"] == "inserted" and not r["gone"]}
        removed = {int(o["id"][5:]) for s, o in enumerate(ops) if o["op"] == "delete" and o["id"].startswith("x.md:") and s not in {r["seq"] for r in found if r["kind"] == "problem"}}
        for k, path in ((k, paths[f"x.md:{k}"]) for k in range(1, 11)):
            at = max((x for x in path if x in put), default=0)
            below = [x for x in path if x > at]
            if not (put[at]["gone"] if at else False) and not removed & {x for x in path if x >= at}:
                keys[k] = tuple([*put[at]["key"], *(y for x in below for y in (0, x))] if at else [y for x in below for y in (0, x)][1:])
        want, bad = plain_chain(levels, ops)
        assert {r["seq"] for r in found if r["kind"] == "problem"} == set(bad), ops
        assert sorted(keys, key=keys.get) == want, (levels, ops)


def test_chains_through_spark(spark):
    text = tree([1, 2, 3, 2, 1, 2])
    sections = spark.createDataFrame([("p", "x.md", 0, text), ("q", "x.md", 0, text)], "project string, file string, file_ord int, text string")
    _, headings = I.inventory(sections)
    ops = [
        {"op": "move", "id": "x.md:3", "after": "x.md:6"},
        {"op": "insert", "id": "mine", "after": "x.md:3", "level": 3, "title": "new"},
        {"op": "move", "id": "x.md:4", "after": "mine"},
        {"op": "insert", "after": "+2", "level": 4, "title": "unnamed is +4"},
        {"op": "insert", "after": "mine", "level": 4, "title": "second"},
        {"op": "delete", "id": "x.md:2"},
    ]
    plans = spark.createDataFrame([("p", json.dumps({"chained": True, "ops": ops}))], "project string, value string")
    read = P.parse_plan(plans)
    assert [(r["seq"], r["problem"]) for r in P.problems(read, headings, True).collect()] == [(3, "unknown id +2")]
    outline = P.new_outline(headings, read.filter("seq <> 3"), chained=True)
    got = [(r["new_title"], r["state"]) for r in outline.filter("project = 'p'").orderBy("pos").collect()]
    assert got == [("h1", "kept"), ("h2", "deleted"), ("h5", "kept"), ("h6", "kept"), ("h3", "kept"), ("new", "inserted"), ("second", "inserted"), ("h4", "kept")]
    assert [r["new_title"] for r in outline.filter("project = 'q'").orderBy("pos").collect()] == [f"h{k}" for k in range(1, 7)]


def test_term_bank_of_a_run(spark, shelf, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "term_map.json").write_text(json.dumps([{"informal": "Wind", "standard": "Air"}, {"informal": "Mill", "standard": "Works"}, {"informal": "Sail", "standard": "Blade"}, {"informal": "ails", "standard": "x"}]))
    for bank in (["Mills", "Gears"], [{"term": "Mills"}, {"term": " Gears "}]):
        (pages / "term_bank.json").write_text(json.dumps(bank))
        assert workbench.run(spark, str(shelf / "wind"), references=str(pages)) == 0
        items = json.loads((shelf / "wind/frame/frame_lint.json").read_text())["items"]
        assert sorted((i["title"], i["suggestion"]) for i in items if i["rule"] == "term_informal") == [("Sails", "Blade"), ("Wind: a start", "Air")]


def test_segments_against_a_walk(spark):
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("ab水") for _ in range(rng.randint(1, 4))) for _ in range(14)})
    dictionary = {t: (f"better {t}" if k % 2 else None) for k, t in enumerate(terms)}
    titles = [("p", str(k), "".join(rng.choice("ab水c") for _ in range(rng.randint(0, 25)))) for k in range(300)]
    own = [("p", "cab"), ("other", "c")]
    want = set()
    for p, i, title in titles:
        at = 0
        while at < len(title):
            term = max((t for t in [*terms, "cab"] if title.startswith(t, at)), key=len, default=None)
            if term:
                want.add((p, i, title, at + 1, term, None if term == "cab" else dictionary[term]))
            at += len(term or "x")
    frame = spark.createDataFrame(titles, "project string, id string, title string")
    words = spark.createDataFrame(list(dictionary.items()), "term string, standard string")
    got = L.segments(frame, words, spark.createDataFrame(own, "project string, term string"))
    assert {tuple(r) for r in got.collect()} == want
    assert L.segments(frame, words.limit(0)).count() == 0


def test_damaged_and_encrypted_documents(spark, tmp_path):
    for name, content in {"good.pdf": "1|Start", "bare.pdf": "", "torn.pdf": "torn", "locked.pdf": "locked"}.items():
        (tmp_path / name).write_text(content)

    def toc(content):
        text = content.decode()
        if text == "locked":
            raise PermissionError("needs a password")
        return [(int(line.split("|")[0]), line.split("|")[1]) for line in text.split("\n") if line]

    rows = {r["file"]: (r["level"], r["title"], r["error"]) for r in manuscripts.read_pdfs(spark, str(tmp_path), toc).collect()}
    assert rows["good.pdf"] == (1, "Start", None) and rows["locked.pdf"] == (None, None, "PermissionError: needs a password")
    assert rows["torn.pdf"][2].startswith("ValueError") and "bare.pdf" not in rows
    assert [tuple(r) for r in manuscripts.read_pdf_outlines(spark, str(tmp_path), toc).collect()] == [("good.pdf", 1, "Start")]


def test_scans_against_loops(spark):
    rng = random.Random(9)
    rows = [(p, k // 7 if p else None, k, rng.choice([None, rng.randint(0, 50)])) for p in ("a", "b", None) for k in range(60)]
    df = spark.createDataFrame(rows, "p string, b int, k int, v int").repartition(3)
    got = scan(df, ["p"], ["b"], ["k"], Running(sums={"s": F.col("v")}, lasts={"l": F.col("v")}, nexts={"n": F.col("v")}))
    want = set()
    for p, b, k, v in rows:
        upto, after = ([x[3] for x in rows if x[0] == p and t(x[2]) and x[3] is not None] for t in (lambda x, k=k: x <= k, lambda x, k=k: x > k))
        want.add((p, b, k, v, sum(upto), upto[-1] if upto else None, min(after, default=None)))
    assert {tuple(r) for r in got.collect()} == want


def test_drift_counts_every_line(spark):
    rng = random.Random(4)
    made = lambda: [("p" if rng.random() < 0.5 else "q", rng.choice(["x", "y", " ", "zz", "w" * 9]), rng.random() < 0.2) for _ in range(300)]
    one, two = made(), made()
    frame = lambda rows: spark.createDataFrame(rows, "project string, line string, is_head boolean").repartition(3)
    body = lambda rows: sorted((p, x) for p, x, h in rows if not h and x.strip())
    want = []
    for side, a, b in (("lost", body(one), body(two)), ("new", body(two), body(one))):
        for row in a:
            if row in b:
                b.remove(row)
            else:
                want.append((row[0], side, row[1]))
    assert sorted(map(tuple, A.drift(frame(one), frame(two)).collect())) == sorted(want)
    assert A.drift(frame(one), frame(one)).count() == 0


def plain_code(text):
    """(code, opens) of each line, walked from the top."""
    mark, out = "", []
    for line in text.split("\n"):
        found = re.match(r" {0,3}(`{3,}|~{3,})", line)
        fence = found[1] if found else ""
        opens = bool(fence and not mark)
        out.append((bool(mark or fence), opens))
        if opens:
            mark = fence
        elif fence and fence.startswith(mark) and not line[found.end() :].strip(" \t\r"):
            mark = ""
    return out


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_fences_in_a_file_that_is_cut(spark, bits, monkeypatch):
    """Files cut into stretches of one line, of four, and not at all: fences of both marks and many lengths."""
    monkeypatch.setattr(I, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    parts = ["```", "````", "`````", "~~~", "~~~~", "~~~~~~", "``` python", "  ```", "    ```", "text", "# title", "", "``", "~~~ x", "```\r"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = [(f"p{k % 3}", f"{k}.md", k if k % 5 else None, t) for k, t in enumerate(texts)]
    marked = I.mark_code(I.split_lines(spark.createDataFrame(rows, "project string, file string, file_ord int, text string")))
    got = {}
    for r in marked.collect():
        got.setdefault(r["file"], {})[r["line_no"]] = (r["code"], r["opens"])
    for k, t in enumerate(texts):
        assert [got[f"{k}.md"][n] for n in sorted(got[f"{k}.md"])] == plain_code(t), t
