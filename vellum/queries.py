"""The outline engine over the test tables, each query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions.roles import role_of
from vellum.operators import apply as A
from vellum.operators import corpus as C
from vellum.operators import inventory as I
from vellum.operators import lint as L
from vellum.plans import outline as P
from vellum.plans.settle import settle
from vellum.schemas import OP_KINDS
from vellum.sources import adapters as S

#: Terms for the invented English of the test tables.
TERMS = [("the", "THE"), ("ing", "-ing"), ("th", "th.")]
#: Words that are fine, some with terms in them; ``OWN`` by project.
BANK = [("thing",), ("inge",), ("erth",), ("heth",)]
OWN = [("pages", "anth"), ("other", "the")]
#: Old and new numbers; the last two stand in code or as a literal only.
NUMBERS = [("1.1", "3.2.1"), ("2.2", "1.1"), ("2", "5"), ("9.9", "8.8"), ("12.3", "0")]
#: Roles for it: by the letters a title begins with.
RULES = [("alpha", 1, "^[A-H]", False), ("omega", 1, "^[S-Z]", True), ("sub_alpha", 2, "^[A-D]", False), ("sub_mid", 2, "^[I-R]", False)]


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    marked = settle(I.mark_code(S.catalog_lines(spark, sf_dir)))
    return marked, I.find_headings(marked, RULES)


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of the catalog where its other lines are not needed."""
    return I.find_headings(I.mark_code(S.catalog_lines(spark, sf_dir, keep=False), I.may_head()), RULES)


def _with_ops(headings: DataFrame, kinds: tuple[str, ...] = OP_KINDS) -> tuple[DataFrame, DataFrame]:
    headings = settle(I.with_extent(headings))
    return headings, settle(S.catalog_ops(headings).filter(F.col("op").isin(*kinds)))


def _outline(headings: DataFrame, kinds: tuple[str, ...] = OP_KINDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    headings, ops = _with_ops(headings, kinds)
    return headings, ops, P.new_outline(headings, ops)


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    marked, headings = _catalog(spark, sf_dir)
    return marked, *_outline(headings)


def inv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.split_lines(S.document_sections(spark, sf_dir)).select("project", "file", F.col("line_no").cast("long").alias("line_no"), "line")


def inv_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_sections(spark, sf_dir).select("project", "file", F.sha2("text", 256).alias("sha"))


def inv_code_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = I.mark_code(S.catalog_lines(spark, sf_dir))
    return marked.groupBy("project", "file").agg(F.count("*").alias("n_lines"), F.sum(F.col("code").cast("long")).alias("n_code"), F.sum(F.col("opens").cast("long")).alias("n_blocks"))


def inv_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = _headings(spark, sf_dir)
    return headings.select("project", "id", F.col("ord").cast("long").alias("ord"), F.col("level").cast("long").alias("level"), "title", "num", "num_style", "role")


def inv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.count_levels(_headings(spark, sf_dir)).select("project", F.col("level").cast("long").alias("level"), "n")


def inv_own_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, headings = _catalog(spark, sf_dir)
    return I.own_body(marked, headings).select("project", "file", F.col("line_no").cast("long").alias("line_no"), "display_eqs", "figures", "code_blocks")


def inv_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, headings = _catalog(spark, sf_dir)
    tree = I.subtree(headings, I.own_body(marked, headings))
    return tree.select("project", "id", F.col("subtree_end").cast("long").alias("subtree_end"), "total_display_eqs", "total_figures", "total_code_blocks")


def inv_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = S.page_titles(spark, sf_dir)
    return titles.select("id", "title", F.col("level").cast("long").alias("level"), role_of(F.col("title"), F.col("level"), RULES).alias("role"))


def inv_num_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.find_headings(I.mark_code(I.split_lines(S.page_sections(spark, sf_dir))))
    return found.select("project", "id", F.col("level").cast("long").alias("level"), "title", "num", "num_style")


def lint_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.term_informal(S.page_titles(spark, sf_dir), spark.createDataFrame(TERMS, "informal string, standard string"))
    return found.select("rule", "id", "title", "suggestion")


def lint_term_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("pages", "th")], "project string, term string")
    found = L.term_informal(S.page_titles(spark, sf_dir), spark.createDataFrame(TERMS, "informal string, standard string"), allowed)
    return found.select("rule", "id", "title", "suggestion")


def lint_term_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles segmented by informal terms, a bank and the project's own words: "th" and "the" no longer both report."""
    informal = spark.createDataFrame(TERMS, "informal string, standard string")
    bank, own = spark.createDataFrame(BANK, "term string"), spark.createDataFrame(OWN, "project string, term string")
    return L.term_segments(S.page_titles(spark, sf_dir), informal, bank, own).select("rule", "id", "title", "suggestion")


def lint_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part that is cut off a title, with its place."""
    dictionary = spark.createDataFrame([*TERMS, *[(t, None) for (t,) in BANK]], "term string, standard string")
    return L.segments(S.page_titles(spark, sf_dir), dictionary).select("id", F.col("at").cast("long").alias("at"), "term", "standard")


def lint_colon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id").cast("long")
    title = F.when(k % 3 == 0, F.concat("title", F.lit(": part"))).when(k % 5 == 1, F.concat("title", F.lit("：part"))).otherwise(F.col("title"))
    return L.title_colon(S.page_titles(spark, sf_dir).withColumn("title", title)).select("project", "rule", "id", "title")


def lint_length_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.document_sections(spark, sf_dir).filter("text is not null")
    titles = docs.select("project", F.col("file").alias("id"), (F.col("file_ord") % 3 + 1).cast("int").alias("level"), F.substring_index("text", " ", 3).alias("title"))
    return L.title_length(titles, C.thresholds(titles)).select("rule", "id", "title", "msg")


def lint_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.find_references(I.mark_code(S.order_notes(spark, sf_dir)))
    return found.select("project", "file", F.col("line_no").cast("long").alias("line_no"), "ref", "num", "kind")


def lint_chapter_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = _chapters(spark, sf_dir)
    usual = [r["pattern"] for r in C.chapter_patterns(chapters, 3).collect()]
    found = L.chapter_pattern(chapters.withColumn("project", F.lit("customers")), usual)
    return found.select("rule", "id", "title")


def lint_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.title_length(S.page_titles(spark, sf_dir)).select("rule", "id", "title", "msg")


def lint_role_unclear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.role_unclear(_headings(spark, sf_dir)).select("project", "rule", "id", "title")


def lint_xref_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, headings = _catalog(spark, sf_dir)
    return L.xref_missing(L.find_references(marked), headings).select("project", "rule", "msg")


def lint_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.skeleton_missing(_headings(spark, sf_dir), ["alpha", "omega", "references"]).select("project", "rule", "msg")


def lint_role_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = S.page_titles(spark, sf_dir).withColumn("role", role_of(F.col("title"), F.col("level"), RULES))
    return L.role_wording(titles, C.role_forms(titles, 3)).select("id", "title", "msg", "suggestion")


def plan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = P.parse_plan(S.order_plans(spark, sf_dir))
    return ops.select("project", "src", "numbering", F.col("seq").cast("long").alias("seq"), "op", "id", "after", F.col("level").cast("long").alias("level"), "title", "new")


def _broken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ops with mistakes, and what is found."""
    headings = _headings(spark, sf_dir)
    headings = settle(I.with_extent(headings))
    ops = settle(S.bad_ops(S.catalog_ops(headings)))
    return ops, P.problems(ops, headings)


def plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir)[1].select("project", F.col("seq").cast("long").alias("seq"), "problem")


def plan_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings, ops = _with_ops(_headings(spark, sf_dir))
    plans = [("valid", ops, P.problems(ops, headings)), ("broken", *_broken(spark, sf_dir))]
    parts = []
    for name, own, found in plans:
        counts = own.groupBy("project").agg(F.count("*").alias("n_ops")).join(found.groupBy("project").agg(F.count("*").alias("n")), "project", "left")
        parts.append(counts.select("project", F.lit(name).alias("plan"), "n_ops", F.coalesce("n", F.lit(0)).alias("n_problems"), F.col("n").isNull().alias("valid")))
    return parts[0].unionByName(parts[1])


def plan_outline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings, _, outline = _outline(_headings(spark, sf_dir))
    diff = P.outline_diff(headings, outline)
    return diff.select("project", F.col("ord").cast("long").alias("ord"), F.col("pos").cast("long").alias("pos"), "before", "after", "mark")


def _applied(kinds: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        outline = _outline(_headings(spark, sf_dir), kinds)[2]
        return outline.select("project", "id", "state", F.col("pos").cast("long").alias("pos"), F.col("new_level").cast("long").alias("new_level"), "new_title", "new_num", "out_file")

    return query


def apply_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings, ops = _with_ops(_headings(spark, sf_dir))
    outline = P.new_outline(headings, ops, "keep")
    return outline.select("project", "id", "state", F.col("pos").cast("long").alias("pos"), F.col("new_level").cast("long").alias("new_level"), "new_title", "new_num", "out_file")


def apply_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = _headings(spark, sf_dir)
    headings = settle(I.with_extent(headings))
    outline = P.new_outline(headings, settle(S.chained_ops(headings)), chained=True)
    return outline.select("project", "id", "state", F.col("pos").cast("long").alias("pos"), F.col("new_level").cast("long").alias("new_level"), "new_title", "new_num", "out_file", "moved")


def plan_chained_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain in which every fifth op names something unknown; what was to hang on an insertion that failed is unknown too."""
    headings = _headings(spark, sf_dir)
    headings = settle(I.with_extent(headings))
    ops = settle(S.chained_ops(headings).withColumn("after", F.when(F.col("after").isNotNull() & (F.col("seq") % 5 == 2), F.lit("none.md:1")).otherwise(F.col("after"))))
    return P.problems(ops, headings, chained=True).select("project", F.col("seq").cast("long").alias("seq"), "problem")


def plan_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = S.damaged_plans(spark, sf_dir)
    ops = P.parse_plan(plans).groupBy("project").agg(F.count("*").alias("n_ops"))
    found = plans.select("project").join(P.unreadable(plans).select("project", "problem"), "project", "left").join(ops, "project", "left")
    return found.select("project", "problem", F.coalesce("n_ops", F.lit(0)).alias("n_ops"))


def apply_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = S.order_notes(spark, sf_dir)
    numbers = notes.select("project").distinct().crossJoin(F.broadcast(spark.createDataFrame(NUMBERS, "num string, target string")))  # a project has five numbers
    lines = A.renumbered(I.mark_code(notes), numbers, notes, ~F.col("code"))
    return lines.select("project", "file", F.col("line_no").cast("long").alias("line_no"), F.coalesce("rewritten", "line").alias("line"))


def apply_number_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.number_map(_outline(_headings(spark, sf_dir))[2])


def apply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, headings, _, outline = _planned(spark, sf_dir)
    lines = A.rewrite(marked, headings, settle(outline))
    return lines.select("project", "file", F.col("pos").cast("long").alias("pos"), F.col("k").cast("long").alias("k"), "line")


def apply_ref_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, headings, _, outline = _planned(spark, sf_dir)
    log = A.reference_log(A.rewrite(marked, headings, settle(outline)))
    return log.select("project", "file", F.col("src_line").cast("long").alias("src_line"), "old", "new")


def apply_deleted_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, headings, _, outline = _planned(spark, sf_dir)
    warn = A.deleted_warnings(marked, headings, settle(outline))
    return warn.select("project", "file", F.col("line_no").cast("long").alias("line_no"), "ref", "warn")


def _rebuilt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rewritten lines, and the lines of the new files as read again."""
    marked, headings, _, outline = _planned(spark, sf_dir)
    lines = settle(A.rewrite(marked, headings, settle(outline)))
    again = I.mark_code(settle(A.output_lines(lines, marked)))
    return marked, lines, settle(again.withColumn("is_head", ~F.col("code") & F.col("line").rlike(X.HEADING)))


def verify_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end in a 7 are spoilt in the output: each is lost once and new once, as often as it stands there."""
    _, lines, again = _rebuilt(spark, sf_dir)
    spoilt = F.when(~F.col("is_head") & F.col("line").endswith("7 节"), F.concat("line", F.lit(" drift"))).otherwise(F.col("line"))
    return A.drift(lines, again.withColumn("line", spoilt)).groupBy("project", "side", "line").agg(F.count("*").alias("n"))


def verify_no_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body lines of both sides, and how many of them differ."""
    _, lines, again = _rebuilt(spark, sf_dir)
    bad = A.drift(lines, again).groupBy("project").agg(F.count("*").alias("bad"))
    body = lines.filter("not is_head and trim(line) <> ''").groupBy("project").agg(F.count("*").alias("n_lines"))
    return body.join(bad, "project", "left").select("project", "n_lines", F.coalesce("bad", F.lit(0)).alias("n_drift"))


def verify_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, _, again = _rebuilt(spark, sf_dir)
    return A.asset_changes(A.assets(marked), A.assets(again)).select("project", "kind", "name", "n_before", "n_after")


def verify_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = inv_digest(spark, sf_dir)
    touched = S.document_sections(spark, sf_dir).withColumn("text", F.when(F.col("file_ord") % 10 == 3, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    return A.source_changes(before, touched.select("project", "file", F.sha2("text", 256).alias("sha")))


def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings, _, outline = _outline(_headings(spark, sf_dir))
    return P.outline_diff(headings, outline).filter("mark is not null").groupBy("project", "mark").agg(F.count("*").alias("n"))


def norms_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.thresholds(S.page_titles(spark, sf_dir)).select(F.col("level").cast("long").alias("level"), "n", "max_title")


def norms_role_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = S.page_titles(spark, sf_dir).withColumn("role", role_of(F.col("title"), F.col("level"), RULES))
    return C.role_forms(titles, 3).select("role", "title", "n", F.col("rank").cast("long").alias("rank"))


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = S.table(spark, sf_dir, "customer")
    title = F.concat(F.lit("问题"), (F.col("c_custkey") % 40).cast("string"), F.lit(" "), "c_mktsegment")
    return customers.select(F.col("c_custkey").cast("string").alias("id"), title.alias("title"), F.lit("problem_chapter").alias("role"))


def norms_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chapter_patterns(_chapters(spark, sf_dir), 5)


_PLAIN = (
    inv_lines, inv_digest, inv_code_mask, inv_headings, inv_counts, inv_own_body, inv_subtree, inv_roles, lint_term, lint_term_allowed, lint_term_longest, lint_segments, lint_colon, lint_length,
    inv_num_style, lint_length_norms, lint_references, lint_chapter_pattern, plan_parse, apply_keep, apply_chained, plan_chained_problems, plan_unreadable, apply_references, verify_no_drift,
    lint_role_unclear, lint_xref_missing, lint_skeleton, lint_role_wording, plan_problems, plan_valid, plan_outline_diff, apply_number_map, apply_lines, apply_ref_log,
    apply_deleted_warn, verify_drift, verify_assets, verify_source, report_changes, norms_thresholds, norms_role_forms, norms_patterns,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to function; the flagship, subtree totals of the catalog, comes first."""
    plain = {f.__name__: f for f in (inv_subtree, *_PLAIN)}
    return plain | {f"apply_{k}": _applied((k,)) for k in OP_KINDS} | {"apply_renumber": _applied(OP_KINDS)}


_ROLE = """case when level = 1 and regexp_matches(title, '^[A-H]') then 'alpha' when level = 1 and regexp_matches(title, '^[S-Z]') then 'omega'
  when level = 2 and regexp_matches(title, '^[A-D]') then 'sub_alpha' when level = 2 and regexp_matches(title, '^[I-R]') then 'sub_mid'
  when regexp_matches(title, '^[A-H]') then 'alpha' end"""

_LINES = """nat as (select r_name project, n_nationkey, n_name, row_number() over (partition by r_regionkey order by n_nationkey) h1 from nation join region on n_regionkey = r_regionkey),
cus as (select *, dense_rank() over (partition by c_nationkey order by c_mktsegment) h2, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) h3 from customer),
ord0 as (select o_orderkey, o_custkey, 'order ' || o_orderkey || ', see ' || (o_orderkey % 6 + 1) || '.' || (o_custkey % 7 + 1) || ' 节' t, o_orderstatus st from orders),
ord1 as (select *, case when st = 'F' then [t, '$$ x = ' || o_orderkey || ' $$'] when st = 'P' then [t, '```', '# 9 not a heading', '```'] when o_orderkey % 5 = 0 then [t, '![f](a.png){#fig:o' || o_orderkey || '}'] else [t] end l from ord0),
body as (select o_orderkey, o_custkey, unnest(l) line, generate_subscripts(l, 1) part from ord1),
raw as (select n_nationkey k, 0 s, 0 c, -1 o, 0 part, '# ' || h1 || ' ' || n_name line from nat
  union all select distinct n_nationkey, h2, 0, -1, 0, '## ' || h1 || '.' || h2 || ' ' || c_mktsegment from cus join nat on c_nationkey = n_nationkey
  union all select n_nationkey, h2, h3, -1, 0, '### ' || h1 || '.' || h2 || '.' || h3 || ' ' || c_name from cus join nat on c_nationkey = n_nationkey
  union all select c_nationkey, h2, h3, o_orderkey, part, line from body join cus on o_custkey = c_custkey),
lines as (select project, printf('%02d.md', k) file, k file_ord, row_number() over (partition by k order by s, c, o, part) line_no, line from raw join nat on k = n_nationkey),
marked0 as (select *, starts_with(line, '```') fence, sum(case when starts_with(line, '```') then 1 else 0 end) over (partition by project, file order by line_no) nf from lines),
marked as (select project, file, file_ord, line_no, line, fence or nf % 2 = 1 code, fence and nf % 2 = 1 opens from marked0),
heads0 as (select project, file, file_ord, line_no, length(regexp_extract(line, '^(#+)', 1)) as level, regexp_extract(line, '^#+ ([0-9.]+) (.*)$', 2) title, regexp_extract(line, '^#+ ([0-9.]+) ', 1) num
  from marked where not code and regexp_matches(line, '^#{1,6}[ \\t]+[^ \\t]')),
heads1 as (select *, file || ':' || line_no id, row_number() over (partition by project order by file_ord, line_no) ord from heads0),
heads as (select *, coalesce((select min(b.ord) from heads1 b where b.project = a.project and b.ord > a.ord and b.level <= a.level), (select count(*) + 1 from heads1 b where b.project = a.project)) subtree_end from heads1 a)"""

_OWN = """owned as (select m.*, h.ord is not null is_head, last_value(h.ord ignore nulls) over (partition by m.project, m.file order by m.line_no rows unbounded preceding) own from marked m left join heads h using (project, file, line_no)),
own as (select project, file, own ord, sum(case when not code and not is_head and contains(line, '$$') then 1 else 0 end)::bigint display_eqs,
  sum(case when not code and contains(line, '![f](') then 1 else 0 end)::bigint figures, sum(case when opens then 1 else 0 end)::bigint code_blocks from owned where own is not null group by all)"""


_NUMBERING = """outl2 as (select *, sum(case when live and new_level < 2 then 1 else 0 end) over w g2, sum(case when live and new_level < 3 then 1 else 0 end) over w g3 from outl1 window w as (partition by project order by pos)),
outl3 as (select *, sum(case when live and new_level = 1 then 1 else 0 end) over (partition by project order by pos) c1, sum(case when live and new_level = 2 then 1 else 0 end) over (partition by project, g2 order by pos) c2,
  sum(case when live and new_level = 3 then 1 else 0 end) over (partition by project, g3 order by pos) c3 from outl2),
outl4 as (select *, case when live then case new_level when 1 then c1::varchar when 2 then c1 || '.' || c2 else c1 || '.' || c2 || '.' || c3 end end new_num from outl3),
"""


_CHAINED = f"""{_LINES},
ways as (select *, last_value(case when level = 1 then ord end ignore nulls) over w q, last_value(case when level = 2 then ord end ignore nulls) over w p2 from heads window w as (partition by project order by ord rows unbounded preceding)),
ends as (select project, min(case when level = 3 then ord end) f3, list_sort(list(ord) filter (level = 2))[1] o1, list_sort(list(ord) filter (level = 2))[2] o2 from heads group by project),
picked as (select project, ord, id, row_number() over (partition by project order by ord) - 1 r from heads join ends using (project) where level = 3 and ord % 23 = 5 and ord <> f3),
many as (select project, count(*) n from picked group by project),
target as (select e.project, f3, o1, [w.q, 0, e.o2, n + 1] k, w.file file2 from ends e join many using (project) join ways w on w.project = e.project and w.ord = e.o2),
chain(project, r, k) as (select project, 0, list_concat(k, [0, f3, 1]) from target union all select c.project, c.r + 1, list_concat(c.k, case when (c.r + 1) % 3 = 1 then [0, 0, c.r + 2] else [c.r + 2] end) from chain c join many using (project) where c.r + 1 < n),
outl0 as (select w.project, id, ord, num, title, case when ord = f3 then 'deleted' else 'kept' end state, level new_level, title new_title,
    case when c.k is not null then c.k when ord = o1 then t.k when level = 3 and p2 = o1 then list_concat(t.k, [0, ord]) when level = 1 then [ord] when level = 2 then [q, 0, ord] else [q, 0, p2, 0, ord] end k,
    case when c.k is not null or ord = o1 or (level = 3 and p2 = o1) then file2 else file end out_file, coalesce(c.k is not null or ord = o1 or (level = 3 and p2 = o1), false) moved
  from ways w left join target t using (project) left join (select project, id, k from chain join picked using (project, r) where r % 3 <> 1) c using (project, id)
  union all select project, null, null, null, null, 'inserted', 3, 'Chained', c.k, file2, false from chain c join target using (project) where r % 3 = 1),
outl1 as (select *, row_number() over (partition by project order by k) pos, state in ('kept', 'inserted') live from outl0),
{_NUMBERING.rstrip().rstrip(",")}"""


def _plan_sql(kinds: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"""{_LINES},
p0 as (select *, last_value(case when level = 2 then ord end ignore nulls) over (partition by project order by ord rows unbounded preceding) p2, first_value(id) over (partition by project order by ord) first from heads),
p1 as (select *, case when level = 1 then 'insert' when level = 2 and ord % 9 = 2 then 'delete' when level = 2 and ord % 7 = 3 then 'rename'
  when level = 3 and p2 % 9 <> 2 then case when ord % 17 = 6 then 'delete' when ord % 19 = 7 then 'move' when ord % 13 = 4 then 'relevel' when ord % 11 = 5 then 'merge_up' end end op from p0),
allops as (select *, row_number() over (partition by project order by ord) - 1 seq from p1 where op is not null),
ops as (select * from allops where op in ({listed})),
tail as (select project, subtree_end - 1 last1, file file1 from heads where ord = 1),
old as (select h.project, h.id, h.ord, h.num, h.title,
    case when exists (select 1 from ops d where d.op = 'delete' and d.project = h.project and h.ord >= d.ord and h.ord < d.subtree_end) then 'deleted' when o.op = 'merge_up' then 'merged' else 'kept' end state,
    case when o.op = 'relevel' then 2 else h.level end new_level, case when o.op = 'rename' then 'Renamed ' || h.title else h.title end new_title,
    case when o.op = 'move' then last1 else h.ord end k1, case when o.op = 'move' then seq + 1 else 0 end k2, h.ord k3, case when o.op = 'move' then file1 else h.file end out_file, o.op is not distinct from 'move' moved
  from heads h left join ops o on o.project = h.project and o.ord = h.ord join tail t on t.project = h.project),
outl0 as (select * from old union all select project, null, null, null, null, 'inserted', 2, 'Inserted', ord, seq + 1, 0, file, false from ops where op = 'insert'),
outl1 as (select *, row_number() over (partition by project order by k1, k2, k3) pos, state in ('kept', 'inserted') live from outl0),
{_NUMBERING}outl as (select *, case state when 'kept' then new_num when 'merged' then last_value(new_num ignore nulls) over (partition by project order by pos rows unbounded preceding) end target_num from outl4),
nums as (select project, num, min_by(target_num, ord) target from outl where num is not null and target_num is not null group by all),
diff as (select coalesce(h.project, o.project) project, h.ord ord, o.pos pos, case when h.ord is not null then repeat('#', h.level) || ' ' || h.num || ' ' || h.title end before,
    case when o.state in ('kept', 'inserted') then repeat('#', o.new_level) || ' ' || o.new_num || ' ' || o.new_title end after_, o.state, o.moved from outl o left join heads h on h.project = o.project and h.id = o.id),
diffed as (select project, ord, pos, before, after_, case when state = 'deleted' then '← 删除' when state = 'inserted' then '← 新增' when state = 'merged' then '← 并入上节' when moved then '← 移动' when before is distinct from after_ then '← 修改' end mark from diff),
owned as (select m.*, h.ord is not null is_head, last_value(h.ord ignore nulls) over (partition by m.project, m.file order by m.line_no rows unbounded preceding) own from marked m left join heads h using (project, file, line_no)),
moved0 as (select w.project, w.file src_file, w.line_no src_line, w.line old, w.code, w.is_head, o.* exclude (project) from owned w join outl o on o.project = w.project and o.ord = w.own where o.state <> 'deleted' and not (w.is_head and o.state = 'merged')),
moved as (select m.*, case when is_head then repeat('#', new_level) || ' ' || new_num || ' ' || new_title when code or n.target is null then old
  else regexp_replace(old, '[0-9]+\\.[0-9]+ 节', n.target || ' 节') end line from moved0 m left join nums n on n.project = m.project and not m.code and not m.is_head and n.num = regexp_extract(m.old, '([0-9]+\\.[0-9]+) 节', 1))"""


_BROKEN = """b as (select project, seq, case when seq % 7 = 6 then 'shuffle' else op end op, case when op <> 'insert' then case when seq % 5 = 1 then 'none.md:999' else id end end id,
  case when op = 'insert' then id when op = 'move' then first end after_, case when op in ('insert', 'relevel') then case when seq % 4 = 0 then 0 else 2 end end lvl, case when op = 'rename' then case when seq % 3 = 0 then ' ' else 'x' end end new from ops),
res as (select b.*, t.ord tord, t.subtree_end tend, a.ord aord from b left join heads t on t.project = b.project and t.id = b.id left join heads a on a.project = b.project and a.id = b.after_),
pts as (select project, seq, op, tord spot, false anchor from res where tord is not null union all select project, seq, op, aord, true from res where aord is not null),
found as (select project, seq, 'unknown op shuffle' as problem from b where op = 'shuffle'
  union select project, seq, 'unknown id none.md:999' from b where op <> 'shuffle' and id = 'none.md:999'
  union select project, seq, 'illegal level 0' from b where op in ('relevel', 'insert') and lvl = 0
  union select project, seq, 'rename without a title' from b where op = 'rename' and new = ' '
  union select project, seq, 'move into its own section' from res where op = 'move' and aord >= tord and aord < tend
  union select p.project, p.seq, 'depends on op ' || (o.seq + 1) from pts p join res o on o.project = p.project and o.op in ('delete', 'move') and p.spot >= o.tord and p.spot < o.tend and o.seq <> p.seq
    where o.op = 'delete' or p.anchor or p.op in ('move', 'delete', 'relevel', 'merge_up')
  union select project, max(seq), 'same op twice' from b where op in ('rename', 'merge_up', 'relevel', 'delete', 'move') group by project, id, op having count(*) > 1)"""


def _cut(titles: str, terms: str) -> str:
    """Titles walked from the left, a term or a character at a time; ``terms`` from the longest to the shortest."""
    return f"""walk(id, title, place, term, step) as (select id, title, 0, null::varchar, 1 from {titles}
  union all select id, title, place + step, ([x for x in [{terms}] if starts_with(substr(title, place + step), x)])[1], coalesce(length(([x for x in [{terms}] if starts_with(substr(title, place + step), x)])[1]), 1)
  from walk where place + step <= length(title)),
cut as (select id, title, place, term from walk where term is not null)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of every query."""
    alls = tuple(OP_KINDS)
    page = "titles as (select page_id::varchar id, (page_id % 2 + 1)::bigint as level, regexp_extract(html, '<h1>([^<]*)</h1>', 1) title from pages where regexp_extract(html, '<h1>([^<]*)</h1>', 1) <> '')"
    terms = "terms(informal, standard) as (values ('the', 'THE'), ('ing', '-ing'), ('th', 'th.'))"
    roles = f"roles as (select *, {_ROLE} as role from titles)"
    forms = "counted as (select role, title, count(*) n from roles where role is not null group by all), forms as (select *, row_number() over (partition by role order by n desc, title) as rank from counted qualify rank <= 3)"
    notes = "notes as (select o_orderstatus project, o_custkey || '.md' file, row_number() over (partition by o_orderstatus, o_custkey order by o_orderkey) - 1 n, o_orderkey k, o_orderkey % 6 + 1 a, o_orderkey % 7 + 1 b, o_orderkey % 5 + 1 c from orders)"
    outline = "select project, id, state, pos::bigint pos, new_level::bigint new_level, new_title, new_num, out_file from outl"
    out = {
        "inv_lines": "select source as project, doc_id || '.md' as file, unnest(range(1, len(string_split(text, chr(10))) + 1))::bigint as line_no, unnest(string_split(text, chr(10))) as line from documents",
        "inv_digest": "select source as project, doc_id || '.md' as file, sha256(text) as sha from documents",
        "inv_code_mask": f"with {_LINES} select project, file, count(*) n_lines, sum(case when code then 1 else 0 end)::bigint n_code, sum(case when opens then 1 else 0 end)::bigint n_blocks from marked group by all",
        "inv_headings": f"with {_LINES} select project, id, ord, level::bigint as level, title, num, 'arabic' as num_style, {_ROLE} as role from heads",
        "inv_counts": f"with {_LINES} select project, level::bigint as level, count(*) n from heads group by all",
        "inv_own_body": f"with {_LINES}, {_OWN} select h.project, h.file, h.line_no, display_eqs, figures, code_blocks from heads h join own using (project, file, ord)",
        "inv_subtree": f"with {_LINES}, {_OWN} select h.project, h.id, h.subtree_end::bigint subtree_end, sum(display_eqs)::bigint total_display_eqs, sum(figures)::bigint total_figures, sum(code_blocks)::bigint total_code_blocks from heads h join own w on w.project = h.project and w.ord >= h.ord and w.ord < h.subtree_end group by all",
        "inv_roles": f"with {page}, {roles} select id, title, level, role from roles",
        "lint_term": f"with {page}, {terms} select 'term_informal' as rule, id, title, standard as suggestion from titles join terms on contains(title, informal)",
        "lint_term_allowed": f"with {page}, {terms} select 'term_informal' as rule, id, title, standard as suggestion from titles join terms on contains(title, informal) where informal <> 'th'",
        "lint_term_longest": f"""with recursive {page}, known(term, standard) as (values ('the', 'THE'), ('ing', '-ing'), ('th', 'th.')), {_cut("titles", "'thing', 'inge', 'erth', 'heth', 'anth', 'the', 'ing', 'th'")}
select distinct 'term_informal' as rule, id, title, standard as suggestion from cut join known using (term)""",
        "lint_segments": f"""with recursive {page}, known(term, standard) as (values ('the', 'THE'), ('ing', '-ing'), ('th', 'th.')), {_cut("titles", "'thing', 'inge', 'erth', 'heth', 'the', 'ing', 'th'")}
select id, place::bigint as "at", term, standard from cut left join known using (term)""",
        "lint_colon": f"with {page}, t as (select id, case when id::bigint % 3 = 0 then title || ': part' when id::bigint % 5 = 1 then title || '：part' else title end title from titles) select 'pages' as project, 'title_colon' as rule, id, title from t where contains(title, ':') or contains(title, '：')",
        "lint_length_norms": "with titles as (select doc_id || '.md' id, doc_id % 3 + 1 as level, array_to_string(string_split(text, ' ')[1:3], ' ') title from documents where text is not null), n as (select level, quantile_cont(length(title)::double, 0.95) most from titles group by level) select 'title_length' as rule, id, title, 'title has ' || length(title) || ' characters' as msg from titles join n using (level) where length(title) > most",
        "lint_references": f"with {notes} select project, file, (n * 4 + 1)::bigint line_no, a || '.' || b || ' 节' as ref, a || '.' || b as num, 'section' as kind from notes union all select project, file, n * 4 + 1, '第 ' || c || ' 章', c::varchar, 'chapter' from notes",
        "lint_chapter_pattern": "with t as (select c_custkey::varchar id, '问题' || (c_custkey % 40) || ' ' || c_mktsegment title, '问题N ' || c_mktsegment p from customer), u as (select p from t group by p order by count(*) desc, p limit 3) select 'chapter_pattern' as rule, id, title from t where p not in (select p from u)",
        "inv_num_style": f"with {page} select 'pages' as project, id || '.md:1' as id, 1::bigint as level, rtrim(title) title, case when id::bigint % 3 <> 0 then id || '.' || (id::bigint % 4) end num, case when id::bigint % 3 <> 0 then 'arabic' else 'none' end num_style from titles",
        "plan_parse": """with o as (select o_orderkey k from orders), x as (select k, 0 seq, 'rename' op, '01.md:' || k id, null "after", null lvl, null title, 'T' || k "new" from o union all select k, 1, 'insert', null, '01.md:' || k, k % 6 + 1, 'N', null from o union all select k, 2, 'delete', '02.md:' || k, null, null, null, null from o)
select k::varchar project, 'paper/sections' as src, case when k % 3 = 0 then 'auto' else 'keep' end numbering, seq::bigint seq, op, id, "after", lvl::bigint as level, title, "new" from x""",
        "apply_keep": f"with {_plan_sql(alls)} select project, id, state, pos::bigint pos, new_level::bigint new_level, new_title, case when state = 'kept' then num end new_num, out_file from outl",
        "apply_references": f"""with {notes}, m as (select *, case a || '.' || b when '1.1' then '3.2.1' when '2.2' then '1.1' else a || '.' || b end s2, case c when 2 then 5 else c end c2 from notes)
select project, file, (n * 4 + 1)::bigint line_no, '价 ' || (k % 90) || '.' || (k % 7) || ' 元，见 ' || s2 || ' 节与第 ' || c2 || ' 章' as line from m
union all select project, file, n * 4 + i, l from notes, (values (2, '```'), (3, '见 9.9 节'), (4, '```')) x(i, l)""",
        "lint_length": f"with {page} select 'title_length' as rule, id, title, 'title has ' || length(title) || ' characters' as msg from titles where length(title) > 20",
        "lint_role_unclear": f"with {_LINES} select project, 'role_unclear' as rule, id, title from heads where level <= 2 and ({_ROLE}) is null",
        "lint_xref_missing": f"with {_LINES} select distinct project, 'xref_missing' as rule, 'no section for ' || regexp_extract(line, '([0-9]+\\.[0-9]+ 节)', 1) as msg from lines l where contains(line, ' 节') and not exists (select 1 from heads h where h.project = l.project and h.num = regexp_extract(l.line, '([0-9]+\\.[0-9]+) 节', 1))",
        "lint_skeleton": f"with {_LINES}, w(role) as (values ('alpha'), ('omega'), ('references')), r as (select project, {_ROLE} as role from heads) select distinct project, 'skeleton_missing' as rule, 'no section for role ' || w.role as msg from heads p cross join w where not exists (select 1 from r where r.project = p.project and r.role = w.role)",
        "lint_role_wording": f"with {page}, {roles}, {forms}, best as (select role, list_sort(list(distinct title)) l from forms group by role) select id, title, 'uncommon wording for role ' || role as msg, array_to_string(l, ' / ') as suggestion from roles join best using (role) where not list_contains(l, title)",
        "plan_problems": f"with {_plan_sql(alls)}, {_BROKEN} select project, seq::bigint seq, problem from found",
        "apply_chained": f"with recursive {_CHAINED} select project, id, state, pos::bigint pos, new_level::bigint new_level, new_title, new_num, out_file, moved from outl4",
        "plan_chained_problems": f"""with recursive {_CHAINED},
steps(project, r, dead) as (select project, 0, false from target union all select s.project, s.r + 1, (s.r + 1) % 3 = 1 and ((s.r + 1) % 5 = 2 or (s.r % 3 = 1 and s.dead)) from steps s join many using (project) where s.r + 1 < n)
select project, r::bigint as seq, 'unknown id none.md:1' as problem from picked where r % 5 = 2 union all select project, n, 'unknown id none.md:1' from many where n % 5 = 2
union all select s.project, s.r + 1, 'unknown id n' || s.r from steps s join many using (project) where s.dead and s.r + 1 < n and (s.r + 1) % 5 <> 2""",
        "plan_unreadable": """select o_orderkey::varchar as project, [null, 'unreadable plan', 'unreadable plan', 'plan without ops', 'unknown numbering roman', 'empty plan', 'empty plan'][o_orderkey % 7 + 1] as problem, case when o_orderkey % 7 = 0 then 3 else 0 end::bigint as n_ops from orders""",
        "plan_valid": f"""with {_plan_sql(alls)}, {_BROKEN}, c as (select project, count(*) n_ops from ops group by project), f as (select project, count(*) n from found group by project)
select project, 'valid' as plan, n_ops, 0::bigint n_problems, true valid from c union all select project, 'broken', n_ops, coalesce(n, 0), n is null from c left join f using (project)""",
        "plan_outline_diff": f"with {_plan_sql(alls)} select project, ord::bigint ord, pos::bigint pos, before, after_ as \"after\", mark from diffed",
        "apply_number_map": f"with {_plan_sql(alls)} select project, num, target from nums",
        "apply_lines": f"with {_plan_sql(alls)} select project, out_file as file, pos::bigint pos, src_line::bigint k, line from moved union all select project, out_file, pos, 0, repeat('#', new_level) || ' ' || new_num || ' ' || new_title from outl where state = 'inserted' union all select project, out_file, pos, 1, '' from outl where state = 'inserted'",
        "apply_ref_log": f"with {_plan_sql(alls)} select project, src_file as file, src_line::bigint src_line, old, line as new from moved where not is_head and old <> line",
        "apply_deleted_warn": f"with {_plan_sql(alls)} select m.project, m.src_file as file, m.src_line::bigint as line_no, regexp_extract(m.old, '([0-9]+\\.[0-9]+ 节)', 1) as ref, g.num || ' ' || g.title as warn from moved m join outl g on g.project = m.project and g.state = 'deleted' and not m.code and not m.is_head and g.num = regexp_extract(m.old, '([0-9]+\\.[0-9]+) 节', 1)",
        "verify_drift": f"with {_plan_sql(alls)}, s as (select project, line, count(*) n from moved where not is_head and line like '%7 节' group by all) select project, 'lost' as side, line, n from s union all select project, 'new', line || ' drift', n from s",
        "verify_no_drift": f"with {_plan_sql(alls)} select project, count(*) n_lines, 0::bigint n_drift from moved where not is_head and trim(line) <> '' group by project",
        "verify_assets": f"""with {_plan_sql(alls)}, gone as (select w.project, w.line from owned w join outl o on o.project = w.project and o.ord = w.own where o.state = 'deleted' and not w.code),
t as (select project, 'label' as kind, regexp_extract(line, '\\{{#([^}}]+)\\}}', 1) as name, 1 n from gone where contains(line, '{{#') union all select project, 'figure', regexp_extract(line, '(!\\[f\\]\\(a.png\\))', 1), 1 from gone where contains(line, '![f]')
  union all select project, 'equation marks', '$$', 2 from gone where contains(line, '$$')),
s as (select w.project, 'label' as kind, regexp_extract(line, '\\{{#([^}}]+)\\}}', 1) as name, 1 n from owned w where not code and contains(line, '{{#') union all select project, 'figure', regexp_extract(line, '(!\\[f\\]\\(a.png\\))', 1), 1 from owned where not code and contains(line, '![f]')
  union all select project, 'equation marks', '$$', 2 from owned where not code and contains(line, '$$')),
a as (select project, kind, name, sum(n)::bigint n_before from s group by all), d as (select project, kind, name, sum(n)::bigint lost from t group by all)
select project, kind, name, n_before, n_before - lost as n_after from a join d using (project, kind, name)""",
        "verify_source": "select source as project, doc_id || '.md' as file, sha256(text) as sha_before, sha256(text || chr(10)) as sha_after from documents where doc_id % 10 = 3",
        "report_changes": f"with {_plan_sql(alls)} select project, mark, count(*) n from diffed where mark is not null group by all",
        "norms_thresholds": f"with {page} select level, count(*) n, quantile_cont(length(title)::double, 0.95) as max_title from titles group by all",
        "norms_role_forms": f"with {page}, {roles}, {forms} select role, title, n, rank::bigint as rank from forms",
        "norms_patterns": "select '问题N ' || c_mktsegment as pattern, count(*) n from customer group by all order by n desc, pattern limit 5",
    }
    return out | {f"apply_{k}": f"with {_plan_sql((k,))} {outline}" for k in OP_KINDS} | {"apply_renumber": f"with {_plan_sql(alls)} {outline}"}
