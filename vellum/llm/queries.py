"""The registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, conversations, decontaminate, embeddings, language, licences, near_dedup, secrets, sharding, substrings, token_counts, token_files
from .staging import new_folder


def tokenizer_path() -> str:
    """The byte-level vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the corpus as token files and describe each document as read back."""
    folder = new_folder(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), folder, tokenizer_path(), end_id=0)
    return token_files.read_token_files(spark, folder, with_ids=False)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text by kind and place, with those that ownership adds."""
    found = secrets.scan_secrets(documents(spark, sf_dir).select("doc_id", "text", "source"), carry=("doc_id",))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "owned")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count("owned"),
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class under links of similarity 0.85."""
    found = near_dedup.near_duplicates(documents(spark, sf_dir), shingle=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every text."""
    found = licences.scan_licences(documents(spark, sf_dir).select("doc_id", "text"), carry=("doc_id",))
    labels = lambda *columns: F.array_join(
        F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda m: m["label"]) for c in columns]))), ","
    )
    starts = F.transform("base", lambda m: m["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "templates").alias("labels"),
        "score",
    )


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and class under cosine 0.98 among equal labels."""
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of the rows."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs.select("doc_id", "text", "lang"))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "shares")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 and place in it."""
    return sharding.assign_shards(documents(spark, sf_dir), 40)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text that lie in windows of 35 words which recur."""
    found = substrings.find_repeats(documents(spark, sf_dir), window=35)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; digests of both."""
    both = bpe.recode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the item and where it stands."""
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_path() -> str:
    """The piece vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every text."""
    return alignment.aligned_texts(documents(spark, sf_dir), tokenizer_path(), piece_path())


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens under the piece vocabulary, and whether they are over 4,096."""
    return token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), piece_path(), 4096).drop("text")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    return conversations.damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to function."""
    return {f.__name__: f for f in (op1_token_files, op2_secrets, op3_near_dedup, op4_licences, op5_embeddings, op6_language, op7_sharding, op8_substrings, op9_bpe, op10_decontaminate, op11_alignment, op12_token_counts, op13_conversations)}


_WORDS = "'[^\\x20\\x09-\\x0D]+'"
_CLASSES = """reach as (select r as a, r as b from d union select reach.a, e.y from reach join e on reach.b = e.x),
least as (select a as r, min(doc_id) as c from reach join d on d.r = reach.b group by a)"""

_OP3 = f"""with recursive d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) ws from documents),
s as (select distinct r, case when len(ws) < 5 then len(ws) || '|' || array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end g from d, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) where len(ws) > 0),
n as (select r, count(*) n from s group by r),
p as (select x.r a, y.r b, count(*) both_ from s x join s y on x.g = y.g and x.r < y.r group by all),
l as (select a, b from p join n na on na.r = a join n nb on nb.r = b where 100 * both_ >= 85 * (na.n + nb.n - both_)),
e as (select a x, b y from l union all select b, a from l),
{_CLASSES}
select doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id, doc_id is not distinct from c as kept from d left join n using (r) join least using (r)"""

_OP5 = f"""with recursive d as (select row_number() over () r, vec_id as doc_id, label, embedding::double[] v from embeddings),
l as (select x.r a, y.r b from d x join d y on x.label = y.label and x.r < y.r where list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.98),
e as (select a x, b y from l union all select b, a from l),
{_CLASSES}
select doc_id as vec_id, (select count(*) from e where e.x = d.r)::bigint as n_links, c as component_id, doc_id is not distinct from c as kept from d join least using (r)"""

_OP8 = f"""with d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) ws from documents),
w as (select r, i, array_to_string(ws[i:i + 34], ' ') g from d, unnest(range(1, len(ws) - 33)) t(i)),
again as (select g from w group by g having count(*) > 1),
gone as (select distinct r, i + k as i from (select r, i from w join again using (g)), unnest(range(0, 35)) t(k)),
x as (select d.r, u.i, d.ws[u.i] word from d, unnest(range(1, len(ws) + 1)) u(i)),
k as (select x.r, count(g.i) removed, string_agg(word, ' ' order by x.i) filter (g.i is null) kept from x left join gone g on g.r = x.r and g.i = x.i group by x.r)
select doc_id, len(ws)::bigint as n_words, coalesce(removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (r)"""


_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
_KINDS = [  # name, pattern, group of the value
    ("assign", f"""({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", "AKIA[A-Z0-9]{16,}", 0),
    ("hex", "[0-9a-f]{24,}", 0),
    ("owned", "[A-Za-z0-9+/_=-]{20,}", 0),
]
_FINDS = " union all ".join(
    f"""select r, source, {order} o, '{kind}' kind, list_sum([length(x) for x in gaps[:i]]) + coalesce(list_sum([length(x) for x in whole[:i - 1]]), 0) s,
    length(whole[i]) n, vals[i] v from (select r, source, string_split_regex(t, '{pattern}') gaps, regexp_extract_all(t, '{pattern}', 0) whole, regexp_extract_all(t, '{pattern}', {group}) vals from d),
    unnest(range(1, len(whole) + 1)) u(i)"""
    for order, (kind, pattern, group) in enumerate(_KINDS)
)
_OP2 = f"""with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t from documents),
f as (select *, s + n e from ({_FINDS}) where kind <> 'assign' or length(v) >= 6),
own as (select v, count(distinct split_part(source, '/', 1)) owners from f group by v),
b as (select * from f where kind <> 'owned'),
o as (select f.* from f join own using (v) where kind = 'owned' and owners <= 1 and len(list_distinct(string_split(v, ''))) >= 10
  and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and not regexp_matches(v, '(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567')
  and not exists (select 1 from b where b.r = f.r and b.s < f.e and b.e > f.s)),
a as (select r, o, kind, s, kind || ':' || s::bigint || ':' || e::bigint w from (select * from b union all select * from o)),
g as (select r, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex, count(*) filter (kind = 'owned') n_owned,
  string_agg(w, ',' order by s, o) filter (kind <> 'owned') base, string_agg(w, ',' order by s, o) spans from a group by r)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_owned, 0)::bigint n_owned from d left join g using (r)"""


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(str(x) if isinstance(x, int) else repr(x) for x in r)})" for r in rows)


_LABELS = [(k, label) for k, (label, _, _) in enumerate(licences.TEMPLATES)]
_OP4 = f"""with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from documents),
w as (select r, i - 1 i, ws[i] w from d, unnest(range(1, len(ws) + 1)) t(i)),
spoken(phrase, k) as (values {_values(sorted({(p, len(p.split())) for p in [*licences.BASE, *(p for p, _, _ in licences.phrase_postings())]}))}),
said as (select r, phrase, i from w join spoken on w.w = split_part(phrase, ' ', 1) join d using (r) where array_to_string(ws[i + 1:i + k], ' ') = phrase),
named(phrase, label) as (values {_values(sorted(licences.BASE.items()))}),
base as (select r, i, label from said join named using (phrase)),
posting(w, template, position) as (values {_values(licences.word_postings())}),
frequency as (select w, ln(((select count(*) from d) + 1) / count(distinct r)) idf from w where w in (select w from posting) group by w),
posted as (select *, row_number() over (partition by template order by idf desc nulls last, position) <= {licences.SEEDS} seed from posting left join frequency using (w)),
total as (select template, sum(idf) total from posted group by template),
stands as (select r, i, template, position, idf, seed, floor((i - position) / {licences.DRIFT // 2}) - o win from w join posted using (w), (values (0), (1)) x(o)),
mandatory(phrase, template, position) as (values {_values(licences.phrase_postings())}),
sure as (select distinct r, template, floor((i - position) / {licences.DRIFT // 2}) - o win from said join mandatory using (phrase), (values (0), (1)) x(o)),
copy as (select distinct r, template, win from stands join sure using (r, template, win) where seed),
words as (select r, template, win, position, any_value(idf) idf, min(i) a, max(i) b from stands join copy using (r, template, win) group by all),
scored as (select r, template, win, least(1.0, round(sum(idf) / any_value(total), 6)) score, min(a) a, max(b) b from words join total using (template) group by r, template, win),
agreed as (select x.*, label from scored x join (values {_values(_LABELS)}) l(template, label) using (template) where score >= {licences.AGREE} and not exists (select 1 from scored y where y.r = x.r and y.template = x.template
  and y.score >= {licences.AGREE} and abs(y.win - x.win) = 1 and (y.score > x.score or y.score = x.score and y.win < x.win))),
ranked as (select *, row_number() over best n, first(a) over best ta, first(b) over best tb from agreed window best as (partition by r, label order by score desc, win, template)),
found as (select r, label, score from ranked where n = 1 or a > tb or b < ta),
labelled as (select r, string_agg(distinct label, ',' order by label) labels, max(score) score from (select r, label, score from found union all select r, label, 1.0 from base) group by r),
based as (select r, count(*) n, min(i) a, max(i) b, string_agg(distinct label, ',' order by label) labels from base group by r)
select doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_base, a::bigint first_word, b::bigint last_word, coalesce(based.labels, '') base_labels, coalesce(labelled.labels, '') labels, coalesce(score, 0)::double score
from d left join based using (r) left join labelled using (r)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express a query; the small scales are within its reach."""
    return {"op2_secrets": _OP2, "op3_near_dedup": _OP3, "op4_licences": _OP4, "op5_embeddings": _OP5, "op8_substrings": _OP8}
