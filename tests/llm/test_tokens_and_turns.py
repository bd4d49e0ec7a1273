"""Alignment, token counts and conversation repair against plain Python."""

import bisect
import hashlib
import heapq
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.llm import alignment, conversations, queries, token_counts

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", " a  b ", "▁x y", "x▁ y", "tab\tnew\n line　wide  nbsp  em", "日本語のテスト は 長い", "😀 naïve ﬁ Ａ é", "<s> </s> <unk> <0x0A>", "end<|endoftext|> mark", "a" * 3000, "don't  we'll\u0085 nel", "x\x00 y"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def pieces(a, b, text):
    """(id, bytes) of both, or none if one alters the text."""
    if not text:
        return [], []
    table = {c: i for i, c in byte_letters().items()}
    left = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    same = b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode()
    return (left, right) if same else ([], [])


def byte_letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(rest)}


def plain_alignment(a, b, docs):
    made = []
    for doc, text in docs:
        left, right = pieces(a, b, text)
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, raw in side:
                out.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        parts = [defaultdict(list), defaultdict(list)]
        for side, own in zip(spans, parts, strict=True):
            for _, e, i in side:
                own[bisect.bisect_left(cuts, e)].append(str(i))
        groups = [",".join(parts[0][k]) + "|" + ",".join(parts[1][k]) for k in range(len(cuts))]
        links, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k][0] > s:
                k -= 1
            while spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        made.append((doc, len(left), len(right), groups, links))
    count = Counter(x for *_, links in made for x in links)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(doc, n_a, n_b, len(g), len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), digest(g)) for doc, n_a, n_b, g, ls in made]


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment_of_odd_texts(spark, libraries, seed, monkeypatch):
    rng = random.Random(seed)
    made = ["".join(rng.choice("ab the ing.\n▁日é  ") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    docs = [(k if k % 9 else None, t) for k, t in enumerate(ODD + made + ODD)]
    monkeypatch.setattr(alignment, "TOGETHER", 500 * seed)
    monkeypatch.setattr(alignment, "PART", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("units", F.lit("clash")).repartition(3)
    assert rows(alignment.aligned_texts(df, A, B)) == sorted(plain_alignment(*libraries, docs), key=lambda r: tuple((x is None, x) for x in r))


def test_alignment_of_tables(spark, libraries, tables, docs, empty):
    want = plain_alignment(*libraries, [(d[0], d[1]) for d in docs])
    assert rows(queries.op11_alignment(spark, tables)) == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
    assert queries.op11_alignment(spark, empty).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_alignment_of_words_that_are_cut(spark, libraries, seed, monkeypatch):
    """Signs, line ends and apostrophes beside letters of all kinds, and pieces of B in any order."""
    rng = random.Random(seed)
    b = libraries[1]
    made = ["".join(rng.choice("abllst éà×÷Ñяđ'..,,;%%_-(\n\n\r\t 17▁\u00a0日\u0301") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    pieces_b = [x.replace("▁", " ") for x in map(b.id_to_piece, range(b.get_piece_size())) if not x.startswith("<")]
    made += ["".join(rng.choice([*rng.sample(pieces_b, 9), "\n", ".", "'"]) for _ in range(40)) for _ in range(100)]
    made += [f"{x}{sign}{y}" for sign in ".,;:!?_%\"'(\n" for x in ("the", "é", "×", "я", "he'll", "3", ".") for y in ("", "The", "Éa", "×", "\nThe", "\n\nThe", " x", "'s", "7")]
    docs = list(enumerate(made))
    monkeypatch.setattr(alignment, "TOGETHER", 3000)
    monkeypatch.setattr(alignment, "PART", 50)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(alignment.aligned_texts(df, A, B)) == sorted(plain_alignment(*libraries, docs))


def test_words_are_aligned_once_whatever_sign_follows(spark):
    """The links that are sorted grow with the words, not with words times the signs after them."""
    words = [f"{x}nthaingbleoften{y}" for x in "abcdefgh" for y in "klmnop"]
    count = lambda text: alignment.unit_links(alignment.cut_texts(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1), A, B)).count()
    alone = count(" ".join(words))
    marked = count(" ".join(f"{w}{sign}" for sign in ("", ".", ",", ";", "%%%", "!") for w in words))
    assert marked <= alone + 40


def test_assembly_takes_links_in_any_order(spark, libraries):
    """Links mostly come in the order in which they were written; others are sorted."""
    docs = [(1, "the nations. of the\nThings"), (2, "of the the nations")]
    found = alignment.align(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), A, B)
    left = found.batches.filter("doc_ids is not null").select("bucket", "doc_ids", "places").toArrow()
    links = found.links.join(found.counts, ["a", "b"]).select("bucket", "k", "end", "a", "b", "a_ends", "b_ends", "pair_n", "best").toArrow()
    for order in ([("k", "ascending"), ("end", "descending")], [("end", "ascending"), ("k", "descending")]):
        got = alignment.assembled(left, links.sort_by(order)).to_pylist()
        assert sorted(tuple(r.values()) for r in got) == sorted(plain_alignment(*libraries, docs))


def test_links_cover_every_overlap(spark, libraries):
    """The links of a stretch are the overlapping pairs, however long its groups are."""
    units = [" " + "heinthsupercalifragilistic" * 40, " ....====----", " x", " \t\t\n"]
    docs = spark.createDataFrame([(k, u[1:]) for k, u in enumerate(units)], "doc_id long, text string").coalesce(1)
    batches = alignment.cut_texts(docs, A, B)
    where = batches.filter("doc_ids is not null").select("bucket", F.explode(F.arrays_zip("doc_ids", "places")).alias("x")).select("bucket", "x.doc_ids", F.explode("x.places").alias("k"))
    links = alignment.unit_links(batches).join(where, ["bucket", "k"])
    got = Counter((units[r["doc_ids"]], r["a"], r["b"]) for r in links.collect())
    want = Counter()
    for unit in units:
        left, right = pieces(*libraries, unit[1:])
        ends = lambda side: np.cumsum([0, *(len(x) for _, x in side)])
        p, q = ends(left), ends(right)
        want.update((unit, i, j) for x, (i, _) in enumerate(left) for y, (j, _) in enumerate(right) if p[x] < q[y + 1] and q[y] < p[x + 1])
    assert got == want


def test_counts_of_odd_texts(libraries):
    rng = random.Random(3)
    alphabets = ["abcdehinorstu  ▁\n\t.é日本の語　Ａ😀<s>0x41'", "ab", "the ing", " ▁", "a ", "hent"]
    texts = ODD + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 2, 5, 30, 90]))) for _ in range(5000)]
    texts += ["ab" * 2000, " " * 999, "▁" * 333, "the" * 1500, "".join(rng.choice("etaoinshrdlu") for _ in range(6000))]
    got = token_counts.PieceCounter(B, size=64).count(pa.array(texts))
    assert got.tolist() == [len(libraries[1].encode(t or "")) for t in texts]


def test_merging_is_one_place_after_the_other():
    """Vocabularies with pieces that outrank their own parts, where merging all places at once would go wrong."""
    rng = random.Random(7)
    for _ in range(300):
        texts = {"a", "b", "c"} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(12)}
        vocabulary = [(t, float(rng.randint(-9, 0))) for t in sorted(texts)]
        score = dict(vocabulary)
        merges = token_counts.PieceMerges(vocabulary)
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        symbols = list(word)
        while True:
            ways = [(-score[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in score]
            if not ways:
                break
            k = min(ways)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        flat = merges.symbol[[ord(c) for c in word]]
        first = np.zeros(len(word), bool)
        first[0] = True
        left, _ = merges.merge(flat, merges.pre_tokens(np.array([ord(c) for c in word]), first))
        assert [merges.texts[k] for k in left] == symbols


def test_counts_of_tables(spark, libraries, tables, docs, empty):
    want = [(d, len((t or "").encode()), len(libraries[1].encode(t or "")), len(libraries[1].encode(t or "")) > 4096) for d, t, *_ in docs]
    assert rows(queries.op12_token_counts(spark, tables)) == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
    assert queries.op12_token_counts(spark, empty).count() == 0
    kept = token_counts.count_tokens(spark.createDataFrame([("x", 1, "z")], "text string, N_TOKENS int, other string"), B, 0)
    assert [r.asDict() for r in kept.collect()] == [{"text": "x", "other": "z", "n_bytes": 1, "n_tokens": 1, "over_limit": True}]


def plain_report(turns):
    """A conversation's report from its raw rows (conv, turn, role, text), by a search over all edits."""
    out = []
    for conv, turn, role, text in turns:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    counts, must, cut, seen = Counter(), [], [], set()
    for _, role, text in out:
        solid = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        must.append(fault in ("blank", "duplicate"))
        cut.append(fault == "truncated")
    known = {t for t, *_ in out if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    initials = [r[:1] for _, r, _ in out]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, k, last, made = heapq.heappop(heap)
        if k == len(out) and last in ("", "a"):
            break
        if (k, last) in done:
            continue
        done.add((k, last))
        fits = lambda x: x == "s" and last == "" or x == "u" and last != "u" or x == "a" and last == "u"  # noqa: B023, E731
        for x, whole in (("u", "user"), ("a", "assistant")):
            if fits(x):
                heapq.heappush(heap, (cost + 3, audit + "I", k, x, (*made, f"{whole}:")))
        if k < len(out):
            _, role, text = out[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, last, made))
            if not must[k]:
                more = 3 * cut[k]
                if fits(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[:1], (*made, f"{role}:{text}")))
                for x, whole in (("u", "user"), ("a", "assistant")):
                    if fits(x):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, x, (*made, f"{whole}:{text}")))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def plain_reports(turns):
    by = defaultdict(list)
    for row in turns:
        by[row[0]].append(row)
    return sorted(((conv, *plain_report(own)) for conv, own in by.items()), key=lambda r: (r[0] is None, r[0]))


def odd_turns(seed, convs=60):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"], ["Hello.", "why?", "so", "", "  \t", "x! \n", None, "é…", "a.b", "Fine."]
    out = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"said {c} {t}.") for c in range(convs) for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    out += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (7000, None, "user", "Nothing."), (7001, 5, "user", "Once.")]
    dropped = next(c for c in range(8000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*out, (dropped, 0, "user", "All gone.")]


@pytest.mark.parametrize("seed", range(3))
def test_random_layers(seed):
    rng = random.Random(seed)
    for _ in range(40):
        codes = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 2))]
        ways = []
        for edits in product("KRD", repeat=len(codes)):
            for holes in product((0, 1, 2), repeat=len(codes) + 1):
                cost, audit, reached = 3 * sum(holes), "", {""}
                for k in range(len(codes) + 1):
                    for _ in range(holes[k]):
                        reached, audit = {r + x for r in reached for x in "ua"}, audit + "I"
                    if k < len(codes):
                        n = "abcdefghijkl".index(codes[k])
                        initial, fault = "sua?"[n // 3], n % 3
                        audit += edits[k]
                        cost += {"K": 0, "R": 3, "D": 4}[edits[k]] + (3 if fault == 1 and edits[k] != "D" else 0)
                        if edits[k] != "D":
                            reached = set() if fault == 2 else {r + x for r in reached for x in ([initial] if edits[k] == "K" else "ua")}
                if any(re.fullmatch("(s?(ua)+)?", r) for r in reached):
                    ways.append((cost, audit))
        assert conversations.cheapest("".join(codes)) == min(ways)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most", [4096, 3])
def test_conversations_of_any_length(spark, most, monkeypatch):
    """Whole ones, and cut into blocks of two rows."""
    monkeypatch.setattr(conversations, "BLOCK_BITS", 1)
    turns = odd_turns(most)
    df = spark.createDataFrame(turns, SCHEMA).withColumn("copy", F.lit("clash")).repartition(3)
    got = conversations.damaged_and_repaired(df, most=most)
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[0])) == plain_reports(turns)


def test_long_texts_are_cut_too(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"word {t}. " * 50) for t in range(20)] + [(2, 0, "user", "Short.")]
    got = conversations.damaged_and_repaired(spark.createDataFrame(turns, SCHEMA), most_chars=1000)
    assert sorted(map(tuple, got.collect())) == plain_reports(turns)


def test_conversations_of_tables(spark, tmp_path):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13_conversations(spark, SF).collect())) == plain_reports(turns)
    nothing = spark.createDataFrame([], SCHEMA)
    assert conversations.damaged_and_repaired(nothing).count() == 0
    assert json.dumps(conversations.cheapest("")) == '[0, ""]'
