"""Cross-tokenizer alignment (operator 11).

Where tokens of a byte-level tokenizer A and a piece tokenizer B end at the same byte, the
text is cut into groups; a link joins two tokens whose bytes overlap.  The work is relational:
tokens are posexploded, windowed sums of their lengths give their ends, both sides meet on
(stretch of text, end), a running count of the ends they share is the group.  What meets there
is a stretch of bytes between two ends; exactly one token of A and one of B cover it, so these
rows are the links, as many as there are tokens less the cuts, however long a group is.

No token of A or B reaches across a space that follows a visible character.  Texts are
therefore cut there, and a stretch is aligned once for all its places in a batch of texts:

1. A pass over the texts cuts them and encodes each distinct stretch of ``TOGETHER`` bytes of
   texts by both libraries.  Such a batch is some rows of a table, with the texts as lists of
   numbers into its stretches.  A text that a tokenizer alters (a piece model writes U+2581
   for a space) has no tokens and no places.
2. That table and the one of links are bucketed by batch, so all that follows, which is by
   batch and stretch, shuffles nothing.  Hence the equi-join of the two sides on the end, which
   each side holds once, is an aggregation over their union: a join would deal all tokens anew.
3. Links are counted by id pair over all places in the corpus.
4. Links meet the counts of their pairs and go, batch by batch, to the places in the texts.

Defined results: a null or empty text has no tokens, zeros and an empty digest; null ids and
rows that repeat are kept, each with its own result; an empty table stays empty; other columns
are not carried.  A text of any length is aligned whole: memory follows the longest text and
``TOGETHER``.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import in_arrow, rest, slices, sole
from .staging import new_folder, sendable, stage
from .units import _BLANK_END, UnitTable, buffers, hashes, spread, texts_of

#: Bytes of text whose distinct stretches go into one row, and those that are cut at a time.
TOGETHER = 8 << 20
CUT = 2 << 20
#: Stretches in a row, and those that the libraries get at a time.
PART = 1 << 16
ENCODED = 20_000
#: More than any vocabulary has entries.
VOCABULARY = 1 << 24
#: More than any token has bytes.
LENGTH = 1 << 16
MARK = "▁"
STATS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ROW = {"bucket": pa.int64(), "base": pa.int32(), "n": pa.list_(pa.int32()), "token": pa.list_(pa.int64()), "doc_ids": pa.list_(pa.int64()), "places": pa.list_(pa.list_(pa.int32()))}
#: What tells a stretch.
UNIT = ["bucket", "k"]


#: First bytes of two-byte letters (Latin and Cyrillic; less two signs), ASCII letters, and ASCII signs but the apostrophe.
_LEAD, _LETTER, _SIGN = (np.zeros(256, bool) for _ in range(3))
_LEAD[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def _letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter that is known as one ends at each place."""
    lead = data[at - 1]
    two = _LEAD[lead] & (data[at] >= 0x80) & (data[at] < 0xC0) & (at > 0)
    return _LETTER[data[at]] | two & ((lead != 0xC3) | (data[at] != 0x97) & (data[at] != 0xB7))


def inner_starts(data: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Places within words where both tokenizers cut: signs after letters, and letters after a lone line end.

    A's pre-tokens end there whatever stands around; of B no piece has the two bytes (``beside``) side by side.
    """
    signs = np.flatnonzero(_SIGN[data[1:]]) + 1
    signs = signs[_letters(data, signs - 1) & ~beside[data[signs - 1], data[signs]]]
    lines = np.flatnonzero(data[:-1] == 10) + 1
    lines = lines[lines > 1]
    two = _LEAD[data[lines]]
    begins = _LETTER[data[lines]]
    begins[two] = _letters(data, lines[two] + 1)
    before = data[lines - 2]
    lines = lines[begins & ~beside[10, data[lines]] & ((before > 32) & (before < 127) | _letters(data, lines - 2))]
    return np.concatenate((signs, lines))


def safe_starts(data: np.ndarray, offsets: np.ndarray, beside: np.ndarray | None = None) -> np.ndarray:
    """Where stretches begin: at texts, at spaces after a visible character that is not U+2581, and with ``beside`` at :func:`inner_starts`."""
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces > 0]
    after = data[spaces - 1]
    good = after > 32
    odd = np.flatnonzero((after >= 0x80) & _BLANK_END[after])
    at = spaces[odd]
    two, three = data[at - 2], data[at - 3]
    blank = (two == 0xC2) | (((two == 0x80) | (two == 0x81) | (two == 0x9A)) & (three >= 0xE1) & (three <= 0xE3))
    good[odd] = ~blank & ((two != 0x96) | (three != 0xE2))
    begins[spaces[good]] = True
    if beside is not None:
        begins[inner_starts(data, beside)] = True
    return np.flatnonzero(begins[:-1])


class Pair:
    """Both libraries, and the ids of stretches that were met before."""

    def __init__(self, path_a: str, path_b: str, size: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"{path_a}: not a byte-level tokenizer without a prefix space")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text here
        self.a.no_truncation()
        self.a.no_padding()
        own = self.a.get_vocab(with_added_tokens=True)
        self.size_a = np.zeros(max(own.values()) + 1, np.int32)
        for text, i in own.items():
            self.size_a[i] = len(text)  # a byte-level entry has a character a byte
        self.b = SentencePieceProcessor(model_file=path_b)
        ids = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int32)
        self.blob, self.start_b = np.frombuffer(b"".join(self.bytes_b), np.uint8), np.cumsum(self.size_b) - self.size_b
        self.blank = self.b.piece_to_id(MARK)
        #: Bytes that stand side by side in a piece of B; none if words cannot be cut.
        self.beside = np.zeros((256, 256), bool)
        for x in self.bytes_b:
            self.beside[list(x[:-1]), list(x[1:])] = True
        lines = [i for i in ids if b"\n" in self.bytes_b[i] and not self.b.is_byte(i)]
        if lines or not pre.get("use_regex", True) or spec.get("normalizer") or any(not t["special"] for t in spec.get("added_tokens") or []):
            self.beside = None
        self.tables = [UnitTable(np.dtype(np.int32), size) for _ in range(2)]

    def _ask_a(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]

    def _ask_b(self, units: list[str]) -> list[list[int]]:
        # the library puts a space before each text; what begins with a line end has none
        found = self.b.encode([u[u[0] == " " :] for u in units], num_threads=1)
        return [(ids if u[0] == " " else ids[1:]) if len(u) > 1 else [self.blank] for u, ids in zip(units, found, strict=True)]

    def _ids(self, ask: Callable, known: np.ndarray, units: list[str], sizes: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of stretches; those that ``joins`` marks are asked for many in one text and come apart at their ends."""
        together = [x.tolist() for x in np.array_split(np.flatnonzero(joins), joins.sum() // 200 + 1)]
        alone = np.flatnonzero(~joins).tolist()
        counts, order, parts = np.zeros(len(units), np.int64), [], []
        for group, ids in zip(together, ask(["".join([units[k] for k in g]) or " " for g in together]), strict=True):
            ends, own = np.cumsum(known[ids]), np.cumsum(sizes[group])
            at = np.searchsorted(ends, own)
            if len(group) and len(ends) == at[-1] + 1 and (ends[at] == own).all():
                counts[group] = np.diff(at, prepend=-1)
                order += group
                parts.append(np.array(ids, np.int32))
            else:  # something in it is altered
                alone += group
        found = ask([units[k] for k in alone])
        counts[alone] = [len(ids) for ids in found]
        flat = np.concatenate([*parts, np.fromiter(chain.from_iterable(found), np.int32)])
        order = np.array(order + alone, np.int64)
        first = np.zeros(len(units), np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return flat[spread(first, counts)], counts

    def learn(self, raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) of both for each stretch, none of either if one does not give it back."""
        units = [r.decode("utf-8", "replace") for r in raw]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data, last = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes)
        joins = (data[last - 1] > 32) & (data[last - 1] < 0x80) | _letters(data, last - 1)  # what follows a visible character is cut off there
        inner = data[last - sizes] != 32  # these get a line end before them, which is a token of its own, and is taken off again
        units = [f"\n{u}" if x else u for u, x in zip(units, inner.tolist(), strict=True)]
        found = []
        for ask, known in ((self._ask_a, self.size_a), (self._ask_b, self.size_b)):
            ids, counts = self._ids(ask, known, units, sizes + inner, joins)
            stay = np.ones(len(ids), bool)
            stay[(np.cumsum(counts) - counts)[inner]] = False
            found.append((ids[stay], counts - inner))
        same = np.ones(len(raw), bool)
        for known, (ids, counts) in zip((self.size_a, self.size_b), found, strict=True):
            ends = np.concatenate(([0], np.cumsum(known[ids])))
            bound = np.cumsum(counts)
            same &= (ends[bound] - ends[bound - counts] == sizes) & (counts > 0)
        some = np.flatnonzero(same)
        ids, counts = found[1]
        own = ids[spread((np.cumsum(counts) - counts)[some], counts[some])]
        wrong = self.blob[spread(self.start_b[own], self.size_b[own])] != data[spread((last - sizes)[some], sizes[some])]
        seen = np.concatenate(([0], np.cumsum(wrong)))
        bound = np.cumsum(sizes[some])
        same[some] = seen[bound] == seen[bound - sizes[some]]
        return [(flat[spread((np.cumsum(n) - n)[same], n[same])], np.where(same, n, 0)) for flat, n in found]

    def encode(self, one: np.ndarray, two: np.ndarray, raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) of A and of B for distinct stretches."""
        entry = [t.find(one, two) for t in self.tables]
        new = np.flatnonzero(entry[0] < 0)
        if len(new) and self.tables[0].used + len(new) > self.tables[0].size:
            self.tables = [UnitTable(t.dtype, max(t.size, 2 * len(one))) for t in self.tables]
            new = np.arange(len(one))
        if len(new):
            for x in range(0, len(new), ENCODED):
                part = new[x : x + ENCODED]
                for table, (ids, counts) in zip(self.tables, self.learn([raw[k] for k in part.tolist()]), strict=True):
                    table.add(one[part], two[part], ids, counts)
            entry = [t.find(one, two) for t in self.tables]
        return [(t.ids[spread(t.start[e], t.count[e])], t.count[e]) for t, e in zip(self.tables, entry, strict=True)]


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    """Both libraries, once a worker process."""
    return Pair(path_a, path_b)


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair of hashes stands first, and which of these every place is."""
    _, first, place = np.unique(one ^ (two << np.uint64(1)), return_index=True, return_inverse=True)
    if (one[first[place]] != one).any() or (two[first[place]] != two).any():  # 64 bits did not tell them apart
        _, first, place = np.unique(np.stack((one, two)), axis=1, return_index=True, return_inverse=True)
    return first, place.ravel()


class Batch:
    """Texts with their distinct stretches, until they are ``TOGETHER`` bytes."""

    def __init__(self, beside: np.ndarray | None) -> None:
        self.beside, self.size = beside, 0
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.one: list[np.ndarray] = []
        self.two: list[np.ndarray] = []
        self.raw: list[bytes] = []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        """More texts; a space is put before each."""
        texts = pc.fill_null(texts, "")
        data, offsets = buffers(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " ")))
        starts = safe_starts(data, offsets, self.beside)
        sizes = np.diff(starts, append=len(data))
        first = place = np.zeros(0, np.int64)
        if len(starts):
            one, two = hashes(data, starts, sizes)
            first, place = distinct(one, two)
            self.one.append(one[first])
            self.two.append(two[first])
        self.places.append((place + len(self.raw)).astype(np.int32))
        self.raw += texts_of(data, starts[first], sizes[first])
        self.ids.append(ids)
        self.lengths.append(np.diff(np.searchsorted(starts, offsets)))
        self.size += len(data)

    def rows(self, bucket: int, tool: Pair) -> Iterator[pa.RecordBatch]:
        """The batch: rows of ``PART`` stretches each, then rows of texts."""
        one, two = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (self.one, self.two))
        first, same = distinct(one, two)
        place, lengths = same.astype(np.int32)[np.concatenate(self.places)], np.concatenate(self.lengths)
        (a, n_a), (b, n_b) = tool.encode(one[first], two[first], [self.raw[k] for k in first.tolist()])
        docs = pa.concat_arrays(self.ids)
        self.__init__(self.beside)  # its bytes are not needed while rows are made
        del one, two, same
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        whole = np.ones(len(lengths), bool)
        whole[owner[n_a[place] == 0]] = False  # a text with a stretch that is not given back
        place, lengths = place[whole[owner]], np.where(whole, lengths, 0)
        n = np.bincount(place, minlength=len(first)).astype(np.int32)
        from_a, from_b, bounds = (np.concatenate(([0], np.cumsum(x))) for x in (n_a, n_b, lengths))
        nothing = {c: pa.nulls(1, t) for c, t in ROW.items()}
        row = lambda **new: pa.RecordBatch.from_pydict({**nothing, "bucket": pa.array([bucket], pa.int64())} | {c: v if c == "base" else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in new.items()})
        for x in range(0, len(first), PART):
            y = min(x + PART, len(first))
            ids = [flat[at[x] : at[y]] for flat, at in ((a, from_a), (b, from_b))]
            turns = np.stack((n_a[x:y], n_b[x:y]), axis=1).ravel()  # A's and B's tokens of a stretch follow each other: nearly the order of what comes
            first_of = np.cumsum(turns) - turns
            token = np.repeat(np.arange(len(turns)), turns) * LENGTH
            for side, known in enumerate((tool.size_a, tool.size_b)):
                token[spread(first_of[side::2], turns[side::2])] += known[ids[side]]
            token *= VOCABULARY
            for side in (0, 1):
                token[spread(first_of[side::2], turns[side::2])] += ids[side]
            yield row(base=pa.array([x], pa.int32()), n=pa.array(n[x:y]), token=pa.array(token))
        x = 0
        while x < len(docs):
            y = max(x + 1, int(np.searchsorted(bounds, bounds[x] + 8 * PART, "right")) - 1)
            lists = pa.ListArray.from_arrays(pa.array((bounds[x : y + 1] - bounds[x]).astype(np.int32)), pa.array(place[bounds[x] : bounds[y]]))
            yield row(doc_ids=docs[x:y], places=lists)
            x = y


def cut_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """bucket and either base, n, token (stretches from number ``base`` on) or doc_ids, places (texts); staged.

    ``n`` are the places of each stretch, ``token`` its tokens: unit, length and id in one number,
    a unit being the number of a stretch after ``base``, doubled and one more for B.  ``places``
    are the texts as stretches.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("alignment", pair.cache_clear)
        tool, bucket = pair(path_a, path_b), TaskContext.get().partitionId() << 32
        held = Batch(tool.beside)
        for whole in batches:
            for batch in slices(whole, "text", CUT):
                held.add(batch.column("doc_id"), batch.column("text"))
                if held.size >= TOGETHER:
                    yield from held.rows(bucket, tool)
                    bucket, held = bucket + 1, Batch(tool.beside)
        if held.ids:
            yield from held.rows(bucket, tool)

    schema = "bucket long, base int, n array<int>, token array<long>, doc_ids array<long>, places array<array<int>>"
    return bucketed(in_arrow(rows, run, schema), 4 * docs.rdd.getNumPartitions(), "texts")


def bucketed(df: DataFrame, n: int, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, in files by ``bucket`` that readers need not shuffle."""
    spark, table = df.sparkSession, f"vellum_{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", new_folder(spark, name))
    # numbers in order: their differences are packed; dictionaries would be filled and then given up
    writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v2")
    writer.bucketBy(max(1, min(n, 100_000)), "bucket").saveAsTable(table)
    return spark.table(table)


def unit_links(batches: DataFrame) -> DataFrame:
    """bucket, k, end, group, a, b, a_ends, b_ends, n: a row a link of each stretch k, its groups numbered from its end."""
    dealt = batches.filter("base is not null")
    running = lambda *order: Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the id and the places of its stretch share a column: rows are sorted twice, and come almost in order
    unit = F.expr(f"cast(token div {LENGTH * VOCABULARY} as int)")
    tokens = dealt.select("bucket", "base", "n", F.posexplode("token").alias("at", "token")).select("bucket", "at", (unit + 2 * F.col("base")).alias("unit"), (F.get("n", F.shiftright(unit, 1)).cast("long") * VOCABULARY + F.col("token") % VOCABULARY).alias("x"), F.expr(f"token div {VOCABULARY} % {LENGTH}").alias("size"))
    tokens = tokens.filter(F.col("x") >= VOCABULARY)  # the others are in altered texts only
    ends = tokens.select("bucket", "unit", "x", F.sum("size").over(running("bucket", "unit", "at")).cast("int").alias("end"))
    ends = ends.select("bucket", F.shiftright("unit", 1).alias("k"), (F.col("unit") % 2 == 0).alias("of_a"), "x", "end")
    back = running(*UNIT, F.desc("end"))  # from the last end on; the later row of an end, with both sides seen, has the tokens that cover a place
    there = Window.partitionBy(*UNIT).orderBy(F.desc("end"))
    cover = lambda own: F.last(F.when(own, (F.col("x") % VOCABULARY).cast("int")), ignorenulls=True).over(back)
    cuts = F.row_number().over(there) - F.dense_rank().over(there)  # rows less ends: the ends that both sides have
    met = ends.select(*UNIT, "end", cuts.alias("group"), cover(F.col("of_a")).alias("a"), cover(~F.col("of_a")).alias("b"), "of_a", F.lag("end").over(there).alias("before"), F.lead("end").over(there).alias("after"), F.expr(f"x div {VOCABULARY}").alias("n"))
    both = F.col("before").eqNullSafe(F.col("end"))
    once = met.filter(~F.col("after").eqNullSafe(F.col("end")))  # one row an end
    return once.select(*UNIT, "end", "group", "a", "b", (F.col("of_a") | both).alias("a_ends"), (~F.col("of_a") | both).alias("b_ends"), "n")


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, pair_n, best: links of each id pair in the corpus, and whether it is the most of its b; staged."""
    counts = stage(links.groupBy("a", "b").agg(F.sum("n").alias("pair_n")), "pairs")
    most = F.broadcast(counts.groupBy("b").agg(F.max("pair_n").alias("most")))  # as many rows as the vocabulary of B at most
    return counts.join(most, "b").select("a", "b", "pair_n", (F.col("pair_n") == F.col("most")).alias("best"))


@dataclass
class Alignment:
    """The tables of an alignment: batches of texts, links of their stretches, counts of id pairs."""

    batches: DataFrame
    links: DataFrame
    counts: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str) -> Alignment:
    """Links of all stretches of ``docs`` (doc_id, text) and the corpus-wide counts of id pairs."""
    batches = cut_texts(docs, path_a, path_b)
    links = bucketed(unit_links(batches), 4 * docs.rdd.getNumPartitions(), "links")
    return Alignment(batches, links, pair_counts(links))


def _groups(t: dict[str, np.ndarray], first: np.ndarray) -> list[str]:
    """The groups of each stretch as text; ``t``: links in order of stretch and end, ``first``: where stretches begin."""
    ends = np.flatnonzero(t["a_ends"] & t["b_ends"]) + 1  # a group ends where both do
    sides = []
    for side in ("a", "b"):
        there = np.flatnonzero(t[f"{side}_ends"])
        bounds = np.concatenate(([0], np.searchsorted(there, ends))).astype(np.int32)
        sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), pc.cast(pa.array(t[side][there]), pa.string())), ","))
    said = pc.binary_join_element_wise(*sides, "|")
    bounds = np.searchsorted(ends, np.append(first, len(t["k"])), "right").astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), said), ";").to_pylist()


def text_results(found: Alignment) -> DataFrame:
    """A row a text: the statistics and the digest of its groups."""
    texts = found.batches.filter("doc_ids is not null").select("bucket", "doc_ids", "places")
    links = found.links.join(sendable(found.counts), ["a", "b"]).select(F.col("bucket").alias("in_bucket"), "k", "end", "a", "b", "a_ends", "b_ends", "pair_n", "best")

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        sole("alignment_put")
        try:
            return assembled(left, right)
        finally:
            rest()

    return texts.groupBy("bucket").cogroup(links.groupBy("in_bucket")).applyInArrow(put, RESULT)


def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of one batch with the statistics and groups of their stretches."""
    t = {c: right.column(c).to_numpy() for c in right.column_names[1:]}
    place = (t["k"].astype(np.int64) << 32) - t["end"]
    # links are written by stretch and from the last end on: mostly they only have to be turned round
    order = slice(None, None, -1) if (place[1:] > place[:-1]).all() else np.argsort(place)[::-1]
    t = {c: v[order] for c, v in t.items()}
    first = np.flatnonzero(np.diff(t["k"], prepend=-1))
    groups = _groups(t, first)
    whole = {"n_a": t["a_ends"], "n_b": t["b_ends"], "n_groups": t["a_ends"] & t["b_ends"], "n_links": np.ones(len(place), bool), "n_best": t["best"], "count_sum": t["pair_n"]}
    stats = {c: np.add.reduceat(v.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for c, v in whole.items()}
    k = t["k"][first]
    at = np.zeros(int(k.max(initial=-1)) + 1, np.int64)
    at[k] = np.arange(len(k))
    out = []
    for ids, places in zip(*(left.column(c).combine_chunks() for c in ("doc_ids", "places")), strict=True):
        ids, places = ids.values, places.values
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64))))
        flat = at[places.flatten().to_numpy(zero_copy_only=False)]
        said = (";".join(map(groups.__getitem__, flat[x:y].tolist())) for x, y in pairwise(bounds.tolist()))
        digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
        sums = {c: np.diff(np.concatenate(([0], np.cumsum(v[flat])))[bounds]).astype(np.int64) for c, v in stats.items()}
        out.append(pa.table({"doc_id": ids, **sums, "groups_sha256": pa.array(digests, pa.string())}))
    return pa.concat_tables(out)


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    return text_results(align(docs, path_a, path_b))
