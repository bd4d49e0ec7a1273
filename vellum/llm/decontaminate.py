"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 10).

An item of n words is found where its best alignment by words (Smith-Waterman with linear gap
costs) has at least the part ``least`` of the score of a whole copy.  What seeds an alignment
follows from that bound alone.  With M words matched and E edits, 2M - E >= 2n least; the
matches fall into E + 1 runs at most, so at least M - E - 1 >= (2 least - 1) n - 1 pairs of
neighbouring words are shared, wherever the edits are; and M >= n least words are.  So an item
shares T of its word pairs, or where that bound is no use (short items, low bounds), T of its
words.  The pairs of an item are ordered by their count in the corpus, the rarest first: any T
of N hold j of the N - T + j rarest, so these are the seeds, and j of them (``LEAST_SEEDS`` at
most) have to stand on near diagonals, whose distance is bounded by E.  Nothing is lost
by leaving out the most frequent pairs, and nothing depends on how often a passage is copied.

Around such seeds, a stretch of the document that is wide enough for all edits is aligned with
the item, if it holds n least of the item's words, without which the score can't be reached.

The items are a query set: they are taken in blocks of ``BLOCK_WORDS`` words, each block
broadcast to all tasks as a few arrays, whatever the size of the benchmark; each block reads
the documents twice, once to count its pairs.  Documents are not shuffled.  Alignments use the
text around seeds, not the document, so their cost does not grow with the document.

Words are runs of letters and digits, A-Z lower-cased.

Defined results: null or empty texts and items have no words and match nothing; items that
repeat are matched each; documents that repeat are matched each; of alignments with the same
score the first stays; seeds of the same count are ordered by place; null ids are matched like
others; empty tables give an empty result; other columns are kept by :func:`drop_leaks` and
not read by :func:`find_leaks`, whatever they are called; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_arrow, slices, sole
from .textunits import ALNUM, gram_hashes, inside, mix, word_hashes
from .units import spread

#: Scores of the alignment, in words.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items that are held by every task at a time.
BLOCK_WORDS = 2_000_000
#: Seeds that have to stand together, where an item has that many to share.
LEAST_SEEDS = 3


def normal(text: str | None) -> bytes:
    """Words of a text joined by one space."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(ALNUM).split())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word arrays: score, and where it starts and ends in ``b``."""
    n, m = len(a), len(b)
    score, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    steps = np.arange(m + 1) * -GAP
    for i in range(n):
        diagonal = score[:-1] + np.where(b == a[i], MATCH, MISMATCH)
        up = score[1:] + GAP
        now = np.zeros(m + 1, np.int64)
        from_ = np.arange(m + 1)
        take = diagonal > np.maximum(up, 0)
        now[1:] = np.maximum(np.maximum(diagonal, up), 0)
        from_[1:] = np.where(take, start[:-1], np.where(up > 0, start[1:], from_[1:]))
        # gaps along the row: the best earlier cell less its distance
        lifted = now + steps
        peak = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == peak, np.arange(m + 1), 0))
        by_gap = peak - steps > now
        from_ = np.where(by_gap, from_[at], from_)
        now = np.maximum(now, peak - steps)
        score, start = now, from_
        top = int(now.argmax())
        if now[top] > best[0]:
            best = (int(now[top]), int(start[top]), top)
    return best


def shared(n: int, least: float) -> tuple[int, int]:
    """(words of a seed, seeds that any alignment shares) for an item of ``n`` words."""
    pairs = math.ceil((2 * least - 1) * n - 1 - 1e-9)
    return (2, pairs) if pairs >= 1 else (1, max(1, math.ceil(n * least - 1e-9)))


class Items:
    """One block of the benchmark: word hashes and seeds in order of their hash."""

    def __init__(self, rows: list[tuple[int, bytes]], least: float) -> None:
        self.ids, self.least = [i for i, _ in rows], least
        self.hashes, self.offsets = word_hashes([t for _, t in rows])
        grams, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        self.share = np.zeros(len(rows), np.int64)
        self.sizes = np.diff(self.offsets)
        for k in range(len(rows)):
            words = self.words(k)
            if len(words):
                size, self.share[k] = shared(len(words), least)
                grams.append(mix(words) if size == 1 else gram_hashes(words, size))  # told from the hashes of pairs
                item.append(np.full(len(grams[-1]), k, np.int32))
                place.append(np.arange(len(grams[-1]), dtype=np.int32))
        self._hold(np.concatenate(grams), np.concatenate(item), np.concatenate(place))
        self.need = np.ones(len(rows), np.int64)

    def _hold(self, flat: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(flat, kind="stable")
        self.seeds, self.item, self.place = flat[order], item[order], place[order]
        #: Is a hash a seed?  A bit map answers most questions.
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def rarest(self, counts: dict[int, int]) -> Items:
        """The same items with the rarest seeds only, by the count of each hash (as a signed number) in the corpus."""
        out = copy(self)
        found = np.array([counts.get(x, 0) for x in self.seeds.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.place, found, self.item))
        first = np.searchsorted(self.item[order], self.item[order], "left")
        total = np.bincount(self.item, minlength=len(self.ids))
        out.need = np.clip(self.share, 1, LEAST_SEEDS)
        kept = order[np.arange(len(order)) - first < (total - self.share + out.need)[self.item[order]]]
        out._hold(self.seeds[kept], self.item[kept], self.place[kept])
        return out

    def grams(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where seeds stand in texts, and the range of the seeds, by their length."""
        for n in (1, 2):
            at, low, high = self.find(mix(words) if n == 1 else gram_hashes(words, n))
            inner = inside(offsets, n, len(words))[at]
            yield at[inner], low[inner], high[inner]

    def words(self, k: int) -> np.ndarray:
        return self.hashes[self.offsets[k] : self.offsets[k + 1]]

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``grams`` are seeds, and the range of their seeds."""
        at = np.flatnonzero(self.bits[(grams >> np.uint64(42)).astype(np.int64)])
        low, high = np.searchsorted(self.seeds, grams[at], "left"), np.searchsorted(self.seeds, grams[at], "right")
        known = np.flatnonzero(high > low)
        return at[known], low[known], high[known]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document and item that it holds: key, item_id, score (0 to 1), first_word, last_word."""
    spark = docs.sparkSession
    out = None

    def search(items: Items) -> DataFrame:
        block = spark.sparkContext.broadcast(items)
        schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, item_id long, score double, first_word long, last_word long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sole("decontaminate")
            for whole in batches:
                for batch in slices(whole, text):
                    found = list(leaks([normal(t) for t in batch.column(text).to_pylist()], block.value))
                    if found:
                        rows, item, score, first, last = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(key).take(pa.array(rows)), pa.array(item, pa.int64()), pa.array(score), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                            [key, "item_id", "score", "first_word", "last_word"],
                        )

        return in_arrow(docs.select(key, text), run, schema)

    for items in _blocks(benchmark, least):
        found = search(rare_seeds(docs, items, text))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else search(Items([], least))


def rare_seeds(docs: DataFrame, items: Items, text: str = "text") -> Items:
    """``items`` with the seeds that are rarest in ``docs``; the driver gets a count a seed of the block."""
    block = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("decontaminate")
        own, total = block.value, None
        for whole in batches:
            for batch in slices(whole, text):
                words, offsets = word_hashes([normal(t) for t in batch.column(text).to_pylist()])
                total = np.zeros(len(own.seeds), np.int64) if total is None else total
                for _, low, _ in own.grams(words, offsets):
                    total += np.bincount(low, minlength=len(total))  # at the first seed of a hash
        if total is not None and total.any():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own.seeds[some].view(np.int64)), pa.array(total[some])], ["h", "n"])

    counts = in_arrow(docs.select(text), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return items.rarest({r["h"]: r["n"] for r in counts.toLocalIterator()})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a test item; rows are judged where they are read, without a join."""
    out = docs
    for items in _blocks(benchmark, least):
        out = _clean(out, rare_seeds(docs, items, text), text)
    return out


def _clean(docs: DataFrame, items: Items, text: str) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("decontaminate")
        for whole in batches:
            for batch in slices(whole, text):
                good = np.ones(batch.num_rows, bool)
                for k, *_ in leaks([normal(t) for t in batch.column(text).to_pylist()], block.value):
                    good[k] = False
                yield batch.filter(pa.array(good))

    return in_arrow(docs, run, docs.schema)


def _blocks(benchmark: DataFrame, least: float) -> Iterator[Items]:
    """The items in blocks of a fixed number of words (one item at least)."""
    block: list[tuple[int, bytes]] = []
    held = 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = normal(r[1])
        block.append((r[0], words))
        held += words.count(b" ") + 1
        if held >= BLOCK_WORDS:
            yield Items(block, least)
            block, held = [], 0
    if block:
        yield Items(block, least)


def leaks(texts: list[bytes], items: Items) -> Iterator[tuple]:
    """(text, item id, score, first word, last word) of every item that a text in normal form holds."""
    words, offsets = word_hashes(texts)
    owner, item, start = [], [], []
    for at, low, high in items.grams(words, offsets):
        seeds = spread(low, high - low)
        at = np.repeat(at, high - low)
        text = np.searchsorted(offsets, at, "right") - 1
        owner.append(text)
        item.append(items.item[seeds])
        start.append(at - offsets[text] - items.place[seeds])  # where the item would begin
    owner, item, start = np.concatenate(owner), np.concatenate(item), np.concatenate(start)
    order = np.lexsort((start, item, owner))
    owner, item, start = owner[order], item[order], start[order]
    # enough seeds have to begin within the edits that an alignment can have
    edits = np.floor((2 - 2 * items.least) * items.sizes + 1e-9).astype(np.int64)
    last = np.arange(len(order)) + items.need[item] - 1
    held = np.minimum(last, len(order) - 1)
    good = (last < len(order)) & (owner[held] == owner) & (item[held] == item)
    good &= start[held] - start <= edits[item]
    owner, item, start = owner[good], item[good], start[good]
    cuts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])))) if len(owner) else owner
    for a, b in pairwise([*cuts.tolist(), len(owner)] if len(owner) else []):
        k, own = int(owner[a]), int(item[a])
        query, text = items.words(own), words[offsets[k] : offsets[k + 1]]
        n, wide = len(query), int(edits[own])
        best = (0, 0, 0)
        done = None
        for s in start[a:b].tolist():  # neighbours share a stretch
            if done is not None and s <= done:
                continue
            done = s + n // 4
            first, last_ = max(0, s - wide), min(len(text), s + n + 2 * wide + n // 4 + 1)
            if np.isin(query, text[first:last_]).sum() < items.least * n:
                continue  # each word of the item matches once at most
            score, x, y = align(query, text[first:last_])
            if score > best[0]:
                best = (score, first + x, first + y)
        part = best[0] / (MATCH * n)
        if part >= items.least:
            yield k, items.ids[own], part, best[1], best[2] - 1
