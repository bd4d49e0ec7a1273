"""Token counts by rank-synchronous merging of ragged arrays (operator 12).

A text is cut where no piece of the vocabulary can reach across: before a space that
follows another character, and between two characters that stand side by side in no piece.
The pre-tokens of a whole batch lie one after the other in one array of symbols.  In each
round every pre-token's pair of the lowest rank is merged, in all pre-tokens at once; those
without a pair are done, and what is left of them is counted.

Within a round a pre-token's pair is merged at all its places, from left to right, up to the
first one where the new symbol makes a pair of the same or a lower rank with a neighbour:
that one would be next, so the other places wait for a later round.  The result is that of
merging one place at a time.  A character without a piece counts as its UTF-8 bytes.

Words recur, so the counts of the stretches between spaces are kept in a bounded table; a
stretch is told from others by 128 bits of hash.

Defined results: a null text counts as empty and has no tokens; rows that repeat are counted
each; an empty table stays empty; every other column is kept, and an input column called
like an output column gives way to it.  Texts of any length are counted whole; memory
follows the longest text, time the longest stretch without a cut.  A model of another kind
(not BPE with byte fallback, or with a normalizer) is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import in_arrow, slices, sole, with_columns
from .staging import without
from .units import UnitTable, buffers, hashes, spread

#: What the models write for a space: fixed by their format.
MARK = "▁"
#: Bytes of text that are counted at a time.
TOGETHER = 1 << 20
#: The rank of a pair that cannot be merged.
NEVER = np.iinfo(np.int32).max


class PieceMerges:
    """The merges of a piece vocabulary as sorted arrays."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        """``pieces``: text and score of what merges may yield; equal scores share a rank."""
        ids = {p: k for k, (p, _) in enumerate(pieces)}
        for p, _ in pieces:  # characters that only stand within pieces
            for c in p:
                ids.setdefault(c, len(ids))
        self.known = len(pieces)
        self.texts = list(ids)
        #: After the symbols of ``ids``: characters of 1, 2, 3 and 4 bytes without a piece.
        self.foreign = len(ids) - 1
        self.base = len(ids) + 5
        self.weight = np.array([1 if k < self.known else len(c.encode()) for c, k in ids.items()] + [1, 2, 3, 4], np.int64)
        ranks = np.unique([-score for _, score in pieces], return_inverse=True)[1]
        pairs = [(ids[p[:k]] * self.base + ids[p[k:]], ids[p], ranks[ids[p]]) for p, _ in pieces for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        keys, merged, self.ranks = (np.array(x) for x in zip(*pairs, (-1, 0, NEVER), strict=True))  # the last entry is no pair
        self.merged, self.none = merged.astype(np.int32), len(keys) - 1
        self.shift = 64 - max(8, int(np.ceil(np.log2(len(keys) * 8))))
        self.slot_key, self.slot = np.full(1 << (64 - self.shift), -1, np.int64), np.full(1 << (64 - self.shift), self.none, np.int32)
        left = np.arange(self.none)
        at = self._hash(keys[left])
        while len(left):  # of several entries for a slot one stays, the others go on
            free = self.slot_key[at] < 0
            self.slot_key[at[free]], self.slot[at[free]] = keys[left[free]], left[free]
            left, at = (x[self.slot[at] != left] for x in (left, at))
            at = (at + 1) % len(self.slot)
        chars = sorted({c for p, _ in pieces for c in p})
        number = {c: k + 1 for k, c in enumerate(chars)}
        #: Number of a character in pieces, 0 for any other, and whether two stand side by side in one.
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p, _ in pieces:
            for x, y in pairwise(p):
                self.beside[number[x], number[y]] = True
        width = np.searchsorted([0x80, 0x800, 0x10000], np.arange(0x110000), "right")
        self.symbol = (self.foreign + 1 + width).astype(np.int32)
        for c, k in ids.items():
            if len(c) == 1:
                self.symbol[ord(c)] = k

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of each pair; the last one is none."""
        key = left.astype(np.int64) * self.base + right
        at = self._hash(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot[at], self.none)
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.slot)
            held = self.slot_key[at[todo]]
            found = held == key[todo]
            out[todo[found]] = self.slot[at[todo[found]]]
            todo = todo[~found & (held >= 0)]
        return out

    def pre_tokens(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``first`` (begins of stretches) with the places between characters that no piece holds side by side."""
        number = self.number[points]
        out = first.copy()
        out[1:] |= ~self.beside[number[:-1], number[1:]]
        return out

    def merge(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive and their places in the input; ``first`` marks the begins of pre-tokens."""
        place = np.arange(len(symbols))
        symbols = symbols.copy()
        entry = np.full(len(symbols), self.none)  # of the pair that each symbol begins
        entry[:-1] = np.where(first[1:], self.none, self.pairs(symbols[:-1], symbols[1:]))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = self.ranks[entry]
            starts = np.flatnonzero(first)
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(symbols)))
            done = low == NEVER
            if done.any():
                out.append((symbols[done], place[done]))
                symbols, place, first, entry, rank, low = (x[~done] for x in (symbols, place, first, entry, rank, low))
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == low)
            # of places that overlap every other one is merged, the left one first
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
            new = self.merged[entry[hit]]
            # the pairs that the new symbols make with what is on both sides of them
            chained = np.diff(hit, prepend=-9) == 2
            before = symbols[np.maximum(hit - 1, 0)]
            before[chained] = new[np.flatnonzero(chained) - 1]
            left = np.where(first[hit], self.none, self.pairs(before, new))
            chained &= ~first[hit]
            right = np.where(np.append(first, True)[hit + 2], self.none, self.pairs(new, symbols[np.minimum(hit + 2, len(symbols) - 1)]))
            stop = np.minimum(self.ranks[left], self.ranks[right]) <= low[hit]
            if stop.any():
                begin = np.flatnonzero(np.diff(np.cumsum(first)[hit], prepend=0))
                stops = np.cumsum(stop) - stop
                go = stops == np.repeat(stops[begin], np.diff(begin, append=len(hit)))
                hit, new, left, right, chained = (x[go] for x in (hit, new, left, right, chained))
            symbols[hit], entry[hit] = new, right
            inner = ~first[hit]
            entry[np.where(chained, hit - 2, hit - 1)[inner]] = left[inner]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, place, first, entry = (x[stay] for x in (symbols, place, first, entry))
        if not out:
            return symbols, place
        symbols, place = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(place, kind="stable")
        return symbols[order], place[order]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin: at texts, and at spaces that follow neither a space nor the mark for one."""
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces > 0]
    after = data[spaces - 1]
    good = after != 32
    odd = np.flatnonzero(after == 0x81)
    if len(odd):  # the last byte of the mark
        at = spaces[odd]
        good[odd] = (data[at - 2] != 0x96) | (data[at - 3] != 0xE2)
    begins[spaces[good]] = True
    return np.flatnonzero(begins[:-1])


class PieceCounter:
    """Token counts of texts under a model; stretches that were met before are looked up."""

    def __init__(self, path: str, size: int = 700_000) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as model

        spec = model.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = model.ModelProto.SentencePiece
        norm, kind = spec.normalizer_spec, spec.trainer_spec
        odd = {p.type for p in spec.pieces} - {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
        if kind.model_type != 2 or not kind.byte_fallback or kind.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or odd:
            raise ValueError(f"{path}: not a plain piece BPE model with byte fallback")
        self.merges = PieceMerges([(p.piece, p.score) for p in spec.pieces if p.type == kinds.NORMAL])
        self.library = SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.table = UnitTable(np.dtype(np.int64), size)

    def learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each stretch (its bytes, a leading space included)."""
        flat = data[spread(starts, sizes)]
        ends = np.cumsum(sizes)
        head = (flat & 0xC0) != 0x80
        head[ends - sizes] = True
        points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").replace(" ", MARK).encode("utf-32-le"), np.uint32)
        lengths = np.add.reduceat(head.astype(np.int64), ends - sizes)
        if lengths.sum() != len(points):
            raise ValueError("a text is not UTF-8")
        symbols = self.merges.symbol[points]
        bounds = np.cumsum(lengths) - lengths
        first = np.zeros(len(symbols), bool)
        first[bounds] = True
        left, place = self.merges.merge(symbols, self.merges.pre_tokens(points, first))
        return np.add.reduceat(self.merges.weight[left], np.searchsorted(place, bounds))

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column."""
        column = pc.fill_null(column, "")
        wide = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise("", column, " "))  # the model begins each text with a space
        data, offsets = buffers(wide)
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        starts = word_starts(data, offsets)
        sizes = np.diff(starts, append=len(data))
        one, two = hashes(data, starts, sizes)
        table = self.table
        if table.used + len(starts) > table.size and len(np.unique(one)) + table.used > table.size:  # the worst case does not fit
            table.clear()
        entry = table.find(one, two)
        missing = np.flatnonzero(entry < 0)
        while len(missing):
            _, at = np.unique(one[missing], return_index=True)
            new = missing[at]
            if len(new) > table.size:
                self.table = table = UnitTable(table.dtype, 2 * len(new))
            table.add(one[new], two[new], self.learn(data, starts[new], sizes[new]), np.ones(len(new), np.int32))
            entry[missing] = table.find(one[missing], two[missing])
            missing = missing[entry[missing] < 0]
        total = np.concatenate(([0], np.cumsum(table.ids[table.start[entry]])))
        return np.diff(total[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=1)
def counter(path: str) -> PieceCounter:
    """One counter a worker process."""
    return PieceCounter(path)


def count_tokens(df: DataFrame, model: str, limit: int, text: str = "text") -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens under the piece model at ``model`` and over_limit (more than ``limit`` tokens)."""
    base = without(df, "n_bytes", "n_tokens", "over_limit")
    keep = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("token_counts", counter.cache_clear)
        tool = counter(model)
        for whole in batches:
            for batch in slices(whole, text, TOGETHER):
                n = tool.count(batch.column(text))
                size = pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64())
                yield with_columns(batch, keep, {"n_bytes": size, "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return in_arrow(base, run, T.StructType([*base.schema.fields, *new]))
