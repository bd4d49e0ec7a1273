"""BPE encoding and decoding through a tokenization automaton (operator 9).

``encode`` adds the token ids of a text column, ``decode`` turns ids back into text.  The
merges are compiled once a Python worker into a :class:`MergeAutomaton`; words are encoded
by its tables, many side by side, and kept in a bounded table, since words recur.

Defined results: a null text counts as empty and has no ids; null ids decode to an empty
text; rows that repeat are encoded each; an empty table stays empty; every other column is
kept, and an input column called like an output column gives way to it.  Texts of any
length are encoded whole; memory follows the longest text, words over ``WIDE`` bytes take a
path of their own through the same tables.  A tokenizer file of another kind is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import in_arrow, slices, sole, with_columns
from .bpe_automaton import MergeAutomaton
from .staging import without
from .units import PRE_TOKEN, UnitEncoder, buffers, spread, texts_of

#: Bytes of text that are encoded at a time.
TOGETHER = 1 << 20


class Codec:
    """Texts to ids and back, with one automaton and one table of units."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or odd:
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer {odd}")
        added = spec.get("added_tokens") or []
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in added):
            raise ValueError(f"{path}: special tokens that take spaces are not supported")
        self.automaton = MergeAutomaton.from_file(path)
        self.special = {x["content"]: int(x["id"]) for x in added}
        self.automaton.label({i: text.encode() for text, i in self.special.items()})
        self.dtype = np.dtype(np.uint16 if len(self.automaton.labels) <= 1 << 16 else np.uint32)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.units = UnitEncoder(self._learn, self.dtype, [x.encode() for x in self.special])

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units: their pre-tokens go through the automaton together."""
        plain, rough = np.flatnonzero(single), np.flatnonzero(~single)
        words: list[bytes] = []
        parts: list[list[int]] = []  # of a rough unit: a word's number, or a special token's id less 1, negative
        for unit in texts_of(data, starts[rough], sizes[rough]):
            text, own = unit.decode("utf-8", "replace"), []
            for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
                if k % 2:
                    own.append(-1 - self.special[piece])
                else:
                    found = self.pre_token.findall(piece)
                    own += range(len(words), len(words) + len(found))
                    words += [w.encode() for w in found]
            parts.append(own)
        held = np.concatenate((data[spread(starts[plain], sizes[plain])], np.frombuffer(b"".join(words), np.uint8)))
        ids, counts = self.automaton.encode_flat(held, np.concatenate((sizes[plain], np.fromiter(map(len, words), np.int64, len(words)))))
        if not len(rough):
            return ids.astype(self.dtype), counts
        ends = np.cumsum(counts)
        n = len(plain)
        out: list[np.ndarray] = []
        for own in parts:
            out.append(np.concatenate([[-1 - k] if k < 0 else ids[ends[n + k] - counts[n + k] : ends[n + k]] for k in own]) if own else ids[:0])
        total = np.zeros(len(sizes), np.int64)
        total[plain], total[rough] = counts[:n], [len(x) for x in out]
        first = np.cumsum(total) - total
        both = np.zeros(int(total.sum()), self.dtype)
        both[spread(first[plain], counts[:n])] = ids[: int(counts[:n].sum())]
        both[spread(first[rough], total[rough])] = np.concatenate(out)
        return both, total

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a column, one after the other, and where each text's begin (and the end)."""
        return self.units.encode(*buffers(column))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of the ids between ``offsets``, special tokens included."""
        data, ends = self.automaton.decode_flat(ids)
        bounds = ends[offsets]
        body = data.tobytes()
        whole = bounds[-1] < 1 << 31 and not ((data[bounds[:-1][bounds[:-1] < len(data)]] & 0xC0) == 0x80).any()
        if whole:
            try:
                body.decode("utf-8")
            except UnicodeDecodeError:
                whole = False
        if whole:
            return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body))
        return pa.array([body[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One codec a worker process."""
    return Codec(path)


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` as an array of ints."""
    base = without(df, ids)
    keep = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("bpe", codec.cache_clear)
        tool = codec(tokenizer)
        for whole in batches:
            for batch in slices(whole, text, TOGETHER):
                yield with_columns(batch, keep, {ids: _lists(*tool.encode(batch.column(text)))})

    return in_arrow(base, run, T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that the array ``ids`` stands for."""
    base = without(df, decoded)
    keep = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("bpe", codec.cache_clear)
        tool = codec(tokenizer)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                column = batch.column(ids)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield with_columns(batch, keep, {decoded: tool.decode(flat, np.cumsum([0, *sizes]))})

    return in_arrow(base, run, T.StructType([*base.schema.fields, T.StructField(decoded, T.StringType())]))


def recode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass, so that a task has one Python worker and one automaton."""
    base = without(df, ids, decoded)
    keep = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("bpe", codec.cache_clear)
        tool = codec(tokenizer)
        for whole in batches:
            for batch in slices(whole, text, TOGETHER):
                flat, offsets = tool.encode(batch.column(text))
                yield with_columns(batch, keep, {ids: _lists(flat, offsets), decoded: tool.decode(flat, offsets)})

    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    return in_arrow(base, run, T.StructType([*base.schema.fields, *new]))
