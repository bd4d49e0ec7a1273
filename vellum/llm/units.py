"""Token ids of many texts at once, through a table of the units that were met before.

A byte-level pre-tokenizer always cuts before a space that follows a visible character, so
a text falls into pieces there, and the bytes of a piece alone decide its tokens.  A piece
of plain letters, digits and marks is cut further, where its pre-tokens meet; any other
piece (apostrophes, inner white space, rare scripts, special tokens) stays one unit.  Units
are found, hashed and looked up by array operations on the bytes of a batch; only units
that are not in the table are tokenized, each once.

Units are told apart by 128 bits of hash.  The table starts anew when it is full, so memory
is bounded whatever the number of different words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens of byte-level vocabularies of this kind: fixed by the tokenizer file's format.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Units of more bytes are not kept by their position hash.
LONG = 2048

_U = np.uint64
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 1 << 63, LONG + 1, dtype=np.uint64) * _U(2) + _U(1)
_ODD = _U(0x9E3779B97F4A7C15)

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _kinds() -> np.ndarray:
    """What each byte can be a part of; two-byte letters of Latin and Cyrillic count as letters."""
    out = np.full(256, OTHER, np.uint8)
    out[33:127] = MARK
    out[32] = SPACE
    out[ord("'")] = OTHER
    for c in range(128):
        if chr(c).isalnum():
            out[c] = DIGIT if chr(c).isdigit() else LETTER
    out[0x80:0xC0] = LETTER  # goes with the byte before it
    out[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = LETTER
    return out


_KIND = _kinds()
#: The last bytes of white space beyond ASCII, after which a space is no safe cut.
_BLANK_END = np.zeros(256, bool)
_BLANK_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def cut(data: np.ndarray, offsets: np.ndarray, special: list[bytes] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where units start in the texts of ``data``, whether each is a single pre-token, and the first unit of each text (and the end)."""
    n = len(data)
    kind = _KIND[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # of an empty text: also the next one's begin
    spaces = np.flatnonzero(data == 32)
    before = data[spaces - 1]
    safe = before > 32
    odd = np.flatnonzero((before >= 0x80) & _BLANK_END[before])
    if len(odd):
        at = spaces[odd]
        two, three = data[at - 2], data[at - 3]
        safe[odd] = ~((two == 0xC2) | (((two == 0x80) | (two == 0x81) | (two == 0x9A)) & (three >= 0xE1) & (three <= 0xE3)))
    inner = spaces[~safe]
    begins[spaces[safe]] = True
    begins = begins[:n]
    starts = np.flatnonzero(begins)
    # pieces that are not plain
    rough = [np.flatnonzero(kind == OTHER), inner[~begins[inner]]]
    sign = np.flatnonzero(data[:-1] == 0xC3)
    rough.append(sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)])
    whole = data.tobytes() if special else b""
    for s in special:
        at = whole.find(s)
        while at >= 0:
            rough.append(np.array([at]))
            at = whole.find(s, at + 1)
    plain = np.ones(len(starts), bool)
    plain[np.searchsorted(starts, np.concatenate(rough), "right") - 1] = False
    sizes = np.diff(starts, append=n)
    # pre-tokens of plain pieces
    change = np.zeros(n, bool)
    if n:
        change[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        change &= np.repeat(plain, sizes)
        change |= begins
    units = np.flatnonzero(change)
    single = plain[np.cumsum(begins)[units] - 1] if len(units) else np.zeros(0, bool)
    return units, single, np.searchsorted(units, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each unit; units follow each other in ``data`` without gaps."""
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    x = _BYTE[data] * _PLACE[np.minimum(place, LONG)]
    one = np.add.reduceat(x, starts)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    two = np.add.reduceat(x, starts)
    one = (one ^ (one >> _U(31))) * _ODD + sizes.astype(np.uint64)
    for k in np.flatnonzero(sizes > LONG).tolist():
        digest = hashlib.blake2b(data[starts[k] : starts[k] + sizes[k]].tobytes(), digest_size=16).digest()
        one[k], two[k] = np.frombuffer(digest, np.uint64)
    return one, two


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


class UnitTable:
    """Units by hash, with their ids in one array."""

    def __init__(self, dtype: np.dtype, size: int) -> None:
        self.dtype, self.size = dtype, size
        self.bits = max(8, int(np.ceil(np.log2(size * 2))))
        self.clear()

    def clear(self) -> None:
        """Forget everything."""
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.one, self.two = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
        self.start, self.count = np.zeros(self.size, np.int64), np.zeros(self.size, np.int32)
        self.ids = np.zeros(4 * self.size, self.dtype)
        self.used = self.ids_used = 0

    def _at(self, one: np.ndarray) -> np.ndarray:
        return ((one * _ODD) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The entry of each unit, or -1."""
        at = self._at(one)
        out = self.slot[at]
        todo = np.flatnonzero((out >= 0) & ((self.one[out] != one) | (self.two[out] != two)))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slot) - 1)
            held = self.slot[at[todo]]
            out[todo] = held
            todo = todo[(held >= 0) & ((self.one[held] != one[todo]) | (self.two[held] != two[todo]))]
        return out

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New entries; none of them is known, and no two are equal."""
        n, total = len(one), len(ids)
        if self.ids_used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(total, len(self.ids)), self.dtype)))
        new = np.arange(self.used, self.used + n, dtype=np.int32)
        self.one[new], self.two[new], self.count[new] = one, two, counts
        self.start[new] = self.ids_used + np.cumsum(counts) - counts
        self.ids[self.ids_used : self.ids_used + total] = ids
        self.used, self.ids_used = self.used + n, self.ids_used + total
        at = self._at(one)
        while len(new):
            free = self.slot[at] < 0
            self.slot[at[free]] = new[free]  # of several for a slot one stays
            left = self.slot[at] != new
            new, at = new[left], (at[left] + 1) & (len(self.slot) - 1)


#: Tokenizes units: (bytes, starts, sizes, whether each is one pre-token) to ids and counts.
Learn = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class UnitEncoder:
    """Ids of texts by a table of units; ``learn`` tokenizes those that are not in it."""

    def __init__(self, learn: Learn, dtype: np.dtype, special: list[bytes] = (), size: int = 700_000) -> None:
        self.learn, self.special, self.table = learn, special, UnitTable(dtype, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts between ``offsets``, one after the other, and where each text's begin (and the end)."""
        table = self.table
        if not len(data):
            return np.zeros(0, table.dtype), np.zeros(len(offsets), np.int64)
        starts, single, firsts = cut(data, offsets, self.special)
        sizes = np.diff(starts, append=len(data))
        one, two = hashes(data, starts, sizes)
        if table.used + len(starts) > table.size:  # the worst case may not fit
            if len(np.unique(one)) + table.used > table.size:
                table.clear()
        entry = table.find(one, two)
        missing = np.flatnonzero(entry < 0)
        while len(missing):
            _, first = np.unique(one[missing], return_index=True)
            new = missing[first]
            if len(new) > table.size:
                self.table = table = UnitTable(table.dtype, 2 * len(new))
            table.add(one[new], two[new], *self.learn(data, starts[new], sizes[new], single[new]))
            entry[missing] = table.find(one[missing], two[missing])
            missing = missing[entry[missing] < 0]
        counts = table.count[entry]
        ids = table.ids[spread(table.start[entry], counts)]
        return ids, np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[firsts]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, body = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def texts_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
    """The bytes of each unit."""
    ends = np.cumsum(sizes)
    joined = data[spread(starts, sizes)].tobytes()
    for a, b in pairwise([0, *ends.tolist()]):
        yield joined[a:b]
