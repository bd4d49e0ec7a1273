"""Words, word hashes and n-gram hashes of many texts at once, in numpy.

A text is first put in normal form: words joined by one space.  The hash of a word is a
polynomial over a table of random 64-bit values, taken from prefix sums modulo 2**64 and
mixed; an n-gram's hash is a polynomial over the hashes of its words.  All of it is a few
array operations a byte, in blocks, so that a text of any length fits.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text whose prefix sums are held at a time.
BLOCK = 2 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = _U(0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Letters and digits stay (A-Z in lower case), other ASCII separates words, non-ASCII stays.
ALNUM = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: A-Z in lower case, nothing else.
LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    held = _powers.get(0)
    if held is None or len(held[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _P), np.full(size, _PINV)
        up[0] = down[0] = 1
        held = _powers[0] = np.cumprod(up), np.cumprod(down)
    return held


def _hash_block(block: bytes) -> np.ndarray:
    """Hashes of the words of a block in normal form."""
    b = np.frombuffer(block, np.uint8)
    up, down = _tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    gaps = np.flatnonzero(b == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(b)]))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in normal form, one after the other, and where each text starts (and the end)."""
    counts = [t.count(b" ") + 1 if t else 0 for t in texts]
    offsets = np.cumsum([0, *counts], dtype=np.int64)
    joined = b" ".join([t for t in texts if t])
    if not joined:
        return np.zeros(0, np.uint64), offsets
    out, at = [], 0
    while at < len(joined):
        end = len(joined)
        if end - at > BLOCK:
            cut = joined.rfind(b" ", at, at + BLOCK)
            end = cut if cut > at else joined.find(b" ", at + BLOCK)
            end = len(joined) if end < 0 else end
        out.append(_hash_block(joined[at:end]))
        at = end + 1
    return np.concatenate(out), offsets


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; the last ``n - 1`` places are left out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total, size, power, have, q = None, 1, words, 0, _Q
    while True:  # doubling: hashes of 1, 2, 4, ... words, put together by the bits of n
        if n & size:
            if total is None:
                total, have = power, size
            else:
                m = min(len(total), len(power) - have)
                total = total[:m] + _U(pow(int(_Q), have, 1 << 64)) * power[have : have + m]
                have += size
        size *= 2
        if size > n:
            break
        half = size // 2
        power = power[:-half] + q * power[half:]
        q = _U(int(q) * int(q) & 0xFFFFFFFFFFFFFFFF)
    return mix(total[: len(words) - n + 1])


def inside(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the ``total - n + 1`` places start an n-gram within one text."""
    good = np.ones(max(0, total - n + 1), bool)
    ends = offsets[1:]
    for k in range(1, n):
        bad = ends - k
        bad = bad[(bad >= 0) & (bad < len(good))]
        good[bad] = False
    return good
