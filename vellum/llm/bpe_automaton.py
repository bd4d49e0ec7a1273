"""A deterministic automaton that accepts just the token sequences BPE produces.

The automaton starts with one state that loops on every byte token.  Each merge (u, v)
then adds one gadget: the state entered by u is copied without its v-transition, u leads
to the copy, and wherever u could be read the merged token uv can be read as well,
leading where v led.  Two facts keep this small:

* every transition on a token t leads to one state, ``after[t]``, so a transition table is
  a yes/no matrix of states by tokens;
* a copy differs from its original in one entry, and the column of a merged token equals
  the column of its left part at that moment.

So the matrix is kept as its history (parent and birth of each state, left part and birth
of each token, and one removal per merge), and an entry is found by walking that history
back.  All arrays together take a few MB for 50,000 merges.

A word has exactly one accepted path that spells it.  Because every prefix of a correct
tokenization is one, each byte position has exactly one state as well: the path is found
left to right by table look-ups, without search.
"""

from __future__ import annotations

import json
from itertools import pairwise

import numpy as np

from .units import spread

#: Words of more bytes than this go one by one through the same tables.
WIDE = 200
#: Answers of the automaton that are kept: two to this power.
MEMO = 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Table:
    """A fixed hash table of 64-bit keys for whole arrays of look-ups."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]  # of several keys for a slot one stays
            won = self.keys[at] == keys[todo]
            self.values[at[won]] = values[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def as_dict(self) -> dict[int, int]:
        """All entries, for single look-ups; made when first wanted."""
        if not hasattr(self, "held"):
            some = np.flatnonzero(self.keys >= 0)
            self.held = dict(zip(self.keys[some].tolist(), self.values[some].tolist(), strict=True))
        return self.held

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out


class MergeAutomaton:
    """Compiled from a vocabulary and ranked merges of byte-level BPE."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        alphabet = byte_alphabet()
        size = max(vocab.values()) + 1
        self.size = size
        #: The arc label of each token.
        self.labels: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.labels[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
        self.left = np.full(size, -1, np.int32)
        self.token_birth = np.full(size, -1, np.int32)
        self.after = np.full(size, -1, np.int32)
        base = [vocab[c] for c in alphabet if c in vocab]
        self.after[base] = 0
        self._gadgets([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges if a + b in vocab], len(base))
        live = [i for i in range(size) if self.after[i] >= 0 and self.labels[i]]
        self._trie(live)
        self.widths = np.fromiter(map(len, self.labels), np.int64, size)
        self.label({})
        self.memo_keys = np.full(1 << MEMO, -1, np.int64)
        self.memo = np.zeros(1 << MEMO, bool)

    @classmethod
    def from_file(cls, path: str) -> MergeAutomaton:
        """From the JSON file of a byte-level BPE tokenizer."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges)

    def _gadgets(self, merges: list[tuple[int, int, int]], n_base: int) -> None:
        """One gadget a merge, in rank order."""
        after, left, birth = self.after.tolist(), self.left.tolist(), self.token_birth.tolist()
        parent, state_birth, entered = [-1], [-1], [n_base + 1]  # the start counts as an entry: it is never altered
        removed: dict[int, int] = {}
        size = self.size

        def allowed(p: int, x: int, at: int) -> bool:
            while True:
                gone = removed.get(p * size + x)
                if gone is not None and gone <= at:
                    return False
                if birth[x] >= state_birth[p]:
                    if left[x] < 0:
                        return True
                    at, x = birth[x], left[x]
                else:
                    at, p = state_birth[p], parent[p]

        for rank, (u, v, w) in enumerate(merges):
            if after[u] < 0 or after[v] < 0 or after[w] >= 0 or not allowed(after[u], v, rank):
                continue  # no correct sequence has this pair any more
            after[w], left[w], birth[w] = after[v], u, rank
            entered[after[v]] += 1
            q = after[u]
            if entered[q] > 1:
                entered[q] -= 1
                parent.append(q)
                state_birth.append(rank)
                entered.append(1)
                q = after[u] = len(parent) - 1
            removed[q * size + v] = rank
        self.after, self.left, self.token_birth = (np.array(x, np.int32) for x in (after, left, birth))
        self.parent, self.state_birth = np.array(parent, np.int32), np.array(state_birth, np.int32)
        self.removed = _Table(np.fromiter(removed, np.int64, len(removed)), np.fromiter(removed.values(), np.int32, len(removed)))

    def _trie(self, live: list[int]) -> None:
        """The labels as a table node * 256 + byte -> node; spelled: node -> token."""
        edges: dict[int, int] = {}
        spelled = [-1]
        for i in live:
            node = 0
            for b in self.labels[i]:
                key = node * 256 + b
                child = edges.get(key)
                if child is None:
                    child = edges[key] = len(spelled)
                    spelled.append(-1)
                node = child
            spelled[node] = i
        firsts = {edges[b] for b in range(256) if b in edges}
        if len(firsts) < 256:
            raise ValueError("a byte-level vocabulary has a token for every byte")
        self.edge = _Table(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.spelled = np.array(spelled, np.int32)
        # the first two levels as plain tables
        self.roots = np.array([edges.get(b, 0) for b in range(256)], np.int32)
        self.pairs = np.full((int(self.roots.max()) + 1, 256), -1, np.int32)
        for key, child in edges.items():
            if key >= 256 and key >> 8 in firsts:
                self.pairs[key >> 8, key & 255] = child

    def allowed(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has a transition on each token; recent answers are kept."""
        keys = states.astype(np.int64) * self.size + tokens
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO)).astype(np.int64)
        known = self.memo_keys[slot] == keys
        out = self.memo[slot]
        if not known.all():
            ask = np.unique(keys[~known])
            p, x = ask // self.size, ask % self.size
            answer = self._walk(p, x)
            new = np.flatnonzero(~known)
            out[new] = answer[np.searchsorted(ask, keys[new])]
            where = slot[new]
            self.memo_keys[where] = keys[new]
            self.memo[where] = out[new]
            # two keys that want one slot: keep the pair that was written last
            stale = self.memo_keys[where] != keys[new]
            if stale.any():
                at = where[stale]
                self.memo_keys[at] = -1
        return out

    def _walk(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(p), bool)
        idx = np.arange(len(p))
        at = np.full(len(p), np.iinfo(np.int32).max, np.int64)
        p, x = p.astype(np.int64), x.astype(np.int64)
        while len(idx):
            gone = self.removed.get(p * self.size + x)
            dead = (gone >= 0) & (gone <= at)
            out[idx[dead]] = False
            by_token = self.token_birth[x] >= self.state_birth[p]
            done = dead | (by_token & (self.left[x] < 0))
            at = np.where(by_token, self.token_birth[x], self.state_birth[p]).astype(np.int64)
            x, p = np.where(by_token, self.left[x], x).astype(np.int64), np.where(by_token, p, self.parent[p]).astype(np.int64)
            idx, at, x, p = idx[~done], at[~done], x[~done], p[~done]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, counts = self.encode_flat(np.frombuffer(b"".join(words), np.uint8), sizes)
        ends = np.cumsum(counts)
        return [ids[b - c : b].tolist() for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]

    def encode_flat(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words that follow each other in ``data``, and how many each has; words are encoded side by side."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        wide = np.flatnonzero(sizes > WIDE)
        if not len(wide):
            return self._encode_block(data, starts, sizes)
        long = [self._encode_long(data[starts[k] : ends[k]].tobytes()) for k in wide.tolist()]
        rest = np.flatnonzero(sizes <= WIDE)
        ids, some = self._encode_block(data[spread(starts[rest], sizes[rest])], np.cumsum(sizes[rest]) - sizes[rest], sizes[rest])
        counts = np.zeros(len(sizes), np.int64)
        counts[rest], counts[wide] = some, [len(x) for x in long]
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        out[spread(first[rest], some)] = ids
        for k, x in zip(wide.tolist(), long, strict=True):
            out[first[k] : first[k] + len(x)] = x
        return out, counts

    def _arcs(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token that the bytes of a word spell anywhere: where it begins and ends, and which it is."""
        stop = np.repeat(starts + sizes, sizes)
        at = np.arange(len(data))
        node = self.roots[data]
        begin, end, token = [], [], []
        depth = 1
        while len(at):
            found = self.spelled[node]
            some = np.flatnonzero(found >= 0)
            begin.append(at[some])
            end.append(at[some] + depth)
            token.append(found[some])
            go = np.flatnonzero(at + depth < stop[at])
            at, node = at[go], node[go]
            after = data[at + depth]
            node = self.pairs[node, after] if depth == 1 else self.edge.get(node.astype(np.int64) * 256 + after)
            go = np.flatnonzero(node >= 0)
            at, node = at[go], node[go]
            depth += 1
        return np.concatenate(begin), np.concatenate(end), np.concatenate(token)

    def _encode_block(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(sizes)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        begin, end, token = self._arcs(data, starts, sizes)
        word = np.repeat(np.arange(n), sizes)
        place = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.uint8)[begin]
        order = np.argsort(place, kind="stable")
        steps = np.searchsorted(place[order], np.arange(int(sizes.max()) + 1))
        # a word of k bytes has k + 1 boundaries
        shift = word[begin]
        begin, end, token = (begin + shift)[order], (end + shift)[order], token[order]
        state = np.zeros(len(data) + n, np.int32)
        last = np.full(len(data) + n, -1, np.int32)
        for a, b in pairwise(steps.tolist()):
            to, t = end[a:b], token[a:b]
            fresh = np.flatnonzero(last[to] < 0)  # a boundary has one state: once found, no more is asked
            to, t = to[fresh], t[fresh]
            good = self.allowed(state[begin[a:b][fresh]], t)
            to, t = to[good], t[good]
            last[to] = t
            state[to] = self.after[t]
        at, rows, back = np.cumsum(sizes + 1) - 1, np.flatnonzero(sizes > 0), []
        floor = starts + np.arange(n)
        counts = np.zeros(n, np.int64)
        while len(rows):
            t = last[at[rows]]
            if (t < 0).any():
                raise ValueError("a byte of the text is not in the vocabulary")
            back.append((rows, t))
            counts[rows] += 1
            at[rows] -= self.widths[t]
            rows = rows[at[rows] > floor[rows]]
        ids = np.zeros(int(counts.sum()), np.int32)
        tail = np.cumsum(counts) - 1
        for k, (rows, t) in enumerate(back):
            ids[tail[rows] - k] = t
        return ids, counts

    def _encode_long(self, word: bytes) -> list[int]:
        """The same path for one word of any length, with memory in proportion to it."""
        n = len(word)
        state, token = np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
        edges, spelled, after, seen = self.edge.as_dict(), self.spelled, self.after, {}
        for i in range(n):
            node, p = 0, int(state[i])
            for j in range(i, n):
                node = edges.get(node * 256 + word[j], -1)
                if node < 0:
                    break
                t = int(spelled[node])
                if t >= 0 and token[j + 1] < 0:
                    ok = seen.get((p, t))
                    if ok is None:
                        ok = seen[p, t] = bool(self._walk(np.array([p]), np.array([t]))[0])
                    if ok:
                        token[j + 1], state[j + 1] = t, after[t]
        ids, at = [], n
        while at:
            t = int(token[at])
            if t < 0:
                raise ValueError("a byte of the text is not in the vocabulary")
            ids.append(t)
            at -= len(self.labels[t])
        return ids[::-1]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arc labels of the ids, one after the other, and where each begins (and the end)."""
        size = self.label_sizes[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.label_bytes[spread(self.label_starts[ids], size)], ends

    def label(self, more: dict[int, bytes]) -> None:
        """Labels of tokens beside the merges', and all labels as one array."""
        for i, text in more.items():
            self.labels += [b""] * (i + 1 - len(self.labels))
            self.labels[i] = text
        self.label_sizes = np.fromiter(map(len, self.labels), np.int64, len(self.labels))
        self.label_starts = np.cumsum(self.label_sizes) - self.label_sizes
        self.label_bytes = np.frombuffer(b"".join(self.labels), np.uint8)
