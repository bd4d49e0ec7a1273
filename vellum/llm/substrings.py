"""Substring dedup with repeated-phrase automata (operator 8).

A window is ``window`` consecutive words of one text.  Every word is removed that lies in a
window whose words also start anywhere else, in the same text or another.

1. One pass: each window is named by an anchor, the least hash of the ``GRAM``-word phrases
   in it (the leftmost, if several are equal).  Windows in a row mostly share their anchor,
   so a text has about one row (anchor, first window, count) for 13 words.  Equal windows
   have equal anchors, hence only anchors that recur can hold recurring windows.
2. Texts with the same words become one; if there are several, all of it recurs.
3. The places of recurring anchors are dealt by anchor, each with its words.  In a shard,
   windows in a row whose hashes recur make a passage.  Passages with the same words are one
   text, which is a pattern as a whole; a passage that stands once gives an example of each
   of its windows.  Aho-Corasick automata of these patterns read every different passage,
   and what they find holds at all its places: an occurrence elsewhere confirms an example,
   and both cover their words.  An automaton holds ``PATTERNS`` patterns at most.
4. Anchors with over ``HOT`` places (a passage that a third of all texts share) are split.
   Their windows are counted by hash, pre-aggregated in every task; each hash that recurs
   gets one place as its example, whose words become a pattern.  Places and patterns are
   dealt into shards of bounded size, and every place runs through the automata of its
   anchor's patterns.  A match elsewhere confirms the example, by words.
5. Covered words are united for each text.

Words are compared as such in the automata; hashes of 64 bits choose what is compared.

Defined results: null, empty and blank texts have no words; texts shorter than a window
lose nothing; repeated rows count as texts of their own, so all of their words go if they
have a window; null ids are ids like others; an empty table has an empty result; other
input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_arrow, slices
from .staging import sendable, stage
from .textunits import gram_hashes, inside, word_hashes

GRAM = 10
#: Places of an anchor from which on it is split, and places in a shard of such anchors.
HOT, SHARD = 20_000, 4_000
#: Patterns of one automaton, and words of text it is built for at a time.
PATTERNS, TOGETHER = 50_000, 400_000

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "replace").split()


def anchors(words: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: anchor, first window (counted through all texts), number of windows."""
    n_windows = len(words) - window + 1
    if n_windows <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = gram_hashes(words, gram)
    value[~inside(offsets, gram, len(words))] = _TOP
    place = np.arange(len(value))
    span, need = 1, window - gram + 1

    def shifted(v: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        later = v[k:] < v[:-k]  # the left one stays if both are equal
        return np.where(later, v[k:], v[:-k]), np.where(later, p[k:], p[:-k])

    while span * 2 <= need:
        value, place = shifted(value, place, span)
        span *= 2
    if need > span:
        value, place = shifted(value, place, need - span)
    good = inside(offsets, window, len(words))
    first = good & np.concatenate(([True], (place[1:] != place[:-1]) | ~good[:-1]))
    at = np.flatnonzero(first)
    run = np.cumsum(first)[good] - 1
    return value[at], at, np.bincount(run, minlength=len(at))


def _scan(base: DataFrame, text: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                plain = [b" ".join(split_words(t)) for t in batch.column(text).to_pylist()]
                words, offsets = word_hashes(plain)
                value, at, count = anchors(words, offsets, window, GRAM)
                owner = np.searchsorted(offsets, at, "right") - 1
                runs = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(plain))))).astype(np.int32)
                items = pa.StructArray.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array((at - offsets[owner]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["anchor", "first", "n"],
                )
                digest = [hashlib.sha256(t).hexdigest() for t in plain]
                yield pa.RecordBatch.from_pydict(
                    {
                        "rid": batch.column("rid"),
                        "id": batch.column("id"),
                        "th": batch.column("th"),
                        "n_words": pa.array(np.diff(offsets)),
                        "digest": pa.array(digest),
                        "runs": pa.ListArray.from_arrays(pa.array(runs), items),
                    }
                )

    return in_arrow(
        base, run, "rid long, id long, th long, n_words long, digest string, runs array<struct<anchor:bigint,first:int,n:int>>"
    )


def _places(found: DataFrame, text: str, window: int) -> DataFrame:
    """A row a recurring run with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                rows: list[tuple] = []
                for rid, body, runs in zip(batch.column("rid").to_pylist(), batch.column(text).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                    words = split_words(body)
                    rows += [(r["anchor"], rid, r["first"], r["parts"], b" ".join(words[r["first"] : r["first"] + r["n"] + window - 1])) for r in runs]
                if rows:
                    key, rid, first, parts, segment = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": pa.array(key, pa.int64()),
                            "rid": pa.array(rid, pa.int64()),
                            "first": pa.array(first, pa.int64()),
                            "parts": pa.array(parts, pa.int64()),
                            "segment": pa.array(segment, pa.binary()),
                        }
                    )

    return in_arrow(found, run, "key long, rid long, first long, parts long, segment binary")


def _windows(places: DataFrame, window: int) -> DataFrame:
    """Anchor and hash of each window of hot places: how many there are, and the least place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, offsets = word_hashes(batch.column("segment").to_pylist())
            grams = gram_hashes(words, window)
            at = np.flatnonzero(inside(offsets, window, len(words)))
            row = np.searchsorted(offsets, at, "right") - 1
            key, rid, first = (batch.column(c).to_numpy()[row] for c in ("key", "rid", "first"))
            first = first + at - offsets[row]
            h = grams[at].view(np.int64)
            order = np.lexsort((first, rid, h, key))  # one row a window and batch
            key, h, rid, first = key[order], h[order], rid[order], first[order]
            lead = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (h[1:] != h[:-1]))))
            yield pa.RecordBatch.from_pydict(
                {"key": key[lead], "h": h[lead], "rid": rid[lead], "first": first[lead], "n": np.diff(lead, append=len(key)).astype(np.int64)}
            )

    counted = in_arrow(places.select("key", "rid", "first", "segment"), run, "key long, h long, rid long, first long, n long")
    return counted.groupBy("key", "h").agg(F.min(F.struct("rid", "first")).alias("x"), F.sum("n").alias("n")).filter("n > 1").select("key", "h", "x.rid", "x.first")


def _hot_shards(places: DataFrame, window: int, hot: int) -> DataFrame:
    """Rows of shards: patterns (kind 0) and places (kind 1) of hot anchors; a text's places with one set of patterns lie together."""
    examples = stage(_windows(places, window), "hot-windows")
    wanted = sendable(examples.select(F.col("key").alias("k"), "h", F.col("rid").alias("r"), F.col("first").alias("at")))
    here = (F.col("key") == F.col("k")) & (F.col("rid") == F.col("r")) & F.col("at").between(F.col("first"), F.col("last"))
    last = F.col("first") + F.size(F.split(F.col("segment").cast("string"), " ")) - window
    words = F.slice(F.split(F.col("segment").cast("string"), " "), (F.col("at") - F.col("first") + 1).cast("int"), window)
    patterns = places.withColumn("last", last).join(wanted, here).select("key", "h", "rid", F.col("at").alias("first"), F.array_join(words, " ").cast("binary").alias("segment"))
    patterns = stage(patterns, "hot-patterns")
    subsets = patterns.groupBy("key").agg(F.ceil(F.count("*") / PATTERNS).alias("subsets"))  # one row a hot anchor
    subsets = sendable(stage(subsets, "hot-sets"))
    sets = max(1, -(-patterns.count() // PATTERNS))
    parts = max(1, -(-places.count() // (min(hot, SHARD) * sets)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    shard = F.xxhash64(F.pmod(F.xxhash64("key"), F.lit(sets)), "subset", "part").alias("shard")
    row = ("kind", "rid", "first", "segment")
    asked = patterns.join(subsets, "key").withColumn("subset", F.pmod("h", F.col("subsets"))).withColumn("part", every(F.lit(parts).cast("long")))
    dealt = places.join(subsets, "key").withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts).cast("long"))).withColumn("kind", F.lit(1))
    once = dealt.filter("subsets = 1").withColumn("subset", F.lit(0).cast("long")).select(shard, *row)
    often = dealt.filter("subsets > 1").withColumn("subset", every(F.col("subsets"))).select(shard, *row)
    both = asked.withColumn("kind", F.lit(0)).select(shard, *row).unionByName(once).unionByName(often)
    return both.repartition("shard").sortWithinPartitions("shard", "kind", "rid", "first")


def _ranges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    rid, start, end = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"rid": pa.array(rid, pa.int64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})


def _match(window: int):
    """Work on shards of hot anchors: (rid, start, end) of covered words, of places and of the examples they confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        shard, number, automaton, ready = None, {}, None, False
        covered: list[tuple[int, int, int]] = []  # the last may still grow
        for batch in batches:
            confirmed: set[tuple[int, int]] = set()
            for own, kind, rid, first, segment in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "rid", "first", "segment")), strict=True):
                if own != shard:
                    shard, number, ready = own, {}, False
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                if kind == 0:
                    automaton.add_word(tuple([number.setdefault(w, len(number) + 1) for w in segment.split()]), (rid, first))
                    continue
                if not number:
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                for end, example in automaton.iter(tuple([number.get(w, 0) for w in segment.split()])):
                    start = first + end + 1 - window
                    if example == (rid, start):
                        continue
                    confirmed.add(example)
                    if covered and covered[-1][0] == rid and covered[-1][1] <= start <= covered[-1][2]:
                        covered[-1] = (rid, covered[-1][1], max(covered[-1][2], start + window))
                    else:
                        covered.append((rid, start, start + window))
            rows = covered[:-1] + [(rid, first, first + window) for rid, first in confirmed]
            covered = covered[-1:]
            if rows:
                yield _ranges(rows)
        if covered:
            yield _ranges(covered)

    return run


def cover(segments: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each segment the word ranges that windows cover which recur among the segments; ranges may repeat and overlap."""
    import ahocorasick

    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    words, offsets = word_hashes(segments)
    at = np.flatnonzero(inside(offsets, window, len(words)))
    _, group, times = np.unique(gram_hashes(words, window)[at], return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[group] > 1)
    if not len(again):
        return out
    # passages: windows in a row whose hashes recur; those with the same words are one
    at, group = at[again], group[again]
    owner = np.searchsorted(offsets, at, "right") - 1
    cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]))))
    windows = np.diff(cuts, append=len(at))
    segment, size = owner[cuts], windows + window - 1
    whole = size == np.diff(offsets)[segment]
    passages: dict[bytes, int] = {}
    places: list[list[tuple[int, int]]] = []
    name = np.zeros(len(cuts), np.int64)
    for c, (k, a, n, all_) in enumerate(zip(segment.tolist(), (at[cuts] - offsets[segment]).tolist(), size.tolist(), whole.tolist(), strict=True)):
        name[c] = own = passages.setdefault(segments[k] if all_ else b" ".join(segments[k].split()[a : a + n]), len(passages))
        if own == len(places):
            places.append([])
        places[own].append((k, a))
    # what stands once needs an example of each of its windows, what stands again is a pattern itself
    alone = [len(p) == 1 for p in places]
    asked = np.zeros(len(times), bool)
    asked[group[np.repeat(np.array(alone)[name], windows)]] = True
    wanted = np.flatnonzero(asked[group])
    example = wanted[np.unique(group[wanted], return_index=True)[1]]
    stretch = np.searchsorted(cuts, example, "right") - 1
    patterns = [(p, a, window) for p, a in zip(name[stretch].tolist(), (example - cuts[stretch]).tolist(), strict=True)]
    number: dict[bytes, int] = {}
    coded = [tuple([number.setdefault(w, len(number) + 1) for w in p.split()]) for p in passages]
    patterns += [(p, 0, len(coded[p])) for p in range(len(coded)) if not alone[p]]
    found: list[list[tuple[int, int]]] = [[] for _ in coded]
    for x in range(0, len(patterns), PATTERNS):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern in patterns[x : x + PATTERNS]:
            p, a, n = pattern
            automaton.add_word(coded[p][a : a + n], pattern)
        automaton.make_automaton()
        confirmed = set()
        for own, text in enumerate(coded):
            ranges = found[own]
            for end, (p, a, n) in automaton.iter(text):
                start = end + 1 - n
                if alone[p]:
                    if p == own and a == start:
                        continue
                    confirmed.add((p, a))  # it stands elsewhere, word for word
                if ranges and ranges[-1][0] <= start <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(ranges[-1][1], start + n))
                else:
                    ranges.append((start, start + n))
        for p, start in sorted(confirmed):
            ranges = found[p]
            if ranges and ranges[-1][0] <= start <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], start + window))
            else:
                ranges.append((start, start + window))
    for ranges, where in zip(found, places, strict=True):
        for k, a in where:
            out[k] += [(a + x, a + y) for x, y in ranges]
    return out


def _locate(window: int):
    """Work on the places of one shard, some anchors at a time: (rid, start, end) of covered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = cover([h[3] for h in held], window)
            rows = [(rid, first + a, first + b) for (_, rid, first, _), ranges in zip(held, found, strict=True) for a, b in ranges]
            if rows:
                yield _ranges(rows)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "rid", "first", "segment")), strict=True):
                if size >= TOGETHER and row[0] != held[-1][0]:
                    yield from flush()
                    held, size = [], 0
                held.append(row)
                size += row[3].count(b" ") + 1
        if held:
            yield from flush()

    return run


def find_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row a row of ``docs``: the key, n_words, n_removed, ranges (start, end of removed words) and kept_sha256."""
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"), th.alias("th"), text)
    rows = stage(_scan(base, text, window), "phrases")
    classes = rows.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min(F.struct("rid", "id", "th")).alias("x"), F.count("*").alias("weight"))
    classes = stage(classes.select("digest", "x.rid", "x.id", "x.th", "weight"), "texts")

    runs = rows.select("rid", F.explode("runs").alias("x")).join(classes.select("rid"), "rid", "left_semi").select("rid", "x.anchor", "x.first", "x.n")
    recurring = runs.groupBy("anchor").agg(F.count("*").alias("places")).filter("places > 1")
    recurring = stage(recurring.select("anchor", F.ceil(F.col("places") / hot).alias("parts")), "anchors")
    listed = runs.join(recurring, "anchor").groupBy("rid").agg(F.collect_list(F.struct("anchor", "first", "n", "parts")).alias("runs"))
    listed = listed.join(classes.select("rid", "id", "th"), "rid")
    texts = docs.select(F.col(key).cast("long").alias("tid"), th.alias("tth"), text)
    found = texts.join(listed, texts["tid"].eqNullSafe(listed["id"]) & (texts["tth"] == listed["th"])).dropDuplicates(["rid"])
    found = stage(found.select("rid", text, "runs"), "found")

    places = stage(_places(found, text, window), "places")
    shards = places.filter("parts = 1").drop("parts").repartition("key").sortWithinPartitions("key")
    covered = in_arrow(shards, _locate(window), "rid long, start long, end long")
    split = places.filter("parts > 1")
    if not split.isEmpty():
        covered = covered.unionByName(in_arrow(_hot_shards(split, window, hot), _match(window), "rid long, start long, end long"))
    ranges = covered.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    cut = _cut(found.select("rid", text).join(ranges, "rid"), text)
    result = classes.select("digest", "rid", "weight").join(cut, "rid", "left").drop("rid")

    joined = rows.select("rid", "id", "n_words", "digest").join(result, "digest", "left")
    copied = F.coalesce(F.col("weight"), F.lit(1)) > 1
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    removed = F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    return joined.select(
        F.col("id").alias(key),
        "n_words",
        removed.alias("n_removed"),
        F.when(copied, whole).otherwise(F.coalesce("ranges", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("ranges"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )


def _cut(found: DataFrame, text: str) -> DataFrame:
    """rid, ranges united, n_removed and the digest of the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                removed, digest, united = [], [], []
                for body, ranges in zip(batch.column(text).to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                    words = split_words(body)
                    kept, at, own = [], 0, []
                    for r in ranges:
                        if own and r["start"] <= own[-1]["end"]:
                            own[-1]["end"] = max(own[-1]["end"], r["end"])
                        else:
                            own.append(r)
                    for r in own:
                        kept += words[at : r["start"]]
                        at = r["end"]
                    kept += words[at:]
                    united.append(own)
                    removed.append(len(words) - len(kept))
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid"), pa.array(united, batch.column("ranges").type), pa.array(removed, pa.int64()), pa.array(digest)],
                    ["rid", "ranges", "n_removed", "kept_sha256"],
                )

    return in_arrow(found, run, "rid long, ranges array<struct<start:bigint,end:bigint>>, n_removed long, kept_sha256 string")
