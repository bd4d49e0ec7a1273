"""Embedding near-dedup with an inverted multi-index (operator 5).

Vectors of equal label are linked from a cosine of ``least`` (double precision).

Unit vectors are cut in halves and each half has a codebook of its own, fitted by k-means
on a bounded sample; a pair of codewords is a cell of the product grid, and every vector is
an entry of its nearest cell.  As a query a vector visits cells by multi-sequence
traversal: pairs of codewords in increasing order of a lower bound of the distance to any
vector of the cell (the distance to the planes half-way to the other codewords, squared and
added over the halves), until the bound exceeds the distance that the cosine allows.  So
the target recall is 1: no cell that can hold a link is left out.  Each visited cell's
entries are verified exactly.

Scale: equal vectors become one with a multiplicity before anything is compared.  The cells
of one left codeword lie together, so a query travels once a row of cells with the list of
those it visits.  Rows with many entries are cut into blocks of ``BLOCK`` entries, and
queries go to each block, so that a task holds one block at a time.  Per block only counts and a spanning forest of the
links go on, not the pairs.  ``SAMPLE`` vectors are collected for the codebooks, whatever
the input; the index holds every vector.

Defined results: null labels, null or zero vectors and vectors with a null or non-finite
component have no links; vectors of different length are not compared; repeated rows are
links of each other; null ids never name a component that has an id; an empty table has
an empty result; other input columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_arrow
from .components import components
from .staging import sendable, stage

SAMPLE, BLOCK, ROUNDS = 8192, 4096, 8


def codebook(points: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Codewords by k-means."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    words = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((points**2).sum(1)[:, None] - 2 * points @ words.T + (words**2).sum(1)).argmin(1)
        for c in range(k):
            own = points[near == c]
            if len(own):
                words[c] = own.mean(0)
    return words


def bounds(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each point, and how far the point is at least from the region of every other."""
    squared = np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ words.T + (words**2).sum(1))
    near = squared.argmin(1)
    between = np.sqrt(np.maximum(0, ((words[:, None] - words[None]) ** 2).sum(2)))
    gap = between[near]
    rise = squared - squared[np.arange(len(points)), near][:, None]
    return near, np.where(gap > 0, rise / (2 * np.where(gap > 0, gap, 1)), 0.0)


def traverse(left: np.ndarray, right: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells in increasing order of left[i]**2 + right[j]**2, up to ``most``."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    x, y = left[a] ** 2, right[b] ** 2
    queue, seen = [(float(x[0] + y[0]), 0, 0)], {(0, 0)}
    while queue:
        cost, i, j = heapq.heappop(queue)
        if cost > most:
            return
        yield int(a[i]), int(b[j])
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in seen:
                seen.add(p)
                heapq.heappush(queue, (float(x[p[0]] + y[p[1]]), *p))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors; all are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def near_duplicates(table: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row a row of ``table``: the key, n_links, component_id, kept."""
    spark = table.sparkSession
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = table.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    rows = stage(rows.withColumn("usable", usable), "vectors")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    classes = rows.filter("usable").groupBy("label", "v").agg(first.alias("x"), F.count("*").alias("copies"))
    classes = classes.select("label", "v", F.size("v").alias("length"), "x.rid", "x.id", "copies")
    classes = stage(classes.withColumn("space", F.concat_ws(":", "length", "label")), "distinct-vectors")

    kinds = classes.groupBy("length").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).collect()
    links = None
    for kind in sorted(kinds):  # one codebook a vector length
        own = classes.filter(F.col("length") == kind["length"])
        found = _links(own, kind["length"], kind["n"], max(1, kind["labels"]), least)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long, n long")
    links = stage(links, "links")
    counts = links.filter("n > 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("others"))
    roots = components(links.filter("b is not null").select("a", "b")).withColumnRenamed("vertex", "rid")

    named = classes.select("rid", "id", "label", "v", "copies").join(counts, "rid", "left").join(roots, "rid", "left")
    named = named.withColumn("root", F.coalesce("root", "rid"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("best")
    named = stage(named, "rooted")
    named = named.join(sendable(stage(named.groupBy("root").agg(best), "best")), "root")
    named = named.select("label", "v", F.col("best.id").alias("c"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.filter("usable").join(named, ["label", "v"]).select("id", "n_links", "c")
    alone = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c"))
    both = joined.unionByName(alone)
    return both.select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))


def _links(classes: DataFrame, length: int, n: int, labels: int, least: float) -> DataFrame:
    """Rows (a, null, number of other vectors linked to a) and (a, b, 0), a forest of the links."""
    spark = classes.sparkSession
    draw = F.xxhash64("rid", F.lit("codebook")) / F.lit(2.0**64) + 0.5
    sample = classes.filter(draw < SAMPLE / max(1, n)).select("v").limit(2 * SAMPLE).collect()
    half = (length + 1) // 2
    points = np.array([r["v"] for r in sample] or [[1.0] * length])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    k = int(min(256, max(4, round((n / labels / 16) ** 0.5))))
    books = spark.sparkContext.broadcast((codebook(points[:, :half], k), codebook(points[:, half:], k) if length > 1 else np.zeros((1, 0))))
    most = 2 - 2 * least + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = books.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                unit = _unit(batch.column("v"))
                (a, x), (b, y) = bounds(unit[:, :half], left), bounds(unit[:, half:], right)
                rows, lefts, kinds, rights = [], [], [], []
                for i in range(len(unit)):
                    rows.append(i)
                    lefts.append(int(a[i]))
                    kinds.append(0)
                    rights.append([int(b[i])])
                    visited: dict[int, list[int]] = {}
                    for p, q in traverse(x[i], y[i], most):
                        visited.setdefault(p, []).append(q)
                    rows += [i] * len(visited)
                    lefts += visited
                    kinds += [1] * len(visited)
                    rights += visited.values()
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(take) for c in ("space", "rid", "copies", "v")]
                    + [pa.array(lefts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(rights, pa.list_(pa.int32()))],
                    ["space", "rid", "copies", "v", "left", "kind", "rights"],
                )

    schema = "space string, rid long, copies long, v array<double>, left int, kind int, rights array<int>"
    placed = stage(in_arrow(classes.select("space", "rid", "copies", "v"), place, schema), "cells")
    sizes = placed.filter("kind = 0").groupBy("space", "left").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(sizes, ["space", "left"])  # a row of cells without entries has no links
    own = F.array(F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    block = F.explode(F.when(F.col("kind") == 0, own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.withColumn("block", block)
    dealt = dealt.select(F.concat_ws("/", "space", "left", "block").alias("key"), "kind", "rid", "copies", "v", "rights").repartition("key").sortWithinPartitions("key", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries, ready = None, [], None
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                keys, kinds = batch.column("key").to_pylist(), batch.column("kind").to_pylist()
                rid, copies, unit = batch.column("rid").to_numpy(), batch.column("copies").to_numpy(), _unit(batch.column("v"))
                rights = batch.column("rights")
                cuts = [i for i in range(len(keys)) if i == 0 or (keys[i], kinds[i]) != (keys[i - 1], kinds[i - 1])] + [len(keys)]
                for a, b in pairwise(cuts):
                    if keys[a] != key:
                        key, entries, ready = keys[a], [], None
                    part = rights.slice(a, b - a)
                    cells = part.flatten().to_numpy()
                    if kinds[a] == 0:
                        entries.append((cells, rid[a:b], copies[a:b], unit[a:b]))
                        continue
                    if ready is None and entries:  # entries come first, in order of their cells now
                        held = [np.concatenate(x) for x in zip(*entries, strict=True)]
                        order = np.argsort(held[0], kind="stable")
                        ready = [x[order] for x in held]
                    if ready is None:
                        continue
                    asks = a + np.repeat(np.arange(b - a), pc.list_value_length(part).to_numpy())
                    order = np.argsort(cells, kind="stable")
                    asks, cells = asks[order], cells[order]
                    for cell in np.unique(cells).tolist():
                        c, d = np.searchsorted(ready[0], (cell, cell + 1))
                        if c < d:
                            i, j = np.searchsorted(cells, (cell, cell + 1))
                            q = asks[i:j]
                            yield from _compare((rid[q], copies[q], unit[q]), tuple(x[c:d] for x in ready[1:]), least)

    return in_arrow(dealt, compare, "a long, b long, n long")


def _compare(queries: tuple, entries: tuple, least: float) -> Iterator[pa.RecordBatch]:
    near = (queries[2] @ entries[2].T >= least) & (queries[0][:, None] != entries[0][None])
    number = near @ entries[1]
    hit = np.flatnonzero(number)
    if not len(hit):
        return
    root = np.arange(len(entries[0]))
    first = near.argmax(axis=1)
    for i in hit.tolist():
        known = root[near[i]]
        if known.min() != known.max():
            root[np.isin(root, known)] = known.min()
    moved = np.flatnonzero(root != np.arange(len(root)))
    a = np.concatenate((queries[0][hit], queries[0][hit], entries[0][moved]))
    b = np.concatenate((entries[0][first[hit]], entries[0][first[hit]], entries[0][root[moved]]))
    n = np.concatenate((number[hit], np.zeros(len(hit) + len(moved), np.int64)))
    none = np.concatenate((np.ones(len(hit), bool), np.zeros(len(hit) + len(moved), bool)))
    yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b, mask=none), "n": pa.array(n)})
