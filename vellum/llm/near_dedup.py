"""MinHash near-duplicates by a chosen-path set similarity join (operator 3).

A document's set is its distinct shingles of ``shingle`` words; documents are linked from a
Jaccard similarity of ``percent`` per cent on, found on the full sets, and the result names
each document's class under these links.

1. One pass over the texts keeps, for each document, the size of its set, a 128-bit key of
   it and ``COORDINATES`` minwise values.  Documents with equal sets become one.
2. Path trees: in each of ``TREES`` independent trees a document goes to the node named by
   one minwise token.  Nodes of more than ``LEAF`` documents branch again, twice each, by
   tokens chosen by the node, and again; in small nodes all pairs are compared by their
   minwise values, and what is in a large node still is put into one cluster unseen.  Pairs that might be linked put documents into clusters (components), so a
   document's text is needed once, whatever the number of trees.
3. Clusters are compared exhaustively on full sets.  A cluster that is too large for one
   task is first branched by path trees of its own and dealt three times into random parts,
   which finds most links.  Its members are then dealt into blocks, and every block is
   compared with every other, but for members that are in one class already.
4. Links that were confirmed give the components.

Trees only emit a spanning forest of each node: a group of k copies costs k - 1 rows, not
its pairs.  All counts are aggregated before they are shuffled, nodes and clusters are
split before they are gathered, and nothing but row counts reaches the driver.

Recall: a pair of similarity s misses one tree with probability 1 - s; at 0.85 and 16 trees
that is below 1e-12, and a pair whose minwise values understate it (fewer than ``ENOUGH`` of
64 equal at 0.85) below 1e-5.  Within a cluster of any size no link between two classes is
missed, and a pair gets into one cluster whatever the size of its nodes: each tree brings
it together with probability s (1 - (1 - s (1 - (1 - s)^2))^2), 0.76 at 0.8, so 16 miss it
below 1e-9.

Defined results: null, empty and blank texts have no set and are linked with nothing; a
text of fewer than ``shingle`` words is one shingle; rows that repeat are in one class and
exactly one row of a class is its representative; null ids never name a class that has an
id; an empty table has an empty result; clashing input columns give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_arrow, slices, sole
from .components import FEW, components
from .staging import sendable, stage
from .textunits import LOWER, gram_hashes, inside, mix, word_hashes

COORDINATES, TREES, DEEP = 64, 16, 16
#: Documents compared with each other at once; shingles, too, for more than a few documents.
LEAF, LEAF_SHINGLES = 1024, 8_000_000
#: Rounds of branching in the trees over all documents, and in those of a cluster: one token each in the first two, then three at a time.
ROUNDS, DEPTH = 2, 14

_odd = np.random.default_rng(5).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def enough(percent: int) -> int:
    """Equal minwise values from which a pair is compared on full sets: six deviations under the expected number."""
    s = percent / 100
    return max(1, int(COORDINATES * s - 6 * np.sqrt(COORDINATES * s * (1 - s))))


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after the other, and where each text's begin (and the end)."""
    plain = [b" ".join((t or "").encode("utf-8", "replace").translate(LOWER).split()) for t in texts]
    words, offsets = word_hashes(plain)
    grams = gram_hashes(words, n)
    good = inside(offsets, n, len(words))
    sizes = np.diff(offsets)
    full = np.maximum(sizes - n + 1, 0)
    counts = np.where((sizes > 0) & (full == 0), 1, full)
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    long = np.repeat(full > 0, counts)
    out[long] = grams[good]
    for k in np.flatnonzero((sizes > 0) & (full == 0)).tolist():
        out[ends[k] - 1] = mix(gram_hashes(words[offsets[k] : offsets[k + 1]], int(sizes[k])) + np.uint64(sizes[k]))[0]
    starts = ends - counts
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[starts[counts > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return out[fresh], np.concatenate((kept[starts], kept[-1:]))


def minwise(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each coordinate over each set, 32 bits; empty sets get ones."""
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes > 0)
    out = np.full((len(sizes), COORDINATES), 0xFFFFFFFF, np.uint32)
    if len(some):
        starts = bounds[:-1][some]
        for c in range(COORDINATES):
            out[some, c] = np.minimum.reduceat(sets * _odd[c], starts) >> np.uint64(32)
    return out


def _describe(base: DataFrame, text: str, shingle: int) -> DataFrame:
    """rid, n_shingles, key1, key2 and minwise values of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("near_dedup")
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                sets, bounds = shingle_sets(batch.column(text).to_pylist(), shingle)
                sizes = np.diff(bounds)
                keys = []
                for salt in (1, 2):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets * np.uint64(salt * 2 + 1) + np.uint64(salt)))))
                    keys.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64)).view(np.int64))
                values = minwise(sets, bounds)
                yield pa.RecordBatch.from_pydict(
                    {
                        "rid": batch.column("rid"),
                        "id": batch.column("id"),
                        "th": batch.column("th"),
                        "n_shingles": pa.array(sizes),
                        "key1": pa.array(keys[0]),
                        "key2": pa.array(keys[1]),
                        "values": pa.array([v.tobytes() for v in values], pa.binary()),
                    }
                )

    return in_arrow(base, run, "rid long, id long, th long, n_shingles long, key1 long, key2 long, values binary")


def _child(node, values, coordinate) -> F.Column:
    """The node that a document goes to: its parent, the coordinate and the minwise token there."""
    token = F.substring(values, (coordinate * 4 + 1).cast("int"), F.lit(4))
    return F.xxhash64(node, coordinate, token)


def _branch(rows: DataFrame, node: str, times: int, tokens: int = 1) -> DataFrame:
    """Each row ``times`` times, in children of its node by coordinates that the node chooses."""
    spread = rows.withColumn("branch", F.explode(F.array(*map(F.lit, range(times)))))
    child = F.col(node)
    for k in range(tokens):
        coordinate = F.pmod(F.xxhash64(F.col(node), F.col("branch"), F.lit(k)), F.lit(COORDINATES))
        child = _child(child, F.col("values"), coordinate)
    return spread.withColumn("child", child).drop("branch", node).withColumnRenamed("child", node)


def _grouped(df: DataFrame, group: str, schema: str, work) -> DataFrame:
    """``work(table)`` for the rows of each value of ``group``; groups are bounded in size before."""
    dealt = df.repartition(group).sortWithinPartitions(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column(group)[0].as_py() != keys[a]:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return in_arrow(dealt, run, schema)


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges from each member to the first of its component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(k, find(k)) for k in range(n) if find(k) != k]


def _edges(ids: np.ndarray, forest: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if forest:
        a, b = np.array(forest).T
        yield pa.RecordBatch.from_pydict({"a": pa.array(ids[a]), "b": pa.array(ids[b])})


def _by_values(least: int):
    """Work on a node: links by minwise values."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("rid").to_numpy()
        ids, first = np.unique(ids, return_index=True)
        if len(ids) < 2:
            return
        values = np.frombuffer(b"".join(table.column("values").take(pa.array(first)).to_pylist()), np.uint32).reshape(len(ids), -1)

        def pairs() -> Iterator[tuple[int, int]]:
            for i in range(1, len(ids)):
                like = np.flatnonzero((values[:i] == values[i]).sum(axis=1) >= least)
                for j in like.tolist():
                    yield i, j

        yield from _edges(ids, _forest(len(ids), pairs()))

    return work


def _by_sets(text: str, shingle: int, percent: int):
    """Work on a cluster: links by full sets."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, first = np.unique(table.column("rid").to_numpy(), return_index=True)
        if len(ids) < 2:
            return
        sets, bounds = shingle_sets(table.column(text).take(pa.array(first)).to_pylist(), shingle)
        yield from _edges(ids, _forest(len(ids), linked_pairs(sets, bounds, percent)))

    return work


def linked_pairs(sets: np.ndarray, bounds: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets with 100 * intersection >= percent * union, exactly."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    _, token, df = np.unique(sets, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = df[token] > 1
    renumbered = np.cumsum(df > 1) - 1
    token, owner = renumbered[token[shared]], owner[shared]
    n_tokens = int((df > 1).sum())
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    common = np.zeros((n, n), np.float32)
    width = max(256, (4 << 20) // max(1, n))
    for a in range(0, n_tokens, width):
        lo, hi = np.searchsorted(token, (a, a + width))
        held = np.zeros((n, min(width, n_tokens - a)), np.float32)
        held[owner[lo:hi], token[lo:hi] - a] = 1
        common += held @ held.T
    both = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    i, j = np.nonzero(np.tril((100 * both >= percent * union) & (both > 0), -1))
    yield from zip(i.tolist(), j.tolist(), strict=True)


def _common(sets: np.ndarray, bounds: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many shingles each of ``rows`` has in common with each of ``columns``."""
    token, owner = [], []
    for side in (rows, columns):
        token.append(np.concatenate([sets[bounds[k] : bounds[k + 1]] for k in side]))
        owner.append(np.repeat(np.arange(len(side)), bounds[side + 1] - bounds[side]))
    both = np.intersect1d(*token)
    counts = []
    for k in (0, 1):
        at = np.minimum(np.searchsorted(both, token[k]), max(0, len(both) - 1))
        good = np.flatnonzero(both[at] == token[k]) if len(both) else at[:0]
        order = good[np.argsort(at[good], kind="stable")]
        token[k], owner[k] = at[order], owner[k][order]
        counts.append(np.bincount(token[k], minlength=len(both)))
    n, m = len(rows), len(columns)
    common = np.zeros((n, m), np.int64)
    # tokens of many documents by matrix products, the others pair by pair
    hot = counts[0] * counts[1] > 4096
    place = np.cumsum(hot) - 1
    width = 4096
    held = [(place[t[hot[t]]], o[hot[t]]) for t, o in zip(token, owner, strict=True)]
    for a in range(0, int(hot.sum()), width):
        part = []
        for (t, o), size in zip(held, (n, m), strict=True):
            lo, hi = np.searchsorted(t, (a, a + width))
            part.append(np.zeros((size, width), np.float32))
            part[-1][o[lo:hi], t[lo:hi] - a] = 1
        common += np.rint(part[0] @ part[1].T).astype(np.int64)
    cold = np.flatnonzero(~hot[token[0]])
    begin, times = np.cumsum(counts[1]) - counts[1], counts[1][token[0][cold]]
    cuts = np.searchsorted(np.cumsum(times), np.arange(0, int(times.sum()) + 1, 4 << 20), "left").tolist()
    for a, b in zip(cuts, [*cuts[1:], len(cold)], strict=True):
        some, each = cold[a:b], times[a:b]
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        other = owner[1][np.repeat(begin[token[0][some]], each) + inner]
        common += np.bincount(np.repeat(owner[0][some], each) * m + other, minlength=n * m).reshape(n, m)
    return common


def crossing_pairs(sets: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a set of ``left`` and one of ``right`` with 100 * intersection >= percent * union, exactly."""
    sizes = np.diff(bounds)
    left, right = left[np.argsort(sizes[left], kind="stable")], right[np.argsort(sizes[right], kind="stable")]
    same = np.array_equal(left, right)
    for a in range(0, len(left), LEAF):
        rows = left[a : a + LEAF]
        for b in range(a if same else 0, len(right), LEAF):
            columns = right[b : b + LEAF]
            x, y = sizes[rows], sizes[columns]
            if 100 * x[-1] < percent * y[0] or 100 * y[-1] < percent * x[0]:
                continue  # no two sizes are near enough
            both = _common(sets, bounds, rows, columns)
            i, j = np.nonzero((100 * both >= percent * (x[:, None] + y[None, :] - both)) & (both > 0))
            yield from zip(rows[i].tolist(), columns[j].tolist(), strict=True)


def _by_blocks(text: str, shingle: int, percent: int):
    """Work on two blocks of a cluster (or one): links by full sets between members of different classes."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, first = np.unique(table.column("rid").to_numpy(), return_index=True)
        block, of = (table.column(c).to_numpy()[first] for c in ("block", "of"))
        if (of == of[0]).all():
            return
        sets, bounds = shingle_sets(table.column(text).take(pa.array(first)).to_pylist(), shingle)
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        pairs = ((i, j) for i, j in crossing_pairs(sets, bounds, left, right, percent) if of[i] != of[j])
        yield from _edges(ids, _forest(len(ids), pairs))

    return work


def _blocks(big: DataFrame, classes_of: DataFrame) -> DataFrame:
    """Members of large clusters in pairs of blocks: node, rid, block, of (the class so far).

    The largest class of a cluster has blocks of its own, which are not compared with each
    other; clusters that are one class already have no rows.
    """
    held = big.select("root", "rid", "n_shingles").join(classes_of.select(F.col("vertex").alias("rid"), F.col("root").alias("of")), "rid", "left")
    held = stage(held.withColumn("of", F.coalesce("of", "rid")), "blocks")
    classes = held.groupBy("root", "of").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    most = F.max(F.struct("n", "m", "of")).alias("most")
    layout = classes.groupBy("root").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), most).filter("n > most.n")
    parts = lambda n, m: F.greatest(F.ceil(n / (4 * LEAF)), F.ceil(m / (LEAF_SHINGLES // 2)))
    layout = stage(
        layout.select(
            "root",
            F.col("most.of").alias("main"),
            parts(F.col("n") - F.col("most.n"), F.col("m") - F.col("most.m")).alias("rest"),
            parts(F.col("most.n"), F.col("most.m")).alias("mains"),
        ),
        "layout",
    )
    rows = held.join(sendable(layout), "root")
    inner = F.col("of") == F.col("main")
    dealt = F.when(inner, F.col("rest") + F.pmod(F.xxhash64("rid"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("rid"), F.col("rest")))
    rows = rows.withColumn("block", dealt)
    others = F.sequence(F.lit(0).cast("long"), F.when(inner, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)
    rows = rows.select("root", "rid", "of", "block", F.explode(others).alias("other"))
    node = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"), F.lit("block"))
    return rows.select(node.alias("node"), "rid", "block", "of")


def _split(rows: DataFrame, values: DataFrame, node: str, small, times: int, rounds: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Branch nodes until ``small(count, shingles)`` holds for each; nodes with one document are dropped.

    Also the rows of nodes that are still large after the last round, if there are any.

    ``rows`` are narrow (node, rid, n_shingles); minwise values are fetched for those that branch.
    """
    leaves = None
    for depth in range(rounds + 1):
        rows = stage(rows, name)
        counted = rows.groupBy(node).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")).filter("n > 1")
        counted = stage(counted.withColumn("small", small(F.col("n"), F.col("m"))), f"{name}-counts")
        ready = rows.join(counted.filter("small").select(node), node)
        leaves = ready if leaves is None else leaves.unionByName(ready)
        large = counted.filter("not small").select(node)
        if large.isEmpty():
            return leaves, None
        if depth == rounds:
            return leaves, rows.join(large, node)
        branched = _branch(rows.join(large, node).join(values, "rid"), node, times if depth < 2 else 1, 1 if depth < 2 else 3)
        rows = branched.select(node, "rid", "n_shingles")


def _dealt(rows: DataFrame, node: str) -> DataFrame:
    """Large nodes in random parts of the size of a leaf."""
    sizes = rows.groupBy(node).agg(F.count("*").alias("n")).filter("n > 1")
    part = F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / LEAF))
    return rows.join(sizes, node).withColumn(node, F.xxhash64(node, part)).drop("n")


def _chunks(big: DataFrame, sized: DataFrame) -> DataFrame:
    """Large clusters in random parts of the size of a leaf, dealt three times, with one member that is in all parts."""
    parts = F.greatest(F.ceil(F.col("n") / LEAF), F.ceil(F.col("m") / LEAF_SHINGLES)).alias("parts")
    sized = sized.select("root", parts)
    deal = F.explode(F.array(*map(F.lit, range(3)))).alias("deal")
    rows = big.join(sized, "root").select("root", "rid", "parts", deal)
    rows = rows.select("root", "deal", F.pmod(F.xxhash64("rid", "deal"), F.col("parts")).alias("part"), "rid")
    first = big.groupBy("root").agg(F.min("rid").alias("rid")).join(sized, "root")
    first = first.select("root", deal, "rid", "parts").select("root", "deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "rid")
    return rows.unionByName(first).select(F.xxhash64("root", "deal", "part", F.lit("chunk")).alias("node"), "rid")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``docs``: the key, text_hash, n_shingles, component_id, kept, representative."""
    base = docs.select(key, text)
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    numbered = base.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("id"), th.alias("th"), text)
    rows = stage(_describe(numbered, text, shingle), "sets")

    with_set = rows.filter("n_shingles > 0")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid", "th"))
    classes = with_set.groupBy("key1", "key2").agg(least.alias("x"), F.first("n_shingles").alias("n_shingles"), F.first("values").alias("values"))
    reps = stage(classes.select("key1", "key2", "n_shingles", "values", "x.id", "x.rid", "x.th"), "reps")

    # Trees over the representatives.
    tree = F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree")
    roots = reps.select("rid", "n_shingles", "values", tree)
    roots = roots.withColumn("node", _child(F.xxhash64("tree"), F.col("values"), F.col("tree") * 4 + 1))
    shared = roots.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    roots = roots.select("node", "rid", "n_shingles").join(shared.hint("merge"), "node")
    values = reps.select("rid", "values")
    leaves, alike = _split(roots, values, "node", lambda n, m: n <= LEAF, 2, ROUNDS, "tree")
    leaves = leaves.select("node", "rid").join(values.hint("merge"), "rid")
    guessed = _grouped(leaves.select("node", "rid", "values"), "node", "a long, b long", _by_values(enough(percent)))
    if alike is not None:  # large nodes are compared as clusters
        guessed = guessed.unionByName(alike.join(alike.groupBy("node").agg(F.min("rid").alias("b")), "node").select(F.col("rid").alias("a"), "b"))
    maybe = components(guessed)

    # Clusters, small enough to be compared on full sets.
    members = reps.select("rid", "id", "th", "n_shingles", "values").join(maybe.withColumnRenamed("vertex", "rid"), "rid")
    members = stage(members, "members")
    small = lambda n, m: (n <= LEAF) & ((m <= LEAF_SHINGLES) | (n <= 16))
    sized = stage(members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m")), "clusters")
    whole = members.join(sized.filter(small(F.col("n"), F.col("m"))).select("root"), "root").select(F.xxhash64("root").alias("node"), "rid")
    big = members.join(sized.filter(~small(F.col("n"), F.col("m"))).select("root"), "root")
    deep = big.withColumn("tree", F.explode(F.array(*map(F.lit, range(DEEP))))).withColumn("node", F.xxhash64("root", "tree", F.lit("deep")))
    deep, alike = _split(_branch(deep, "node", 1).select("node", "rid", "n_shingles"), values, "node", small, 1, DEPTH, "deep")
    if alike is not None:
        deep = deep.unionByName(_dealt(alike, "node"))
    wanted = whole.select("node", "rid").unionByName(deep.select("node", "rid"))
    wanted = wanted.unionByName(_chunks(big.select("root", "rid"), sized.filter(~small(F.col("n"), F.col("m")))))
    texts = base.select(F.col(key).cast("long").alias("id"), th.alias("th"), text)
    needed = members.select("rid", "id", "th")
    found = stage(texts.join(sendable(needed), [texts["id"].eqNullSafe(needed["id"]), texts["th"] == needed["th"]]).select("rid", text), "texts")
    compared = _grouped(wanted.join(found, "rid").select("node", "rid", text), "node", "a long, b long", _by_sets(text, shingle, percent))
    classes_of = components(compared)
    # The rest of each large cluster: all pairs of members that are not in one class yet.
    open_ = stage(_blocks(big, classes_of), "pairs")
    if not open_.isEmpty():
        crossing = _grouped(open_.join(found, "rid").select("node", "rid", "block", "of", text), "node", "a long, b long", _by_blocks(text, shingle, percent))
        classes_of = components(crossing.unionByName(classes_of.select(F.col("vertex").alias("a"), F.col("root").alias("b"))))
    classes_of = classes_of.withColumnRenamed("vertex", "rid")

    rooted = reps.select("key1", "key2", "id", "rid").join(classes_of, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("best")
    rooted = stage(rooted, "rooted")
    named = rooted.join(sendable(stage(rooted.groupBy("root").agg(best), "best"), FEW), "root").select("key1", "key2", F.col("best.id").alias("c"), F.col("best.rid").alias("first"))
    placed = with_set.select("rid", "id", "th", "n_shingles", "key1", "key2").join(named, ["key1", "key2"]).drop("key1", "key2")
    alone = rows.filter("n_shingles = 0").select("rid", "id", "th", "n_shingles", F.col("id").alias("c"), F.col("rid").alias("first"))
    return placed.unionByName(alone).select(
        F.col("id").alias(key),
        F.col("th").alias("text_hash"),
        "n_shingles",
        F.col("c").alias("component_id"),
        F.col("id").eqNullSafe(F.col("c")).alias("kept"),
        (F.col("rid") == F.col("first")).alias("representative"),
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class; the rows that go are looked up by id and text hash."""
    found = stage(near_duplicates(docs, shingle, percent, key, text), "classes")
    marks = found.groupBy(F.col(key).alias("__id"), F.col("text_hash").alias("__hash"))
    marks = marks.agg(F.max("representative").alias("__keep"), F.count("*").alias("__rows"), F.max("n_shingles").alias("__size"))
    marks = stage(marks.filter("not __keep or (__rows > 1 and __size > 0)").drop("__size"), "marks")
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    same = F.col(key).cast("long").eqNullSafe(F.col("__id")) & (th == F.col("__hash"))
    marked = docs.join(sendable(marks), same, "left").filter(F.coalesce("__keep", F.lit(True)))
    single = marked.filter("__rows is null").select(docs.columns)
    if marks.filter("__keep").isEmpty():
        return single
    repeated = marked.filter("__rows > 1").dropDuplicates(["__id", "__hash"]).select(docs.columns)
    return single.unionByName(repeated)
