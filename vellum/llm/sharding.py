"""Sharding by sampled splitters (operator 7).

Records are put in order of a hash of their text, so that equal texts are neighbours, and
cut into ranges: a size-weighted sample of keys gives quantile boundaries, exact byte
counts of the ranges follow, and a range that turned out overfull (one text may hold a
third of all rows) is subdivided by a second hash.  Prefix sums over the ranges give each
its place in the whole order of bytes, a window inside each range gives the record's
place, and the place gives the shard.  The law is ``bytes``: shard sizes are near equal.

Records larger than a fiftieth of a shard would make cuts uneven.  There are at most
``50 * n_shards`` of them, whatever the input; they are placed first, each in the shard
that has least, and the ranges fill up what is left.

What reaches the driver is bounded: the sample, one row a range and the large records.
The number of ranges grows with the rows (a range has a million at most), texts are not
shuffled, and slots are numbered from counts of ranges instead of one sort a shard.

Defined results: a null text has no bytes, size 16 and CRC 0; null ids are records like
others; repeated rows are placed each; an empty table has an empty result; further columns
come along only where named in ``keep``, and give way if they are called like a column of
the result.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Records over this part of a shard are placed one by one.
LARGE = 50
#: Columns of the result.
RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _bucket(bounds: np.ndarray, side: str):
    """A column function: how many of the sorted ``bounds`` lie below a value."""

    @F.pandas_udf("int")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values.to_numpy(), side).astype(np.int32))

    return of


def assign_shards(docs: DataFrame, n_shards: int = 40, sample_per_range: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns ``keep``, where not called like one of these."""
    spark = docs.sparkSession
    kept = {f"__keep_{i}": c for i, c in enumerate(keep) if c.lower() not in RESULT}  # set aside under names of their own
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        *[F.col(f"`{c}`").alias(k) for k, c in kept.items()],
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    rows = stage(rows, "shard-rows").withColumn("tie", F.xxhash64("doc_id", "rid"))
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    large_from = max(1, total // (n_shards * LARGE) + 1)

    # Large records: at most LARGE * n_shards rows.
    large = rows.filter(F.col("size") >= large_from).select("rid", "size").collect()
    large.sort(key=lambda r: (-r["size"], r["rid"]))
    fill = [(0, s) for s in range(n_shards)]
    placed, taken = [], [0] * n_shards
    for r in large:
        held, s = heapq.heappop(fill)
        placed.append((r["rid"], s, taken[s]))
        taken[s] += 1
        heapq.heappush(fill, (held + r["size"], s))
    held = [h for h, s in sorted(fill, key=lambda x: x[1])]

    # Room for the others: every shard is filled up to one level.
    rest = total - sum(held)
    level, among = 0.0, sorted(held)
    for k in range(1, n_shards + 1):
        level = (rest + sum(among[:k])) / k
        if k == n_shards or level <= among[k]:
            break
    cuts = np.array(list(accumulate(max(0.0, level - h) for h in held))[:-1])

    # Splitters from a sample in which a record's chance is its size.
    small = rows.filter(F.col("size") < large_from)
    n_ranges = int(min(20_000, max(8 * n_shards, -(-n_rows // 1_000_000))))
    step = max(1.0, rest / (n_ranges * sample_per_range))
    chance = (F.xxhash64("rid", F.lit("sample")) / F.lit(2.0**64)) + 0.5
    sample = small.filter(chance < F.col("size") / step).select("key", F.greatest("size", F.lit(step)).alias("weight")).toPandas().sort_values("key")
    if len(sample):
        quantile = np.searchsorted(sample["weight"].cumsum().to_numpy(), np.arange(1, n_ranges) * sample["weight"].sum() / n_ranges)
        splitters = np.unique(sample["key"].to_numpy()[np.minimum(quantile, len(sample) - 1)])
    else:
        splitters = np.zeros(0, np.int64)
    ranged = small.withColumn("range", _bucket(splitters, "left")("key"))

    # Overfull ranges are subdivided.
    found = {r["range"]: r["bytes"] for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
    fair = max(1.0, rest / n_ranges)
    parts = [(k, int(-(-b // fair))) for k, b in found.items() if b > 2 * fair]
    ranged = ranged.join(F.broadcast(spark.createDataFrame(parts, "range int, parts int")), "range", "left")
    part = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("parts")), F.col("parts") - 1)
    ranged = ranged.withColumn("part", F.coalesce(part, F.lit(0)).cast("int")).drop("parts")

    pieces = sorted((r["range"], r["part"], r["bytes"]) for r in ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes")).collect())
    before = accumulate((b for _, _, b in pieces), initial=0)
    bases = spark.createDataFrame([(r, p, b) for (r, p, _), b in zip(pieces, before, strict=False)], "range int, part int, base long")
    inside = Window.partitionBy("range", "part").orderBy("key", "tie", "rid")
    at = F.col("base") + F.sum("size").over(inside) - F.col("size") / 2
    spread = ranged.join(F.broadcast(bases), ["range", "part"]).select(
        *rows.columns, "range", "part", F.row_number().over(inside).alias("n"), at.cast("double").alias("at")
    )
    spread = stage(spread.withColumn("shard", _bucket(cuts, "right")("at")), "shard-places")

    # Slots: the large records first, then range after range.
    counted = sorted(
        (r["range"], r["part"], r["shard"], r["first"], r["rows"])
        for r in spread.groupBy("range", "part", "shard").agg(F.min("n").alias("first"), F.count("*").alias("rows")).collect()
    )
    slots, used = [], list(taken)
    for r, p, s, first, n in counted:
        slots.append((r, p, s, used[s] - first))
        used[s] += n
    slots = F.broadcast(spark.createDataFrame(slots, "range int, part int, shard int, ahead long"))
    out = [*rows.columns, "shard", "slot"]
    filled = spread.join(slots, ["range", "part", "shard"]).withColumn("slot", F.col("n") + F.col("ahead")).select(out)
    singles = F.broadcast(spark.createDataFrame(placed, "rid long, shard int, slot long"))
    both = filled.unionByName(rows.filter(F.col("size") >= large_from).join(singles, "rid").select(out))
    return both.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(k).alias(c) for k, c in kept.items()],
    )


def write_shards(docs: DataFrame, folder: str, n_shards: int = 40) -> None:
    """The documents themselves, one folder a shard, each file in order of its slots."""
    placed = assign_shards(docs, n_shards, keep=tuple(docs.columns))
    cut = placed.withColumn("__block", F.floor(F.col("slot") / 100_000))
    cut.repartition("shard", "__block").sortWithinPartitions("shard", "slot").drop("__block").write.partitionBy("shard").parquet(folder)
