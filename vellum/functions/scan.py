"""Running values over long sequences, in two passes.

A window over a whole project is one task, however large the project.  Here the sequence is
cut into blocks that follow each other: windows only run within a block; each block is summed
up into one row; a window over those few rows gives what a block takes over from the others
(its carry), and the two are put together: sums add up, the last value is that of the block
or else of the carry, the least is the lesser of both.  All are monoids, so any cut into
blocks gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.plans.settle import settle

#: Lines of a file that make a block, as a power of two.
BLOCK_BITS = 12


@dataclass
class Running:
    """What to carry along a sequence, by the name of the result."""

    #: Sums up to a row and with it.
    sums: dict[str, Column] = field(default_factory=dict)
    #: The last value that isn't null up to a row and with it.
    lasts: dict[str, Column] = field(default_factory=dict)
    #: The least value of the rows after a row.
    nexts: dict[str, Column] = field(default_factory=dict)


def latest(lines: DataFrame, marks: DataFrame, by: list[str], value: str) -> DataFrame:
    """``lines`` with ``value``, that of the last of ``marks`` in the same file at or before a line.

    Both have the columns ``by`` of a file and ``line_no``; a line has one mark at most, and marks
    are few against the lines.  Lines and marks are sorted together by stretches, so that the lines
    are shuffled once and never joined; what a stretch takes over from those before it is a mark at its beginning.
    """
    stretch, kind = F.shiftright("line_no", BLOCK_BITS), marks.schema[value].dataType
    nothing = F.lit(None).cast(kind).alias(value)
    held = marks.groupBy(*by, stretch.alias("__stretch")).agg(F.max_by(value, "line_no").alias(value))
    seen = lines.select(*by, stretch.alias("__stretch")).distinct().select("*", nothing)
    blocks = seen.unionByName(held).groupBy(*by, "__stretch").agg(F.first(value, ignorenulls=True).alias(value))
    before = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carries = blocks.select(*by, F.shiftleft("__stretch", BLOCK_BITS).alias("line_no"), F.last(value, ignorenulls=True).over(before).alias(value)).filter(F.col(value).isNotNull())
    own = [f for f in lines.schema if f.name not in (*by, "line_no")]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in own]
    rows = lines.select(*by, "line_no", *[f.name for f in own], nothing, F.lit(2).alias("__kind"))
    for df, rank in ((marks, 1), (carries, 0)):
        rows = rows.unionByName(df.select(*by, "line_no", *empty, value, F.lit(rank).alias("__kind")))
    rows = rows.withColumn("__stretch", stretch)
    upto = Window.partitionBy("__stretch", *reversed(by)).orderBy("line_no", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(value, F.last(value, ignorenulls=True).over(upto)).filter("__kind = 2")
    return found.select(*lines.columns, value)


def scan(df: DataFrame, by: list[str], block: list[str], order: list[str], running: Running, keep: bool = False) -> DataFrame:
    """``df`` with the running values of each sequence ``by``; blocks follow each other as their columns ``block``, rows as ``order``.

    Both passes read ``df``; with ``keep`` it is computed once and written to the checkpoint
    folder before, which pays for what is small against the way to it (headings, not lines).
    """
    inner = Window.partitionBy(*by, *block).orderBy(*order)
    inner_back = Window.partitionBy(*by, *block).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    value = {f"__v_{k}": c for k, c in (running.sums | running.lasts | running.nexts).items()}
    rows = settle(df.withColumns(value)) if keep else df.withColumns(value)
    place = F.struct(*order)
    totals = [F.sum(f"__v_{k}").alias(f"__t_{k}") for k in running.sums]
    totals += [F.max_by(f"__v_{k}", F.when(F.col(f"__v_{k}").isNotNull(), place)).alias(f"__t_{k}") for k in running.lasts]
    totals += [F.min(f"__v_{k}").alias(f"__t_{k}") for k in running.nexts]
    blocks = rows.groupBy(*by, *block).agg(*totals)
    before = Window.partitionBy(*by).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in block]).rowsBetween(Window.unboundedPreceding, -1)
    carries = blocks.select(
        *by, *block,
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__c_{k}") for k in running.sums],
        *[F.last(f"__t_{k}", ignorenulls=True).over(before).alias(f"__c_{k}") for k in running.lasts],
        *[F.min(f"__t_{k}").over(after).alias(f"__c_{k}") for k in running.nexts],
    )
    named = carries.select(*[F.col(c).alias(f"__k_{c}") for c in (*by, *block)], *carries.columns[len(by) + len(block) :])
    joined = rows.join(named, reduce(Column.__and__, [rows[c].eqNullSafe(named[f"__k_{c}"]) for c in (*by, *block)]))
    out = [(F.coalesce(F.sum(f"__v_{k}").over(upto), F.lit(0)) + F.col(f"__c_{k}")).alias(k) for k in running.sums]
    out += [F.coalesce(F.last(f"__v_{k}", ignorenulls=True).over(upto), F.col(f"__c_{k}")).alias(k) for k in running.lasts]
    out += [F.least(F.min(f"__v_{k}").over(inner_back), F.col(f"__c_{k}")).alias(k) for k in running.nexts]  # nulls don't count
    return joined.select(*df.columns, *out)
