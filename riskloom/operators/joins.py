"""Joins with conditions beyond equality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

#: The level of intervals with an infinite end.
UNBOUNDED = 5000


def as_of(left: DataFrame, right: DataFrame, by: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each left row with the values of the last right row at or before it.

    One sort of the union instead of a range join: right rows come first at
    equal times, and the last non-null struct is carried forward. Without keys
    the rows are dealt by ranges of time, so no task sees all of them.
    """
    packed = F.struct(*values)
    marked = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType)})
    source = right.select(*keys, by, F.lit(0).alias("_side"), packed.alias("_v"))
    both = marked.unionByName(source, allowMissingColumns=True)
    if not keys:
        both = both.withColumn("_b", ordered.range_of(ordered.numeric(both, by), ordered.bounds(left, by)))
    over = Window.partitionBy(*(keys or ["_b"])).orderBy(by, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_v", F.last("_v", ignorenulls=True).over(over))
    if not keys:
        # What a range of times begins with: the last right row of the ranges before, one row a range.
        ends = both.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col(by))).alias("_e"))
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        begins = ends.select("_b", F.last("_e", ignorenulls=True).over(before).alias("_e"))
        carried = carried.join(F.broadcast(begins), "_b").withColumn("_v", F.coalesce("_v", "_e"))
    carried = carried.where("_side = 1")
    return carried.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def containing(texts: DataFrame, items: DataFrame, text: str, item: str, block: int = 4 << 20) -> DataFrame:
    """Rows of ``texts`` with each row of ``items`` whose ``item`` stands in their ``text``, verbatim.

    An item of three words or more has an inner word, which stands as a whole
    word wherever the item does: only texts with such a word are compared. The
    shorter items are looked for as they are. Items come in blocks of measured
    size, each copied to all tasks; texts are not shuffled.
    """
    words = F.split(item, r"\s+")
    inner = F.when(F.size(words) > 2, F.element_at(F.array_sort(F.slice(words, F.lit(2), F.size(words) - 2), lambda a, b: F.length(b) - F.length(a)), 1))
    keyed = items.where(F.length(item) > 0).withColumn("_w", inner)
    count = 1 + int((items.agg(F.sum(F.octet_length(item) + 64)).first()[0] or 0) // block)
    parts = []
    for k in range(count):
        part = keyed if count == 1 else keyed.where(F.pmod(F.xxhash64(item), F.lit(count)) == k)
        long, short = part.where("_w is not null"), part.where("_w is null")
        # The block's words as one row of measured size.
        words_of = lambda rows, c: F.broadcast(rows.agg(F.collect_set(c).alias("_all")))
        hits = texts.crossJoin(words_of(long, "_w")).withColumn("_w", F.explode(F.array_intersect(F.split(text, r"\s+"), "_all"))).drop("_all")
        parts.append(hits.join(F.broadcast(long), "_w").where(F.contains(text, item)).drop("_w"))
        hits = texts.crossJoin(words_of(short, item)).withColumn("_s", F.explode(F.filter("_all", lambda x: F.contains(F.col(text), x)))).drop("_all")
        parts.append(hits.join(F.broadcast(short), F.col("_s") == F.col(item)).drop("_s", "_w"))
    return reduce(DataFrame.unionByName, parts)


def band(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows whose ``at`` lies in the other side's [low, high], by cells: an equi-join, then the exact test.

    An interval lies in cells as wide as itself (``width`` times a power of
    two), so in three at most, however wide it is; a value looks into its cell
    of each width that occurs. Unbounded intervals share one cell. Intervals
    that are empty, null or not numbers meet nothing.
    """
    lo, hi, x = (F.col(c).cast("double") for c in (low, high, at))
    open_ = (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
    known = right.where(F.col(low) <= F.col(high)).where(~F.isnan(lo) & ~F.isnan(hi))
    level = F.when(open_, UNBOUNDED).otherwise(F.ceil(F.log2(F.greatest((hi - lo) / width, F.lit(1.0)))).cast("int"))
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))
    cell = lambda v: F.when(F.col("_level") == UNBOUNDED, F.lit(0).cast("long")).otherwise(F.floor(v / size))
    leveled = known.withColumn("_level", level)
    cells = leveled.withColumn("_cell", F.explode(F.sequence(cell(lo), cell(hi))))
    levels = leveled.select("_level").distinct()  # at most as many as a double has exponents
    looked = left.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_cell", cell(x))
    return looked.join(cells, ["_level", "_cell"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_level", "_cell")


def dense_panel(rows: DataFrame, days: DataFrame, members: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """One row per day and member, zeros where there is none. ``members`` is a registry of fixed size."""
    grid = days.join(F.broadcast(members), how="cross")
    return grid.join(rows, list(keys), "left").na.fill(0, list(fill))
