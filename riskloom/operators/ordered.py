"""Order over whole tables without a single task: value ranges, sums within them, and one row a range for what lies before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def numeric(rows: DataFrame, by: str) -> Column:
    """A value in the order of a column: a number for numeric, date or timestamp columns, text as it is."""
    kind = dict(rows.dtypes)[by]
    if kind == "string":
        return F.col(by)
    if kind == "date":
        return F.unix_date(by).cast("double")
    return F.unix_micros(by).cast("double") if kind == "timestamp" else F.col(by).cast("double")


def text_bounds(rows: DataFrame, by: str, parts: int = PARTS) -> list[str]:
    """Bounds of ranges of a text column, from a sample of some thousand values by their hash."""
    n = rows.count()
    some = rows.select(by).where(F.pmod(F.xxhash64(by), F.lit(max(1, n // (100 * parts)))) == 0).distinct().orderBy(by)
    found = [r[0] for r in some.limit(1000 * parts).collect() if r[0] is not None]
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


def bounds(rows: DataFrame, by: str, parts: int = PARTS) -> list:
    """Bounds of value ranges of like size; fewer than ``parts`` values, by one aggregate."""
    if dict(rows.dtypes)[by] == "string":
        return text_bounds(rows, by, parts)
    found = rows.agg(F.percentile_approx(numeric(rows, by), [k / parts for k in range(1, parts)], 50 * parts)).first()[0]
    return sorted(set(found or []))


def range_of(value: Column, cuts: list) -> Column:
    """The number of the range of a value; equal values share one, nulls come first."""
    return F.coalesce(sum(((value > F.lit(c)).cast("int") for c in cuts), F.lit(0)), F.lit(-1))


def running(rows: DataFrame, by: str, sums: Mapping[str, str], descending: bool = False, parts: int = PARTS) -> DataFrame:
    """``rows`` (one per value of ``by``) with ``sums`` (new column: summed column) over all rows before them in the order."""
    cuts = bounds(rows, by, parts)
    number = range_of(numeric(rows, by), cuts)
    placed = rows.withColumn("_b", -number if descending else number)
    inside = Window.partitionBy("_b").orderBy(F.desc(by) if descending else F.asc(by)).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("_b", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    joined = placed.join(F.broadcast(offsets), "_b")
    return joined.withColumns({o: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{o}") for o, c in sums.items()}).drop("_b", *[f"_o_{o}" for o in sums])


def lagged(rows: DataFrame, keys: Sequence[str], by: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """``rows`` with ``out``: the value of the row before within its key, by a whole number; null for the first.

    Rows are dealt by key and stretches of ``width``, so a key of any size is
    many tasks; what a stretch begins with is one row a stretch.
    """
    placed = rows.withColumn("_s", F.floor(F.col(by) / width))
    held = F.struct(F.col(value).alias("v"))
    ends = placed.groupBy(*keys, "_s").agg(F.max_by(held, by).alias("_e"))
    before = ends.select(*keys, "_s", F.lag("_e").over(Window.partitionBy(*keys).orderBy("_s")).alias("_e"))
    inside = Window.partitionBy(*keys, "_s").orderBy(by)
    carried = placed.withColumn("_p", F.lag(held).over(inside)).join(before, [*keys, "_s"])
    return carried.withColumn(out, F.coalesce("_p", "_e")["v"]).drop("_s", "_p", "_e")
