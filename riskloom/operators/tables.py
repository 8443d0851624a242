"""Key-wise table changes on plain files: upsert, insert-if-absent, replace days, dedup, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key; columns that only one side has are null on the other."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Old rows and those new ones whose key is absent, the first of each key."""
    fresh = dedup(new, keys, order or [F.lit(0)]).join(old.select(*keys).distinct(), list(keys), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def update_columns(old: DataFrame, changes: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Non-null changes of allowed columns written over the rows they name; other columns are an error."""
    changed = [c for c in changes.columns if c not in keys]
    if unknown := sorted(set(changed) - set(allowed)):
        raise ValueError(f"columns that may not change: {unknown}")
    joined = old.alias("o").join(changes.alias("c"), list(keys), "left")
    return joined.select(*[F.coalesce(F.col(f"c.{c}"), F.col(f"o.{c}")).alias(c) if c in changed else F.col(c if c in keys else f"o.{c}") for c in old.columns])


def delete_before(rows: DataFrame, column: str, cutoff: Column) -> DataFrame:
    """Rows from the cutoff on; rows without a value stay."""
    return rows.where(F.col(column).isNull() | (F.col(column) >= cutoff))


def dedup(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def replace_days(history: DataFrame, rescored: DataFrame, day: str = "day") -> DataFrame:
    """History without the rescored days, and the rescored days; a dirty day that wasn't rescored keeps its old row."""
    return upsert(history, rescored, [day])


def merge_sources(early: DataFrame, late: DataFrame, cut: str, day: str = "day") -> DataFrame:
    """The early source before the cut, the late one from it on."""
    at = F.lit(cut).cast("date")
    return early.where(F.col(day) < at).unionByName(late.where(F.col(day) >= at), allowMissingColumns=True)


def health(attempts: DataFrame, key: str = "feed", at: str = "at", ok: str = "ok") -> DataFrame:
    """Per feed: last attempt, last success, and failures since that success. One aggregation, no window."""
    runs = attempts.groupBy(key).agg(F.max(at).alias("last_attempt"), F.max(F.when(F.col(ok), F.col(at))).alias("last_success"))
    since = attempts.join(runs.select(key, "last_success"), key).where(~F.col(ok) & (F.col("last_success").isNull() | (F.col(at) > F.col("last_success"))))
    return runs.join(since.groupBy(key).agg(F.count("*").alias("failures")), key, "left").na.fill(0, ["failures"])


def filler(days: DataFrame, missing: str) -> DataFrame:
    """Synthetic rows for a day's articles that were seen but not taken: ``day, identifier``."""
    numbered = days.where(F.col(missing) > 0).select("day", F.explode(F.sequence(F.lit(1), F.col(missing).cast("int"))).alias("k"))
    return numbered.select("day", F.concat(F.lit("filler-"), F.date_format("day", "yyyyMMdd"), F.lit("-"), F.lpad("k", 6, "0")).alias("identifier"))


def gate(rows: DataFrame, *conditions: tuple[Column, str]) -> DataFrame:
    """Rows unchanged; an error at run time on the first that breaks a condition."""
    for condition, message in conditions:
        rows = rows.where(F.assert_true(condition, message).isNull())
    return rows


def systematic_sample(rows: DataFrame, order: Sequence[str], step: int, offset: int = 0) -> DataFrame:
    """Every ``step``-th row of the order.

    Rows are dealt by ranges of the first column of the order and numbered
    within them; the rows of the ranges before are one number a range.
    """
    if step < 1 or not 0 <= offset < step:
        raise ValueError("0 <= offset < step is needed")
    number = ordered.range_of(ordered.numeric(rows, order[0]), ordered.bounds(rows, order[0]))
    placed = rows.withColumn("_b", number)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1 + F.col("_o")
    return placed.join(F.broadcast(sizes), "_b").withColumn("_n", at).where(F.col("_n") % step == offset).drop("_n", "_b", "_o")


def seeded_sample(rows: DataFrame, keys: Sequence[str], identifier: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per key, by a hash of the identifier and a seed."""
    return dedup_n(rows, keys, [F.xxhash64(identifier, F.lit(seed)), F.col(identifier)], n)


def dedup_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
