"""Structured Streaming forms of the ingest and refresh cycle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import rollup, scoring, similar_titles, tables, timeseries
from ..sources import readers, shared, versions


def first_links(entries: DataFrame, delay: str = "1 day") -> DataFrame:
    """First entry per link within the delay; state is dropped with the watermark."""
    return entries.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["link"])


def day_counts(entries: DataFrame, delay: str = "1 day") -> DataFrame:
    """Entries and risk per UTC day, late ones within the delay included (update or append mode)."""
    return (
        entries.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day"))
        .agg(F.count("*").alias("n"), F.sum("risk_score").alias("risk_sum"))
        .select(F.to_date("window.start").alias("day"), "n", "risk_sum")
    )


def upsert_days(path: str):
    """A ``foreachBatch`` sink that replaces the days of a batch in a table; a replayed batch changes nothing more."""

    def write(batch: DataFrame, _: int) -> None:
        newest = tables.dedup(batch, ["day"], [F.desc("n")])
        newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return write


def _claim(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = list(zip(*state.get)) if state.exists else []
    out, newest = [], 0
    rows = pd.concat(list(batches)).sort_values(["event_time", "id"])
    for row in rows.itertuples():
        at = int(row.event_time.timestamp())
        newest = max(newest, at)
        held = [h for h in held if at - h[1] <= similar_titles.SECONDS]
        text = row.title.strip().lower()
        copy = next((h[0] for h in held if similar_titles.alike(text, h[2])), None)
        if copy is None:
            held.append((row.id, at, text))
        out.append((row.id, copy))
    if held:
        state.update(tuple(list(c) for c in zip(*held)))
        if newest:
            state.setTimeoutTimestamp(max((newest + similar_titles.SECONDS) * 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["id", "duplicate_of"]).astype({"id": "int64", "duplicate_of": "Int64"})


def similar_within(entries: DataFrame, key: str, delay: str = "2 hours") -> DataFrame:
    """``id, duplicate_of`` as titles arrive, compared within a key over the last window; older titles leave the state.

    A constant key compares across all sources, as one state; a key such as a
    topic or language spreads the work and compares within it.
    """
    return (
        entries.withWatermark("event_time", delay)
        .select(key, "id", "title", "event_time")
        .groupBy(key)
        .applyInPandasWithState(_claim, "id long, duplicate_of long", "ids array<long>, times array<long>, titles array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def refresh_index(path: str, base: tuple[str, str], product: str, cut: str | None = None, least: int = 7):
    """A ``foreachBatch`` sink that keeps articles, day sums and the index of all days, under ``path``.

    Per batch: articles that are new (the first of an id stays) are kept by
    batch and day; the days they touch, late ones included, are scored again
    from all their articles; the other days come in as sums; and the whole
    series is normalised, since one day alone would always be at its own mean.
    With fewer than ``least`` days since ``product`` (or all of them, while
    there are fewer) the sums are kept and the index waits. Index and sums are
    one version, switched to once per batch: a batch that runs again after its
    switch changes nothing, before it writes the same.
    """
    held, series = f"{path}/articles", f"{path}/series"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = versions.current(spark, series)
        if number <= last:
            return
        first = tables.dedup(batch.where("id IS NOT NULL AND day IS NOT NULL"), ["id"], [F.asc("event_time")])
        touched = first.select("day").distinct()
        kept = None
        if last >= 0 and readers.first_existing(spark, [held]):
            # Partition pruning by batch and day: only articles of touched days are read.
            kept = spark.read.option("mergeSchema", "true").parquet(held).where(F.col("batch") < number).join(F.broadcast(touched), "day", "left_semi").drop("batch")
            first = first.join(kept.select("id"), "id", "left_anti")
        first.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(held)
        stored = spark.read.parquet(held).where(F.col("batch") == number).drop("batch")
        rows = stored if kept is None else stored.unionByName(kept, allowMissingColumns=True).join(F.broadcast(stored.select("day").distinct()), "day", "left_semi")
        fresh = rollup.daily(scoring.score_articles(rows))
        if last >= 0:
            before = spark.read.parquet(versions.folder(series, last)).select(*fresh.columns)
            fresh = tables.replace_days(before, fresh)
        days = rollup.ensure_ratios(shared.cut(fresh))
        start = F.lit(product).cast("date")
        since = days.agg(F.count_if(F.col("day") >= start).alias("n"), F.greatest(F.lit(0), F.date_diff(F.max("day"), start) + 1).alias("most")).first()
        ready = since["n"] > 0 and since["n"] >= min(least, since["most"])
        index = timeseries.index_series(days, *base, cut=cut)
        names = [c for c in index.columns if c not in days.columns]
        out = index if ready else days.withColumns({c: F.lit(None).cast("double") for c in names})
        versions.write(out.withColumn("ready", F.lit(ready)), series, number)

    return write


def current_index(spark, path: str) -> DataFrame:
    """The series that the last finished batch of ``refresh_index`` left."""
    return versions.read(spark, f"{path}/series")


class Pairs(StatefulProcessor):
    """Titles of one index key, held for a window: each that arrives is paired with those like it.

    Two titles share many keys; only the first that both have makes the pair.
    A title's first key alone also says that it came.
    """

    def __init__(self, threshold: float, seconds: int) -> None:
        self.threshold, self.seconds = threshold, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("titles", "id long", "at double, title string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {i[0]: tuple(v) for i, v in self.held.iterator()}
        out = []
        arrived = pd.concat(list(rows)).sort_values(["at", "id"])
        for row in arrived.itertuples():
            mine = similar_titles.keys(row.t, self.threshold)
            if mine[0] == key[0]:
                out.append((row.id, row.at, None, None))
            for i, (at, t) in held.items():
                if i != row.id and abs(row.at - at) <= self.seconds and next(k for k in mine if k in set(similar_titles.keys(t, self.threshold))) == key[0]:
                    if similar_titles.alike(row.t, t, self.threshold):
                        out.append((row.id, row.at, i, at))
            if row.id not in held:
                held[row.id] = row.at, row.t
                self.held.updateValue((row.id,), (row.at, row.t))
                self.handle.registerTimer(int((row.at + self.seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["id", "at", "early", "early_at"]).astype({"id": "int64", "at": "float64", "early": "Int64", "early_at": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [i for i, v in self.held.iterator() if int((v[0] + self.seconds) * 1000) + 1 <= expiredTimerInfo.getExpiryTimeInMs()]
        for i in gone:
            self.held.removeKey(i)
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "at": pd.Series(dtype="float64"), "early": pd.Series(dtype="Int64"), "early_at": pd.Series(dtype="float64")})

    def close(self) -> None:
        """Nothing is open."""


def similar_pairs(entries: DataFrame, delay: str = "2 hours", threshold: float = similar_titles.THRESHOLD, seconds: int = similar_titles.SECONDS) -> DataFrame:
    """``id, at, early, early_at``: every title once with null ends, and once per held title that it is like, across all sources.

    Titles are routed by their index keys, so the work of a window is spread
    over as many groups as there are keys. Needs the RocksDB state store.
    """
    rows = entries.withWatermark("event_time", delay).select("id", similar_titles.clean(F.col("title")).alias("t"), (F.unix_micros("event_time") / 1e6).alias("at"), "event_time").where("t <> '' AND at IS NOT NULL")
    keyed = rows.withColumn("key", F.explode(similar_titles._keys_of(threshold)("t")))
    return keyed.groupBy("key").transformWithStateInPandas(Pairs(threshold, seconds), "id long, at double, early long, early_at double", "Append", "EventTime")


def claim_titles(path: str):
    """A ``foreachBatch`` sink of ``similar_pairs``: decisions ``id, duplicate_of, at`` in ``path``, one folder a batch.

    A title copies the earliest similar original, those of earlier batches
    included, whose decisions stand. A batch that runs again writes the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        new = rows.where("early IS NULL").select("id", "at").dropDuplicates(["id"])
        seen = rows.where("early IS NOT NULL").select(F.col("id").alias("late"), "at", "early", "early_at").dropDuplicates(["late", "early"])
        fresh = new.select(F.col("id").alias("early"), F.lit(True).alias("new"))
        marked = seen.join(fresh, "early", "left")
        # Among titles of this batch the earlier one decides; one of an earlier batch always does.
        forward = F.col("new").isNull() | (F.struct("early_at", "early") < F.struct(F.col("at"), F.col("late")))
        edges = marked.select(F.when(forward, F.col("late")).otherwise(F.col("early")).alias("late"), F.when(forward, F.col("early")).otherwise(F.col("late")).alias("early"), F.when(forward, F.col("early_at")).otherwise(F.col("at")).alias("at")).distinct()
        old = spark.createDataFrame([], "id long, duplicate_of long, at double")
        if number and readers.first_existing(spark, [path]):
            old = spark.read.schema("id long, duplicate_of long, at double, batch long").parquet(path).where(F.col("batch") < number).drop("batch")
        known = old.join(edges.select(F.col("early").alias("id")).distinct(), "id", "left_semi").select("id", "duplicate_of")
        settled = similar_titles.settle(edges, known)
        decided = new.join(settled, "id", "left").select("id", "duplicate_of", "at")
        decided.write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.unpersist()

    return write


class Progress(StreamingQueryListener):
    """Stops the queries it guards at the first batch that had rows and brought nothing forward."""

    def __init__(self) -> None:
        self.stuck: dict[int, int] = {}
        self.stopped: list[str] = []

    def guard(self, sink):
        """A ``foreachBatch`` sink around one that returns how many rows it brought forward."""

        def write(batch: DataFrame, number: int) -> None:
            if not sink(batch, number) and not batch.isEmpty():
                self.stuck[number] = self.stuck.get(number, 0) + 1

        return write

    def onQueryStarted(self, event) -> None:
        """Nothing to watch yet."""

    def onQueryIdle(self, event) -> None:
        """No batch, no progress to miss."""

    def onQueryProgress(self, event) -> None:
        if event.progress.batchId in self.stuck:
            self.stopped.append(str(event.progress.id))
            SparkSession.active().streams.get(str(event.progress.id)).stop()

    def onQueryTerminated(self, event) -> None:
        """Its state is in the checkpoint."""


def run_guarded(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> bool:
    """Process what there is, but stop after a batch without progress; whether all of it went through.

    ``sink(batch, number)`` returns the number of rows it brought forward. The
    batches after the stop stay unread for the next run.
    """
    spark, watch = stream.sparkSession, Progress()
    spark.streams.addListener(watch)
    try:
        query = stream.writeStream.foreachBatch(watch.guard(sink)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        while not query.awaitTermination(1):
            if watch.stuck:
                query.stop()
        return not watch.stuck
    finally:
        spark.streams.removeListener(watch)


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, batch by batch, and stop: the scheduled form of a stream."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
