"""Queries of whole cycles: the refresh stream, a batch that resumes, regressions with robust errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import resume, rollup, scoring, signal, stats, timeseries
from ..sources import shared, versions
from ..streaming import jobs
from . import articles as A
from .refresh import LATE
from .registry import query
from .risk import COUNTS, DAYS_SQL, INDEX_SQL, W, r6, s6


@query(f"{W}{INDEX_SQL} SELECT day, total_articles, TRUE AS ready, {s6('risk_sum', 'raw_ratio', 'risk_index', 'acts_index', 'threats_index', 'ma7', 'ma30')} FROM indexed")
def refresh_stream(spark, sf_dir):
    """Articles that arrive in three batches, the last of them late ones of two days, give the series of a full run."""
    root = shared.run_folder(spark, "refresh")
    rows = A.articles(spark, sf_dir)
    late, split = F.expr(LATE.replace("DATE ", "date")), F.col("day") <= F.lit("2024-01-12").cast("date")
    sink = jobs.refresh_index(root, (A.BASE_START, A.BASE_END), A.BASE_START)
    for arrived in (rows.where(~late & split), rows.where(~late & ~split), rows.where(late)):
        arrived.write.mode("append").parquet(f"{root}/in")
        jobs.run_available(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), sink, f"{root}/state")
    out = jobs.current_index(spark, root)
    return out.select("day", "total_articles", "ready", *r6("risk_sum", "raw_ratio", "risk_index", "acts_index", "threats_index", "ma7", "ma30"))


@query(f"{W}{DAYS_SQL} SELECT day, {', '.join(COUNTS)}, {s6('risk_sum', 'raw_ratio', 'acts_ratio')} FROM days")
def resumed_batch(spark, sf_dir):
    """Days scored in committed ranges: a run over the first ranges, and one over all that takes them up."""
    path, rows = shared.run_folder(spark, "resume"), A.articles(spark, sf_dir)
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    work = lambda a, b: rollup.daily(scoring.score_articles(rows.where(F.col("day").between(F.lit(a), F.lit(b)))))
    every = resume.ranges(first, last, 7)
    resume.run(spark, path, every[:2], work)
    return resume.run(spark, path, every, work).select("day", *COUNTS, *r6("risk_sum", "raw_ratio", "acts_ratio"))


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS twice FROM orders WHERE o_orderkey % 2 = 0")
def versioned_table(spark, sf_dir):
    """A table replaced twice by rows read from it, each time by one switch."""
    path = shared.run_folder(spark, "versions") + "/orders"
    versions.write(A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("twice")), path)
    versions.write(versions.read(spark, path).where("o_orderkey % 2 = 0"), path)
    versions.write(versions.read(spark, path).withColumn("twice", F.round(F.col("twice") * 2, 2)), path)
    return versions.read(spark, path)


def months(spark, sf_dir):
    """``month, rvol, ret, log_index, log_global`` and the month before's: prices, orders and lines by month."""
    daily = signal.returns(A.daily_prices(spark, sf_dir)).withColumn("month", F.trunc("day", "MM"))
    market = daily.groupBy("month").agg((F.stddev_samp("lr") * F.sqrt(F.lit(252.0)) * 100).alias("rvol"), (F.sum("lr") * 100).alias("ret"))
    level = lambda t, day, out: A.table(spark, sf_dir, t).groupBy(F.trunc(F.to_date(day), "MM").alias("month")).agg(F.ln(F.count("*").cast("double")).alias(out))
    both = market.join(level("orders", "o_orderdate", "log_index"), "month").join(level("lineitem", "l_shipdate", "log_global"), "month")
    w = timeseries.ordered(by="month")  # one row a month
    return both.withColumns({f"{c}_l1": F.lag(c).over(w) for c in ("rvol", "log_index", "log_global")})


REGRESSIONS = {
    "contemporaneous": ("rvol", ("log_index",)),
    "vol on index and vol before": ("rvol", ("log_index_l1", "rvol_l1")),
    "return on index before": ("ret", ("log_index_l1",)),
    "horse race": ("rvol", ("rvol_l1", "log_index_l1", "log_global_l1")),
}


@query()
def regressions(spark, sf_dir):
    """Four regressions by month with Newey-West errors of six lags (tested against matrix algebra)."""
    rows = shared.cut(months(spark, sf_dir))
    parts = [stats.ols(rows, y, xs, "month").select(F.lit(name).alias("model"), F.lit(y).alias("y"), "*") for name, (y, xs) in REGRESSIONS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
