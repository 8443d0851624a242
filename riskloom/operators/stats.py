"""Statistics that Spark lacks or defines otherwise: rank correlation, unbiased skew, curves, error measures."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import ordered


def skew(value: str) -> Column:
    """Bias-corrected sample skewness; null for fewer than three values."""
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation of complete pairs; null where a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def quantile(value: str, q: float) -> Column:
    return F.percentile(value, F.lit(q))


def average_rank(rows: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank.

    Ranks come from counts of distinct values, so rows are aggregated before
    the ordered window and a tie of any size is one row in it. Without keys
    the values are dealt by ranges, so no task sees all of them.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    if not keys:
        ranked = ordered.running(shared.cut(counts), value, {"_before": "_c"})
        return rows.join(ranked.select(value, (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(out)), value)
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(*keys, value, (before + (F.col("_c") + 1) / 2.0).alias(out))
    return rows.join(ranks, [*keys, value])


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of complete pairs, ties averaged."""
    known = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    ranked = average_rank(average_rank(known, "x", "rx"), "y", "ry")
    return ranked.agg(correlation("rx", "ry").alias("spearman"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums; null without both classes."""
    ranked = average_rank(rows.select(F.col(score).alias("s"), F.col(label).alias("l")).where("s is not null and l is not null"), "s", "r")
    p, n = F.count_if(F.col("l") == 1), F.count_if(F.col("l") != 1)
    total = F.sum(F.when(F.col("l") == 1, F.col("r")))
    return ranked.agg(F.try_divide(total - p * (p + 1) / 2.0, p * n).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Sum of precision times recall gained at each distinct score, from the top."""
    by_score = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).alias("tp"), F.count("*").alias("n"))
    curve = ordered.running(shared.cut(by_score), "s", {"ctp": "tp", "cn": "n"}, descending=True)
    gained = F.col("tp") * (F.col("ctp") + F.col("tp")) / (F.col("cn") + F.col("n"))
    return curve.agg(F.try_divide(F.sum(gained), F.sum("tp")).alias("average_precision"))


def f1(predicted: Column, label: Column) -> Column:
    tp = F.count_if(predicted & (label == 1))
    wrong = F.count_if(predicted & (label != 1)) + F.count_if(~predicted & (label == 1))
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + wrong), F.lit(0.0))


def errors(rows: DataFrame, actual: str, predicted: str, naive: str) -> DataFrame:
    """RMSE, MAE and R² against a naive forecast, over rows with all three."""
    known = rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull() & F.col(naive).isNotNull())
    e, b = F.col(actual) - F.col(predicted), F.col(actual) - F.col(naive)
    return known.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.sum(b * b))).alias("r2_vs_naive"), F.count("*").alias("n")
    )


def ols_hac(rows: DataFrame, y: str, x: str, order: str, lags: int = 6) -> DataFrame:
    """One-variable least squares with Newey-West standard error of the slope."""
    known = rows.select(F.col(y).alias("y"), F.col(x).alias("x"), F.col(order).alias("t")).where("x is not null and y is not null")
    every = Window.partitionBy()
    fitted = known.withColumns(
        {"b": F.regr_slope("y", "x").over(every), "a": F.regr_intercept("y", "x").over(every), "d": F.col("x") - F.avg("x").over(every), "n": F.count("*").over(every)}
    ).withColumn("u", F.col("d") * (F.col("y") - F.col("a") - F.col("b") * F.col("x")))
    by = Window.partitionBy().orderBy("t")
    terms = [F.sum(F.col("u") * F.col("u"))] + [F.lit(2.0 * (1 - k / (lags + 1))) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0)) for k in range(1, lags + 1)]
    lagged = fitted.withColumns({f"u{k}": F.lag("u", k).over(by) for k in range(1, lags + 1)})
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return lagged.agg(
        F.first("b").alias("slope"), F.first("a").alias("intercept"), (F.sqrt(total) / F.sum(F.col("d") * F.col("d"))).alias("slope_se"),
        F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"),
    )


TERMS = "array<struct<term: string, coef: double, se: double, z: double, p: double, low: double, high: double>>"
NORMAL_95 = 1.959963984540054


def _solved(normal: pd.Series, moments: pd.Series) -> pd.DataFrame:
    """Coefficients and inverse of the normal equations of each row (k x k; nulls where they are singular)."""
    out = []
    for a, b in zip(normal, moments):
        k = len(b)
        matrix = np.array(a, float).reshape(k, k)
        if not np.isfinite(matrix).all() or np.linalg.matrix_rank(matrix) < k:
            out.append((None, None))
            continue
        inverse = np.linalg.inv(matrix)
        out.append(((inverse @ np.array(b, float)).tolist(), inverse.ravel().tolist()))
    return pd.DataFrame(out, columns=["beta", "inverse"])


def _described(names: Sequence[str]):
    @F.pandas_udf(TERMS)
    def terms(beta: pd.Series, inverse: pd.Series, gamma: pd.Series, lagged: pd.Series) -> pd.Series:
        out = []
        for b, i, g, w in zip(beta, inverse, gamma, lagged):
            if b is None:
                out.append([{"term": n} for n in names])
                continue
            k = len(b)
            i, g, w = (np.array(x, float).reshape(k, k) for x in (i, g, w))
            errors = np.sqrt(np.maximum(np.diag(i @ (g + w + w.T) @ i), 0))
            rows = []
            for name, c, e in zip(names, b, errors):
                z = c / e if e else None
                rows.append({"term": name, "coef": c, "se": e, "z": z, "p": None if z is None else math.erfc(abs(z) / math.sqrt(2)), "low": c - NORMAL_95 * e, "high": c + NORMAL_95 * e})
            out.append(rows)
        return pd.Series(out)

    return terms


def ols(rows: DataFrame, y: str, xs: Sequence[str], order: str, lags: int = 6) -> DataFrame:
    """Least squares on a constant and ``xs``, with Newey-West errors: ``term, coef, se, z, p, low, high, r2, adj_r2, dw, n``.

    Rows with all values, one per value of ``order`` (numbers, dates or
    times). The normal equations and the lagged outer products of the scores
    are sums over all rows; rows get their position by ranges and meet those
    before them by an equi-join on it, so no task sees the whole series. Only
    k x k matrices are solved in Python. Terms of a singular system are null.
    """
    names = ["const", *xs]
    k = len(names)
    x = [f"_x{i}" for i in range(k)]
    known = rows.select(F.col(order).alias("_t"), F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *[F.col(c).cast("double").alias(f"_x{i + 1}") for i, c in enumerate(xs)])
    known = shared.cut(known.na.drop())
    cells = lambda left, right: F.array(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)) for a in left for b in right])
    sums = known.agg(cells(x, x).alias("normal"), cells(x, ["_y"]).alias("moments"), F.count("*").alias("n"), F.var_pop("_y").alias("_v"))
    solved = F.pandas_udf(_solved, "struct<beta: array<double>, inverse: array<double>>")
    fit = sums.withColumn("fit", solved("normal", "moments")).select("n", "_v", "fit.*")
    fitted = known.crossJoin(F.broadcast(fit.select("beta")))  # one row on the right
    residual = F.col("_y") - reduce(lambda a, b: a + b, [F.col(c) * F.get("beta", F.lit(i)) for i, c in enumerate(x)])
    scores = fitted.withColumn("_e", residual).select("_t", "_e", F.lit(1).alias("_one"), *[(F.col(c) * F.col("_e")).alias(f"_u{i}") for i, c in enumerate(x)])
    u = [f"_u{i}" for i in range(k)]
    placed = shared.cut(ordered.running(scores, "_t", {"_at": "_one"}))
    before = placed.select(F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + lags)).alias("_to"), F.col("_at").alias("_from"), F.col("_e").alias("_eb"), *[F.col(c).alias(f"{c}b") for c in u])
    joined = placed.join(before, F.col("_at") == F.col("_to"))
    weighted = joined.withColumn("_w", 1 - (F.col("_at") - F.col("_from")) / (lags + 1.0))
    with_weights = weighted.agg(F.array(*[F.coalesce(F.sum(F.col("_w") * F.col(a) * F.col(f"{b}b")), F.lit(0.0)) for a in u for b in u]).alias("lagged"), F.sum(F.when(F.col("_at") - F.col("_from") == 1, (F.col("_e") - F.col("_eb")) ** 2)).alias("_dd"))
    now = placed.agg(cells(u, u).alias("gamma"), F.sum(F.col("_e") ** 2).alias("_ss"))
    one = fit.crossJoin(now).crossJoin(with_weights)  # one row each
    r2 = 1 - F.try_divide(F.col("_ss"), F.col("_v") * F.col("n"))
    adjusted = 1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - 1, F.col("n") - k)
    told = one.withColumn("r2", r2).withColumns({"adj_r2": adjusted, "dw": F.try_divide(F.col("_dd"), F.col("_ss")), "t": _described(names)("beta", "inverse", "gamma", "lagged")})
    return told.select(F.explode("t").alias("t"), "r2", "adj_r2", "dw", "n").select("t.*", "r2", "adj_r2", "dw", "n")
