"""Scalar rules: capped lines, safe ratios, regimes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def bands(value: Column, *steps: tuple[float, str], rest: str) -> Column:
    """The first label whose bound the value reaches, from the top down."""
    (bound, label), *more = steps
    out = F.when(value >= bound, label)
    for bound, label in more:
        out = out.when(value >= bound, label)
    return out.otherwise(rest)


def capped(value: Column, cap: float, scale: float, floor: float | None = None) -> Column:
    """Linear up to ``cap`` at ``scale``, from ``floor`` on; 0 below it."""
    if floor is None:
        return F.least(F.lit(cap), value / scale * cap)
    return F.when(value < floor, 0.0).otherwise(F.least(F.lit(cap), (value - floor) / scale * cap))


def clip(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(default))


def percent_change(first: Column, last: Column) -> Column:
    return F.when(first == 0, 0.0).otherwise((last - first) / first * 100.0)


def z_score(value: Column, mean: float = C.BASE_MEAN, std: float = C.BASE_STD) -> Column:
    return (value - mean) / std


def regime(z: Column) -> Column:
    return bands(z, (2, "HIGH"), (1, "ELEVATED"), (0, "MODERATE"), rest="LOW")


def index_regime(value: Column) -> Column:
    """Regime by the index alone; blank for a value that is no number."""
    return F.when(value.isNull() | F.isnan(value), "").otherwise(bands(value, (135, "ELEVATED"), (100, "MODERATE"), rest="LOW"))


def vol_regime(probability: Column) -> Column:
    return bands(probability, (0.5, "HIGH_VOL"), (0.25, "ELEVATED"), rest="NORMAL")


def stress(geo: Column, vol: Column) -> Column:
    return F.round(0.6 * geo + 0.4 * vol, 1)


def stress_regime(score: Column) -> Column:
    return bands(score, (75, "HIGH_STRESS"), (50, "WATCH"), rest="CALM")


def stress_story(score: Column, geo: Column, vol: Column) -> Column:
    """Which of the two signals leads: both, geo, vol, mixed or none."""
    return (
        F.when(score >= 75, "both")
        .when(score < 50, "none")
        .when((geo >= 60) & (vol < 50), "geo_leads")
        .when((vol >= 60) & (geo < 50), "vol_leads")
        .otherwise("mixed")
    )


def quadrant(geo: Column, vol: Column) -> Column:
    """Which of the two percentiles reach 50; an unavailable one doesn't."""
    g, v = F.coalesce(geo >= 50, F.lit(False)), F.coalesce(vol >= 50, F.lit(False))
    return F.when(g & v, "both").when(g, "geo_only").when(v, "vol_only").otherwise("calm")


def risk_action(risk: Column, status: Column) -> Column:
    return F.when(status == "insufficient_history", "Calibrating").otherwise(bands(risk, (50, "High"), (20, "Watch"), rest="Low"))


def trend(previous: Column, value: Column, band: float = 2.0) -> Column:
    return F.when(previous.isNull(), "flat").when(value - previous > band, "rising").when(value - previous < -band, "falling").otherwise("flat")


def spike(hits: Column, daily: Column, operational: Column) -> Column:
    return F.coalesce((hits > 0) & (daily > operational + 5), F.lit(False))


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def session_open(ts: Column, zone: str = "Asia/Kolkata", opens: str = "09:15", closes: str = "15:30") -> Column:
    """Whether a UTC time falls on a weekday between the exchange's hours of its own clock."""
    local = F.from_utc_timestamp(ts, zone)
    return F.dayofweek(local).between(2, 6) & F.date_format(local, "HH:mm").between(opens, closes)
