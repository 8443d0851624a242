"""Dashboard rules as columns: channels, tilts, verdicts, staleness, precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: Where a sector leans when risk is elevated, and otherwise.
SECTORS = (("energy", "headwind", "mixed"), ("it_exporters", "tailwind", "mixed"), ("banks", "mixed", "tailwind"), ("consumer_autos", "headwind", "mixed"), ("defence_infra", "mixed", "mixed"), ("pharma", "mixed", "mixed"))


def elevated(regime: Column) -> Column:
    return F.coalesce(F.upper(regime).isin("HIGH", "ELEVATED"), F.lit(False))


def sector_tilts(regime: Column, route: Column) -> Column:
    """Array of (sector, tilt); oil routes weigh on energy, border routes lift defence."""
    route, high = F.lower(F.coalesce(route, F.lit(""))), elevated(regime)
    out = []
    for sector, hot, calm in SECTORS:
        tilt = F.when(high, hot).otherwise(calm)
        if sector == "energy":
            tilt = F.when(high | route.contains("hormuz") | route.contains("red_sea"), "headwind").otherwise("mixed")
        if sector == "defence_infra":
            tilt = F.when(route.contains("lac") | route.contains("pakistan"), "tailwind").otherwise("mixed")
        out.append(F.struct(F.lit(sector).alias("sector"), tilt.alias("tilt")))
    return F.array(*out)


def channels(oil: Column, currency: Column, fear: Column, stocks: Column) -> Column:
    """Active transmission channels; a missing quote counts as unchanged."""
    o, c, f, s = (F.coalesce(x, F.lit(0.0)) for x in (oil, currency, fear, stocks))
    return F.array_compact(F.array(F.when((o > 0.3) & (c > 0.05), "oil_rupee"), F.when((f > 0.5) & (s < -0.1), "risk_off")))


def channel_tone(active: Column) -> Column:
    return F.when(F.size(active) >= 2, "alert").when(F.size(active) == 1, "watch").otherwise("clear")


def verdict(quadrant: Column, available: Column, stress_regime: Column) -> Column:
    """Today's message: partial without a vol model, then by quadrant, more urgent under high stress."""
    return (
        F.when(~F.coalesce(available, F.lit(False)), "partial")
        .when(quadrant == "calm", "normal")
        .when(quadrant == "geo_only", "headlines_hot")
        .when(quadrant == "vol_only", "markets_nervous")
        .when(F.upper(stress_regime) == "HIGH_STRESS", "both_stressed")
        .otherwise("elevated")
    )


def portfolio_context(stress: Column, route: Column, regime: Column) -> Column:
    return F.when(F.lower(stress) == "high", "combined").when(F.lower(stress) == "geo", "headline_led").when(F.coalesce(route, F.lit("")) != "", "route").when(elevated(regime), "regime").otherwise("none")


def quote_stale(as_of: Column, now: Column, exchange: Column, zone: str = "Asia/Kolkata") -> Column:
    """Whether a quote is older than the exchange's (or anyone's) current day; a quote without a day is stale."""
    today = F.to_date(F.from_utc_timestamp(now, zone))
    return F.coalesce(F.when(exchange, as_of < today).otherwise(F.datediff(today, as_of) >= 1), F.lit(True))


def usable_image(url: Column) -> Column:
    low = F.lower(url)
    bad = low.endswith(".ico") | low.contains("favicon") | low.contains("/icon.")
    return F.coalesce(~bad & url.rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def preferred_source(table_day: Column, table_value: Column, file_day: Column, file_value: Column) -> Column:
    """``file`` if it is newer, or of the same day and more than 0.5 apart; else ``table`` where it has a row."""
    newer = (file_day > table_day) | ((file_day == table_day) & (F.abs(table_value - file_value) > 0.5))
    return F.when(table_day.isNull() & file_day.isNull(), None).when(table_day.isNull() | F.coalesce(newer, F.lit(False)), "file").otherwise("table")


def staled(status: Column, freshness: Column, tier: Column, artefact_day: Column, live_day: Column) -> Column:
    """A passing offline headline check warns once its artefacts are older than the live index."""
    stale = F.coalesce(artefact_day < live_day, F.lit(False)) & (freshness == "offline") & (tier == "headline")
    return F.when(stale & (status == "pass"), "warn").otherwise(status)


def what_changed(index_days: Column, change_7: Column, label: Column, change: Column) -> Column:
    """A line on the week's move of the index and the largest mover of the day (from 0.05 % on)."""
    week = F.when(index_days < 8, "News risk 7d change needs 8+ index days").when(
        change_7.isNotNull(), F.concat(F.lit("News risk "), F.when(change_7 >= 0, "up").otherwise("down"), F.format_string(" %.1f%% over 7 days", F.abs(change_7)))
    )
    mover = F.when(F.abs(change) >= 0.05, F.concat(label, F.when(change >= 0, " +").otherwise(" "), F.format_string("%.2f%% today", change)))
    return F.coalesce(F.nullif(F.concat_ws(" \u00b7 ", week, mover), F.lit("")), F.lit("Waiting for market and news updates\u2026"))


def quote_source(exchange: Column, session_open: Column, fast_day: Column, intraday: Column, daily_day: Column, today: Column) -> Column:
    """Which quote to show: the fast one, an intraday one, the day's or a file's; null without any.

    An exchange's symbol takes the fast quote while the session is open, others
    if it isn't older than the daily one. Intraday history is asked for in an
    open session, or if the daily quote is a day old.
    """
    fast = fast_day.isNotNull() & F.when(exchange, session_open).otherwise(daily_day.isNull() | (fast_day >= daily_day))
    asked = F.when(exchange & session_open, True).otherwise(daily_day.isNull() | (F.datediff(today, daily_day) >= 1))
    return F.when(fast, "fast").when(asked & intraday, "intraday").when(daily_day.isNotNull(), "daily").when(fast_day.isNotNull(), "fast")


def quote_day(epoch_seconds: Column, daily_day: Column, today: Column, zone: str = "Asia/Kolkata") -> Column:
    """The day of a quote: of its own time on the exchange's clock, else the daily row's, else today."""
    return F.coalesce(F.to_date(F.from_utc_timestamp(F.timestamp_seconds(epoch_seconds), zone)), daily_day, today)


def toggled(watched: Column, item: Column) -> Column:
    """A watchlist without repeats, the item taken out if it is in it and added at its end if not."""
    once = F.array_distinct(F.coalesce(watched, F.array().cast("array<string>")))
    return F.when(F.array_contains(once, item), F.array_remove(once, item)).otherwise(F.array_append(once, item))


def waypoints(route: Column) -> Column:
    """The route's points as (latitude, longitude) pairs; its centre where it has none, nothing for an unknown route."""
    out = F.array().cast("array<array<double>>")
    for name in C.ROUTES:
        points = C.WAYPOINTS.get(name) or (C.CENTRES[name],)
        out = F.when(F.lower(route) == name, F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in points])).otherwise(out)
    return out


def centre(route: Column) -> Column:
    """The route's centre as (longitude, latitude)."""
    out = F.lit(None).cast("array<double>")
    for name, (lat, lon) in C.CENTRES.items():
        out = F.when(F.lower(route) == name, F.array(F.lit(lon), F.lit(lat))).otherwise(out)
    return out


def route_category(route: Column, own: Column) -> Column:
    """A row's own category, else the registry's, else sea."""
    known = F.create_map(*[F.lit(x) for k, v in C.ROUTES.items() for x in (k, v["category"])])
    return F.coalesce(own, F.try_element_at(known, F.lower(route)), F.lit("sea"))


def risk_colour(risk: Column) -> Column:
    return F.when(risk >= 50, "error").when(risk >= 20, "tertiary").otherwise("secondary")


def stale_reason(artefact_day: Column, live_day: Column) -> Column:
    """Why a report is stale; null if it isn't."""
    return F.when(artefact_day < live_day, "Offline benchmarks predate the current index. Re-run validate after index rebuild.")
