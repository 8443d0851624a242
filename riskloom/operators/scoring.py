"""Article scores: weighted themes, tone and coded dimensions, each capped, themes a must."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, text
from ..functions import constants as C


def clean_raw(raw: DataFrame) -> DataFrame:
    """Raw slot rows (``stamp, source, identifier, themes, locations, tone, dims``, all strings) to processed articles.

    Rows without a valid stamp or an identifier go; offsets leave the theme
    list; the tone list becomes three numbers.
    """
    stamp = F.try_to_timestamp(F.col("stamp"), F.lit("yyyyMMddHHmmss"))
    tone = F.coalesce(F.col("tone"), F.lit(""))
    return (
        raw.select(
            stamp.alias("event_time"),
            F.coalesce("source", F.lit("")).alias("source"),
            F.coalesce("identifier", F.lit("")).alias("identifier"),
            text.strip_offsets(F.coalesce("themes", F.lit(""))).alias("themes"),
            F.coalesce("locations", F.lit("")).alias("locations"),
            F.coalesce("dims", F.lit("")).alias("dims"),
            text.tone_part(tone, 0).alias("tone_overall"),
            text.tone_part(tone, 2, absolute=True).alias("tone_neg"),
            text.tone_part(tone, 3, absolute=True).alias("tone_polarity"),
        )
        .where(F.col("event_time").isNotNull() & (F.length("identifier") > 0))
    )


def score_articles(articles: DataFrame) -> DataFrame:
    """``articles`` with ``theme_score, tone_score, dim_score, risk_score, risk_type, category`` from ``themes, tone_neg, tone_polarity, dims``.

    All in whole-stage expressions; no shuffle.
    """
    out = articles.withColumns(
        {f"_t{i}": text.theme_hits(F.col("themes"), tier) for i, (tier, _) in enumerate(C.TIER_WEIGHTS, 1)}
        | {f"_d{i}": text.dimension(F.col("dims"), key) for i, key in enumerate(C.DIM_WEIGHTS)}
    )
    raw = reduce(lambda a, b: a + b, [F.col(f"_t{i}") * F.lit(w) for i, (_, w) in enumerate(C.TIER_WEIGHTS, 1)])
    neg, pol = (F.abs(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in ("tone_neg", "tone_polarity"))
    weighted = reduce(lambda a, b: a + b, [F.when(F.col(f"_d{i}") > C.DIM_MIN, F.col(f"_d{i}")).otherwise(0.0) * F.lit(w) for i, w in enumerate(C.DIM_WEIGHTS.values())])
    out = out.withColumns(
        {
            "theme_score": F.least(F.lit(C.THEME_CAP), raw / C.THEME_SCALE),
            "tone_score": bands.capped(neg, C.TONE_NEG_CAP, C.TONE_NEG_SCALE, C.TONE_NEG_MIN) + bands.capped(pol, C.TONE_POL_CAP, C.TONE_POL_SCALE),
            "dim_score": F.when(F.col("_t1") > 0, F.least(F.lit(C.DIM_CAP), weighted)).otherwise(0.0),
            "risk_type": F.when(F.col("_t1") > 0, "act").when(F.col("_t2") > 0, "threat").when(F.col("_t3") > 0, "context").otherwise("none"),
        }
    )
    # A row's score is made once: conditions on it aren't pushed through explode, where they would repeat all patterns.
    total = F.when(F.col("theme_score") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("theme_score") + F.col("tone_score") + F.col("dim_score")))
    out = out.drop("risk_score").select("*", F.explode(F.array(total)).alias("risk_score"))
    category: Column = F.lit("other")
    for name, listed in reversed(C.CATEGORIES.items()):
        category = F.when(text.has_code(F.col("themes"), listed), name).otherwise(category)
    out = out.withColumn("category", F.when(F.col("risk_score") == 0, "none").otherwise(category))
    return out.drop(*[f"_t{i}" for i in (1, 2, 3)], *[f"_d{i}" for i in range(len(C.DIM_WEIGHTS))])


def score_bucket(score: Column) -> Column:
    return F.when(score == 0, "zero").when(score <= 0.2, "to_0.2").when(score <= 0.4, "to_0.4").when(score <= 0.6, "to_0.6").otherwise("over_0.6")
