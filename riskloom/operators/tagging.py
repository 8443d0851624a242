"""The tagging cycle: pending articles, their tags, and the tags written back until none is pending; and the threshold's calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text
from ..sources import readers
from . import scoring, themes

TAGS = "id long, themes string, tone_neg double, tone_polarity double, dims string, locations string, version string, extracted_at timestamp"


def tag(articles: DataFrame, version: str, encoder: themes.Encoder = themes.hashed_words, threshold: float = C.SIMILARITY) -> DataFrame:
    """The columns of ``TAGS`` from ``id, title, content``: themes, tone, dimensions and places of whole texts."""
    body = F.trim(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    # Rows pass to the encoder with the words of the lexicons alone.
    told = text.tallied(body, C.NEGATIVE_WORDS, C.POSITIVE_WORDS, *C.DIM_LEXICONS.values())
    rows = articles.select("id", "title", "content", told.alias("_words"))
    found, n = F.col("_words.found"), F.col("_words.n")
    return rows.select(
        "id",
        F.array_join(themes.reached(themes.similarities(F.col("title"), F.col("content"), encoder), threshold), ";").alias("themes"),
        text.density(found, C.NEGATIVE_WORDS, n).alias("tone_neg"),
        text.density(found, [*C.NEGATIVE_WORDS, *C.POSITIVE_WORDS], n).alias("tone_polarity"),
        text.dimension_list(found, total=n).alias("dims"),
        text.located(F.col("title"), F.col("content")).alias("locations"),
        F.lit(version).alias("version"),
        F.current_timestamp().alias("extracted_at"),
    )


def written(spark: SparkSession, path: str) -> DataFrame:
    """All tags under ``path`` with their ``batch``; none if nothing was written."""
    if readers.first_existing(spark, [path]):
        return spark.read.schema(f"{TAGS}, batch long").parquet(path)
    # Known to be empty when the plan is made: no join shuffles articles for it.
    return spark.createDataFrame([], f"{TAGS}, batch long").where(F.lit(False))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last tags of every article."""
    tags = written(spark, path)
    names = [c for c in tags.columns if c not in ("id", "batch")]
    return tags.groupBy("id").agg(F.max_by(F.struct(*names), "batch").alias("t")).select("id", "t.*")


def pending(articles: DataFrame, tags: DataFrame, version: str) -> DataFrame:
    """Canonical articles that this version hasn't tagged."""
    rows = articles.where("duplicate_of IS NULL") if "duplicate_of" in articles.columns else articles
    return rows.join(tags.where(F.col("version") == version).select("id"), "id", "left_anti")


def run(articles: DataFrame, path: str, version: str, limit: int | None = None, until_empty: bool = False, encoder: themes.Encoder = themes.hashed_words) -> int:
    """Tag the oldest pending articles, all or ``limit`` of them, and again until none is pending; how many were tagged.

    A batch is one folder of tags under ``path``, overwritten if it is run
    again. A round that tags nothing ends the run, whatever is pending.
    """
    spark, total = articles.sparkSession, 0
    while True:
        tags = written(spark, path)
        todo = pending(articles, tags, version)
        if limit is not None:
            todo = todo.orderBy(F.asc_nulls_first("event_time"), "id").limit(limit)
        number = (tags.agg(F.max("batch")).first()[0] or 0) + 1
        folder = f"{path}/batch={number}"
        tag(todo, version, encoder).write.mode("overwrite").parquet(folder)
        updated = spark.read.parquet(folder).count()
        total += updated
        if not until_empty or limit is None or updated == 0:
            return total


def sweep(compared: DataFrame, thresholds: Sequence[float], codes: Sequence[str] = tuple(C.DESCRIPTIONS), median: tuple[float, float] = C.CALIBRATION_MEDIAN, mean: tuple[float, float] = C.CALIBRATION_MEAN) -> DataFrame:
    """``threshold, total, positive, median, mean, tier1, tier2, tier3, passed, low_coverage`` from ``id, similarities``.

    Each text is read once and meets every threshold in its own row; the
    theme score's median and mean are of texts with any theme.
    """
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = compared.select("id", F.explode(F.transform(grid, lambda t: F.struct(t.alias("threshold"), F.array_join(themes.reached(F.col("similarities"), t, codes), ";").alias("themes")))).alias("r")).select("id", "r.*")
    none = F.lit(None).cast("double")
    scored = scoring.score_articles(rows.withColumns({"tone_neg": none, "tone_polarity": none, "dims": F.lit("")}))
    score = F.when(F.col("risk_score") > 0, F.col("theme_score"))
    tiers = [F.count_if(text.theme_hits(F.col("themes"), t) > 0).alias(f"tier{i}") for i, (t, _) in enumerate(C.TIER_WEIGHTS, 1)]
    told = scored.groupBy("threshold").agg(F.count("*").alias("total"), F.count(score).alias("positive"), F.median(score).alias("median"), F.avg(score).alias("mean"), *tiers)
    passed = F.coalesce(F.col("median").between(*median) & F.col("mean").between(*mean), F.lit(False))
    low = (F.col("positive") < C.LEAST_POSITIVE) | (F.col("positive") < C.LEAST_SHARE * F.col("total"))
    return told.withColumns({"passed": passed, "low_coverage": low})


def pick(swept: DataFrame) -> DataFrame:
    """Of the thresholds that pass, the one with the most texts that have a theme, the lower on ties; ``advisory`` for small samples. No row if none passes."""
    best = F.max_by(F.struct(*swept.columns), F.struct("positive", (-F.col("threshold")).alias("t")))
    return swept.where("passed").agg(best.alias("b")).where("b IS NOT NULL").select("b.*").withColumn("advisory", F.col("total") < C.LEAST_SAMPLE)


#: Fixed value: routes that may well have no article.
SELDOM = frozenset(
    "danish_straits_baltic cape_of_good_hope imec instc_chabahar india_china_lac india_pakistan_attari india_bangladesh_petrapole india_nepal_raxaul".split()
)


def theme_hits(rows: DataFrame, themes: str = "themes", most: int = 15) -> tuple[DataFrame, DataFrame]:
    """Articles by tier (``tier, articles, total, low_coverage``) and the ``most`` frequent known codes (``tier, code, n``).

    The row of tier ``any`` says whether too few articles have a code to choose a threshold by: under 30, or under a tenth.
    """
    tiers = {f"tier{i}": codes for i, (codes, _) in enumerate(C.TIER_WEIGHTS, 1)}
    hit = {t: text.has_code(F.col(themes), codes) for t, codes in tiers.items()}
    hit["any"] = reduce(lambda a, b: a | b, hit.values())
    one = rows.agg(F.count("*").alias("total"), *[F.count_if(h).alias(t) for t, h in hit.items()])
    shares = one.select("total", F.inline(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("articles")) for t in hit])))
    low = (F.col("articles") < 30) | (F.col("articles") < 0.1 * F.col("total"))
    codes = rows.select(F.explode(F.array_distinct(text.theme_codes(F.col(themes)))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    known = rows.sparkSession.createDataFrame([(t, c) for t, cs in tiers.items() for c in sorted(cs)], "tier string, code string")
    top = codes.join(F.broadcast(known), "code").orderBy(F.desc("n"), "tier", "code").limit(most)
    return shares.withColumn("low_coverage", F.when(F.col("tier") == "any", low)), top.select("tier", "code", "n")


def route_coverage(sums: DataFrame, advisory: bool = False) -> DataFrame:
    """``kind, route, matches, share, status`` of articles counted by ``mask, blocks, n``: a row a route, and one of place blocks.

    ``blocks`` tells whether an article has a block of type 4. A route without a
    match fails unless it is seldom seen; with ``advisory`` (a small sample) it
    is noted. Place blocks fail if no article has one and warn under 1 %.
    """
    one = sums.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("blocks"), F.col("n")).otherwise(0)).alias("blocks"), *[F.sum(F.when(F.array_contains(text.masked_routes(F.col("mask")), r), F.col("n")).otherwise(0)).alias(r) for r in C.ROUTES])
    fail, warn = ("note", "note") if advisory else ("fail", "warn")
    status = lambda r: F.when(F.col(r) > 0, "pass").otherwise("seldom" if r in SELDOM else fail)
    cell = lambda kind, r, c, s: F.struct(F.lit(kind).alias("kind"), F.lit(r).alias("route"), F.col(c).alias("matches"), F.try_divide(F.col(c), F.col("total")).alias("share"), s.alias("status"))
    blocks = F.when(F.col("blocks") == 0, "fail").when(F.col("blocks") < 0.01 * F.col("total"), warn).otherwise("pass")
    return one.where("total > 0").select(F.inline(F.array(*[cell("route", r, r, status(r)) for r in C.ROUTES], cell("blocks", "", "blocks", blocks))))
