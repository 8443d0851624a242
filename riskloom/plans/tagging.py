"""Queries of tagging: places, the cycle, calibration, table functions; and of workbooks and artefacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import lateral, text
from ..operators import tagging, vectors
from ..sources import readers, shared, writers
from . import articles as A
from .registry import query
from .risk import W

TITLES = (
    "Talks in Sri Lanka and South Korea", "Saudi Arabia, Saudi oil and the UAE", "The Indian Ocean, not Indiana", "North Korea and Korea", "Chabahar Port and CHABAHAR", "The IMEC corridor meets the Suez Canal",
    "Attari Wagah Border closed", "Britain's British guests from England", "Oman or Romania, womanly", "american-made for the United States of America", "No place at all", "Hormuz: the Hormuz Strait of Hormuz",
)


def titled(spark, sf_dir):
    """Documents under a headline: ``id, title, content, event_time, duplicate_of``."""
    n = F.col("doc_id")
    title = A.cases(n % len(TITLES), enumerate(TITLES))
    return A.table(spark, sf_dir, "documents").select(n.alias("id"), title.alias("title"), F.col("text").alias("content"), F.timestamp_seconds(n * 600).alias("event_time"), F.when(n % 13 == 0, n - 1).alias("duplicate_of"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _names(found, order, block) -> tuple[str, str]:
    """SQL of the names' pattern, longest first, and of their table (name, rank, block)."""
    rows = [(w.lower(), i, block(x)) for i, x in enumerate(sorted(found, key=order)) for w in x[-1]]
    return "|".join(sorted((w for w, _, _ in rows), key=len, reverse=True)), ", ".join(f"({_quoted(w)}, {i}, {_quoted(b)})" for w, i, b in rows)


_country, _country_rows = _names(C.COUNTRIES, lambda c: c[:4], lambda c: f"1#{c[1]}#{c[0]}#{c[0]}#{c[2]}#{c[3]}#0")
_place, _place_rows = _names([(*p[:1], *p[2:6], p[1]) for p in C.PLACES], lambda p: p[0], lambda p: f"4#{p[0]}#{p[3]}#{p[4]}#{p[1]}#{p[2]}#0")
_titles = "CASE doc_id % " + str(len(TITLES)) + " " + " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in enumerate(TITLES)) + " END"


@query(f"""WITH b AS (SELECT doc_id, {_titles} || ' ' || coalesce(text, '') AS b FROM documents), m AS (SELECT * FROM (VALUES {_country_rows}) AS v(w, i, block)), p AS (SELECT * FROM (VALUES {_place_rows}) AS v(w, i, block)),
c AS (SELECT doc_id, lower(unnest(regexp_extract_all(b, '(?i)\\b({_country})\\b', 1))) AS w FROM b), d AS (SELECT doc_id, lower(unnest(regexp_extract_all(b, '(?i)\\b({_place})\\b', 1))) AS w FROM b),
f AS (SELECT DISTINCT doc_id, 1 AS k, i, block FROM c JOIN m USING (w) UNION ALL SELECT DISTINCT doc_id, 2, i, block FROM d JOIN p USING (w))
SELECT b.doc_id, coalesce(string_agg(block, ';' ORDER BY k, i), '') AS locations FROM b LEFT JOIN f USING (doc_id) GROUP BY b.doc_id""")
def place_mentions(spark, sf_dir):
    """Countries and route places that headlines and whole texts name: left-most, longest, without overlaps."""
    return titled(spark, sf_dir).select(F.col("id").alias("doc_id"), text.located(F.col("title"), F.col("content")).alias("locations"))


@query()
def tagging_cycle(spark, sf_dir):
    """All canonical documents tagged in batches until none is pending (tested against plain Python; prototypes have no SQL)."""
    path = shared.run_folder(spark, "tags") + "/tags"
    rows = titled(spark, sf_dir)
    tagging.run(rows.where("id % 2 = 0"), path, "v1")
    tagging.run(rows, path, "v1")
    return tagging.current(spark, path).drop("extracted_at")


CODES = tuple(C.DESCRIPTIONS)[:20:2]
GRID, RANGE = (0.1, 0.15, 0.2, 0.25, 0.3, 0.34, 0.4), (0.15, 0.5)
_similar = "c AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT label, i, avg(x) AS m FROM c GROUP BY 1, 2), q AS (SELECT label, list(m ORDER BY i) AS proto FROM p GROUP BY 1), s AS (SELECT e.vec_id, q.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.proto), 4) AS sim FROM embeddings e CROSS JOIN q)"
_first = sum(c in C.TIER1 for c in CODES)
SWEEP_SQL = f"""{_similar}, g AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS threshold),
h AS (SELECT vec_id, threshold, count(*) FILTER (WHERE sim >= threshold AND label < {_first}) AS t1, count(*) FILTER (WHERE sim >= threshold AND label >= {_first}) AS t2 FROM s CROSS JOIN g GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN t1 + t2 > 0 THEN least(0.5, (t1 * 1.0 + t2 * 0.6) / 3.0)::DOUBLE END AS score FROM h),
w AS (SELECT threshold, count(*) AS total, count(score) AS positive, median(score) AS med, avg(score) AS mean, count(*) FILTER (WHERE t1 > 0) AS tier1, count(*) FILTER (WHERE t2 > 0) AS tier2 FROM k GROUP BY 1),
swept AS (SELECT *, coalesce(med BETWEEN {RANGE[0]} AND {RANGE[1]} AND mean BETWEEN {RANGE[0]} AND {RANGE[1]}, FALSE) AS passed, positive < 30 OR positive < 0.1 * total AS low_coverage FROM w)"""


def swept(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings")
    pairs = vectors.assign(rows, vectors.prototypes(rows, "label", "embedding"), "label", "embedding", "vec_id")
    # As many similarities as there are labels.
    compared = pairs.groupBy(F.col("vec_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("label", F.round("similarity", 4).alias("s")))), lambda x: x["s"]).alias("similarities"))
    return tagging.sweep(compared, GRID, CODES, RANGE, RANGE)


@query(f"WITH {SWEEP_SQL} SELECT threshold, total, positive, round(med, 6) AS median, round(mean, 6) AS mean, tier1, tier2, 0 AS tier3, passed, low_coverage FROM swept")
def calibration_sweep(spark, sf_dir):
    return swept(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("median", "mean")})


@query(f"WITH {SWEEP_SQL} SELECT threshold, positive, round(med, 6) AS median, total < 100 AS advisory FROM swept WHERE passed ORDER BY positive DESC, threshold LIMIT 1")
def threshold_pick(spark, sf_dir):
    """The threshold that passes both ranges with the most coverage, the lower on ties."""
    return tagging.pick(swept(spark, sf_dir)).select("threshold", "positive", F.round("median", 6).alias("median"), "advisory")


@query(f"{W}{A.ROUTES_SQL} SELECT id, name AS fullname, c AS country, adm1, lat, lon FROM fields")
def locations_lateral(spark, sf_dir):
    """Mentions by the table function, laterally from SQL."""
    lateral.register(spark)
    return spark.sql("SELECT a.id, m.fullname, m.country, m.adm1, m.lat, m.lon FROM {rows} a, LATERAL parse_locations(a.locations) m", rows=A.articles(spark, sf_dir).select("id", "locations"))


@query("SELECT * FROM (VALUES ('products', TRUE, TRUE), ('payloads', TRUE, TRUE), ('absent', FALSE, NULL)) AS v(artefact, there, fresh) WHERE (SELECT count(*) FROM nation) > 0")
def artefact_freshness(spark, sf_dir):
    """How old written artefacts are, by the times of their files."""
    root = shared.run_folder(spark, "artefacts")
    nations = A.table(spark, sf_dir, "nation")
    writers.products(f"{root}/products", nations=nations)
    writers.payload(nations, "n_nationkey").write.json(f"{root}/payloads")
    found = readers.freshness(spark, {n: f"{root}/{n}" for n in ("products", "payloads", "absent")})
    return found.select("artefact", (F.col("files") > 0).alias("there"), (F.col("as_of") > F.current_timestamp() - F.expr("INTERVAL 1 HOUR")).alias("fresh"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) + 1e-6, 4) AS bench FROM orders GROUP BY 1")
def benchmark_workbook(spark, sf_dir):
    """A benchmark in workbooks, one a year, with days as serial dates, read back by its column names."""
    root = shared.run_folder(spark, "books")
    writers.day_books(A.daily_prices(spark, sf_dir).select("day", F.col("close").alias("GPRD")), f"{root}/bench.xlsx")
    return readers.benchmark(spark, f"{root}/bench.xlsx", "GPRD")
