"""Queries of text functions over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, text
from ..functions import constants as C
from . import articles as A
from .registry import query

#: Words that the invented documents have, as lexicons of the driver's queries.
NEG, POS = ("the", "threat", "and", "le"), ("of", "la", "der")
DIMS = {"c18.1": ("of", "and"), "c18.2": ("threat", "le"), "c18.3": ("is",), "c9.1": ("der", "die")}
_words = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: lower(x))"
WORDS_SQL = f"w AS (SELECT doc_id, source, lang, text, {_words} AS words FROM documents)"


def docs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents")


def _count(lexicon) -> str:
    return f"len(list_filter(words, lambda x: x IN ({A.listed(lexicon)})))"


@query(f"WITH {WORDS_SQL} SELECT doc_id, len(words) AS n_words, round(coalesce(100.0 * {_count(NEG)} / nullif(len(words), 0), 0), 6)::DOUBLE AS neg_pct, round(coalesce(100.0 * {_count(NEG + POS)} / nullif(len(words), 0), 0), 6)::DOUBLE AS tonal_pct FROM w")
def token_density(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", text.tallied(F.col("text"), NEG, POS).alias("w"))
    found, n = F.col("w.found"), F.col("w.n")
    return rows.select("doc_id", n.cast("long").alias("n_words"), F.round(text.density(found, NEG, n), 6).alias("neg_pct"), F.round(text.density(found, NEG + POS, n), 6).alias("tonal_pct"))


@query(f"WITH {WORDS_SQL} SELECT doc_id, {', '.join(f'round(coalesce(least(1.0, {_count(v)} / nullif(len(words) * 0.04, 0)), 0), 6)::DOUBLE AS d{i}' for i, v in enumerate(DIMS.values()))} FROM w")
def lexicon_dims(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", text.tallied(F.col("text"), *DIMS.values()).alias("w"))
    return rows.select("doc_id", *[F.round(text.dimension_density(F.col("w.found"), v, total=F.col("w.n")), 6).alias(f"d{i}") for i, v in enumerate(DIMS.values())])


KEYS = ("License", "token", "the and", "threat", "avec")
_kw = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])') THEN '{k}' END" for k in KEYS)


@query(f"SELECT doc_id, concat_ws(',', {_kw}) AS keywords FROM documents")
def keyword_match(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.keywords(F.col("text"), KEYS), ",").alias("keywords"))


GAZETTEER = (("Ofland", ("license", "public"), "1#Ofland#OF#OF#1.0#2.0#0"), ("Alpha", ("token",), "1#Alpha#AL#AL#3.0#4.0#0"))
_gz = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(a)})($|[^\\p{{L}}\\p{{N}}_])') THEN '{b}' END" for _, a, b in sorted(GAZETTEER))


@query(f"SELECT doc_id, concat_ws(';', {_gz}) AS locations FROM documents")
def mention_extract(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.place_blocks(F.col("text"), GAZETTEER).alias("locations"))


def topic_sql(toks: str) -> str:
    """SQL of the topic of a list of tokens: the first bucket of any, else the first token in words, else General."""
    rules = [f"WHEN k IN ({A.listed(codes)}) THEN '{name}'" for name, codes in C.TOPIC_CODES.items()] + [f"WHEN regexp_matches(k, '{p}') THEN '{name}'" for name, p in C.TOPIC_PATTERNS]
    keys = f"list_transform({toks}, lambda t: regexp_replace(upper(trim(t)), '[\\s-]+', '_', 'g'))"
    buckets = f"list_filter(list_transform({keys}, lambda k: CASE {' '.join(rules)} END), lambda x: x IS NOT NULL)"
    words = f"string_split(trim(regexp_replace({toks}[1], '[_\\s-]+', ' ', 'g')), ' ')"
    return f"coalesce({buckets}[1], array_to_string(list_transform({words}, lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' '), 'General')"


TOKENS_SQL = "list_filter(list_transform(regexp_split_to_array(themes, '[,;]+'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"WITH {A.ARTICLES_SQL}, t AS (SELECT event_type, {TOKENS_SQL} AS toks, count(*) AS n FROM articles GROUP BY 1, 2) SELECT event_type, {topic_sql('toks')} AS topic, CAST(sum(n) AS BIGINT) AS n, len(toks) AS n_tokens FROM t GROUP BY event_type, topic, n_tokens")
def topic_bucket(spark, sf_dir):
    rows = A.articles(spark, sf_dir).select("event_type", text.article_topic(F.col("themes")).alias("topic"), F.size(text.tokens(F.col("themes"))).cast("long").alias("n_tokens"))
    return rows.groupBy("event_type", "topic", "n_tokens").agg(F.count("*").alias("n"))


def pages(spark, sf_dir):
    return A.table(spark, sf_dir, "pages")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, coalesce(regexp_extract(html, '<meta[^>]+charset=\"([^\"]*)\"', 1), '') AS charset, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_matches(url, '^https?://[^/?#]+') AS safe FROM pages")
def page_meta(spark, sf_dir):
    return pages(spark, sf_dir).select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", r'<meta[^>]+charset="([^"]*)"', 1).alias("charset"),
        F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("host"),
        text.safe_url(F.col("url")).alias("safe"),
    )


_un = "regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')"
for _a, _b in text.ENTITIES:
    _un = "replace({}, '{}', '{}')".format(_un, _a, _b.replace("'", "''"))


@query(f"SELECT page_id, trim(regexp_replace({_un}, '\\s+', ' ', 'g')) AS plain FROM pages")
def html_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^(https?)://', 1) || '://cdn.example/' || page_id || '.png' WHEN page_id % 3 = 1 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/img/' || page_id || '.png' ELSE 'https://x.example/i.png' END AS image FROM pages")
def meta_image(spark, sf_dir):
    """Image metadata in both attribute orders, made absolute; the pages have none, so a tag is put in front."""
    n = F.col("page_id").cast("string")
    first = F.concat(F.lit('<meta property="og:image" content=" //cdn.example/'), n, F.lit('.png "/>'))
    second = F.concat(F.lit("<META content='/img/"), n, F.lit(".png' name='twitter:image'>"))
    third = F.lit('<meta name="twitter:image" content="https://x.example/i.png">')
    html = F.concat(F.when(F.col("page_id") % 3 == 0, first).when(F.col("page_id") % 3 == 1, second).otherwise(third), "html")
    image = text.meta_content(html, ("og:image", "twitter:image"))
    return pages(spark, sf_dir).select("page_id", text.absolute_url(image, F.col("url")).alias("image"))


@query("SELECT n_name, left(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_'), 40) AS slug, n_name ILIKE '%n_1%' AS wild FROM nation")
def ilike_slug(spark, sf_dir):
    return A.table(spark, sf_dir, "nation").select("n_name", text.slug(F.col("n_name")).alias("slug"), F.col("n_name").ilike("%n_1%").alias("wild"))


@query("SELECT DISTINCT CAST(ts AS DATE) AS day FROM events")
def distinct_days(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select(F.to_date(F.col("ts").cast("timestamp")).alias("day")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(value + CAST(json_extract_string(props, '$.k') AS BIGINT), 6) AS total FROM events")
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k long")
    return A.table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.round(F.col("value") + parsed["k"], 6).alias("total"))


@query("SELECT source, lang, count(*) AS n, CASE WHEN source IN ('src1', 'src2') THEN 'hi' ELSE 'en' END AS language FROM documents GROUP BY 1, 2")
def source_coverage(spark, sf_dir):
    out = docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return out.select("source", "lang", "n", text.language_of(F.col("source"), ("src1", "src2")).alias("language"))


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'india_nepal_raxaul' WHEN c_mktsegment = 'BUILDING' THEN 'strait_of_hormuz,instc_chabahar,imec' WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE 'red_sea_suez,strait_of_hormuz,danish_straits_baltic,strait_of_malacca,taiwan_south_china_sea' END AS routes FROM customer")
def suggested_routes(spark, sf_dir):
    seg = F.col("c_mktsegment")
    origin = F.when(seg == "HOUSEHOLD", "Kathmandu, Nepal").when(seg == "BUILDING", "Dubai").when(seg == "MACHINERY", " ").otherwise("Nowhere")
    mode = F.when(seg == "HOUSEHOLD", "road").otherwise("sea")
    return A.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.array_join(text.suggested_routes(origin, F.lit("Delhi"), mode), ",").alias("routes"))


@query("SELECT p_partkey, regexp_replace(p_brand, '[^0-9.-]', '', 'g')::DOUBLE AS number, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS head FROM (SELECT p_partkey, p_brand, split_part(p_name, ' ', 1) AS p_name FROM part)")
def part_labels(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", text.leading_number(F.col("p_brand")).alias("number"), text.humanise(F.get(F.split("p_name", " "), F.lit(0))).alias("head"))


@query("WITH t AS (SELECT conv_id, turn, role, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) AS turns, CAST(sum(n) AS BIGINT) AS chars, count(*) FILTER (WHERE role <> before) AS switches, count(*) FILTER (WHERE role = 'assistant') AS answers FROM t GROUP BY conv_id")
def turn_stats(spark, sf_dir):
    """The role before each turn is carried by stretches of turns, so a conversation of any length stays spread."""
    from ..operators import ordered

    rows = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    both = ordered.lagged(rows, ["conv_id"], "turn", "role", "before")
    return both.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("chars"), F.count_if(F.col("role") != F.col("before")).alias("switches"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query("SELECT event_id, dayofweek(ts + INTERVAL 330 MINUTE) BETWEEN 1 AND 5 AND strftime(ts + INTERVAL 330 MINUTE, '%H:%M') BETWEEN '09:15' AND '15:30' AS open FROM events")
def session_open(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", bands.session_open(F.col("ts").cast("timestamp")).alias("open"))


#: Routes that the places of an article must and must not lead to, by the list that it has.
FIXTURES = (
    (("india_china_lac",), ("red_sea_suez",)), (("strait_of_hormuz", "instc_chabahar"), ("imec",)), (("strait_of_hormuz",), ("strait_of_malacca",)),
    (("strait_of_malacca", "red_sea_suez"), ("cape_of_good_hope",)), ((), ("imec",)),
)
_sets = lambda n: "CASE k % 5 " + " ".join(f"WHEN {i} THEN [{A.listed(f[n])}]::VARCHAR[]" for i, f in enumerate(FIXTURES)) + " END"


@query(f"WITH {A.ROUTES_SQL}, f AS (SELECT s.id, any_value(k) AS k, coalesce(list(route) FILTER (WHERE route IS NOT NULL), []) AS found FROM scored s LEFT JOIN tagged t ON t.id = s.id GROUP BY s.id) SELECT k % 5 AS fixture, count(*) FILTER (WHERE list_has_all(found, {_sets(0)}) AND NOT list_has_any(found, {_sets(1)})) AS passed, count(*) AS n FROM f GROUP BY 1")
def label_fixtures(spark, sf_dir):
    """Labelled articles by fixture: how many have all routes that they should and none that they shouldn't."""
    from ..operators.feed import label_sets

    k = F.col("k") % 5
    listed = lambda n: A.cases(k, [(i, text.strings(f[n]) if f[n] else F.array().cast("array<string>")) for i, f in enumerate(FIXTURES)])
    passed = label_sets(listed(0), listed(1), text.masked_routes(F.col("routes")))
    return A.routed(spark, sf_dir).groupBy(k.cast("long").alias("fixture")).agg(F.count_if(passed).alias("passed"), F.count("*").alias("n"))


@query()
def near_dup_titles(spark, sf_dir):
    """Greedy canonical titles (matching-block similarity has no SQL form)."""
    from ..operators import similar_titles

    title = F.get(F.split("text", "\n"), F.lit(0))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), title.alias("title"), F.timestamp_seconds(F.col("doc_id") * 600).alias("event_time"))
    return similar_titles.resolve(rows)


@query("WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS a FROM documents) SELECT x.doc_id AS early, y.doc_id AS late, CASE WHEN x.a = y.a THEN 0 ELSE levenshtein(x.a, y.a) END AS distance FROM t x JOIN t y ON y.doc_id BETWEEN x.doc_id + 1 AND x.doc_id + 12 AND abs(strlen(x.a) - strlen(y.a)) <= 6 AND (x.a = y.a OR levenshtein(x.a, y.a) <= 6)")
def near_title_distance(spark, sf_dir):
    """Whole first lines among the 12 that follow, at most six edits of their UTF-8 bytes apart."""
    line = F.decode(F.encode(F.get(F.split("text", "\n"), F.lit(0)), "UTF-8"), "ISO-8859-1")  # one character a byte
    t = docs(spark, sf_dir).select("doc_id", line.alias("a"))
    late = t.select(F.col("doc_id").alias("late"), F.col("a").alias("b"), F.explode(F.sequence(F.col("doc_id") - 12, F.col("doc_id") - 1)).alias("doc_id"))
    return t.join(late, "doc_id").select(F.col("doc_id").alias("early"), "late", F.levenshtein("a", "b", 6).alias("distance")).where("distance >= 0").select("early", "late", F.col("distance").cast("long"))


@query("SELECT doc_id, contains(lower(d.text), lower(b.text)) AS verbatim, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def verbatim_items(spark, sf_dir):
    """Items that stand verbatim in documents."""
    from ..operators import joins

    items = A.table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("item"))
    found = joins.containing(docs(spark, sf_dir).select("doc_id", F.lower("text").alias("body")), items, "body", "item")
    return found.select("doc_id", F.lit(True).alias("verbatim"), "item_id")
