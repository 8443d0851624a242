"""Main-text extraction by equivalence-class template deduction.

Pages of one host share a template. Its tokens (tags with their path and
labels, and whole text blocks with their path) occur in page after page the
same number of times: their occurrence vectors over the host's pages are
equal. Tokens with equal vectors form a class; a class is valid if it is
frequent (in at least ``SUPPORT`` of the host's pages) and large (``LARGE``
tokens or more), and a valid token is nested if the element that holds it is
valid too, or else if it is in the class of the nearest valid element around. Nested valid tokens are the template, what stands between them are
slots, and the slots of the article are the page's text.

A vector is never held: per token, the number of pages and the sum of the
hashes of (page, count) identify it, both of which add up map-side, so a host
with any number of pages costs a few rows per token. A page that is listed
more than once counts once, whether or not it has an id. Templates are joined back
by broadcast while they are measurably small, else by a salted shuffle.

Template text is left out on every page, inside ``article``/``main`` elements
too. The article's slots are those under such elements (labels such as
``role="main"`` count too) if a page has any there, else all. Menus, footers,
sidebars, forms and hidden elements, by name or role, are left out anywhere.
Class and id words (adverts, notices, comments, ...) are a hint: an element
with one is left out if it stands in at least ``SUPPORT`` of the host's pages
and is no paragraph or heading; on a host without a template the words alone
decide. A page that is template throughout keeps its text.

Contract: one row per page. Null or empty html gives empty text; a null or
odd url counts as a host of its own name (empty); broken markup is read as
browsers do in the main (unclosed and unopened tags, unclosed comments).
Repeated pages give repeated rows with the text that one of them would have;
a null ``page_id`` stays null; extra columns are ignored. A page of n
characters takes memory and time in proportion, however deep its elements.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SUPPORT, LARGE, LEAST_PAGES = 0.5, 3, 3
#: Templates of up to this many bytes are broadcast; beyond, they are copied to ``SALTS`` places and shuffled.
BROADCAST, SALTS = 16 << 20, 64
#: Tokens that a task gathers before it passes them on.
GATHERED = 150_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|object|canvas|math|title)\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""",
    re.S | re.I,
)
LABEL = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# Element names by their role in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul dd dt tr td th tbody".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article section main nav aside header footer body html td th form blockquote".split())
DROPPED = frozenset("nav footer aside form button dialog menu fieldset head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form status".split())
DROPPED_LABELS = frozenset(
    "ad ads adv advert advertisement advertising advertorial sponsor sponsored promo promotion sidebar sidebars menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert banner popup modal overlay newsletter "
    "subscribe subscription signup login paywall comment comments commentlist respond reply replies discussion disqus related recommended "
    "recommendations share sharing social pagination pager widget widgets skip search".split()
)
MAIN_LABELS = frozenset("article articlebody main maincontent".split())


class Block(NamedTuple):
    path: int  # rolling hash of the names and labels of the open elements, 0 for the page
    article: int  # number of the innermost article element, 0 outside
    dropped: bool  # by name, role or as hidden
    hinted: bool  # by class or id words, paragraphs and headings too
    hints: tuple | None  # (path, those around) of the open elements with such words that are no paragraph or heading
    text: str


class Element(NamedTuple):
    name: str
    path: int
    article: int
    dropped: bool
    hinted: bool
    hints: tuple | None


def labels(name: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(name with class and id, whether it is an article, whether its content is left out, whether class or id words hint at that)."""
    found: dict[str, str] = {}
    if attributes:
        for m in LABEL.finditer(attributes):
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    tokens = found.get("class", "").split() + found.get("id", "").split()
    words = {w for t in tokens for w in (t, *re.split(r"[-_]+", t))}
    role = found.get("role", "")
    article = name in ("article", "main") or role in ("main", "article") or bool({t.replace("-", "") for t in tokens} & MAIN_LABELS) or found.get("itemprop") == "articlebody"
    hinted = bool(words & DROPPED_LABELS) and name not in ("html", "body", "main")
    dropped = name in DROPPED or role in DROPPED_ROLES
    dropped = dropped or "hidden" in found and name != "body" or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return ".".join([name, *sorted(tokens)]), article, dropped, hinted


def below(path: int, label: str) -> int:
    """The path of an element in another: as long as nesting is deep, a path is one number."""
    return xxhash.xxh64_intdigest(f"{path}/{label}".encode("utf-8", "surrogatepass")) or 1


def parse(source: str) -> tuple[list[tuple[int, int]], list[Block]]:
    """((path, path around) of every opened block element, text blocks) of a page, in page order."""
    stack, opened, blocks, run = [Element("", 0, 0, False, False, None)], [], [], []
    articles = 0
    held: Counter = Counter()  # open elements by name, so that a stray end tag needn't search for its start

    def close(k: int) -> None:
        for e in stack[k:]:
            held[e.name] -= 1
        del stack[k:]

    def flush():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(top.path, top.article, top.dropped, top.hinted, top.hints, text))

    at = 0
    for m in MARKUP.finditer(source):
        if m.start() > at:
            run.append(source[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name in ("br", "img"):
                run.append(" ")
            continue
        flush()
        if m[2]:
            if held[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            continue
        if name in ENDS_P and stack[-1].name in PLAIN:
            close(len(stack) - 1)
        if name in CLOSES and any(held[n] for n in CLOSES[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in CLOSES[name]:
                    close(k)
                    break
                if stack[k].name in SCOPES:
                    break
        label, article, dropped, hinted = labels(name, m[4] or "")
        top = stack[-1]
        if name == "header" and not top.article and not article:
            dropped = True
        path = below(top.path, label)
        opened.append((path, top.path))
        if name in VOID or (m[4] or "").rstrip().endswith("/"):
            continue
        number = top.article
        if article and not top.article:
            articles += 1
            number = articles
        hints = (path, top.hints) if hinted and name not in PLAIN else top.hints
        stack.append(Element(name, path, number, dropped or top.dropped, hinted or top.hinted, hints))
        held[name] += 1
    run.append(source[at:])
    flush()
    return opened, blocks


def token(kind: str, path: int, text: str = "") -> int:
    h = xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def page_tokens(source: str) -> Counter:
    """(token, token of the element that holds it) counts of a page."""
    opened, blocks = parse(source)
    counts: Counter = Counter()
    for path, outer in opened:
        counts[token("tag", path), token("tag", outer) if outer else 0] += 1
    for b in blocks:
        counts[token("text", b.path, b.text), token("tag", b.path) if b.path else 0] += 1
    return counts


def host_of(column: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TOKENS = "host string, token long, holder long, pages long, high long, low long"


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``TOKENS`` summed over the pages of a task; token 0 counts the pages. A vector is a sum of hashes modulo 2^64, in two halves."""
    sums: dict[tuple[str, int, int], list[int]] = {}

    def out():
        rows = [(*k, n, v >> 32 & 0xFFFFFFFF, v & 0xFFFFFFFF) for k, (n, v) in sums.items()]
        sums.clear()
        kinds = (pa.string(), *[pa.int64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 6, kinds)], [c.split()[0] for c in TOKENS.split(", ")])

    for batch in common.pieces(batches, 128):
        for page, host, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
            key = f"{page} {xxhash.xxh64_intdigest(source)}"
            hashes: dict[int, int] = {}
            for (t, holder), n in [((0, 0), 1), *page_tokens(source).items()]:
                h = hashes.get(n)
                if h is None:
                    h = hashes[n] = xxhash.xxh64_intdigest(f"{key} {n}")
                entry = sums.setdefault((host, t, holder), [0, 0])
                entry[0] += 1
                entry[1] += h
        if len(sums) > GATHERED:
            yield out()
    yield out()


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Each page of a host once. Pages are only shuffled if any is listed more than once (a count of hashes tells)."""
    keys = ["page_id", "host", F.xxhash64("html").alias("h")]
    if pages.select(*keys).groupBy("page_id", "host", "h").count().where("count > 1").isEmpty():
        return pages
    return pages.select("*", keys[2]).dropDuplicates(["page_id", "host", "h"]).drop("h")


def nested(tokens: list[int], holders: list[int], large: list[bool], classes: list[int]) -> list[int]:
    """The valid tokens, of all frequent ones, that are nested up to the page itself.

    A token is nested in the element that holds it if that is valid. If it
    isn't (an element that pages repeat as often as they like, as paragraphs),
    the token must be in the class of the nearest valid element around it.
    """
    held, valid, class_of = dict(zip(tokens, holders)), {t for t, ok in zip(tokens, large) if ok}, dict(zip(tokens, classes))
    good = {0: True}

    def outer(t: int) -> int | None:
        """The nearest valid element around a token that nests it, 0 for the page, None for neither."""
        h = held[t]
        if h == 0 or h in valid:
            return h
        while h in held and h not in valid:
            h = held[h]
        return h if h in valid and class_of[h] == class_of[t] else None

    for t in valid:
        chain = []
        while t is not None and t not in good:
            chain.append(t)
            t = outer(t)
        found = t is not None and good[t]
        for c in chain:
            good[c] = found
    return sorted(t for t in valid if good[t])


def templates(pages: DataFrame) -> DataFrame:
    """``host, template array<long>, others array<long>``: the nested valid tokens of each host with enough pages, and its other frequent ones."""
    once = distinct_pages(pages.select("page_id", "host", "html"))
    seen = once.mapInArrow(gathered, TOKENS).groupBy("host", "token", "holder").agg(*[F.sum(c).alias(c) for c in ("pages", "high", "low")])
    # Halves that were summed by different tasks carry to one value.
    high = F.pmod(F.col("high") + F.shiftright("low", 32), F.lit(1 << 32))
    seen = seen.select("host", "token", "holder", "pages", F.shiftleft(high, 32).bitwiseOR(F.col("low").bitwiseAND(F.lit((1 << 32) - 1))).alias("vector"))
    seen = common.cut(seen.where((F.col("pages") >= 2)))
    whole = seen.where("token = 0").select("host", F.col("pages").alias("of")).where(F.col("of") >= LEAST_PAGES)
    frequent = seen.where("token <> 0").join(whole, "host").where(F.col("pages") >= F.col("of") * SUPPORT)
    classes = frequent.groupBy("host", "pages", "vector").agg(F.count("*").alias("size"))
    # Tokens in half of a host's pages: at most twice the tokens of a page, so the lists are bounded.
    chosen = frequent.join(classes, ["host", "pages", "vector"]).groupBy("host").agg(
        *[F.collect_list(c).alias(n) for n, c in (("tokens", F.col("token")), ("holders", F.col("holder")), ("large", F.col("size") >= LARGE), ("classes", F.xxhash64("pages", "vector")))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, others = [], []
            for t, *rest in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                kept.append(nested(t, *rest))
                others.append(sorted(set(t) - set(kept[-1])))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (kept, others)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["host", "template", "others"])

    return chosen.mapInArrow(run, "host string, template array<long>, others array<long>")


def main_text(source: str | None, template: frozenset | set, others: frozenset | set = frozenset()) -> str:
    """The article of one page, given the template tokens of its host and the other ones in at least ``SUPPORT`` of its pages."""
    if not source:
        return ""
    _, blocks = parse(source)
    if template:

        told: dict[int, bool] = {}  # by the innermost path with a hint, whose chain is then known

        def hinted(b):
            chain, unknown = b.hints, []
            while chain and chain[0] not in told:
                unknown.append(chain[0])
                chain = chain[1]
            found = bool(chain) and told[chain[0]]
            for p in reversed(unknown):
                t = token("tag", p)
                found = told[p] = found or t in template or t in others
            return found
    else:

        def hinted(b):
            return b.hinted

    kept = [b for b in blocks if not b.dropped and not hinted(b)]
    slots = [b for b in kept if token("text", b.path, b.text) not in template] or kept
    return "\n\n".join(b.text for b in [b for b in slots if b.article] or slots)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    body = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("host", host_of())
    found = common.cut(templates(body))
    size = found.agg(F.sum(F.length("host") + 16 + 8 * F.size("template") + 8 * F.size("others"))).first()[0] or 0
    if size <= BROADCAST:
        joined = body.join(F.broadcast(found), "host", "left")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = body.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
        joined = salted.join(found.select("*", salt), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 128):
            texts = [main_text(s, frozenset(t or ()), frozenset(o or ())) for s, t, o in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "html", "template", "others").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_html_extract``: all of ``pages``."""
    return extract(common.table(spark, sf_dir, "pages"))
