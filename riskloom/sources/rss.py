"""Feeds as a data source of Spark: RSS and Atom documents, with fallbacks, retries and counts by feed.

``spark.read.format("rss")`` and ``spark.readStream.format("rss")`` take

- ``feeds``: JSON list of ``{"source", "source_code", "tier", "urls"}``. A url
  is a folder in which every fetch of the feed left one document; the name of
  a document is that of its fetch, the same in all folders of a feed, and
  later fetches have greater names.
- ``rows``: ``entries`` (the default), ``status`` (one row per fetch:
  counts, attempts, the url that answered, the error), or ``both`` from one
  reading: the columns of both, a status row having no ``position``.
- ``retries``, ``backoff``: further attempts at a document that can't be read,
  and seconds between them.

The urls of a fetch are tried in their order until one has entries. A
partition has fetches of one feed: few are spread over ``SPREAD`` partitions
or so, many are dealt by ``MOST``, so tasks don't grow with small documents.
A document is parsed as it streams by, so what stands before a damage counts;
the damage goes to ``error``. A stream's offset is the name of
the last fetch of each feed, so a restart reads each fetch once.
"""

from __future__ import annotations

import functools
import html
import json
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import text

ENTRIES = "source string, source_code string, tier int, fetch string, position int, title string, link string, published timestamp, published_raw string, description string"
STATUS = "source_code string, tier int, fetch string, url string, attempts int, fetched int, seen int, error string"
#: Columns of both: those of a status row that entries lack follow theirs.
BOTH = f"{ENTRIES}, url string, attempts int, fetched int, seen int, error string"
ROWS = {"entries": ENTRIES, "status": STATUS, "both": BOTH}
#: Partitions for few fetches, fetches in a partition at most, and rows that are gathered for a batch.
SPREAD, MOST, GATHERED = 64, 500, 4096
ENTRY_TAGS = ("item", "entry")
#: Child elements by preference, without their name spaces.
SUMMARY, PUBLISHED, UPDATED = ("summary", "description", "encoded", "content"), ("pubdate", "published", "issued"), ("updated", "modified", "date")
KINDS = {"string": pa.string(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC")}
CHUNK = 1 << 16
Open = Callable[[str], Iterator[bytes]]


class Entry(NamedTuple):
    title: str
    link: str
    published: datetime | None
    description: str


@functools.lru_cache(4096)
def local(tag: str) -> str:
    """A tag without its name space, in lower case."""
    return tag.rpartition("}")[2].lower()


def when(written: str | None) -> datetime | None:
    """A time of RFC 822 or ISO 8601 in UTC; one without a zone is UTC; null if it is neither."""
    if not written or not written.strip():
        return None
    for read in (datetime.fromisoformat, parsedate_to_datetime):
        try:
            found = read(written.strip())
            return (found if found.tzinfo else found.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
        except (ValueError, TypeError, OverflowError):
            pass
    return None


def plain(markup: str | None) -> str:
    """Text of a piece of markup: tags become spaces, character references are decoded, white space is squeezed."""
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", markup or ""))).strip()


def entry_of(element: ElementTree.Element, brief: bool = False) -> Entry:
    """An entry; a brief one goes without time and description."""
    found: dict[str, str] = {}
    link = ""
    for child in element:
        name = local(child.tag)
        content = ("".join(child.itertext()) if len(child) else child.text or "").strip()
        if name == "link":
            # Atom may have several links; the article itself is the alternate one, which is also the default.
            if child.get("rel", "alternate") == "alternate":
                link = link or (child.get("href") or content).strip()
        elif content and name not in found:
            found[name] = content
    if brief:
        return Entry(found.get("title", ""), link, None, "")
    first = lambda names: next((found[n] for n in names if n in found), None)
    published = next((t for t in (when(first(PUBLISHED)), when(first(UPDATED))) if t), None)
    return Entry(found.get("title", ""), link, published, plain(first(SUMMARY)))


def parse(chunks: Iterator[bytes], brief: bool = False) -> tuple[list[Entry], str | None]:
    """Entries of a document and what is wrong with it; entries before a damage count."""
    parser, out, depth = ElementTree.XMLPullParser(("start", "end")), [], 0

    def drain() -> None:
        nonlocal depth
        for event, element in parser.read_events():
            if local(element.tag) not in ENTRY_TAGS:
                continue
            depth += 1 if event == "start" else -1
            if event == "end" and not depth:
                out.append(entry_of(element, brief))
                element.clear()

    try:
        for chunk in chunks:
            parser.feed(chunk)
            drain()
        parser.close()
        drain()
    except ElementTree.ParseError as e:
        drain()
        return out, f"damaged: {e}"
    return out, None if out else "no entries"


def opened(url: str) -> Iterator[bytes]:
    """A document of any file system that executors reach, in pieces."""
    fs, path = pafs.FileSystem.from_uri(url)
    with fs.open_input_stream(path) as f:
        while chunk := f.read(CHUNK):
            yield chunk


class Fetched(NamedTuple):
    entries: list[Entry]
    url: str | None
    attempts: int
    error: str | None


def fetch(urls: list[str], name: str, retries: int = 2, backoff: float = 3.0, read: Open = opened, wait: Callable[[float], None] = time.sleep, brief: bool = False) -> Fetched:
    """The first of the urls whose document has entries. Reading is tried again, a damaged document is not: it stays damaged."""
    attempts, error = 0, None
    for url in urls:
        for attempt in range(retries + 1):
            attempts += 1
            try:
                entries, error = parse(read(f"{url}/{name}"), brief)
                if entries:
                    return Fetched(entries, url, attempts, error)
                break
            except OSError as e:
                error = f"unreadable: {type(e).__name__}"
                if isinstance(e, FileNotFoundError):
                    break
                if attempt < retries:
                    wait(backoff)
    return Fetched([], None, attempts, error or "no entries")


class Fetches(InputPartition):
    def __init__(self, feed: dict, names: list[str]) -> None:
        self.feed, self.names = feed, names


def dealt(found: list[tuple[dict, list[str]]]) -> list[Fetches]:
    """Feeds and names of their fetches as partitions."""
    size = max(1, min(MOST, -(-sum(len(names) for _, names in found) // SPREAD)))
    return [Fetches(feed, names[i : i + size]) for feed, names in found for i in range(0, len(names), size)]


class Rss:
    """What batch and stream share: the feeds, their fetches, and reading them."""

    def __init__(self, options: dict) -> None:
        self.feeds = json.loads(options["feeds"])
        codes = [f["source_code"] for f in self.feeds]
        if len(set(codes)) != len(codes):
            raise ValueError("a source code stands for two feeds")
        self.rows = options.get("rows", "entries")
        self.schema = pa.schema([(c, KINDS[k]) for c, k in (x.split() for x in ROWS[self.rows].split(", "))])
        self.retries, self.backoff = int(options.get("retries", 2)), float(options.get("backoff", 3))

    def names(self, feed: dict) -> list[str]:
        """Names of the feed's fetches, from any of its urls."""
        found: set[str] = set()
        for url in feed["urls"]:
            fs, path = pafs.FileSystem.from_uri(url)
            infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
            found |= {i.base_name for i in infos if i.is_file and not i.base_name.startswith((".", "_"))}
        return sorted(found)

    def rows_of(self, feed: dict, name: str) -> Iterator[tuple]:
        """The rows of one fetch."""
        got = fetch(feed["urls"], name, self.retries, self.backoff, brief=self.rows == "status")
        valid = [(i, e) for i, e in enumerate(got.entries) if e.title and e.link]
        told = (got.url, got.attempts, len(got.entries), len(valid), got.error)
        if self.rows == "status":
            yield feed["source_code"], feed["tier"], name, *told
            return
        of = feed["source"], feed["source_code"], feed["tier"], name
        none = (None,) * len(told) if self.rows == "both" else ()
        for i, e in valid:
            raw = e.published.strftime("%B %d, %Y %H:%M") if e.published else None
            yield *of, i, e.title, e.link, e.published, raw, e.description, *none
        if none:
            yield *of, None, None, None, None, None, None, *told

    def read(self, partition: Fetches) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), self.schema)], schema=self.schema)
        for name in partition.names:
            held += self.rows_of(partition.feed, name)
            if len(held) >= GATHERED:
                yield batch()
                held.clear()
        if held:
            yield batch()


class RssReader(Rss, DataSourceReader):
    def partitions(self) -> list[Fetches]:
        return dealt([(feed, self.names(feed)) for feed in self.feeds])


class RssStream(Rss, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f["source_code"]: names[-1] for f in self.feeds if (names := self.names(f))}

    def partitions(self, start: dict, end: dict) -> list[Fetches]:
        code = lambda feed: feed["source_code"]
        return dealt([(f, [n for n in self.names(f) if start.get(code(f), "") < n <= end.get(code(f), "")]) for f in self.feeds])

    def commit(self, end: dict) -> None:
        """Documents stay where they are."""


class RssSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rss"

    def schema(self) -> str:
        return ROWS[self.options.get("rows", "entries")]

    def reader(self, schema) -> RssReader:
        return RssReader(self.options)

    def streamReader(self, schema) -> RssStream:
        return RssStream(self.options)


def entries(spark: SparkSession, feeds: list[dict], rows: str = "entries", streaming: bool = False, retries: int = 2, backoff: float = 3.0) -> DataFrame:
    """Entries, the status of each fetch, or both, of the configured feeds."""
    spark.dataSource.register(RssSource)
    reader = spark.readStream if streaming else spark.read
    return reader.format("rss").options(feeds=json.dumps(feeds), rows=rows, retries=retries, backoff=backoff).load()


def candidates(found: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """Entries that may become articles: all of tier 1, and those of tier 2 in whose title or description a keyword stands."""
    matched = F.when(F.col("tier") == 2, text.keywords(F.concat_ws(" ", "title", "description"), keywords)).otherwise(F.array().cast("array<string>"))
    rows = found.withColumns({"matched_keywords": matched, "confidence": F.when(F.col("tier") == 1, "high").otherwise("filtered_match")})
    return rows.where((F.col("tier") == 1) | (F.size("matched_keywords") > 0))
