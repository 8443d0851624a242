"""Secret scans: fixed patterns, and guess costs of values in credential context.

Three fixed patterns (assign, access, hex) give the base spans. Beyond them,
every value that stands in a credential context is segmented into words,
dates, repeats, keyboard walks, sequences and brute-force stretches so that
the total number of guesses is least (dynamic programming over the value);
values that cost at least ``LOG_GUESSES`` decimal orders are spans of kind
``guess``. Base spans stay whatever their cost. Only templates such as
``${NAME}`` or ``your_secret_here`` (``PLACEHOLDER``) are passed over whatever
theirs. Values are segmented whole.

Contract: one row per input row. A null text is the empty text and has no
span. Positions are code points, ends exclusive. Repeated rows give repeated
results; extra columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Where a value is a credential: a naming word and a separator, or the password part of a URL.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth)["']?\x20*(?:[:=]|\bis\b)\x20*["']?([^\s"'<>,;()\[\]{}]{8,})"""
    r"""|://[^\s:/@]*:([^\s:/@]{8,})@""",
    re.I | re.A,
)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "://")
LOG_GUESSES = 9.0
#: Parts of a segmentation that need looking at: one of more parts has that many orders of guesses by the order of its parts alone (k! of them).
MOST_PARTS = next(k for k in range(1, 99) if math.log10(math.factorial(k + 1)) >= LOG_GUESSES)
#: Values that name a secret instead of being one: templates, and words joined like ``your_secret_here``.
PLACEHOLDER = re.compile(r"^(?:[*x.#_-]+|\$\{?[A-Za-z_][A-Za-z_]*\}?|\$\{\w+\}|%\w+%|(?:your|example|changeme|placeholder|redacted)(?:[_-][a-z]+)*)$", re.I | re.A)

# Frequent password words, most frequent first (the rank is the number of guesses).
WORDS = (
    "password 123456 qwerty letmein admin welcome login abc123 monkey dragon master sunshine princess football baseball "
    "shadow superman iloveyou trustno1 hello freedom whatever michael jordan hunter secret summer winter spring autumn "
    "love test guest root user default pass access server system database key token public private security account "
    "computer internet google apple mustang harley ranger thomas robert daniel andrew charlie jessica ashley george "
    "killer pepper ginger cheese orange banana coffee cookie flower purple silver golden soccer hockey tennis matrix "
    "london paris berlin monday friday january february march april june july august september october november december "
    "correct horse battery staple change temp demo sample the and for you with"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}


@functools.cache
def ranks() -> dict[str, int]:
    """Password words, then the words of the tokenizer's vocabulary by its order, with their numbers of guesses."""
    import public_tokenizers

    found = dict(RANK)
    for line in common.read_bytes(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).splitlines():
        word = base64.b64decode(line.split()[0]) if line else b""
        if re.fullmatch(rb" [A-Za-z]{4,}", word):
            found.setdefault(word[1:].decode().lower(), len(found) + 1)
    return found


@functools.cache
def longest_word() -> int:
    return max(map(len, ranks()))


ROWS_OF_KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i + 0.5 * r) for r, row in enumerate(ROWS_OF_KEYS) for i, c in enumerate(row)}
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")


def near(a: str, b: str) -> bool:
    """Whether two characters are neighbours on the keyboard."""
    if a not in PLACE or b not in PLACE or a == b:
        return False
    (r, x), (s, y) = PLACE[a], PLACE[b]
    return abs(r - s) <= 1 and abs(x - y) <= 1


def matches(value: str) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of everything cheaper than brute force."""
    found, n, low = [], len(value), value.lower()
    plain = low.translate(LEET)
    known, longest = ranks(), longest_word()
    runs = {}  # by unit: how often the stretch at each position stands in a row
    for unit in range(1, min(8, n // 2) + 1):
        run = runs[unit] = [1] * n
        for i in range(n - 2 * unit, -1, -1):
            if value[i : i + unit] == value[i + unit : i + 2 * unit]:
                run[i] = run[i + unit] + 1
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = known.get(low[i:j]) or known.get(plain[i:j])
            if rank:
                upper = sum(c.isupper() for c in value[i:j])
                variants = 1 if not upper else 2 if upper == j - i or value[i].isupper() and upper == 1 else math.comb(j - i, upper) + 1
                swapped = 2 if low[i:j] != plain[i:j] and low[i:j] not in known else 1
                found.append((i, j, math.log10(rank * variants * swapped + 1)))
        if m := DATE.match(value, i):
            found.append((i, m.end(), math.log10(365 * 119 * (4 if re.search(r"[-/._]", m[0]) else 1)) if len(m[0]) > 4 else math.log10(119)))
        for unit in range(1, min(8, (n - i) // 2) + 1):
            times = runs[unit][i]
            if times > 1 and times * unit >= 3:
                found.append((i, i + times * unit, unit * 1.0 + math.log10(times)))
    for rule, base in (("walk", 94.0), ("step", 36.0)):
        i = 0
        while i < n - 1:
            if rule == "walk":
                j, turns, was = i, 0, None
                while j + 1 < n and near(low[j], low[j + 1]):
                    move = (PLACE[low[j + 1]][0] - PLACE[low[j]][0], PLACE[low[j + 1]][1] > PLACE[low[j]][1])
                    turns, was = turns + (move != was), move
                    j += 1
                cost = math.log10(base * max(1, j - i)) + turns * math.log10(4.6)
            else:
                j = i
                d = ord(value[1 + i]) - ord(value[i])
                while abs(d) <= 2 and d and j + 1 < n and ord(value[j + 1]) - ord(value[j]) == d:
                    j += 1
                cost = math.log10(base * max(1, j - i + 1))
            if j - i >= 2:
                found.append((i, j + 1, cost))
            i = max(i + 1, j)
    return found


def log_guesses(value: str, most: int = MOST_PARTS) -> float:
    """log10 of the guesses for the cheapest segmentation into at most ``most`` parts, the order of its parts included.

    With ``MOST_PARTS`` it is below ``LOG_GUESSES`` iff the cheapest of all
    segmentations is.
    """
    n = len(value)
    if not n:
        return 0.0
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in matches(value):
        ends[j].append((i, cost))
    unit = math.log10(max(10, 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)))
    # By parts so far: the least cost of the first j characters, and of those segmentations that end in a brute-force stretch.
    best = np.full((n + 1, most + 1), np.inf)
    best[0, 0] = 0.0
    brute = np.full(most + 1, np.inf)
    for j in range(1, n + 1):
        brute[1:] = np.minimum(brute[1:], best[j - 1, :-1]) + unit
        best[j] = brute
        for i, cost in ends[j]:
            best[j, 1:] = np.minimum(best[j, 1:], best[i, :-1] + cost)
    orders = [math.log10(math.factorial(k)) for k in range(1, most + 1)]
    return float((best[n, 1:] + orders).min())


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(h in low for h in ("pass", "secret", "token", "key")):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def guessed_spans(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Credential-context values outside the base spans that are costly to guess."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        group = 1 if m[1] is not None else 2
        a, b = m.span(group)
        if any(s < b and a < e for s, _, e, _ in base) or PLACEHOLDER.match(m[group]):
            continue
        if log_guesses(m[group]) >= LOG_GUESSES:
            found.append((a, 3, b, a))
    return found


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every secret value replaced by ``mark``."""
    base = base_spans(text)
    spans = sorted((v, e) for _, _, e, v in base + guessed_spans(text, base))
    out, at = [], 0
    for s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]]) if spans else text


def scan(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of every row. No shuffle."""
    sha = hashlib.sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            counts, digest, spans = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digest.append(sha(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + guessed_spans(text, base))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return common.texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, secret values in ``text`` replaced; ``n_chars``, where present, follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            at = batch.schema.get_field_index("text")
            body = [t if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            changed = [a != b for a, b in zip(columns[at].to_pylist(), body)]
            columns[at] = pa.array(body, batch.schema.field(at).type)
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                sizes = [len(b) if c else old for b, c, old in zip(body, changed, columns[n].to_pylist())]
                columns[n] = pa.array(sizes, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_secret_scan``: all of ``documents``."""
    return scan(common.table(spark, sf_dir, "documents"))
