"""Column builders over text: theme lists, coded dimensions, lexicon densities, mentions, topics, HTML."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Mapping, Sequence
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def theme_codes(themes: Column) -> Column:
    """Upper-case, trimmed codes of a ``;`` list; null is the empty list's one blank code."""
    return F.transform(F.split(F.upper(F.coalesce(themes, F.lit(""))), ";"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))


def code_pattern(codes: Sequence[str]) -> str:
    """One trimmed code of a ``;`` list, whatever its case, as a pattern whose matches don't overlap."""
    return r"(?i)(?:^|;)\s*(?:" + "|".join(map(re.escape, codes)) + r")\s*(?=;|$)"


def theme_hits(themes: Column, tier: Sequence[str]) -> Column:
    """Occurrences of the tier's codes in a ``;`` list; a repeated code counts each time. One generated regex pass, no array."""
    return F.regexp_count(F.coalesce(themes, F.lit("")), F.lit(code_pattern(tier)))


def has_code(themes: Column, codes: Sequence[str]) -> Column:
    return F.coalesce(themes.rlike(code_pattern(codes)), F.lit(False))


def strip_offsets(themes: Column) -> Column:
    """Codes without their ``,offset`` suffixes."""
    return F.regexp_replace(themes, r",\d+", "")


def number(text: Column) -> Column:
    """A number, or null for anything else, NaN included."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def tone_part(tone: Column, position: int, absolute: bool = False) -> Column:
    """One field of a comma list of numbers; 0 where it is missing or no number."""
    value = F.coalesce(number(F.get(F.split(tone, ","), F.lit(position))), F.lit(0.0))
    return F.abs(value) if absolute else value


NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def dimension(coded: Column, key: str) -> Column:
    """The last ``key:number`` of a comma list, at least 0; 0 if there is none. Anything that is no finite number is passed over."""
    last = F.regexp_extract(F.coalesce(coded, F.lit("")), rf"(?s)^(?:.*,)?\s*{re.escape(key)}:\s*({NUMBER})\s*(?:,|$)", 1)
    return F.greatest(F.lit(0.0), F.coalesce(last.try_cast("double"), F.lit(0.0)))


def countries(locations: Column) -> Column:
    """Distinct country codes (third ``#`` field) in order of mention."""
    found = F.transform(F.split(F.coalesce(locations, F.lit("")), ";"), lambda e: F.upper(F.get(F.split(e, "#"), F.lit(2))))
    return F.array_distinct(F.filter(found, lambda c: c.isNotNull() & (c != "")))


def mentions(locations: Column) -> Column:
    """Structs (fullname, country, adm1, lat, lon) of the mentions with six fields or more; coordinates both or neither."""

    def one(entry: Column) -> Column:
        part = F.split(entry, "#")
        lat, lon = (F.get(part, F.lit(i)).try_cast("double") for i in (4, 5))
        both = lat.isNotNull() & lon.isNotNull()
        return F.struct(
            F.get(part, F.lit(1)).alias("fullname"),
            F.upper(F.get(part, F.lit(2))).alias("country"),
            F.upper(F.get(part, F.lit(3))).alias("adm1"),
            F.when(both, lat).alias("lat"),
            F.when(both, lon).alias("lon"),
        )

    entries = F.filter(F.split(F.coalesce(locations, F.lit("")), ";"), lambda e: F.size(F.split(e, "#")) >= 6)
    return F.transform(entries, one)


def whole_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """Whether any phrase stands in the text as whole words, whatever its case (Unicode words)."""
    return text.rlike(r"(?iU)(?<!\w)(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases) + r")(?!\w)")


def _masks(pairs) -> dict[str, int]:
    out: dict[str, int] = {}
    for key, bit in pairs:
        out[key] = out.get(key, 0) | bit
    return out


def _looked_up(masks: Mapping[str, int], key: Column) -> Column:
    if not masks:
        return F.lit(0).cast("long")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in masks.items() for x in kv]), key).cast("long"), F.lit(0).cast("long"))


def route_mask(locations: Column, registry: Mapping[str, dict] = C.ROUTES, places: Sequence[tuple] = C.PLACES) -> Column:
    """The routes that any mention meets by name, by country (and region) or by bounding box, as bits in registry order.

    A mention is parsed once. Codes are look-ups, boxes comparisons; names are
    looked for only where the list has any of them at all.
    """
    if len(registry) > 62:
        raise ValueError("a mask holds 62 routes")
    bits = {route: 1 << i for i, route in enumerate(registry)}
    plain = _masks((c, bits[r]) for r, spec in registry.items() if not spec["adm1"] for c in spec["countries"])
    regional = _masks((f"{c}#{a}", bits[r]) for r, spec in registry.items() for c in spec["countries"] for a in spec["adm1"])

    def boxed(lat: Column, lon: Column) -> Column:
        found = [F.when(lat.between(s, n) & lon.between(w, e), F.lit(bits[r])).otherwise(0) for r, spec in registry.items() if spec["bounds"] for s, n, w, e in [spec["bounds"]]]
        return F.when(lon.isNotNull(), reduce(lambda a, b: a.bitwiseOR(b), found)).otherwise(0).cast("long")

    def met(entry: Column) -> Column:
        country, adm1 = F.upper(F.get(entry, F.lit(2))), F.upper(F.get(entry, F.lit(3)))
        lat, lon = (F.get(entry, F.lit(i)).try_cast("double") for i in (4, 5))
        found = _looked_up(plain, country).bitwiseOR(_looked_up(regional, F.concat(country, F.lit("#"), adm1))).bitwiseOR(boxed(lat, lon))
        return F.when(F.size(entry) >= 6, found).otherwise(F.lit(0).cast("long"))

    text = F.coalesce(locations, F.lit(""))
    entries = F.transform(F.split(text, ";"), lambda e: F.split(e, "#"))
    by_field = F.aggregate(entries, F.lit(0).cast("long"), lambda mask, e: mask.bitwiseOR(met(e)))
    field, rest = r"[^#;]*#", r"#[^#;]*#[^#;]*#[^#;]*#"
    aliases = {r: [re.escape(a).replace(r"\ ", " ") for p in places if p[6] == r for a in p[1]] for r in registry}
    named = [F.when(text.rlike(rf"(?iU)(?:^|;){field}[^#;]*(?<!\w)(?:{'|'.join(names)})(?!\w)[^#;]*{rest}"), F.lit(bits[r])).otherwise(0) for r, names in aliases.items() if names]
    spelt = {a.lower() for p in places for a in p[1]}
    least = sorted(a for a in spelt if not any(b in a for b in spelt - {a}))
    low = F.lower(text)
    any_name = reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in least], F.lit(False))
    by_name = F.when(any_name, reduce(lambda a, b: a.bitwiseOR(b), named, F.lit(0)).cast("long")).otherwise(0)
    return by_field.bitwiseOR(by_name)


def masked_routes(mask: Column, registry: Mapping[str, dict] = C.ROUTES) -> Column:
    """The route ids of a mask, in registry order."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(r)) for i, r in enumerate(registry)]))


def routes(locations: Column, registry: Mapping[str, dict] = C.ROUTES, places: Sequence[tuple] = C.PLACES) -> Column:
    """Route ids, in registry order, that any mention meets (see ``route_mask``)."""
    mask = F.array(route_mask(locations, registry, places))  # bound once: it is long
    return F.transform(mask, lambda m: masked_routes(m, registry))[0]


def place_blocks(text: Column, gazetteer: Sequence[tuple[str, Sequence[str], str]]) -> Column:
    """``;`` list of the blocks whose place any alias names; gazetteer rows are (sort key, aliases, block), emitted in key order."""
    rows = sorted(gazetteer)
    return F.array_join(F.array_compact(F.array(*[F.when(whole_phrase(text, aliases), F.lit(block)) for _, aliases, block in rows])), ";")


def route_gazetteer(places: Sequence[tuple] = C.PLACES) -> list[tuple[str, Sequence[str], str]]:
    """Type-4 mention blocks of the route places."""
    return [(name, aliases, f"4#{name}#{country}#{adm1}#{lat}#{lon}#0") for name, aliases, lat, lon, country, adm1, _ in places]


def _spellings(names: Iterable[str]) -> str:
    """A pattern of the names that tries each shared beginning once, the longest name first."""
    tree: dict = {}
    for name in names:
        node = tree
        for char in name:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        forms = [re.escape(char).replace(r"\ ", " ") + pattern(rest) for char, rest in sorted(node.items()) if char]
        if not forms:
            return ""
        return f"(?:{'|'.join(forms)})" + ("?" if "" in node else "")

    return pattern(tree)


def _beginnings(names: Collection[str], most: int = 3) -> str:
    """A look ahead that passes wherever a name may begin, whatever its case, by the characters that the names have at each place.

    Characters outside ASCII always pass: some are another case of an ASCII letter.
    """
    cases = lambda c: c + c.lower() + c.upper() + c.lower().upper() + c.upper().lower()
    places = [sorted({x for n in names for x in cases(n[i]) if x.isascii()}) for i in range(min(most, *map(len, names)))]
    return "(?=(?-i:" + "".join("[" + "".join(map(re.escape, chars)) + r"[^\x00-\x7f]]" for chars in places) + "))"


def _named(body: Column, names: Mapping[str, int], blocks: Sequence[str], left: str, right: str) -> Column:
    """Blocks, in their order, of what is named in a text: one pass, the left-most and there the longest name, without overlaps."""
    pattern = f"(?iU){_beginnings(names)}{left}({_spellings(names)}){right}"
    number = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    found = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda n: F.try_element_at(number, F.lower(n)))
    listed = strings(blocks)
    return F.transform(F.array_sort(F.array_compact(F.array_distinct(found))), lambda i: F.element_at(listed, i))


def located(title: Column, body: Column, countries: Sequence[tuple] = C.COUNTRIES, places: Sequence[tuple] = C.PLACES) -> Column:
    """``;`` list of the countries and route places that a title and a text name: countries by code, then places by name."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
    by_code = sorted(countries, key=lambda c: c[:4])
    of_country = {w: i for i, c in enumerate(by_code, 1) for w in c[4]}
    by_name = sorted(places, key=lambda p: p[0])
    of_place = {a.lower(): i for i, p in enumerate(by_name, 1) for a in p[1]}
    one = _named(both, of_country, [f"1#{name}#{code}#{code}#{lat}#{lon}#0" for code, name, lat, lon, _ in by_code], r"\b", r"\b")
    two = _named(both, of_place, [f"4#{name}#{country}#{adm1}#{lat}#{lon}#0" for name, _, lat, lon, country, adm1, _ in by_name], r"(?<!\w)", r"(?!\w)")
    return F.array_join(F.concat(one, two), ";")


def _spelt_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?"), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters with inner apostrophes."""
    return F.transform(_spelt_words(text), F.lower)


def tallied(text: Column, *lexicons: Sequence[str]) -> Column:
    """Struct of a text's number of words, ``n``, and of those that stand in any lexicon, ``found``: all that densities need, in one pass."""
    listed = sorted({w for lexicon in lexicons for w in lexicon})

    def of(spelt: Column) -> Column:
        return F.struct(F.size(spelt).alias("n"), F.transform(F.filter(spelt, lambda w: F.lower(w).isin(*listed)), F.lower).alias("found"))

    return F.transform(F.array(_spelt_words(text)), of)[0]


def count_in(found: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(*lexicon)))


def density(found: Column, lexicon: Sequence[str], total: Column | None = None) -> Column:
    """Percentage of words in the lexicon, of ``total`` words if ``found`` isn't all of them; 0 for no words."""
    n = F.size(found) if total is None else total
    return F.coalesce(F.try_divide(F.lit(100.0) * count_in(found, lexicon), n), F.lit(0.0))


def dimension_density(found: Column, lexicon: Sequence[str], reference: float = C.DIM_DENSITY, total: Column | None = None) -> Column:
    """Share of the reference density, at most 1."""
    n = F.size(found) if total is None else total
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(count_in(found, lexicon).cast("double"), n * F.lit(reference))), F.lit(0.0))


def dimension_list(found: Column, lexicons: Mapping[str, Sequence[str]] = C.DIM_LEXICONS, total: Column | None = None) -> Column:
    """The dimensions as a ``key:value`` list with three decimals."""
    return F.concat_ws(",", *[F.format_string(f"{k}:%.3f", dimension_density(found, lexicon, total=total)) for k, lexicon in lexicons.items()])


def keywords(text: Column, listed: Sequence[str] = C.KEYWORDS) -> Column:
    """The listed keywords, in list order and spelling, that stand in the text as whole words.

    Patterns are tried where the characters stand at all; characters are the same as the patterns' case folding has them.
    """

    def of(t: Column, low: Column) -> Column:
        whole = {k: t.rlike(rf"(?iU)\b{re.escape(k)}\b") for k in listed}
        return F.array_compact(F.array(*[F.when((F.contains(low, F.lit(k.lower())) & w) if k.isascii() else w, F.lit(k)) for k, w in whole.items()]))

    # The text and its folded form are bound once: both are long.
    folded = lambda t: F.array(F.lower(F.translate(t, "\u0130\u0131\u017f\u212a", "iisk")))
    return F.transform(F.array(text), lambda t: F.transform(folded(t), lambda low: of(t, low))[0])[0]


def tokens(themes: Column) -> Column:
    """Trimmed, non-blank tokens between commas and semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(themes, F.lit("")), "[,;]+"), F.trim), lambda t: t != "")


def topic(token: Column) -> Column:
    """Editorial bucket of a token by exact code, then by pattern; null if none fits."""
    key = F.regexp_replace(F.upper(F.trim(token)), r"[\s-]+", "_")
    rules = [(key.isin(*codes), name) for name, codes in C.TOPIC_CODES.items()] + [(key.rlike(p), name) for name, p in C.TOPIC_PATTERNS]
    return F.coalesce(*[F.when(rule, F.lit(name)) for rule, name in rules])


def humanise(text: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(text, r"[_\s-]+", " ")))


def article_topic(themes: Column) -> Column:
    """First token's bucket that exists, else the first token in words, else General."""
    found = tokens(themes)
    bucket = F.get(F.array_compact(F.transform(found, topic)), F.lit(0))
    return F.coalesce(bucket, humanise(F.get(found, F.lit(0))), F.lit("General"))


def theme_display(themes: Column, keywords: Column) -> Column:
    """The themes, or else the matched keywords: a JSON list joined by commas, an object as ``key: value`` pairs, anything else as it stands."""
    raw = F.trim(keywords)
    listed = F.array_join(F.filter(F.from_json(raw, "array<string>"), lambda k: F.coalesce(k, F.lit("")) != ""), ", ")
    pairs = F.array_join(F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ")
    shown = F.when(raw.startswith("["), listed).when(raw.startswith("{"), pairs)
    return F.coalesce(F.nullif(themes, F.lit("")), shown, keywords, F.lit(""))


def text_of_locations(locations: Column) -> Column:
    """The distinct names of a location list, in order of mention, as a line of text."""
    names = F.transform(F.split(F.coalesce(locations, F.lit("")), ";"), lambda e: F.get(F.split(e, "#"), F.lit(1)))
    return F.array_join(F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")), " ")


def extractor_id(*parts: str) -> Column:
    """The versions that made a row's tags, as one identifier."""
    return F.lit("+".join(parts))


def slug(text: Column, longest: int = 40) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(longest))


def leading_number(text: Column) -> Column:
    """The number left when everything but digits, points and minus signs is gone; null if that is none."""
    return F.regexp_replace(text, r"[^0-9.-]", "").try_cast("double")


#: References that the plans' SQL decodes too.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


#: Characters of HTML 4's names, and of the numbers that stand for Windows-1252 bytes; a hard space is a space.
NAMED = {name: chr(at) for name, at in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
WINDOWS = {at: bytes([at]).decode("cp1252", "ignore") or chr(at) for at in range(128, 160)}


def unescape(text: Column) -> Column:
    """Numeric and named character references decoded once.

    A number may go without its semicolon, a name may not; unknown names stay.
    Numbers that are no character become U+FFFD.
    """
    flat = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def decoded(part: Column) -> Column:
        ref = F.regexp_extract(part, "^(#[0-9]{1,9};?|#[xX][0-9a-fA-F]{1,7};?|[A-Za-z][A-Za-z0-9]{1,9};)", 1)
        name = F.rtrim(ref, F.lit(";"))
        hexadecimal = F.lower(F.substring(ref, 2, 1)) == "x"
        number = F.when(hexadecimal, F.conv(F.substring(name, 3, 7), 16, 10)).otherwise(F.substring(name, 2, 9)).try_cast("int")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        code = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        char = F.when(number == 160, " ").when(number.between(128, 159), F.try_element_at(flat(WINDOWS), number)).when(valid, code).otherwise("\ufffd")
        found = F.when(ref == "", F.lit(None)).when(F.startswith(ref, F.lit("#")), char).otherwise(F.try_element_at(flat(NAMED), name))
        return F.when(found.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(found, F.substring(part, F.length(ref) + 1, F.length(part))))

    parts = F.split(text, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def strip_html(html: Column) -> Column:
    """Tags to spaces, character references decoded, white space squeezed."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(plain), r"\s+", " "))


def meta_content(html: Column, names: Sequence[str]) -> Column:
    """Content of the first meta element with one of the names, attributes in either order; null if there is none."""
    name = "(?:" + "|".join(map(re.escape, names)) + ")"
    forms = (
        rf"""(?is)<meta[^>]+(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)["']""",
        rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]*(?:property|name)=["']{name}["']""",
    )
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(html, f, 1)), F.lit("")) for f in forms])


def safe_url(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def absolute_url(link: Column, page: Column) -> Column:
    """``//host`` and ``/path`` links made absolute by the page's own address."""
    base = F.regexp_extract(page, r"^(https?)://", 1), F.regexp_extract(page, r"^(https?://[^/?#]+)", 1)
    return F.when(link.startswith("//"), F.concat(base[0], F.lit(":"), link)).when(link.startswith("/"), F.concat(base[1], link)).otherwise(link)


def language_of(source: Column, hindi: Sequence[str]) -> Column:
    return F.when(source.isin(*hindi), "hi").otherwise("en") if hindi else F.lit("en")


# Lanes by words of origin and destination, first match wins.
LAND = ("india_nepal_raxaul", "india_bangladesh_petrapole", "india_pakistan_attari", "india_china_lac")
LAND_LANES = (
    (("nepal", "birgunj", "raxaul"), ("india_nepal_raxaul",)),
    (("bangladesh", "dhaka", "petrapole"), ("india_bangladesh_petrapole",)),
    (("pakistan", "lahore", "wagah", "attari"), ("india_pakistan_attari",)),
    (("china", "ladakh", "lhasa"), ("india_china_lac",)),
)
SEA_LANES = (
    (("europe", "rotterdam", "hamburg", "uk", "mediterranean"), ("red_sea_suez", "strait_of_hormuz", "danish_straits_baltic")),
    (("china", "shanghai", "hong kong", "taiwan", "singapore", "malaysia"), ("strait_of_malacca", "taiwan_south_china_sea")),
    (("uae", "dubai", "middle east", "iran", "chabahar"), ("strait_of_hormuz", "instc_chabahar", "imec")),
    (("africa", "cape"), ("cape_of_good_hope", "red_sea_suez")),
)
SEA = ("red_sea_suez", "strait_of_hormuz", "danish_straits_baltic", "strait_of_malacca", "taiwan_south_china_sea")


def suggested_routes(origin: Column, destination: Column, mode: Column) -> Column:
    """Routes for a lane by the words of its ends; all of the mode's if none is known, none if an end is blank."""
    blob = F.lower(F.concat_ws(" ", F.trim(origin), F.trim(destination)))

    def rules(lanes, rest):
        out = strings(rest)
        for named, found in reversed(lanes):
            out = F.when(reduce(lambda a, b: a | b, [blob.contains(w) for w in named]), strings(found)).otherwise(out)
        return out

    blank = (F.trim(origin) == "") | (F.trim(destination) == "") | origin.isNull() | destination.isNull()
    return F.when(blank, F.array().cast("array<string>")).when(mode.isin("road", "rail"), rules(LAND_LANES, LAND)).otherwise(rules(SEA_LANES, SEA))
