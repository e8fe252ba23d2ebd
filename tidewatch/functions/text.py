"""Text, date, money and quantity expressions. Native columns only."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Words the product and event tokenisers leave out.
PRODUCT_STOPWORDS = ("de", "da", "do", "e", "com", "sem", "para", "em", "tipo", "kit")
EVENT_STOPWORDS = (
    "de", "da", "do", "e", "em", "para", "com", "que", "um", "uma", "na", "no", "por",
    "a", "o", "os", "as", "dos", "das", "ao", "aos", "sua", "seu", "sobre",
)
# Measures recognised in names and unit texts.
MEASURE_UNITS = "kg|g|mg|l|ml|un|und|unidade|unidades|m2|m²"
# Titles too generic to name an event, and network suffixes cut from titles.
GENERIC_TITLES = (
    "instagram", "facebook", "youtube", "google notícias", "google noticias",
    "reclame aqui", "home", "página inicial", "pagina inicial",
)
NETWORK_SUFFIX = r"(?i)\s+[|•-]\s+(Instagram|Facebook|YouTube|Google Notícias|Google Noticias)$"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding as data: characters for ``translate``, and those that become several.

    Every code point whose NFKD form, less combining marks, is one other
    character is mapped, and combining marks are deleted. Hangul syllables follow
    a rule and are left out.
    """
    source, target, removed, several = [], [], [], {}
    for cp in range(0xA0, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            removed.append(ch)
            continue
        full = unicodedata.normalize("NFKD", ch)
        if full == ch:
            continue
        plain = "".join(c for c in full if not unicodedata.combining(c))
        if len(plain) == 1:
            source.append(ch)
            target.append(plain)
        elif plain:
            several[ch] = plain
        else:
            removed.append(ch)
    return "".join(source + removed), "".join(target), several


@lru_cache(maxsize=1)
def _several_class() -> str:
    """The characters that become several, as ranges of a Java character class."""
    points = sorted([ord(c) for c in _fold_tables()[2]])
    spans: list[list[int]] = [[0xAC00, 0xD7A3]]
    for cp in points:
        if len(spans) > 1 and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in spans) + "]"


def code_points(*codes: Column) -> Column:
    """The text of the given code points; a null one is left out."""
    return F.decode(F.unhex(F.concat(*[F.coalesce(F.lpad(F.hex(c.cast("long")), 8, "0"), F.lit("")) for c in codes])), "UTF-32")


def replace_each(c: Column, pattern: str, replacement) -> Column:
    """``c`` with every distinct match of ``pattern`` replaced by ``replacement`` of it, longer matches first; null replaces nothing."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})")))
    found = F.array_sort(F.transform(found, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m"))))
    swapped = F.aggregate(found, c, lambda acc, m: F.coalesce(F.replace(acc, m["m"], replacement(m["m"])), acc))
    return F.when(c.rlike(pattern), swapped).otherwise(c)


def _spelled(ch: Column) -> Column:
    """What a character that becomes several stands for."""
    listed = F.try_element_at(F.from_json(F.lit(json.dumps(_fold_tables()[2])), "map<string,string>"), ch)
    s = F.ascii(ch) - 0xAC00  # Hangul: lead, vowel and tail follow from the place in the table
    tail = F.when(s % 28 > 0, 0x11A7 + s % 28)
    return F.coalesce(listed, F.when(s.between(0, 11171), code_points(0x1100 + F.floor(s / 588), 0x1161 + F.floor(s % 588 / 28), tail)))


@lru_cache(maxsize=1)
def _beyond_latin() -> str:
    """A short class of what is no Latin letter or sign that folds to one character at most; most texts have none of it."""
    several = set(_fold_tables()[2])
    plain = [cp for cp in range(0x250) if chr(cp) not in several]
    starts = [cp for cp in plain if cp - 1 not in plain]
    ends = [cp for cp in plain if cp + 1 not in plain]
    return "[^" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in zip(starts, ends)) + r"\x{2010}-\x{2016}\x{2018}-\x{201f}]"


def fold(c: Column) -> Column:
    """Compatibility-fold and strip combining marks, keeping case and spaces; ASCII stays as it is, Latin text is only translated."""
    matching, replacement, _ = _fold_tables()
    return let(c, lambda x: F.when(F.octet_length(x) == F.length(x), x).when(
        ~x.rlike(_beyond_latin()), F.translate(x, matching, replacement)).otherwise(
        F.translate(replace_each(x, _several_class(), _spelled), matching, replacement)))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and trim; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def normalise(c: Column) -> Column:
    """Accent-free, lower-case, single-spaced text; null becomes ''."""
    return squeeze(F.lower(fold(c)))


def latin1(c: Column) -> Column:
    """Normalised text reduced to Latin-1, typographic signs made plain."""
    plain = F.translate(normalise(c), "—–•“”’", "---\"\"'")
    return F.regexp_replace(plain, r"[^\x00-\xFF]", "")


def quote(term: str) -> str:
    """A literal as a Java regex."""
    return r"\Q" + term.replace("\\E", r"\E\\E\Q") + r"\E"


def has_term(text: Column, term: str) -> Column:
    """Whether already normalised ``text`` holds ``term`` between non-word characters."""
    word = normalise_literal(term)
    if not word:
        return F.lit(False)
    return text.rlike(r"(?U)(?<!\w)" + quote(word) + r"(?!\w)")


def contains_any(text: Column, words) -> Column:
    """Whether ``text`` holds any of the literal ``words`` as substrings."""
    words = [w for w in words if w]
    if not words:
        return F.lit(False)
    return text.rlike("|".join(quote(w) for w in words))


def normalise_literal(value: str | None) -> str:
    """The driver-side twin of :func:`normalise` for option values."""
    s = unicodedata.normalize("NFKD", value or "")
    s = "".join(ch for ch in s if not unicodedata.combining(ch)).lower()
    return " ".join(s.split())


def truncate_words(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut at a blank and marked with '...'."""
    s = squeeze(c)
    head = F.regexp_replace(F.substring(s, 1, max(20, n - 3)), r" [^ ]*$", "")
    return F.when(F.length(s) <= n, s).otherwise(F.concat(head, F.lit("...")))


_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:[.,]\d+)?)?"
_ZONE = r"(?: ?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"


def parse_date(c: Column) -> Column:
    """Calendar date of an ISO, day-first, slashed or RFC-822 text; else null.

    The date is the one written, not shifted to another zone.
    """
    s = F.trim(c)
    year_first = F.regexp_extract(s, rf"^(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}})(?:[T ]{_CLOCK}{_ZONE})?$", 0)
    iso = F.regexp_extract(year_first, r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}", 0)
    day_first = F.regexp_extract(s, r"^\d{1,2}/\d{1,2}/\d{4}$", 0)
    plain = F.regexp_replace(s, r"^[A-Za-z]{3,9},? +(?=\d)", "")
    rfc = F.regexp_extract(plain, rf"^(\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}})(?: {_CLOCK}{_ZONE})?$", 1)
    return F.coalesce(
        F.try_to_date(F.nullif(F.translate(iso, "/", "-"), F.lit("")), "yyyy-M-d"),
        F.try_to_date(F.nullif(day_first, F.lit("")), "d/M/yyyy"),
        F.try_to_date(F.nullif(rfc, F.lit("")), "d MMM yyyy"),
    )


def parse_money(c: Column) -> Column:
    """Amount of a price text, comma or dot as decimal sign; negative or bad → null."""
    s = F.translate(F.replace(F.trim(c.cast("string")), F.lit("R$"), F.lit("")), " ", "")
    # a comma makes every dot before or after it a thousands separator
    s = let(s, lambda t: F.translate(F.when(t.contains(","), F.translate(t, ".", "")).otherwise(t), ",", "."))
    v = F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double")
    return let(v, lambda x: F.when(x >= 0, F.round(x, 2)))


def quantity(unit: Column) -> Column:
    """Struct (amount, base) of a unit text, in g, ml, un or m2; nulls when absent."""
    n = F.translate(normalise(unit), ",", ".")
    pattern = rf"(\d+(?:\.\d+)?)\s*({MEASURE_UNITS})"
    parts = F.struct(
        F.regexp_extract(n, pattern, 1).try_cast("double").alias("amount"),
        F.regexp_extract(n, pattern, 2).alias("name"),
    )

    def to_base(p: Column) -> Column:
        amount, name = p["amount"], p["name"]
        scaled = F.when(name.isin("kg", "l"), amount * 1000).when(name == "mg", amount / 1000).otherwise(amount)
        base = (
            F.when(name.isin("kg", "g", "mg"), "g")
            .when(name.isin("l", "ml"), "ml")
            .when(name.isin("m2", "m²"), "m2")
            .when(name != "", "un")
        )
        return F.struct(scaled.alias("amount"), base.alias("base"))

    return let(parts, to_base)


def product_name(c: Column) -> Column:
    """Name less measures and punctuation."""
    n = F.regexp_replace(normalise(c), rf"(?U)\b\d+(?:[\.,]\d+)?\s*({MEASURE_UNITS})\b", " ")
    return F.trim(F.regexp_replace(n, r"[^a-z0-9]+", " "))


def product_tokens(name: Column) -> Column:
    """Distinct telling words of an already reduced product name."""
    words = F.split(name, " ")
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*PRODUCT_STOPWORDS))
    )


def event_tokens(text: Column) -> Column:
    """Distinct telling words of an already normalised title."""
    words = F.regexp_extract_all(text, F.lit("([a-z0-9]{3,})"))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*EVENT_STOPWORDS)))


def clamp_score(c: Column) -> Column:
    """Integer score in 0..100, ties to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(c, 0).cast("int")))


def stable_title(title: Column, snippet: Column, body: Column) -> Column:
    """Title of an event; generic or short ones fall back to the snippet."""
    base = squeeze(title)
    weak = normalise(title).isin(*[normalise_literal(t) for t in GENERIC_TITLES]) | (F.length(base) < 12)
    alt = F.coalesce(F.nullif(snippet, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 260))
    picked = F.when(weak, squeeze(alt)).otherwise(base)
    return truncate_words(F.trim(F.regexp_replace(picked, NETWORK_SUFFIX, "")), 180)


def round_half_up(c: Column, digits: int) -> Column:
    """Decimal rounding of a double, free of the noise beyond the eighth digit."""
    return F.round(c.cast("decimal(28,8)"), digits).cast("double")
