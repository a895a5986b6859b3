"""Text and URL functions, from Column to Column, all in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import BOARD_DOMAINS, STOPWORDS, SYSTEM_MAILBOXES, TRACKING_PARAMS

_SPACE = r"[\s ﻿ -     　]"


def _accented() -> tuple[str, str]:
    """Letters whose decomposition is one base letter with marks, and those base letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _accented()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def js_trim(c: Column | str) -> Column:
    """Without white space at the ends, no-break spaces included."""
    return F.regexp_replace(col(c), f"^{_SPACE}+|{_SPACE}+$", "")


def collapse_whitespace(c: Column | str) -> Column:
    return js_trim(F.regexp_replace(col(c), f"{_SPACE}+", " "))


def fold_diacritics(c: Column | str) -> Column:
    """Letters without their marks; letters that do not decompose stay."""
    return F.regexp_replace(F.translate(col(c), _MARKED, _BARE), "[\\u0300-\\u036f]", "")


def normalize_text(c: Column | str) -> Column:
    """Folded, lower case, one space for every run of anything but a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(fold_diacritics(c)), "[^a-z0-9]+", " "))


def clean_text(c: Column | str, most: int = 6000) -> Column:
    """Blanks and blank lines collapsed, cut to `most` characters."""
    c = F.regexp_replace(col(c), "\r", "")
    c = F.regexp_replace(c, "[ \t ]+", " ")
    c = F.regexp_replace(c, " *\n *", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.substring(js_trim(c), 1, most)


def dedupe_half(c: Column | str) -> Column:
    """A text that is the same half twice becomes that half; null becomes empty."""
    c = text_or_empty(c)
    half = F.floor(F.length(c) / 2).cast("int")
    first = F.substring(c, F.lit(1), half)
    return F.when((F.length(c) > 0) & (first == F.substring(c, half + 1, F.length(c))), first).otherwise(c)


def canonical_url(c: Column | str) -> Column:
    """The URL without fragment and tracking parameters, host in lower case, other parameters sorted by name; other text trimmed."""
    raw = js_trim(c)
    url = F.try_parse_url(raw, F.lit("PROTOCOL"))
    host = F.lower(F.try_parse_url(raw, F.lit("HOST")))
    port = F.regexp_extract(F.try_parse_url(raw, F.lit("AUTHORITY")), r":(\d+)$", 1)
    default = ((F.lower(url) == "https") & (port == "443")) | ((F.lower(url) == "http") & (port == "80"))
    path = F.coalesce(F.nullif(F.try_parse_url(raw, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.coalesce(F.try_parse_url(raw, F.lit("QUERY")), F.lit(""))
    entries = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("at"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("value")),
    )
    known = F.array(*map(F.lit, TRACKING_PARAMS))
    kept = F.filter(entries, lambda e: ~F.startswith(F.lower(e["name"]), F.lit("utm_")) & ~F.array_contains(known, F.lower(e["name"])))
    search = F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(e["name"], F.lit("="), e["value"])), "&")
    built = F.concat(F.lower(url), F.lit("://"), host, F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(search == "", "").otherwise(F.concat(F.lit("?"), search)))
    return F.when(F.lower(url).isin("http", "https") & host.isNotNull(), built).otherwise(raw)


def host_of(c: Column | str) -> Column:
    """The host of a URL in lower case without www., null for other text."""
    return F.regexp_replace(F.lower(F.try_parse_url(js_trim(c), F.lit("HOST"))), r"^www\.", "")


def job_key(company: Column | str, title: Column | str, city: Column | str) -> Column:
    """Equal for the same opening on different boards."""
    return F.concat_ws("|", *(normalize_text(text_or_empty(c)) for c in (company, title, city)))


def normalized(text: str) -> str:
    """normalize_text of a value that is known before a plan is made."""
    folded = re.sub("[\u0300-\u036f]", "", text.translate(str.maketrans(_MARKED, _BARE))).lower()
    return re.sub("[^a-z0-9]+", " ", folded).strip(" ")


def token_list(text: str) -> list[str]:
    """tokens of a value that is known before a plan is made."""
    return list(dict.fromkeys(w for w in normalized(text).split(" ") if len(w) >= 2 and w not in STOPWORDS))


def string_array(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def tokens(c: Column | str) -> Column:
    """Distinct words of two letters or more that are no stop-words, in order."""
    words = F.split(normalize_text(text_or_empty(c)), " ")
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)))


def content_hash(c: Column | str) -> Column:
    """SHA-1 of the first 2000 normalised characters."""
    return F.sha1(F.substring(normalize_text(text_or_empty(c)), 1, 2000))


def emails_in_text(c: Column | str) -> Column:
    """Distinct addresses in lower case, in order, without names of files."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(r"(?i)([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda e: ~F.rlike(e, F.lit(r"\.(png|jpe?g|gif|svg|webp|js|css)$"))))


def contact_email(candidates: Column) -> Column:
    """The first address of an array of texts that is neither a system's nor a board operator's; null without one."""
    boxes = F.array(*map(F.lit, SYSTEM_MAILBOXES))
    operators = F.array(*map(F.lit, BOARD_DOMAINS))

    def hires(e: Column) -> Column:
        domain = F.substring_index(e, "@", -1)
        run_by = F.exists(operators, lambda d: (domain == d) | F.endswith(domain, F.concat(F.lit("."), d)))
        return ~F.array_contains(boxes, F.substring_index(e, "@", 1)) & ~run_by

    return F.get(F.filter(F.flatten(F.transform(candidates, emails_in_text)), hires), F.lit(0))


def short_company(c: Column | str) -> Column:
    """A company's name without its legal form, unless nothing is left."""
    suffix = r"(?i),?\s*(s\.\s?r\.\s?o\.?|spol\.\s*s\s*r\.\s*o\.?|a\.\s?s\.?|k\.\s?s\.?|v\.\s?o\.\s?s\.?|gmbh|ltd\.?|inc\.?|llc|plc|b\.\s?v\.?|sp\.\s*z\s*o\.\s*o\.?)\s*$"
    c = col(c)
    return F.coalesce(F.nullif(js_trim(F.regexp_replace(c, suffix, "")), F.lit("")), c)


def split_name(c: Column | str) -> Column:
    """struct(first, last): the first word of a name and the others."""
    words = F.split(collapse_whitespace(text_or_empty(c)), " ")
    return F.struct(words[0].alias("first"), F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("last"))


def national_phone(c: Column | str) -> Column:
    """A number without its country code where nine digits remain."""
    digits = F.regexp_replace(text_or_empty(c), r"[^0-9+]", "")
    local = F.regexp_extract(digits, r"^\+\d{1,3}(\d{9})$", 1)
    return F.when(local != "", local).otherwise(digits)


def iso_millis(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def js_round(c: Column, factor: int = 1) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c * factor + F.lit(0.5)) / factor if factor != 1 else F.floor(c + F.lit(0.5))


def html_text(c: Column | str) -> Column:
    """The text of a fragment of HTML, a line for each block, by patterns: enough for descriptions in feeds."""
    c = F.regexp_replace(text_or_empty(c), r"(?is)<(script|style|noscript|template|svg|iframe)\b.*?</\1\s*>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|main|blockquote|dd|dt|dl|pre)\s*>", "\n")
    c = decode_entities(F.regexp_replace(c, r"(?s)<[^>]*>", ""))
    c = F.regexp_replace(c, "[ \t ]+", " ")
    c = F.regexp_replace(c, " *\n *", "\n")
    return js_trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def decode_entities(c: Column | str) -> Column:
    """Named entities replaced, the ampersand last so that nothing is decoded twice."""
    c = col(c)
    for pattern, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.regexp_replace(c, pattern, plain)
    return c
