"""Fields of a posting read from its text: salary, city, work type, level, skills, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import CITIES, CURRENCIES, CURRENCY_TOKENS, HYBRID, MONTHS, ONSITE, PERIODS, REMOTE, SENIORITY, SKILLS
from .text import canonical_url, clean_text, col, contact_email, dedupe_half, emails_in_text, js_trim, normalize_text, normalized, text_or_empty


def first_rule(c: Column, rules: tuple[tuple[str, str], ...], wrap: str = "{}") -> Column:
    """The value of the first rule whose pattern is found."""
    return F.coalesce(*(F.when(F.rlike(c, F.lit(wrap.format(pattern))), F.lit(value)) for pattern, value in rules))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


Table = tuple[tuple[str, tuple[str, ...]], ...]


def names_in(c: Column, table: Table) -> Column:
    """The names of a table (name, spellings) of which a spelling stands in c as whole words, in the table's order; c is folded once."""
    return let(normalize_text(c), lambda folded: names_in_folded(folded, table))


def names_in_folded(folded: Column, table: Table) -> Column:
    """names_in for text that is folded already; `folded` stands in the result twice."""
    name_of = {spelling: name for name, spellings in table for spelling in spellings}
    words = [s for s in name_of if " " not in s]
    runs = [s for s in name_of if " " in s]
    names = F.create_map(*(F.lit(x) for pair in name_of.items() for x in pair))
    hits = F.array_intersect(F.split(folded, " "), F.array(*map(F.lit, words)))
    if runs:
        padded = F.concat(F.lit(" "), folded, F.lit(" "))
        hits = F.concat(hits, F.filter(F.array(*map(F.lit, runs)), lambda r: F.contains(padded, F.concat(F.lit(" "), r, F.lit(" ")))))
    return F.array_intersect(F.array(*(F.lit(name) for name, _ in table)), F.transform(hits, lambda h: F.element_at(names, h)))


def currency(c: Column | str) -> Column:
    return first_rule(col(c), CURRENCIES, "(?iu){}")


def salary_period(c: Column | str) -> Column:
    return first_rule(col(c), PERIODS, "(?iu){}")


def _figures(c: Column) -> Column:
    numeric = F.regexp_replace(c, f"(?iu){CURRENCY_TOKENS}", " ")
    pattern = F.lit("(?iu)(\\d{1,3}(?:[  .,]\\d{3})+|\\d+(?:[.,]\\d+)?)[\\s ]*(k(?!\\p{L})|tis\\.?)?")
    digits, suffixes = (F.regexp_extract_all(numeric, pattern, F.lit(k)) for k in (1, 2))

    def value(d: Column, i: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(d, "[  ]", ""), r"\.(?=\d{3}\b)", "")
        plain = F.regexp_extract(F.regexp_replace(plain, "^([^,]*),", "$1."), r"^\d+(?:\.\d+)?", 0).cast("double")
        return plain * F.when(F.get(suffixes, i) != "", 1000).otherwise(1)

    return F.slice(F.filter(F.transform(digits, value), lambda v: (v > 0) & (v < 10_000_000)), 1, 2)


def parse_salary(c: Column | str) -> Column:
    """struct(min, max, currency, period): up to two plausible figures of a salary text; nulls for null and empty text."""
    c = F.nullif(col(c), F.lit(""))
    figures = _figures(c)
    low, high = F.array_min(figures), F.array_max(figures)
    low = F.when((high >= 1000) & (low < 1000), low * 1000).otherwise(low)
    whole = lambda v: F.floor(v + 0.5).cast("int")
    return F.struct(whole(low).alias("min"), whole(high).alias("max"), currency(c).alias("currency"), salary_period(c).alias("period"))


def salary_midpoint(c: Column | str) -> Column:
    """The mean of all runs of digits in a salary text, null without one: coarser than parse_salary, for filters."""
    runs = F.regexp_extract_all(col(c), F.lit("([0-9\\s ]+)"), F.lit(1))
    values = F.filter(F.transform(runs, lambda r: F.nullif(F.regexp_replace(r, "[\\s ]", ""), F.lit("")).cast("double")), lambda v: v > 0)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def detect_city(c: Column | str) -> Column:
    """The first city of the list that the text names."""
    return F.get(names_in(text_or_empty(c), CITIES), F.lit(0))


def city_in(text: str) -> str | None:
    """detect_city of a value that is known before a plan is made."""
    padded = f" {normalized(text)} "
    return next((name for name, spellings in CITIES if any(f" {s} " in padded for s in spellings)), None)


def work_type(declared: Column | str, title: Column | str, location: Column | str) -> Column:
    """Remote, Hybrid or Onsite as declared, else Hybrid or Remote as location and title hint; null if neither says."""
    said = normalize_text(text_or_empty(declared))
    hint = normalize_text(F.concat(text_or_empty(location), F.lit(" "), text_or_empty(title)))
    return F.coalesce(first_rule(said, ((REMOTE, "Remote"), (HYBRID, "Hybrid"), (ONSITE, "Onsite"))), first_rule(hint, ((HYBRID, "Hybrid"), (REMOTE, "Remote"))))


def seniority(c: Column | str) -> Column:
    return F.get(names_in(text_or_empty(c), SENIORITY), F.lit(0))


def skills(c: Column | str) -> Column:
    """The skills that a text names, in the dictionary's order."""
    c = text_or_empty(c)
    for pattern, word in ((r"(?i)c#", " csharp "), (r"(?i)\.net\b", " dotnet "), (r"(?i)c\+\+", " cpp ")):
        c = F.regexp_replace(c, pattern, word)
    return names_in(c, SKILLS)


def czech_date(c: Column | str, now: Column) -> Column:
    """A day and month in Czech as the latest such date up to a day after `now`; null for other text.

    Months go by their first three letters, so that červenec, which begins as červen does, is read as June.
    """
    pattern = r"(?iu)^(\d{1,2})\.\s*([a-záéíóúůýčďěňřšťž]+)"
    c = js_trim(c)
    day = F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")
    prefix = F.substring(F.lower(F.regexp_extract(c, pattern, 2)), 1, 3)
    seen: dict[str, int] = {}
    for number, name in enumerate(MONTHS, 1):
        seen.setdefault(name[:3], number)
    month = reduce(lambda rest, item: F.when(prefix == item[0], item[1]).otherwise(rest), seen.items(), F.lit(None).cast("int"))
    this = F.make_date(F.year(now), month, day)
    late = this.cast("timestamp") > now + F.expr("INTERVAL 1 DAY")
    return F.when(month.isNull() | day.isNull(), None).when(late, F.add_months(this, -12)).otherwise(this)


def years_of_experience(c: Column | str) -> Column:
    """The most years up to 45 that a CV names, null without any."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(r"(?i)(\d{1,2})\+?\s*(?:years?|yrs|let|roky|rok)\b"), F.lit(1))
    return F.array_max(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y > 0) & (y <= 45)))


def normalized_posting(country: str = "CZ") -> list[Column]:
    """A raw posting's columns (title, company, location, description, url, source, salary, work_type, posted_at) made canonical."""
    title = clean_text(dedupe_half("title"), 200)
    kind = work_type("work_type", "title", "location")
    pay = F.nullif(js_trim("salary"), F.lit(""))
    parsed = parse_salary(pay)
    city = F.coalesce(detect_city("location"), detect_city(title))
    place = F.nullif(clean_text(dedupe_half("location"), 120), F.lit(""))
    body = clean_text(text_or_empty("description"))
    email = contact_email(F.array(text_or_empty("description")))
    return [
        title.alias("title"),
        clean_text(dedupe_half("company"), 120).alias("company"),
        F.coalesce(place, F.when(kind == "Remote", "Remote").otherwise(F.coalesce(city, F.lit("")))).alias("location"),
        body.alias("description"),
        canonical_url("url").alias("source_url"),
        F.col("source"),
        pay.alias("salary"),
        kind.alias("work_type"),
        F.col("posted_at"),
        F.lit(country).alias("country"),
        city.alias("city"),
        F.when(kind.isNotNull(), kind == "Remote").alias("remote"),
        parsed["min"].alias("salary_min"),
        parsed["max"].alias("salary_max"),
        parsed["currency"].alias("salary_currency"),
        skills(F.concat(title, F.lit(" "), body)).alias("skills"),
        F.when(email.isNotNull(), "email").otherwise("board-form").alias("apply_kind"),
        email.alias("apply_email"),
    ]


__all__ = ["currency", "czech_date", "detect_city", "emails_in_text", "normalized_posting", "parse_salary", "salary_midpoint", "salary_period", "seniority", "skills", "work_type", "years_of_experience"]
