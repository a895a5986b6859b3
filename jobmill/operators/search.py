"""Selections of postings: keyword search, filters, freshness, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import SOURCES, STATUSES
from ..functions.fields import salary_midpoint
from ..functions.intents import Intent
from ..functions.text import normalize_text, text_or_empty, tokens


def _holds(c: Column | str, term: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.contains(F.lower(c), F.lit(term.lower()))


def keyword_search(postings: DataFrame, title_terms: list[str], query: str, days: int, limit: int, as_of: Column, country: str = "CZ") -> DataFrame:
    """Live postings of a country, scraped within `days`, whose title holds a term (two letters or more) or whose description
    holds the query (three letters or more); the latest `limit`. Without a usable term nothing matches."""
    terms = list(dict.fromkeys(t.strip() for t in title_terms if len(t.strip()) >= 2))
    matchers = [_holds("title", t) for t in terms] + ([_holds("description", query.strip())] if len(query.strip()) >= 3 else [])
    match = reduce(lambda a, b: a | b, matchers, F.lit(False))
    live = (F.col("country") == country) & F.col("expired_at").isNull() & (F.col("scraped_at") >= as_of - F.make_dt_interval(F.lit(days)))
    return postings.filter(live & match).orderBy(F.desc("scraped_at"), "id").limit(limit)


def posting_filter(postings: DataFrame, source: str | None = None, has_salary: bool = False, position: str = "") -> DataFrame:
    """Stored filters: an unknown source is ignored, a salary is one that isn't null, a position is looked for in title and company."""
    if source in SOURCES:
        postings = postings.filter(F.col("source") == source)
    if has_salary:
        postings = postings.filter(F.col("salary").isNotNull())
    if position.strip():
        postings = postings.filter(_holds("title", position.strip()) | _holds("company", position.strip()))
    return postings


def status_filter(applications: DataFrame, status: str | None) -> DataFrame:
    """Applications in a status; an unknown one filters nothing."""
    return applications.filter(F.col("status") == status) if status in STATUSES else applications


def result_filter(items: DataFrame, source: str = "all", has_salary: bool = False, kind: str = "all", city: str = "", salary_min: int | None = None, salary_max: int | None = None, position: str = "") -> DataFrame:
    """Filters on shown results: a work type passes where it is missing, an empty salary counts as none, a salary without figures passes any range."""
    if source != "all":
        items = items.filter(F.col("source") == source)
    if has_salary:
        items = items.filter(text_or_empty("salary") != "")
    if kind != "all":
        items = items.filter(F.col("work_type").isNull() | (F.col("work_type") == "") | (F.col("work_type") == kind))
    if city.strip():
        items = items.filter(_holds(text_or_empty("location"), city))
    if salary_min or salary_max:
        middle = salary_midpoint("salary")
        fits = F.lit(True)
        if salary_min:
            fits = fits & (middle >= salary_min)
        if salary_max:
            fits = fits & (middle <= salary_max)
        items = items.filter((text_or_empty("salary") != "") & (middle.isNull() | fits))
    if position.strip():
        items = items.filter(_holds("title", position) | _holds(text_or_empty("company"), position))
    return items


def title_matches(title: Column, query: str, intent: Intent) -> Column:
    """Whether a title holds the query, an included title or a word of the query, as parts of words too."""
    folded = normalize_text(text_or_empty(title))
    wanted = [t for t in [query, *intent.included_titles] if t.strip()]
    named = reduce(lambda a, b: a | b, (F.contains(folded, normalize_text(F.lit(t))) for t in wanted), F.lit(False))
    return (folded != "") & (named | F.exists(tokens(F.lit(query)), lambda w: F.contains(folded, w)))


def mentions_query(description: Column, query: str) -> Column:
    """Whether a description holds every word of the query; false for a query without words."""
    words = tokens(F.lit(query))
    folded = normalize_text(text_or_empty(description))
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(folded, w))


def freshness(listings: DataFrame, postings: DataFrame, as_of: Column) -> DataFrame:
    """listings (url, ...) with `known_id` and `fresh`: whether the stored posting of that URL is less than a day old."""
    known = postings.select(F.col("source_url").alias("url"), F.col("id").alias("known_id"), "scraped_at")
    age = as_of - F.make_dt_interval(F.lit(1))
    return listings.join(known, "url", "left").withColumn("fresh", F.coalesce(F.col("scraped_at") > age, F.lit(False))).drop("scraped_at")


def stale(postings: DataFrame, as_of: Column, limit: int = 25) -> DataFrame:
    """Live postings scraped over a day ago and first seen within 60 days, the longest unread first."""
    ago = lambda days: as_of - F.make_dt_interval(F.lit(days))
    due = F.col("expired_at").isNull() & (F.col("scraped_at") < ago(1)) & (F.col("first_seen_at") >= ago(60))
    return postings.filter(due).orderBy("scraped_at", "id").limit(limit)


def flagged(postings: DataFrame, favourite_ids: DataFrame, dismissed_ids: DataFrame, as_of: Column) -> DataFrame:
    """postings with favourited, dismissed, is_new (first seen within a day) and is_stale (scraped over a day ago)."""
    mark = lambda df, name: df.select(F.col("job_id").alias("id")).distinct().withColumn(name, F.lit(True))
    out = postings.join(mark(favourite_ids, "favourited"), "id", "left").join(mark(dismissed_ids, "dismissed"), "id", "left")
    day = as_of - F.make_dt_interval(F.lit(1))
    return out.fillna(False, ["favourited", "dismissed"]).withColumn("is_new", F.col("first_seen_at") > day).withColumn("is_stale", F.col("scraped_at") <= day)
