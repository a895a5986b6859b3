"""A search profile read from a CV's text alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import LANGUAGES, NOT_A_TITLE, REMOTE_WISH, TITLE_TRAILER, TITLE_WORDS
from .fields import detect_city, let, names_in, seniority, skills, years_of_experience
from .text import collapse_whitespace, js_trim, normalize_text, text_or_empty

MOST_TITLES, MOST_SKILLS, MOST_LANGUAGES = 5, 40, 6
SHORTEST, LONGEST = 4, 70
SUMMARY = 400
SENIOR_FROM, MID_FROM = 7, 3


def title_lines(c: Column | str) -> Column:
    """Up to five lines of 4 to 70 characters that name a job, without what follows a dash or stands in brackets; each once, in order."""
    bare = lambda line: js_trim(F.regexp_replace(F.regexp_replace(line, r"[\s ]+", " "), TITLE_TRAILER, ""))
    lines = F.transform(F.split(text_or_empty(c), "\n+"), bare)
    fits = lambda line: F.length(line).between(SHORTEST, LONGEST) & F.rlike(line, F.lit(TITLE_WORDS)) & ~F.rlike(line, F.lit(NOT_A_TITLE))
    return F.slice(F.array_distinct(F.filter(lines, fits)), 1, MOST_TITLES)


def level_of_years(c: Column | str) -> Column:
    """The level that the years of experience in a text stand for, null without any."""
    return let(years_of_experience(c), lambda y: F.when(y >= SENIOR_FROM, "senior").when(y >= MID_FROM, "mid").when(y.isNotNull(), "junior"))


def heuristic_profile(c: Column | str) -> Column:
    """struct(titles, skills, seniority, city, remote, languages, summary) of a CV; a null or empty CV has empty lists, nulls and an empty summary.

    The level is the one that the titles name, else the one that the years stand for; remote is true or unknown.
    """
    titles = title_lines(c)
    wish = F.when(F.rlike(normalize_text(text_or_empty(c)), F.lit(REMOTE_WISH)), True)
    return F.struct(
        titles.alias("titles"),
        F.slice(skills(c), 1, MOST_SKILLS).alias("skills"),
        F.coalesce(seniority(F.array_join(titles, " ")), level_of_years(c)).alias("seniority"),
        detect_city(c).alias("city"),
        wish.alias("remote"),
        F.slice(names_in(text_or_empty(c), LANGUAGES), 1, MOST_LANGUAGES).alias("languages"),
        F.substring(collapse_whitespace(text_or_empty(c)), 1, SUMMARY).alias("summary"),
    )
