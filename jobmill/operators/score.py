"""Scoring of postings against a search: six weighted parts, a profile's fit, and the reasons in words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import FOREIGN_COUNTRIES, LEVELS, PROFILE_SHARE, THRESHOLD, WEIGHTS
from ..functions.fields import city_in, detect_city, let, parse_salary, seniority, skills, work_type
from ..functions.intents import Intent, lookup_intent
from ..functions.text import clean_text, dedupe_half, js_round, js_trim, normalize_text, normalized, string_array, text_or_empty, token_list, tokens


@dataclass(frozen=True)
class Profile:
    titles: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    seniority: str | None = None


@dataclass(frozen=True)
class Request:
    query: str
    as_of: Column
    skill_level: str = "Any"
    city: str = ""
    salary_min: int | None = None
    salary_max: int | None = None
    profile: Profile | None = None
    intent: Intent | None = None

    def meant(self) -> Intent:
        return self.intent or lookup_intent(self.query)


def _part(value: Column | float, reason: Column | str | None = None, multiplier: float | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(value).cast("double").alias("value"), as_column(reason).cast("string").alias("reason"), F.lit(multiplier).cast("double").alias("multiplier")
    )


def _norm(text: str) -> Column:
    return F.lit(normalized(text))


def _title(req: Request, title: Column) -> Column:
    query = normalized(req.query)
    out = F.when(F.lit(query != "") & F.contains(title, F.lit(query)), _part(1.0, f'Title matches "{req.query.strip()}"'))
    for wanted in req.meant().included_titles:
        out = out.when(F.contains(title, _norm(wanted)), _part(0.9, f'Title matches "{wanted}"'))
    words = token_list(req.query)

    def mentioned(found: Column) -> Column:
        share = 0.7 * (F.size(found) / max(1, len(words)))
        return F.when(F.size(found) > 0, _part(share, F.concat(F.lit("Title mentions "), F.array_join(found, ", ")))).otherwise(_part(0.0))

    return out.otherwise(let(F.filter(string_array(words), lambda w: F.contains(title, w)), mentioned))


def _keywords(req: Request, title: Column, description: Column, found_skills: Column) -> Column:
    intent = req.meant()
    vocabulary = list(dict.fromkeys(w for text in (intent.canonical_text, intent.scraping_keyword, req.query) for w in token_list(text)))
    if not vocabulary:
        return _part(0.0)
    own = tokens(F.concat_ws(" ", title, description, F.array_join(found_skills, " ")))

    def matched(hits: Column) -> Column:
        n = F.size(hits)
        reason = F.concat(n.cast("string"), F.when(n == 1, " matching keyword (").otherwise(" matching keywords ("), F.array_join(F.slice(hits, 1, 4), ", "), F.lit(")"))
        return _part(F.least(F.lit(1.0), n / min(len(vocabulary), 10)), F.when(n > 0, reason))

    return let(F.array_intersect(string_array(vocabulary), own), matched)


def _location(req: Request, location: Column, city: Column, remote: Column) -> Column:
    wanted_text = req.city.strip()
    abroad = F.rlike(location, F.lit(f"(^|[^A-Za-z0-9_])({'|'.join(FOREIGN_COUNTRIES)})([^A-Za-z0-9_]|$)"))
    remote = F.coalesce(remote, F.lit(False))
    out = F.when(remote & city.isNull() & abroad, _part(0.6, "Remote, employer abroad"))
    if not wanted_text:
        return out.when(remote, _part(1.0, "Remote")).when(city.isNull(), _part(0.5)).otherwise(_part(0.7, city))
    wanted = city_in(req.city) or wanted_text
    there = normalize_text(location)
    elsewhere = (there != "") & ~F.rlike(there, F.lit("remote|home ?office|vzdalen|z domova")) & ~F.contains(there, _norm(wanted))
    say = lambda place: F.concat(F.lit("Located in "), place, F.lit(f", not {wanted}"))
    return (
        out.when(remote, _part(0.8, "Remote"))
        .when(city.isNull() & elsewhere, _part(0.2, say(js_trim(location)), 0.5))
        .when(city.isNull(), _part(0.5))
        .when(normalize_text(city) == _norm(wanted), _part(1.0, city))
        .otherwise(_part(0.2, say(city), 0.5))
    )


def _seniority(req: Request, title: Column) -> Column:
    chosen = LEVELS.get(req.skill_level.lower())
    wanted = chosen or (req.profile.seniority if req.profile else None)
    if not wanted:
        return _part(0.6)
    actual = seniority(title)
    label = req.skill_level if chosen else f"{wanted} (from your CV)"
    return (
        F.when(actual.isNull(), _part(0.5))
        .when(actual == wanted, _part(1.0, f"Seniority: {label}"))
        .otherwise(_part(0.0, F.concat(F.lit("Seniority mismatch ("), actual, F.lit(")"))))
    )


def _recency(req: Request, posted: Column) -> Column:
    days = F.abs(F.unix_micros(req.as_of.cast("timestamp")) - F.unix_micros(posted.cast("timestamp"))) / 86_400_000_000
    return F.when(posted.isNull(), _part(0.3)).when(days <= 7, _part(1.0, "Posted this week")).when(days <= 30, _part(0.5, "Posted this month")).otherwise(_part(0.0))


def _salary(req: Request, pay: Column) -> Column:
    listed = pay["min"].isNotNull()
    if req.salary_min is None and req.salary_max is None:
        return F.when(listed, _part(1.0, "Salary listed")).otherwise(_part(0.0))
    middle = (pay["min"] + pay["max"]) / 2
    fits = F.lit(True)
    if req.salary_min is not None:
        fits = fits & (middle >= req.salary_min)
    if req.salary_max is not None:
        fits = fits & (middle <= req.salary_max)
    return F.when(~listed, _part(0.0)).when(fits, _part(1.0, "Salary in your range")).otherwise(_part(0.3, "Salary listed"))


def _profile(profile: Profile, title: Column, found_skills: Column) -> tuple[Column, Column]:
    wanted = list(dict.fromkeys(map(normalized, profile.skills)))

    def matched(shared: Column) -> Column:
        n = F.size(shared)
        more = F.when(n > 3, F.concat(F.lit(" +"), n - 3)).otherwise("")
        value = F.least(F.lit(1.0), n / max(1, min(len(wanted), 6)))
        return _part(value, F.when(n > 0, F.concat(F.lit("Matches your CV skills ("), F.array_join(F.slice(shared, 1, 3), ", "), more, F.lit(")"))))

    fit = let(F.filter(found_skills, lambda s: F.array_contains(string_array(wanted), normalize_text(s))), matched)
    named = F.lit(False)
    for wanted_title in profile.titles:
        named = named | F.contains(title, _norm(wanted_title))
    return fit, F.when(named, _part(1.0, "Title fits your CV")).otherwise(_part(0.0))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row: a generator's output, which filters and projections above it don't repeat."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def scored(postings: DataFrame, req: Request) -> DataFrame:
    """postings with `score`, `reasons`, `rejected_by`, `features` and `parts`.

    Fields are read from the stored text again: title, location, description, salary, work_type, posted_at, first_seen_at. A title that
    matches nothing and holds an excluded title scores 0. Nulls count as empty text or an unknown date.
    """
    title = clean_text(dedupe_half("title"), 200)
    kind = work_type("work_type", "title", "location")
    city = F.coalesce(detect_city("location"), detect_city(title))
    place = F.coalesce(F.nullif(clean_text(dedupe_half("location"), 120), F.lit("")), F.when(kind == "Remote", "Remote").otherwise(F.coalesce(city, F.lit(""))))
    body = clean_text(text_or_empty("description"))
    base = _once(
        postings,
        "n",
        F.struct(
            title.alias("title"),
            normalize_text(title).alias("folded"),
            body.alias("body"),
            city.alias("city"),
            place.alias("place"),
            (kind == "Remote").alias("remote"),
            parse_salary(F.nullif(js_trim("salary"), F.lit(""))).alias("pay"),
            skills(F.concat(title, F.lit(" "), body)).alias("skills"),
            F.coalesce("posted_at", "first_seen_at").alias("seen"),
        ),
    )
    n = F.col("n")
    parts = {
        "title": _title(req, n["folded"]),
        "keywords": _keywords(req, n["title"], n["body"], n["skills"]),
        "location": _location(req, n["place"], n["city"], n["remote"]),
        "seniority": _seniority(req, n["title"]),
        "recency": _recency(req, n["seen"]),
        "salary": _salary(req, n["pay"]),
    }
    if req.profile:
        parts["profile_skills"], parts["profile_title"] = _profile(req.profile, n["folded"], n["skills"])
    excluded = F.coalesce(
        *(F.when(F.rlike(n["folded"], F.concat(F.lit("(^| )"), _norm(t), F.lit("( |$)"))), F.lit(t)) for t in req.meant().excluded_titles), F.lit(None).cast("string")
    )
    with_parts = _once(base, "parts", F.struct(*(p.alias(name) for name, p in parts.items())))
    p = lambda name: F.col(f"parts.{name}")
    value = lambda name: F.col(f"parts.{name}.value")
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.lit(weight) * value(name)
    if req.profile:
        total = total * (1 - PROFILE_SHARE) + PROFILE_SHARE * (0.7 * value("profile_skills") + 0.3 * value("profile_title"))
    total = js_round(total * F.coalesce("parts.location.multiplier", F.lit(1.0)), 1000)
    rejected = F.when(value("title") == 0, excluded)
    zero = F.lit(0.0)
    has = lambda c: F.when(c, 1.0).otherwise(0.0)
    features = F.array(
        total,
        *(value(name) for name in ("title", "keywords", "location", "seniority", "recency", "salary")),
        value("profile_skills") if req.profile else zero,
        value("profile_title") if req.profile else zero,
        has(n["remote"]),
        has(p("location")["multiplier"].isNotNull()),
        has(n["pay"]["min"].isNotNull()),
        F.least(F.lit(1.0), F.length(n["body"]) / 3000),
        zero,
    )
    reasons = F.array_compact(F.array(*(p(name)["reason"] for name in parts)))
    return with_parts.select(
        *postings.columns,
        rejected.alias("rejected_by"),
        F.when(rejected.isNotNull(), 0.0).otherwise(total).alias("score"),
        F.when(rejected.isNotNull(), F.array(F.concat(F.lit("Excluded: "), rejected))).otherwise(reasons).alias("reasons"),
        F.when(rejected.isNotNull(), F.array(*[zero] * 14)).otherwise(features).alias("features"),
        "parts",
    )


def ranked(scored_postings: DataFrame, limit: int, threshold: float = THRESHOLD) -> DataFrame:
    """The best postings at or above the threshold; ties go to the later scrape, then the smaller id."""
    return scored_postings.filter(F.col("score") >= threshold).orderBy(F.desc("score"), F.desc("scraped_at"), "id").limit(limit)
