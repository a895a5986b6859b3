"""Stored search, its filters and the score's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intents import lookup_intent
from ..functions.text import tokens
from ..operators import score, search
from ..sources import domain
from ..sources.domain import AS_OF, at
from .registry import literal, query, values
from .views import EVENT, FAVOURITE, JOB, city, level, listed, norm, skill_list, stamp, text, with_
from .views import tokens as sql_tokens

QUERY = "React developer"
INTENT = lookup_intent(QUERY)
PROFILE = score.Profile(titles=["Frontend developer"], skills=["React", "TypeScript", "SQL"], seniority="senior")


def _recent(spark: SparkSession, sf: str, days: int, limit: int) -> DataFrame:
    return search.keyword_search(domain.job_postings(spark, sf), [QUERY, *INTENT.included_titles, "engineer"], QUERY, days, limit, at(AS_OF))


def _recent_sql(days: int, limit: int) -> str:
    terms = [QUERY, *INTENT.included_titles, "engineer"]
    match = " OR ".join([*(f"contains(lower(title), {text(t.lower())})" for t in terms), f"contains(lower(description), {text(QUERY.lower())})"])
    return f"recent AS (SELECT * FROM job WHERE country = 'CZ' AND expired_at IS NULL AND scraped_at >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY AND ({match}) ORDER BY scraped_at DESC, id LIMIT {limit})"


@query("p2_keyword_search", with_(JOB, _recent_sql(60, 300)) + f"SELECT id, title, {stamp('scraped_at')} AS scraped_at FROM recent")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return _recent(spark, sf, 60, 300).select("id", "title", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))


@query("p2_keyword_search_without_terms", with_(JOB) + "SELECT id FROM job WHERE false")
def p2_none(spark: SparkSession, sf: str) -> DataFrame:
    return search.keyword_search(domain.job_postings(spark, sf), ["a", " "], "ab", 60, 300, at(AS_OF)).select("id")


def _scores_sql(source: str, skill_level: str = "senior", place: str = "Brno", salary_min: int | None = 50000, profile: bool = False) -> str:
    """The score's parts over `source`, from their definitions."""
    vocabulary = f"list_distinct(list_concat({sql_tokens(text(INTENT.canonical_text))}, {sql_tokens(text(INTENT.scraping_keyword))}, {sql_tokens(text(QUERY))}))"
    foreign = "regexp_matches(place, '(^|[^A-Za-z0-9_])(POL|SVK|HUN|DEU|AUT|GBR|USA|NLD|ESP|FRA|ITA|ROU|BGR|UKR|Poland|Polska|Germany|Slovakia|Hungary|Austria|United Kingdom|United States|Netherlands|Spain|France|Italy|Romania|Bulgaria|Ukraine)([^A-Za-z0-9_]|$)')"
    wanted = norm(text(place))
    outside = f"({norm('place')} <> '' AND NOT regexp_matches({norm('place')}, 'remote|home ?office|vzdalen|z domova') AND NOT contains({norm('place')}, {wanted}))"
    if place:
        spot = f"""CASE WHEN remote AND town IS NULL AND {foreign} THEN 0.6 WHEN remote THEN 0.8 WHEN town IS NULL AND {outside} THEN 0.2 WHEN town IS NULL THEN 0.5 WHEN {norm('town')} = {wanted} THEN 1.0 ELSE 0.2 END"""
        factor = f"CASE WHEN remote THEN 1.0 WHEN town IS NULL AND {outside} THEN 0.5 WHEN town IS NOT NULL AND {norm('town')} <> {wanted} THEN 0.5 ELSE 1.0 END"
    else:
        spot = f"CASE WHEN remote AND town IS NULL AND {foreign} THEN 0.6 WHEN remote THEN 1.0 WHEN town IS NULL THEN 0.5 ELSE 0.7 END"
        factor = "1.0"
    want = skill_level if skill_level in ("junior", "mid", "senior", "lead") else (PROFILE.seniority if profile else None)
    rank = "0.6" if want is None else f"CASE WHEN lvl IS NULL THEN 0.5 WHEN lvl = '{want}' THEN 1.0 ELSE 0.0 END"
    pay = "CASE WHEN salary IS NULL THEN 0.0 ELSE 1.0 END" if salary_min is None else f"CASE WHEN salary IS NULL THEN 0.0 WHEN price + 10000 >= {salary_min} THEN 1.0 ELSE 0.3 END"
    excluded = " OR ".join(f"contains(' ' || folded || ' ', ' ' || {norm(text(t))} || ' ')" for t in INTENT.excluded_titles)
    included = " OR ".join(f"contains(folded, {norm(text(t))})" for t in INTENT.included_titles)
    fit = ""
    if profile:
        shared = f"len(list_filter(found, lambda s: list_contains({listed(PROFILE.skills)}, s)))"
        fit = f"(0.7 * least(1.0, {shared} / 3.0) + 0.3 * CASE WHEN contains(folded, 'frontend developer') THEN 1.0 ELSE 0.0 END)"
    weighted = "0.35 * title_part + 0.25 * keywords_part + 0.15 * location_part + 0.1 * seniority_part + 0.1 * recency_part + 0.05 * salary_part"
    total = f"(({weighted}) * 0.85 + 0.15 * fit)" if profile else f"({weighted})"
    return f"""base AS (
  SELECT *, {norm('title')} AS folded, coalesce(location, CASE WHEN kind = 'Remote' THEN 'Remote' ELSE coalesce(town, '') END) AS place, kind = 'Remote' AND kind IS NOT NULL AS remote
  FROM (SELECT *, CASE WHEN work_type = 'Remote' THEN 'Remote' WHEN work_type = 'Hybrid' THEN 'Hybrid' WHEN work_type = 'Full office' THEN 'Onsite'
      WHEN regexp_matches({norm("coalesce(location, '') || ' ' || title")}, '(^| )hybrid( |$)') THEN 'Hybrid' WHEN regexp_matches({norm("coalesce(location, '') || ' ' || title")}, '(^| )remote( |$)') THEN 'Remote' END AS kind,
    {city(norm("coalesce(location, '')"))} AS town, {level(norm('title'))} AS lvl, {skill_list(norm("replace(title || ' ' || description, 'Next.js', 'nextjs')"))} AS found FROM {source})),
parts AS (
  SELECT *, CASE WHEN contains(folded, {norm(text(QUERY))}) THEN 1.0 WHEN {included} THEN 0.9 WHEN contains(folded, 'react') THEN 0.7 ELSE 0.0 END AS title_part,
    least(1.0, len(list_intersect({vocabulary}, {sql_tokens("title || ' ' || description || ' ' || array_to_string(found, ' ')")})) / 10.0) AS keywords_part,
    {spot} AS location_part, {factor} AS factor, {rank} AS seniority_part, {fit or '0.0'} AS fit,
    CASE WHEN abs(epoch(TIMESTAMP '{AS_OF}') - epoch(coalesce(posted_at, first_seen_at))) <= 7 * 86400 THEN 1.0 WHEN abs(epoch(TIMESTAMP '{AS_OF}') - epoch(coalesce(posted_at, first_seen_at))) <= 30 * 86400 THEN 0.5 ELSE 0.0 END AS recency_part,
    {pay} AS salary_part, ({excluded}) AS banned FROM base),
scores AS (SELECT *, CASE WHEN title_part = 0 AND banned THEN 0.0 ELSE floor({total} * factor * 1000 + 0.5) / 1000 END AS score FROM parts)"""


def _request(**more) -> score.Request:
    return score.Request(QUERY, at(AS_OF), **({"skill_level": "senior", "city": "Brno", "salary_min": 50000} | more))


PART_NAMES = ("title", "keywords", "location", "seniority", "recency", "salary")
PART_SQL = ", ".join(f"CAST({p}_part AS DOUBLE) AS {p}_part" for p in PART_NAMES)


@query("r1_r9_score_parts", with_(JOB, _scores_sql("job")) + f"SELECT id, {PART_SQL}, CAST(score AS DOUBLE) AS score FROM scores")
def r1(spark: SparkSession, sf: str) -> DataFrame:
    out = score.scored(domain.job_postings(spark, sf), _request())
    return out.select("id", *(F.col(f"parts.{p}.value").alias(f"{p}_part") for p in PART_NAMES), "score")


@query("r8_profile_score", with_(JOB, _scores_sql("job", "Any", "", None, True)) + "SELECT id, CAST(score AS DOUBLE) AS score FROM scores")
def r8(spark: SparkSession, sf: str) -> DataFrame:
    return score.scored(domain.job_postings(spark, sf), _request(skill_level="Any", city="", salary_min=None, profile=PROFILE)).select("id", "score")


@query(
    "r10_feature_vector",
    with_(JOB, _scores_sql("job"))
    + "SELECT id, CASE WHEN title_part = 0 AND banned THEN list_transform(range(0, 14), lambda i: 0.0::DOUBLE) ELSE [score, title_part, keywords_part, location_part, seniority_part, recency_part, salary_part, 0, 0, CASE WHEN remote THEN 1 ELSE 0 END, CASE WHEN factor < 1 THEN 1 ELSE 0 END, CASE WHEN salary IS NULL THEN 0 ELSE 1 END, floor(length(description) / 3000.0 * 1000000 + 0.5) / 1000000, 0]::DOUBLE[] END AS features FROM scores",
)
def r10(spark: SparkSession, sf: str) -> DataFrame:
    out = score.scored(domain.job_postings(spark, sf), _request())
    return out.select("id", F.transform("features", lambda f: F.floor(f * 1_000_000 + 0.5) / 1_000_000).alias("features"))


@query(
    "stored_search",
    with_(JOB, _recent_sql(60, 300), _scores_sql("recent")) + "SELECT id, title, company, CAST(score AS DOUBLE) AS score FROM scores WHERE score >= 0.3 ORDER BY scores.score DESC, scraped_at DESC, id LIMIT 20",
)
def stored_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: recent postings by keyword, scored, cut at the threshold, the best 20."""
    return score.ranked(score.scored(_recent(spark, sf, 60, 300), _request()), 20).select("id", "title", "company", "score")


@query(
    "o2_stream_search",
    with_(JOB, _recent_sql(30, 200), _scores_sql("recent", "Any", "", None)) + "SELECT id, CAST(score AS DOUBLE) AS score FROM scores WHERE score >= 0.3 ORDER BY scores.score DESC, scraped_at DESC, id LIMIT 80",
)
def o2(spark: SparkSession, sf: str) -> DataFrame:
    return score.ranked(score.scored(_recent(spark, sf, 30, 200), _request(skill_level="Any", city="", salary_min=None)), 80).select("id", "score")


@query("o1_o3_latest_and_top", with_(JOB) + "SELECT id FROM job WHERE expired_at IS NULL ORDER BY scraped_at DESC, id LIMIT 10")
def o1(spark: SparkSession, sf: str) -> DataFrame:
    return domain.job_postings(spark, sf).filter("expired_at is null").orderBy(F.desc("scraped_at"), "id").limit(10).select("id")


@query(
    "p1_p3_lookup_by_url",
    with_(JOB) + "SELECT id, title, company, location, salary, work_type FROM job WHERE source_url IN (SELECT source_url FROM job WHERE id % 50 = 1)",
)
def p3(spark: SparkSession, sf: str) -> DataFrame:
    jobs = domain.job_postings(spark, sf)
    wanted = jobs.filter("id % 50 = 1").select("source_url")
    return jobs.join(wanted, "source_url", "left_semi").select("id", "title", "company", "location", "salary", "work_type")


@query("p4_posting_filter", with_(JOB) + "SELECT id FROM job WHERE source = 'COCUMA' AND salary IS NOT NULL AND (contains(lower(title), 'react') OR contains(lower(company), 'react'))")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return search.posting_filter(search.posting_filter(domain.job_postings(spark, sf), "NOT_A_SOURCE"), "COCUMA", True, " React ").select("id")


@query(
    "p6_result_filter",
    with_(JOB)
    + "SELECT id FROM job WHERE coalesce(salary, '') <> '' AND (work_type IS NULL OR work_type = 'Remote') AND contains(lower(coalesce(location, '')), 'pra') AND (price + 10000) * 2 / 2 >= 50000 AND (price + 10000) <= 70000 AND (contains(lower(title), 'd') OR contains(lower(company), 'd'))",
)
def p6(spark: SparkSession, sf: str) -> DataFrame:
    return search.result_filter(domain.job_postings(spark, sf), has_salary=True, kind="Remote", city="Pra", salary_min=50000, salary_max=70000, position="d").select("id")


@query(
    "p7_salary_midpoint",
    values("salary VARCHAR, middle DOUBLE", [("45 000 - 80 000 Kč", 62500.0), ("až 210 000", 210000.0), ("dohodou", None), ("0 Kč", None), ("600 - 900 € / MD", 750.0)]),
)
def p7(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.fields import salary_midpoint

    rows = literal(spark, "salary string", [("45 000 - 80 000 Kč",), ("až 210 000",), ("dohodou",), ("0 Kč",), ("600 - 900 € / MD",)])
    return rows.select("salary", salary_midpoint("salary").alias("middle"))


@query(
    "p8_title_matches",
    with_(JOB) + f"SELECT id, contains({norm('title')}, 'react') OR contains({norm('title')}, 'frontend developer') AS matches FROM job",
)
def p8(spark: SparkSession, sf: str) -> DataFrame:
    return domain.job_postings(spark, sf).select("id", search.title_matches(F.col("title"), QUERY, INTENT).alias("matches"))


@query("p9_mentions_query", f"SELECT doc_id, list_has_all(string_split({norm('text')}, ' '), []) AND contains({norm('text')}, 'the') AND contains({norm('text')}, 'tion') AS mentions FROM documents")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.dictionaries import STOPWORDS

    assert "tion" not in STOPWORDS
    docs = domain.read(spark, sf, "documents")
    both = search.mentions_query(F.col("text"), "tion") & F.contains(F.lower("text"), F.lit("the"))
    return docs.select("doc_id", both.alias("mentions"))


@query(
    "p11_j8_freshness",
    with_(JOB) + f"SELECT l.url, j.id AS known_id, coalesce(j.scraped_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY, false) AS fresh FROM (SELECT CASE WHEN id % 2 = 0 THEN source_url ELSE source_url || '&c=1' END AS url FROM job) l LEFT JOIN job j ON j.source_url = l.url",
)
def p11(spark: SparkSession, sf: str) -> DataFrame:
    jobs = domain.job_postings(spark, sf)
    listings = jobs.select(F.when(F.col("id") % 2 == 0, F.col("source_url")).otherwise(F.concat("source_url", F.lit("&c=1"))).alias("url"))
    return search.freshness(listings, jobs, at(AS_OF))


@query(
    "p12_stale_postings",
    with_(JOB) + f"SELECT id FROM job WHERE expired_at IS NULL AND scraped_at < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY ORDER BY scraped_at, id LIMIT 25",
)
def p12(spark: SparkSession, sf: str) -> DataFrame:
    return search.stale(domain.job_postings(spark, sf), at(AS_OF)).select("id")


FLAGS = with_(JOB, EVENT, FAVOURITE) + f""", dis AS (SELECT DISTINCT job_id FROM ev WHERE kind = 'error' AND user_id = {domain.USER}),
flags AS (SELECT id, id IN (SELECT job_id FROM fav WHERE user_id = {domain.USER}) AS favourited, id IN (SELECT job_id FROM dis) AS dismissed, first_seen_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AS is_new, scraped_at <= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AS is_stale FROM job)
"""


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    mine = F.col("user_id") == domain.USER
    dismissed = domain.feedback_events(spark, sf).filter("kind = 'error'").filter(mine)
    return search.flagged(domain.job_postings(spark, sf), domain.favourites(spark, sf).filter(mine), dismissed, at(AS_OF)).select("id", "favourited", "dismissed", "is_new", "is_stale")


@query("p13_j11_flags", FLAGS + "SELECT * FROM flags")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf)


@query("p14_visible_and_hidden", FLAGS + "SELECT count(*) FILTER (NOT dismissed) AS visible, count(*) FILTER (dismissed) AS hidden FROM flags")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf).agg(F.count_if(~F.col("dismissed")).alias("visible"), F.count_if("dismissed").alias("hidden"))


@query(
    "f18_query_intents",
    values(
        "q VARCHAR, category VARCHAR, keyword VARCHAR",
        [("react", "Frontend", "React"), ("React.js", "Frontend", "React"), ("node.js", "Backend", "node.js"), ("senior react developer", "Frontend", "React"), ("python backend engineer", "Backend", "python"), ("Full-Stack", "Fullstack", "fullstack"), ("zig-lang", "Other", "zig-lang"), ("constructor", "Other", "constructor"), ("machine learning", "Other", "machine learning"), ("ml", "Data", "data")],
    ),
)
def f18(spark: SparkSession, sf: str) -> DataFrame:
    """Intents are looked up once a query, before a plan is made."""
    asked = ["react", "React.js", "node.js", "senior react developer", "python backend engineer", "Full-Stack", "zig-lang", "constructor", "machine learning", "ml"]
    return literal(spark, "q string, category string, keyword string", [(q, lookup_intent(q).category, lookup_intent(q).scraping_keyword) for q in asked])


@query("o14_token_sets", f"SELECT doc_id, len(list_intersect({sql_tokens('text')}, ['rest', 'less', 'tion', 'ing'])) AS shared, len({sql_tokens('text')}) AS distinct_tokens FROM documents")
def o14(spark: SparkSession, sf: str) -> DataFrame:
    own = tokens("text")
    wanted = F.array(*map(F.lit, ("rest", "less", "tion", "ing")))
    return domain.read(spark, sf, "documents").select("doc_id", F.size(F.array_intersect(own, wanted)).cast("long").alias("shared"), F.size(own).cast("long").alias("distinct_tokens"))


@query("f29_reason_order", values("reasons VARCHAR[]", [(["Title fits your CV", "Matches your CV skills (React)", "Remote", "Salary listed"],)]))
def f29(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "reasons array<string>", [(["Remote", "Title fits your CV", "Salary listed", "Matches your CV skills (React)"],)])
    own = lambda r: F.contains(r, F.lit("your CV"))
    return rows.select(F.concat(F.filter("reasons", own), F.filter("reasons", lambda r: ~own(r))).alias("reasons"))
