"""Feeds, pages, structured data and robots rules, over cases and the pages table."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intents import lookup_intent
from ..functions.text import contact_email, html_text
from ..operators import crawl, search
from ..sources import domain, feeds, html, web
from . import captures as cases
from .registry import literal, query, values

EXPECTED = {
    "greenhouse": ("s12_greenhouse", ("5501", "Platform Engineer", "https://boards.greenhouse.io/lipova/jobs/5501", "Olomouc, Czechia", "Your week\nQueues & streams", False, "2025-03-04 05:06:07", None)),
    "lever": ("s13_lever", ("kx-9", "Svelte Engineer", "https://jobs.lever.co/lipova/kx-9", "Remote - CEE", "Maps that load quickly", True, "2025-01-01 00:00:00", "3100 - 4700 EUR")),
    "ashby": ("s14_ashby", ("m31", "Analytics Lead", "https://jobs.ashbyhq.com/lipova/m31", "Liberec", "Numbers, explained", False, None, "90K CZK a month")),
    "recruitee": ("s15_recruitee", ("61", "Svelte Intern", "https://lipova.recruitee.com/o/intern", "Zlín, Czech Republic", "Learn by doing\nCuriosity", True, None, None)),
    "workable": ("s16_workable", ("QQ4", "Office Manager", "https://apply.workable.com/lipova/j/QQ4", "Opava, Czechia", "Plants and people", False, None, None)),
    "smartrecruiters": ("s17_smartrecruiters", ("880", "Site Reliability", "https://jobs.smartrecruiters.com/Lipova/880", "Jihlava, cz", "Keep it up.\n\nWrite it down.", False, "2025-02-01 00:00:00", None)),
}
_COLUMNS = "id VARCHAR, title VARCHAR, url VARCHAR, location VARCHAR, description VARCHAR, remote BOOLEAN, posted_at VARCHAR, salary VARCHAR"


def captures(spark: SparkSession) -> DataFrame:
    rows = [(ats, "lipova", "Lipová dílna", json.dumps(payload)) for ats, payload in cases.FEEDS.items()]
    return literal(spark, "ats string, slug string, name string, payload string", [*rows, ("greenhouse", "broken", "Broken", "{not json"), ("greenhouse", "none", None, None)])


def _feed(ats: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = feeds.postings(captures(spark), ats)
        if ats == "smartrecruiters":
            out = feeds.with_descriptions(out, literal(spark, "id string, payload string", cases.DETAILS))
        return out.select("id", "title", "url", "location", "description", "remote", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"), "salary")

    return run


for _ats, (_name, _row) in EXPECTED.items():
    query(_name, values(_COLUMNS, [_row]))(_feed(_ats))


@query(
    "s18_joined_locations",
    values("id INT, place VARCHAR, pay VARCHAR", [(1, "Prague, Czechia", "80000 - 100000 EUR"), (2, "Brno", "5"), (3, "", None)]),
)
def s18(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "id int, parts array<string>, low string, high string, currency string", [(1, ["Prague, Czechia", "prague", None, " "], "80000", "100000", "EUR"), (2, [None, "Brno"], None, "5", None), (3, [], None, None, "CZK")])
    return rows.select("id", feeds.join_location(F.col("parts")).alias("place"), feeds.salary_range(F.col("low"), F.col("high"), F.col("currency")).alias("pay"))


@query("s19_employer_postings", values("title VARCHAR, name VARCHAR", [("Svelte Engineer", "Lipová dílna"), ("Svelte Intern", "Lipová dílna")]))
def s19(spark: SparkSession, sf: str) -> DataFrame:
    """Of all feeds, the postings in the country that the search asks for."""
    found = feeds.postings(captures(spark), "greenhouse")
    for ats in ("lever", "ashby", "recruitee", "workable"):
        found = found.unionByName(feeds.postings(captures(spark), ats))
    asked = lookup_intent("Svelte")
    wanted = search.title_matches(F.col("title"), "Svelte", asked) | search.mentions_query(F.col("description"), "Svelte")
    return found.filter(feeds.located_in_country(F.col("location"), F.col("remote")) & wanted).select("title", "name")


EMPLOYERS = [(0, "greenhouse", "lipova", "Lipová dílna"), (1, "lever", "koty", "Kóty"), (2, "recruitee", "koty", "Kóty dvě")]


@query(
    "s20_j20_employer_lookup",
    values(
        "url VARCHAR, company VARCHAR, ats VARCHAR, slug VARCHAR, name VARCHAR",
        [("https://mista.example/1", "lipová DÍLNA", "greenhouse", "lipova", "Lipová dílna"), ("https://jobs.lever.co/Koty/abc", "", "lever", "koty", "Kóty"), ("https://mista.example/2", "Nikdo", None, None, None)],
    ),
)
def s20(spark: SparkSession, sf: str) -> DataFrame:
    listings = literal(spark, "url string, company string", [("https://mista.example/1", "lipová DÍLNA"), ("https://jobs.lever.co/Koty/abc", ""), ("https://mista.example/2", "Nikdo")])
    return feeds.employer_of(listings, literal(spark, "seq int, ats string, slug string, name string", EMPLOYERS))


@query("s21_search_queries", values("place INT, q VARCHAR", [(0, "React developer Brno (job OR práce OR kariéra OR careers)"), (1, "React vývojář Brno nabídka práce")]))
def s21(spark: SparkSession, sf: str) -> DataFrame:
    return literal(spark, "place int, q string", list(enumerate(web.search_queries("React developer", "Brno"))))


@query(
    "s22_s23_search_results",
    values(
        "url VARCHAR, title VARCHAR, worth BOOLEAN",
        [
            ("https://prace.vzor.example/mista/svelte", "Svelte ve Vzoru", True),
            ("https://www.profesia.cz/x/9", "Svelte jinde", True),
            ("https://www.prace.cz/nabidka/77/", "Na desce", False),
            ("https://www.linkedin.com/jobs/5", "Za přihlášením", False),
        ],
    ),
)
def s22(spark: SparkSession, sf: str) -> DataFrame:
    found = web.search_results(literal(spark, "page_id int, html string", [(1, cases.FOUND), (2, None)]))
    return found.select("url", "title", web.worth_visiting(F.col("url")).alias("worth"))


@query(
    "s23_worth_visiting_pages",
    "SELECT page_id, NOT regexp_matches(host, '(^|\\.)(example\\.net\\.no|indeed\\.com|google\\.com)$') AND host <> '' AS worth FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages)",
)
def s23(spark: SparkSession, sf: str) -> DataFrame:
    return domain.read(spark, sf, "pages").select("page_id", web.worth_visiting(F.col("url")).alias("worth"))


@query(
    "s24_hop_links",
    values("rank INT, href VARCHAR", [(1, "https://rozcestnik.example/m/svelte-developer-opava-31"), (2, "https://rozcestnik.example/m/svelte-developer-zlin-32?z=1")]),
)
def s24(spark: SparkSession, sf: str) -> DataFrame:
    page = literal(spark, "page_id int, url string, html string", [(1, cases.HUB_URL, cases.HUB), (2, cases.HUB_URL, None)])
    return web.hop_links(page, "Svelte developer", 2).select("rank", "href")


@query(
    "s25_known_hosts_first",
    """WITH p AS (SELECT page_id AS pos, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages)
SELECT pos, url, host, known FROM (SELECT *, ends_with(host, 'example.net') AS known FROM p ORDER BY known DESC, pos LIMIT 20)""",
)
def s25(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import host_of

    pages = domain.read(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url")
    known = pages.select(host_of("url").alias("host")).filter(F.endswith("host", F.lit("example.net")))
    return web.known_hosts_first(pages, known, 20)


@query(
    "s26_f23_json_ld",
    values(
        "title VARCHAR, company VARCHAR, location VARCHAR, description VARCHAR, remote BOOLEAN, posted_at VARCHAR, salary VARCHAR, email VARCHAR",
        [("Svelte Engineer", "Lipová dílna", "Opava, CZ", "Maps\nCharts", False, "2025-01-20", "41000 - 52000 CZK / month", "prace@lipova.example"), ("Kartograf", "", "Zlín", "", True, None, None, None)],
    ),
)
def s26(spark: SparkSession, sf: str) -> DataFrame:
    pages = literal(spark, "page_id int, html string", [(1, cases.STRUCTURED), (2, "<p>nic</p>"), (3, None)])
    return web.json_ld_postings(pages).select("title", "company", "location", "description", "remote", F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"), "salary", "email")


SPOTS = [
    ("Opava, Czechia", False, True, True), ("Zlín", False, True, True), ("CZ - Moravia", False, True, True), ("CEE, home based", True, True, True), ("Lyon, France", False, False, False),
    ("Remote, Portugal", True, False, True), ("Remote", True, True, True), ("Anywhere", True, True, True), ("", False, False, True),
]


@query("s27_country_predicates", values("location VARCHAR, remote BOOLEAN, located BOOLEAN, unknown_ok BOOLEAN", SPOTS))
def s27(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "location string, remote boolean", [s[:2] for s in SPOTS])
    place, away = F.col("location"), F.col("remote")
    return rows.select("location", "remote", feeds.located_in_country(place, away).alias("located"), feeds.located_or_unknown(place, away).alias("unknown_ok"))


@query("s28_html_text_cases", values("id INT, body VARCHAR", [(1, "A & B\nc d"), (2, "one\ntwo"), (3, "")]))
def s28(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "id int, html string", [(1, "<p>A &amp; B</p><div>c   <b>d</b></div><script>x()</script>"), (2, "one<br>two"), (3, None)])
    return rows.select("id", html_text("html").alias("body"))


@query("s28_f7_page_texts")
def s28_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page and its first link, by a parser in Arrow batches."""
    pages = domain.read(spark, sf, "pages")
    link = F.regexp_extract("html", r'(?i)<a[^>]*\bhref="([^"]*)"', 1)
    return pages.select("page_id", F.length(html.page_main_text("html")).alias("n_chars"), html.absolute_url(link, F.col("url")).alias("first_link"))


@query("s29_page_emails", values("id INT, emails VARCHAR", [(1, "lide@lipova.example,vedeni@lipova.example,no-reply@lipova.example"), (2, "")]))
def s29(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "id int, html string", [(1, cases.CONTACTS), (2, None)])
    return rows.select("id", F.array_join(html.page_emails("html"), ",").alias("emails"))


ROBOTS = """# rules
User-agent: evil
Disallow: /
User-agent: *
User-agent: other
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
Disallow:
User-agent: late
Disallow: /late
"""
PATHS = [("/jobs", True), ("/private/x", False), ("/private/open/1", True), ("/cv.pdf", False), ("/cv.pdf?x", True), ("/late", True)]


@query("s30_robots_rules", values("path VARCHAR, allowed BOOLEAN", PATHS))
def s30(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "path string, robots string", [(p, ROBOTS) for p, _ in PATHS])
    return rows.select("path", web.robots_allow(F.col("robots"), F.col("path")).alias("allowed"))


@query("s31_cache_keys", "SELECT page_id, sha1('GET ' || url || chr(10)) AS key FROM pages")
def s31(spark: SparkSession, sf: str) -> DataFrame:
    return domain.read(spark, sf, "pages").select("page_id", web.cache_key(F.lit("GET"), F.col("url"), F.lit(None)).alias("key"))


SOURCE_ROWS = [("nofluffjobs", "NoFluffJobs", ["CZ"], False, 0), ("jobscz", "Jobs.cz", ["CZ"], True, 0), ("jooble", "Jooble", ["CZ"], True, 4), ("other", "Other", ["PL"], True, 0)]


@query(
    "s1_s2_runnable_sources",
    values("id VARCHAR, reason VARCHAR", [("nofluffjobs", "NoFluffJobs skipped: not available"), ("jobscz", None), ("jooble", "Jooble paused after repeated failures (retrying in 4 min)")]),
)
def s1(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "id string, label string, countries array<string>, available boolean, paused int", SOURCE_ROWS)
    reason = F.when(~F.col("available"), F.concat("label", F.lit(" skipped: not available"))).when(
        F.col("paused") > 0, F.concat("label", F.lit(" paused after repeated failures (retrying in "), "paused", F.lit(" min)"))
    )
    return rows.filter(F.array_contains("countries", "CZ")).select("id", reason.alias("reason"))


CONFIG = '{"robotsAllow": ["example.com/api/"], "employers": [{"ats": "greenhouse", "slug": "acme", "name": "Acme"}, {"ats": "unknown", "slug": "x", "name": "X"}]}'


@query("s33_source_config", values("ats VARCHAR, slug VARCHAR, name VARCHAR, valid BOOLEAN", [("greenhouse", "acme", "Acme", True), ("unknown", "x", "X", False)]))
def s33(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "body string", [(CONFIG,)])
    employers = F.from_json("body", "struct<employers:array<struct<ats:string,slug:string,name:string>>>")["employers"]
    return rows.select(F.inline(employers)).withColumn("valid", F.col("ats").isin(*feeds.FEEDS))


NFJ = [
    {"title": "React Developer", "name": "Acme", "url": "r1", "regions": ["cz"], "salary": {"from": 50000, "to": 80000, "currency": "CZK", "period": "Month", "type": "b2b"}, "location": {"places": [{"city": "Praha", "country": {"code": "CZE"}}, {"city": "Praha", "country": {"code": "CZE"}}, {"city": "Brno", "country": {"code": "CZE"}}]}},
    {"title": "React Developer", "name": "ACME", "url": "r2", "regions": ["cz"]},
    {"title": "React Native Developer", "name": "Beta", "url": "r3", "fullyRemote": True, "location": {"places": [{"city": "Remote", "country": {"code": "POL"}}]}, "salary": {"to": 900}},
    {"title": "Accountant", "name": "Acme", "url": "r4", "regions": ["cz"]},
    {"title": "React Lead", "name": "Gamma", "url": "r5", "regions": ["pl"]},
]


@query(
    "s3_s4_board_search",
    values(
        "url VARCHAR, title VARCHAR, company VARCHAR, location VARCHAR, salary VARCHAR, work_type VARCHAR",
        [("https://nofluffjobs.com/cz/job/r1", "React Developer", "Acme", "Praha, Brno", "50000 - 80000 CZK / měsíc (b2b)", None), ("https://nofluffjobs.com/cz/job/r3", "React Native Developer", "Beta", "Remote (POL)", "900", "Remote")],
    ),
)
def s3(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "page int, payload string", [(1, json.dumps({"postings": NFJ})), (2, json.dumps({"postings": NFJ[:1]}))])
    asked = lookup_intent("React")
    return feeds.board_postings(rows, lambda t: search.title_matches(t, "React", asked)).select("url", "title", "company", "location", "salary", "work_type")


@query("s4_board_description", values("body VARCHAR", [("Work.\n\nDaily tasks:\n- code\n- test\n\nMust have: React, SQL\n\nNice to have: Go",)]))
def s4(spark: SparkSession, sf: str) -> DataFrame:
    detail = {"details": {"description": "<p>Work.</p>"}, "requirements": {"musts": [{"value": "React"}, {"value": "SQL"}], "nices": [{"value": "Go"}]}, "specs": {"dailyTasks": ["code", "test"]}}
    return literal(spark, "detail string", [(json.dumps(detail),)]).select(feeds.board_description(F.col("detail")).alias("body"))


@query(
    "s11_aggregator",
    values("title VARCHAR, company VARCHAR, location VARCHAR, description VARCHAR, url VARCHAR, salary VARCHAR, work_type VARCHAR, posted_at VARCHAR", [("Dev", "", "Brno", "a b", "https://x.cz/1", None, "Full-time", "2026-10-01 10:00:00")]),
)
def s11(spark: SparkSession, sf: str) -> DataFrame:
    payload = {"jobs": [{"title": "Dev", "location": "Brno", "snippet": "a <b>b</b>", "salary": "", "type": "Full-time", "link": "https://x.cz/1", "updated": "2026-10-01T10:00:00Z"}, {"title": "No link"}]}
    out = feeds.aggregator_jobs(literal(spark, "payload string", [(json.dumps(payload),)]))
    return out.withColumn("posted_at", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "s5_s10_board_cards",
    values(
        "board VARCHAR, url VARCHAR, title VARCHAR, company VARCHAR, location VARCHAR, salary VARCHAR, work_type VARCHAR",
        [
            ("pracecz", "https://www.prace.cz/nabidka/41/", "Zeměměřič", "Kóty a spol.", "Opava", "38 000 Kč", None),
            ("pracecz", "https://www.prace.cz/nabidka/42/", "Bez karty", None, None, None, None),
            ("startupjobs", "https://www.startupjobs.cz/nabidka/88/mapy", "Kartograf", "Mapová dílna", "Liberec", "od 2 000 EUR", "Hybrid, Part-time"),
            ("jobstack", "https://www.jobstack.it/it-job/77", "Správce", "Kóty", "Dlouhá 12/3, Zlín", "50 000 Kč", "Remote"),
            ("jobstack", "https://www.jobstack.it/it-job/78", "Tester", "Kóty", "Zlín", None, None),
            ("skilleto", "https://www.skilleto.cz/jobs/61", "Kartograf", "Mapová dílna", None, "45 000", None),
            ("skilleto", "https://www.skilleto.cz/jobs/62", "Bez karty", None, None, None, None),
            ("cocuma", "https://www.cocuma.cz/job/mapy", "Z titulku", "Mapová dílna", None, None, "Zkrácený"),
            ("jobscz", "https://www.jobs.cz/rpd/5/", "Kartograf", "Mapová dílna", "Ostrava a okolí", "60 000 Kč", None),
        ],
    ),
)
def s5(spark: SparkSession, sf: str) -> DataFrame:
    rows = literal(spark, "board string, html string", [*cases.CARDS, ("jobscz", None)])
    return rows.select("board", F.inline(html.cards_of("board", "html"))).select("board", "url", "title", "company", "location", "salary", "work_type")


_LONG = "Kreslíme mapy měst, lesů a vod pro každého, kdo chodí pěšky. Kreslíme mapy měst, lesů a vod pro každého, kdo chodí pěšky. Kreslíme mapy měst, lesů a vod pro každého, kdo chodí pěšky. Kreslíme mapy měst, lesů a vod pro každého, kdo chodí pěšky."


@query(
    "s5_s6_posting_details",
    values(
        "url VARCHAR, title VARCHAR, description VARCHAR, apply_email VARCHAR",
        [
            ("u1", "Kartograf", "Úvod\n" + _LONG, "lide@koty.example"),
            ("u2", "Kartograf", "první\n" + _LONG, None),
            ("u3", "Kartograf", _LONG, None),
            ("u4", "Kartograf", _LONG, "nabor@koty.example"),
            ("u5", "Kartograf", "Mapy pro pěší", None),
            ("u6", "Kartograf", "Kartograf — Opava", None),
            ("u7", "Kartograf", "Jen pár slov", None),
            ("u8", "Kartograf II", _LONG, None),
            ("u9", "Z karty", "Celá stránka", None),
        ],
    ),
)
def s5_details(spark: SparkSession, sf: str) -> DataFrame:
    """Postings read on their own pages: as served, as rendered, by their meta line, or from the listing alone."""
    rows = literal(spark, "url string, board string, title string, company string, location string, served string, rendered string", cases.DETAILS_OF)
    rows = rows.withColumn("s", html.detail_of("board", "served")).withColumn("r", html.detail_of("board", "rendered"))
    title = F.when(F.col("board") == "cocuma", F.coalesce(F.nullif("s.title", F.lit("")), "title")).otherwise(F.col("title"))
    every = F.concat(F.coalesce("s.emails", F.array().cast("array<string>")), F.coalesce("r.emails", F.array().cast("array<string>")))
    return rows.select("url", title.alias("title"), crawl.described(["title", "company", "location"], F.col("s"), F.col("r")).alias("description"), contact_email(every).alias("apply_email"))


@query(
    "s6_browsed_pages",
    values("search INT, page INT, url VARCHAR, title VARCHAR", [(1, 1, "https://www.cocuma.cz/job/a", "Svelte Developer"), (1, 1, "https://www.cocuma.cz/job/c", "Senior Svelte Engineer"), (1, 2, "https://www.cocuma.cz/job/d", "Svelte Lead"), (2, 1, "https://www.cocuma.cz/job/f", "Svelte Developer")]),
)
def s6(spark: SparkSession, sf: str) -> DataFrame:
    """All jobs of a board are browsed and matched here; reading ends with a page that is not full."""
    rows = literal(spark, "search int, page int, html string", cases.BROWSED)
    pages = rows.select("search", "page", html.links_with("html", F.lit("/job/")).alias("links"), html.cards_of(F.lit("cocuma"), "html").alias("cards"))
    return crawl.browsed(pages, search.title_matches(F.col("title"), "Svelte", lookup_intent("Svelte"))).select("search", "page", "url", "title")


@query(
    "s10_skill_then_role",
    values("search INT, rank INT, url VARCHAR, title VARCHAR", [(1, 0, "https://www.skilleto.cz/jobs/7", "Svelte Developer"), (2, 1, "https://www.skilleto.cz/jobs/7", "Svelte Developer")]),
)
def s10(spark: SparkSession, sf: str) -> DataFrame:
    """The skill's page, and the role's where that has no match."""
    rows = literal(spark, "search int, rank int, allowed boolean, html string", cases.TWO_PAGES)
    pages = rows.withColumn("cards", html.cards_of(F.lit("skilleto"), "html"))
    return crawl.first_page_with_cards(pages, search.title_matches(F.col("title"), "Svelte", lookup_intent("Svelte"))).select("search", "rank", "url", "title")


@query("s32_latest_cv", values("user_id INT, body VARCHAR", [(1, "new"), (2, "only")]))
def s32(spark: SparkSession, sf: str) -> DataFrame:
    """The text of each user's latest document; others than text are left to their own readers."""
    rows = literal(spark, "user_id int, name string, uploaded_at timestamp_ntz, content binary", [(1, "a.txt", dt.datetime(2024, 1, 1), b"old"), (1, "b.txt", dt.datetime(2024, 2, 1), b"new"), (2, "c.txt", dt.datetime(2024, 1, 1), b"only")])
    last = rows.groupBy("user_id").agg(F.max_by("content", "uploaded_at").alias("content"))
    return last.select("user_id", F.decode("content", "UTF-8").alias("body"))
