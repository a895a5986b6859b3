"""Statistics, calendars and joins over applications and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionaries import HIDDEN_WHEN_EMPTY, SOURCES, STATUSES
from ..operators import joins, reports, search
from ..sources import domain
from ..sources.domain import AS_OF, ORDERS_AS_OF, at
from .registry import literal, query, values
from .views import APPLICATION, EVENT, FAVOURITE, INTERVIEW, JOB, listed, stamp, with_

STATUS_ROWS = f"(SELECT unnest({listed(STATUSES)}) AS status, unnest(range(0, {len(STATUSES)})) AS ordinal)"
SOURCE_ROWS = f"(SELECT unnest({listed(SOURCES)}) AS source, unnest(range(0, {len(SOURCES)})) AS ordinal)"


def moment(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("a1_applications_by_status", with_(APPLICATION) + "SELECT status, count(*) AS n FROM app GROUP BY status")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return reports.by_status(domain.applications(spark, sf))


@query("a2_status_counts", with_(APPLICATION) + f"SELECT s.status, CAST(s.ordinal AS INT) AS ordinal, count(app.id) AS n FROM {STATUS_ROWS} s LEFT JOIN app ON app.status = s.status AND app.user_id = {domain.USER} GROUP BY ALL")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return reports.status_counts(domain.applications(spark, sf).filter(F.col("user_id") == domain.USER))


@query(
    "a3_weekly_applications",
    with_(APPLICATION) + f"SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d') AS \"week\", count(*) AS n FROM app WHERE created_at > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 56 DAY GROUP BY 1",
)
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return reports.weekly(domain.applications(spark, sf), at(ORDERS_AS_OF))


@query("a4_j1_applications_by_source", with_(APPLICATION, JOB) + "SELECT source, count(*) AS n FROM app JOIN job ON job.id = app.job_id GROUP BY source")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return reports.by_source(domain.applications(spark, sf), domain.job_postings(spark, sf))


@query(
    "a5_interview_rate",
    with_(APPLICATION) + "SELECT count(*) AS total, count(*) FILTER (status = 'INTERVIEW') AS interviews, CASE WHEN count(*) > 0 THEN CAST(floor(100.0 * count(*) FILTER (status = 'INTERVIEW') / count(*) + 0.5) AS BIGINT) ELSE 0 END AS interview_rate FROM app",
)
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return reports.totals(domain.applications(spark, sf))


@query(
    "a6_sources_in_order",
    with_(APPLICATION, JOB) + f"SELECT source, CAST(ordinal AS INT) AS ordinal FROM {SOURCE_ROWS} s WHERE source IN (SELECT source FROM job JOIN app ON app.job_id = job.id)",
)
def a6(spark: SparkSession, sf: str) -> DataFrame:
    mine = domain.applications(spark, sf).select(F.col("job_id").alias("id"))
    return reports.sources_in_order(domain.job_postings(spark, sf).join(mine, "id", "left_semi"))


OBSTACLES = [("a1", "CAPTCHA", "dateio.bamboohr.com", 1), ("a1", "CAPTCHA", "dateio.bamboohr.com", 2), ("a2", "CAPTCHA", "dateio.bamboohr.com", 3), ("a3", "LOGIN", "cocuma.cz", 4), ("b1", "CAPTCHA", "jobstack.it", 5), ("b1", "CAPTCHA", "jobstack.it", 6)]
ATTEMPTS = [("cocuma.cz", "a1"), ("cocuma.cz", "a2"), ("cocuma.cz", "a3"), ("jobstack.it", "b1"), ("jobstack.it", "b2"), ("quiet.cz", "c1"), ("", "d1")]


@query(
    "a7_obstacle_summary",
    values("host VARCHAR, attempts BIGINT, captchas BIGINT, logins BIGINT, blocker_host VARCHAR", [("cocuma.cz", 3, 2, 1, "dateio.bamboohr.com"), ("jobstack.it", 2, 1, 0, None), ("quiet.cz", 1, 0, 0, None)]),
)
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return reports.obstacle_summary(literal(spark, "host string, application_id string", ATTEMPTS), literal(spark, "application_id string, kind string, host string, seq int", OBSTACLES))


@query(
    "a11_j5_cross_listings",
    with_(JOB) + f"SELECT a.id, b.id AS other_id, b.source AS other_source, {stamp('b.first_seen_at')} AS other_seen FROM job a JOIN job b ON a.group_key = b.group_key AND a.id <> b.id AND b.expired_at IS NULL WHERE a.expired_at IS NOT NULL",
)
def a11(spark: SparkSession, sf: str) -> DataFrame:
    postings = domain.job_postings(spark, sf)
    gone = postings.filter("expired_at is not null").select("id")
    return joins.cross_listings(postings).join(gone, "id", "left_semi").select("id", "other_id", "other_source", moment("other_seen"))


@query(
    "a12_reference_counts",
    with_(JOB, APPLICATION, EVENT, FAVOURITE)
    + "SELECT job.id, coalesce(a.n, 0) AS applications, coalesce(f.n, 0) AS favourites FROM job LEFT JOIN (SELECT job_id, count(*) AS n FROM app GROUP BY 1) a ON a.job_id = job.id LEFT JOIN (SELECT job_id, count(*) AS n FROM fav GROUP BY 1) f ON f.job_id = job.id",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return reports.references(domain.job_postings(spark, sf), domain.applications(spark, sf), domain.favourites(spark, sf))


@query(
    "a16_mismatch_report",
    with_(JOB)
    + "SELECT coalesce(work_type, 'none') AS expected, CASE WHEN contains(lower(location), 'remote') THEN 'Remote' ELSE 'none' END AS actual, count(*) AS n FROM job WHERE coalesce(work_type, 'none') <> CASE WHEN contains(lower(location), 'remote') THEN 'Remote' ELSE 'none' END GROUP BY ALL",
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    hint = F.when(F.contains(F.lower("location"), F.lit("remote")), "Remote").otherwise("none")
    return reports.mismatches(domain.job_postings(spark, sf).select(F.coalesce("work_type", F.lit("none")).alias("expected"), hint.alias("actual")))


@query("a17_a18_hosts_and_stale", with_(JOB) + f"SELECT count(DISTINCT source) AS hosts, count(*) FILTER (scraped_at <= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS stale, count(*) AS n FROM job")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import host_of

    jobs = domain.job_postings(spark, sf)
    day = at(AS_OF) - F.make_dt_interval(F.lit(1))
    return jobs.agg(F.countDistinct(host_of("source_url")).alias("hosts"), F.count_if(F.col("scraped_at") <= day).alias("stale"), F.count("*").alias("n"))


CALENDAR = with_(JOB, APPLICATION, EVENT, INTERVIEW)


@query(
    "o9_o10_calendar_month",
    CALENDAR
    + """SELECT app.id, 'interview' AS "type", app.user_id, job.company AS title, job.title AS subtitle, strftime(iv.scheduled_at, '%Y-%m-%d %H:%M:%S') AS scheduled_at, duration_minutes
FROM iv JOIN app ON app.id = iv.application_id JOIN job ON job.id = app.job_id WHERE iv.scheduled_at >= TIMESTAMP '1998-10-01' - INTERVAL 1 DAY AND iv.scheduled_at < TIMESTAMP '1998-11-01' + INTERVAL 1 DAY
UNION ALL SELECT event_id, 'event', user_id, 'event ' || event_id, NULL, strftime(ts, '%Y-%m-%d %H:%M:%S'), 60 FROM ev WHERE kind = 'purchase' AND ts >= TIMESTAMP '1998-10-01' - INTERVAL 1 DAY AND ts < TIMESTAMP '1998-11-01' + INTERVAL 1 DAY""",
)
def o9(spark: SparkSession, sf: str) -> DataFrame:
    a, p = domain.applications(spark, sf), domain.job_postings(spark, sf)
    return reports.calendar(domain.interviews(spark, sf), domain.calendar_events(spark, sf), a, p, 1998, 10).withColumn("scheduled_at", moment("scheduled_at"))


@query(
    "a19_calendar_days",
    with_(EVENT)
    + """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg('event:' || event_id, ',' ORDER BY ts, event_id) AS entries, count(*) AS n, CAST((dayofweek(ts::DATE) + 6) % 7 AS INT) AS weekday
FROM ev WHERE kind = 'purchase' AND ts >= TIMESTAMP '2023-12-31' AND ts < TIMESTAMP '2024-02-02' GROUP BY user_id, ts::DATE, strftime(ts, '%Y-%m-%d')""",
)
def a19(spark: SparkSession, sf: str) -> DataFrame:
    a, p = domain.applications(spark, sf), domain.job_postings(spark, sf)
    own = domain.calendar_events(spark, sf)
    none = domain.interviews(spark, sf).filter("application_id < 0")
    return reports.by_day(reports.calendar(none, own, a, p, 2024, 1)).withColumn("day", F.col("day").cast("string"))


@query(
    "p16_status_tabs",
    with_(APPLICATION)
    + f"""SELECT 'ALL' AS status, CAST(-1 AS INT) AS ordinal, count(*) AS n FROM app WHERE user_id = {domain.USER}
UNION ALL SELECT * FROM (SELECT s.status, CAST(s.ordinal AS INT), count(app.id) AS n FROM {STATUS_ROWS} s LEFT JOIN app ON app.status = s.status AND app.user_id = {domain.USER} GROUP BY ALL) WHERE n > 0 OR status NOT IN ({', '.join(f"'{s}'" for s in HIDDEN_WHEN_EMPTY)})""",
)
def p16(spark: SparkSession, sf: str) -> DataFrame:
    return reports.status_tabs(domain.applications(spark, sf).filter(F.col("user_id") == domain.USER))


@query(
    "j2_applications_with_interviews",
    with_(APPLICATION, JOB, INTERVIEW)
    + f"SELECT app.id, app.user_id, job.title, job.company, job.source, app.status, {stamp('app.created_at')} AS created_at, {stamp('iv.scheduled_at')} AS scheduled_at FROM app JOIN job ON job.id = app.job_id LEFT JOIN iv ON iv.application_id = app.id",
)
def j2(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.applications_with_jobs(domain.applications(spark, sf), domain.job_postings(spark, sf), domain.interviews(spark, sf))
    return out.select("id", "user_id", "title", "company", "source", "status", moment("created_at"), moment("scheduled_at"))


@query("j3_favourited_postings", with_(EVENT, FAVOURITE, JOB) + "SELECT id, title FROM job WHERE id IN (SELECT job_id FROM fav)")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return joins.favourited(domain.job_postings(spark, sf), domain.favourites(spark, sf)).select("id", "title")


@query("j4_unreferenced_postings", with_(EVENT, FAVOURITE, JOB, APPLICATION) + "SELECT id, title FROM job WHERE id NOT IN (SELECT job_id FROM fav) AND id NOT IN (SELECT job_id FROM app WHERE job_id IS NOT NULL)")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    return joins.unreferenced(domain.job_postings(spark, sf), domain.applications(spark, sf), domain.favourites(spark, sf)).select("id", "title")


EARLIER = (
    with_(APPLICATION, JOB)
    + f""", made AS (SELECT a.*, j.group_key FROM app a JOIN job j ON j.id = a.job_id WHERE j.group_key IS NOT NULL AND a.status NOT IN ('REJECTED', 'FAILED') AND a.created_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 2000 DAY),
cand AS (SELECT DISTINCT m.user_id, j.id AS job_id, j.group_key FROM made m JOIN job j ON j.group_key = m.group_key),
ranked AS (SELECT c.user_id, c.job_id, m.id AS application_id, m.status, m.created_at, row_number() OVER (PARTITION BY c.user_id, c.job_id ORDER BY m.created_at, m.id) AS r FROM cand c JOIN made m ON m.user_id = c.user_id AND m.group_key = c.group_key AND m.job_id <> c.job_id),
earlier AS (SELECT * FROM ranked WHERE r = 1)
"""
)


def _applied_groups(spark: SparkSession, sf: str) -> DataFrame:
    return joins.applied_groups(domain.applications(spark, sf), domain.job_postings(spark, sf), at(ORDERS_AS_OF), 2000)


@query("j6_earlier_application_in_group", EARLIER + f"SELECT user_id, job_id, application_id, status, {stamp('created_at')} AS created_at FROM earlier")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    """Times are made text before rows multiply."""
    groups = joins.settled(_applied_groups(spark, sf))
    for c in ("first_created_at", "next_created_at"):
        groups = groups.withColumn(c, moment(c))
    return joins.earlier_application(joins.group_candidates(groups, domain.job_postings(spark, sf)))


@query(
    "k7_track_decision",
    EARLIER
    + """, held AS (SELECT DISTINCT user_id, job_id FROM app WHERE status NOT IN ('REJECTED', 'FAILED'))
SELECT c.user_id, c.job_id, h.job_id IS NULL AND e.job_id IS NULL AS tracked,
  CASE WHEN h.job_id IS NOT NULL THEN 'already tracked' WHEN e.status IN ('APPLIED', 'INTERVIEW', 'OFFER') THEN 'already applied elsewhere' WHEN e.job_id IS NOT NULL THEN 'on the dashboard elsewhere' END AS reason,
  h.job_id IS NULL AND e.job_id IS NOT NULL AS can_override
FROM cand c LEFT JOIN held h ON h.user_id = c.user_id AND h.job_id = c.job_id LEFT JOIN earlier e ON e.user_id = c.user_id AND e.job_id = c.job_id""",
)
def k7(spark: SparkSession, sf: str) -> DataFrame:
    groups = joins.decided(_applied_groups(spark, sf))
    return joins.track(joins.group_candidates(groups, domain.job_postings(spark, sf)))


@query(
    "j7_interviews_of_user",
    with_(APPLICATION, JOB, INTERVIEW) + f"SELECT app.user_id, iv.application_id, job.title, {stamp('iv.scheduled_at')} AS scheduled_at FROM iv JOIN app ON app.id = iv.application_id JOIN job ON job.id = app.job_id",
)
def j7(spark: SparkSession, sf: str) -> DataFrame:
    mine = domain.applications(spark, sf).select("user_id", F.col("id").alias("application_id"), "job_id")
    jobs = domain.job_postings(spark, sf).select(F.col("id").alias("job_id"), "title")
    return domain.interviews(spark, sf).join(mine, "application_id").join(jobs, "job_id").select("user_id", "application_id", "title", moment("scheduled_at"))


LABELS = {"JOBSCZ": "Jobs.cz", "WEB": "Web search", "ATS": "Company careers"}


@query(
    "j9_also_on",
    with_(JOB)
    + """SELECT a.id, list(CASE WHEN b.source = 'WEB' THEN 'web.example' WHEN b.source = 'JOBSCZ' THEN 'Jobs.cz' WHEN b.source = 'ATS' THEN 'Company careers' ELSE b.source END ORDER BY b.first_seen_at, b.id) AS boards
FROM job a JOIN job b ON a.group_key = b.group_key AND a.id <> b.id AND b.expired_at IS NULL AND (a.source <> b.source) GROUP BY a.id""",
)
def j9(spark: SparkSession, sf: str) -> DataFrame:
    return joins.also_on(domain.job_postings(spark, sf), LABELS)


@query(
    "f22_board_labels",
    values("source VARCHAR, label VARCHAR", [("JOBSCZ", "Jobs.cz"), ("WEB", "prace.cz"), ("WEB", "Web search"), ("JOOBLE", "JOOBLE")]),
)
def f22(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("JOBSCZ", "https://www.jobs.cz/rpd/1/"), ("WEB", "https://www.prace.cz/nabidka/x/"), ("WEB", "not a url"), ("JOOBLE", "https://cz.jooble.org/x")]
    return literal(spark, "source string, url string", rows).select("source", joins.board_label(F.col("source"), F.col("url"), LABELS).alias("label"))


@query(
    "j10_obstacles_of_host",
    with_(APPLICATION, JOB)
    + "SELECT job.source AS host, count(DISTINCT app.id) AS attempts, count(DISTINCT app.id) FILTER (app.id % 4 = 0) AS captchas, count(DISTINCT app.id) FILTER (app.id % 4 = 1) AS logins FROM app JOIN job ON job.id = app.job_id GROUP BY job.source",
)
def j10(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts by the host of their posting, with obstacles made of the applications' numbers."""
    from ..functions.text import host_of

    jobs = domain.job_postings(spark, sf).select(F.col("id").alias("job_id"), host_of("source_url").alias("host"))
    ran = domain.applications(spark, sf).join(jobs, "job_id").select("host", F.col("id").alias("application_id"))
    met = ran.filter("application_id % 4 < 2").select("application_id", F.when(F.col("application_id") % 4 == 0, "CAPTCHA").otherwise("LOGIN").alias("kind"), "host", F.col("application_id").alias("seq"))
    out = reports.obstacle_summary(ran, met)
    return out.select(F.upper(F.substring_index("host", ".", 1)).alias("host"), "attempts", "captchas", "logins")


@query("j12_p5_status_filter", with_(APPLICATION) + "SELECT id, status FROM app WHERE status = 'OFFER'")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    apps = domain.applications(spark, sf)
    return search.status_filter(search.status_filter(apps, "NO_SUCH_STATUS"), "OFFER").select("id", "status")


@query(
    "o11_o15_recent_applications",
    with_(APPLICATION) + f"SELECT id, user_id, status, {stamp('created_at')} AS created_at, substring(notes, 1, 8) AS notes FROM app ORDER BY app.created_at DESC, id LIMIT 50",
)
def o11(spark: SparkSession, sf: str) -> DataFrame:
    out = domain.applications(spark, sf).orderBy(F.desc("created_at"), "id").limit(50)
    return out.select("id", "user_id", "status", moment("created_at"), F.substring("notes", 1, 8).alias("notes"))


@query(
    "p17_local_month",
    with_(APPLICATION, INTERVIEW) + "SELECT application_id, strftime(scheduled_at + INTERVAL 2 HOUR, '%Y-%m') AS month FROM iv WHERE date_trunc('month', scheduled_at + INTERVAL 2 HOUR) = TIMESTAMP '1998-10-01'",
)
def p17(spark: SparkSession, sf: str) -> DataFrame:
    """Interviews in a month of a zone two hours ahead of UTC."""
    local = F.col("scheduled_at") + F.make_dt_interval(F.lit(0), F.lit(2))
    out = domain.interviews(spark, sf).select("application_id", F.date_format(local, "yyyy-MM").alias("month"))
    return out.filter("month = '1998-10'")
