"""Lifecycle, deduplication and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl, joins, lifecycle, reports
from ..sources import domain
from ..sources.domain import AS_OF, at
from ..streaming import stateful
from .registry import query
from .views import APPLICATION, EVENT, FAVOURITE, JOB, stamp, with_


def _new_rows(jobs: DataFrame) -> DataFrame:
    """Re-read postings: every fifth one again with a new title, and as many unknown ones."""
    again = jobs.filter("id % 5 = 0").withColumn("title", F.concat("title", F.lit(" (new)"))).withColumn("source", F.lit("WEB")).withColumn("apply_path", F.when(F.col("id") % 2 == 0, F.lit("email")))
    unknown = jobs.filter("id % 5 = 1").withColumn("id", F.col("id") + 1_000_000).withColumn("source_url", F.concat("source_url", F.lit("&n=1"))).withColumn("apply_path", F.lit("ats-form"))
    rows = again.unionByName(unknown)
    return rows.withColumn("seq", F.col("id")).withColumn("scraped_at", at(AS_OF)).withColumn("first_seen_at", at(AS_OF)).withColumn("expired_at", F.lit(None).cast("timestamp_ntz"))


@query(
    "k1_upsert",
    with_(JOB)
    + f"""SELECT id, source, title, apply_path, {stamp('first_seen_at')} AS first_seen_at, {stamp('scraped_at')} AS scraped_at, expired_at IS NULL AS live FROM (
  SELECT id, source, CASE WHEN id % 5 = 0 THEN title || ' (new)' ELSE title END AS title, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 'email' ELSE 'board-form' END AS apply_path,
    first_seen_at, CASE WHEN id % 5 = 0 THEN TIMESTAMP '{AS_OF}' ELSE scraped_at END AS scraped_at, CASE WHEN id % 5 <> 0 THEN expired_at END AS expired_at FROM job
  UNION ALL SELECT id + 1000000, source, title, 'ats-form', TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}', NULL FROM job WHERE id % 5 = 1)""",
)
def k1(spark: SparkSession, sf: str) -> DataFrame:
    jobs = domain.job_postings(spark, sf).withColumn("apply_path", F.lit("board-form"))
    out = lifecycle.upsert(jobs, _new_rows(jobs), at(AS_OF))
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("id", "source", "title", "apply_path", moment("first_seen_at"), moment("scraped_at"), F.col("expired_at").isNull().alias("live"))


@query(
    "k2_host_counters",
    "SELECT host, count(*) AS seen, max(page_id) AS last_seen_at FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) WHERE host <> '' GROUP BY host",
)
def k2(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import host_of

    return lifecycle.host_counters(domain.read(spark, sf, "pages").select(host_of("url").alias("host"), F.col("page_id").alias("at")))


@query("k3_favourite_toggles", with_(EVENT, FAVOURITE) + "SELECT user_id, job_id FROM fav")
def k3(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.toggled(domain.feedback_events(spark, sf).filter("kind = 'click'"), ["user_id", "job_id"])


@query(
    "k4_k5_k6_k12_latest_wins",
    with_(EVENT) + "SELECT user_id, job_id, arg_max(kind, event_id) AS kind, arg_max(value, event_id) AS value FROM ev WHERE kind IN ('error', 'view') GROUP BY user_id, job_id",
)
def k4(spark: SparkSession, sf: str) -> DataFrame:
    log = domain.feedback_events(spark, sf).filter("kind in ('error', 'view')").select("user_id", "job_id", "event_id", "kind", "value")
    return lifecycle.latest(log, ["user_id", "job_id"], ["event_id"]).drop("event_id")


@query(
    "k8_scheduled_interviews",
    with_(APPLICATION) + "SELECT id, CASE WHEN id % 6 = 0 THEN 'INTERVIEW' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN id % 90 + 5 END AS duration FROM app",
)
def k8(spark: SparkSession, sf: str) -> DataFrame:
    """Scheduling sets the status and makes the interview in one step."""
    apps = domain.applications(spark, sf)
    scheduled = apps.filter("id % 6 = 0").select("id", (F.col("id") % 90 + 5).alias("duration"))
    out = apps.join(scheduled, "id", "left")
    return out.select("id", F.when(F.col("duration").isNotNull(), "INTERVIEW").otherwise(F.col("status")).alias("status"), "duration")


GONE = with_(JOB, APPLICATION, EVENT, FAVOURITE) + """, refs AS (SELECT job_id AS id FROM app WHERE job_id IS NOT NULL UNION SELECT job_id FROM fav),
fetched AS (SELECT id, CASE WHEN id % 5 = 0 THEN 404 WHEN id % 5 = 1 THEN 410 WHEN id % 5 = 2 THEN 500 ELSE 200 END AS status, id % 5 <> 3 AS found FROM job WHERE id % 6 <> 0),
tried AS (SELECT j.id, f.status, f.found, j.id IN (SELECT id FROM refs) AS kept FROM job j LEFT JOIN fetched f ON f.id = j.id WHERE j.expired_at IS NULL),
outcomes AS (SELECT id, CASE WHEN status IS NULL THEN 'skipped' WHEN status IN (404, 410) OR (status = 200 AND NOT found) THEN CASE WHEN kept THEN 'expired' ELSE 'removed' END WHEN status = 200 THEN 'updated' ELSE 'failed' END AS outcome FROM tried)
"""


def _refreshed(spark: SparkSession, sf: str) -> DataFrame:
    jobs = domain.job_postings(spark, sf)
    five = F.col("id") % 5
    fetched = jobs.filter("id % 6 <> 0").select("id", F.when(five == 0, 404).when(five == 1, 410).when(five == 2, 500).otherwise(200).alias("status"), (five != 3).alias("found"))
    return lifecycle.refresh(jobs.filter("expired_at is null"), fetched, domain.applications(spark, sf), domain.favourites(spark, sf))


@query("k9_w11_refresh_outcomes", GONE + "SELECT * FROM outcomes")
def k9(spark: SparkSession, sf: str) -> DataFrame:
    return _refreshed(spark, sf)


@query("a8_refresh_report", GONE + "SELECT count(*) AS checked, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("updated", "expired", "removed", "failed")) + " FROM outcomes")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.report(_refreshed(spark, sf))


@query("k10_purged_postings", GONE + f"SELECT id FROM job WHERE scraped_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND id NOT IN (SELECT id FROM refs)")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    old = lifecycle.purgeable(domain.job_postings(spark, sf), at(AS_OF))
    return joins.unreferenced(old, domain.applications(spark, sf), domain.favourites(spark, sf)).select("id")


@query("k11_swept_applications", with_(APPLICATION) + "SELECT id, CASE WHEN status IN ('APPLYING', 'WAITING_FOR_USER') AND id % 7 <> 0 THEN 'NEEDS_MANUAL' ELSE status END AS status FROM app")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    apps = domain.applications(spark, sf)
    return lifecycle.swept(apps, apps.filter("id % 7 = 0").select("id")).select("id", "status")


@query("k13_k14_event_lines", with_(EVENT) + """SELECT event_id, 'data: {"type":"' || kind || '","id":' || job_id || '}' AS line FROM ev""")
def k14(spark: SparkSession, sf: str) -> DataFrame:
    return domain.feedback_events(spark, sf).select("event_id", stateful.event_line(type=F.col("kind"), id=F.col("job_id")).alias("line"))


@query("w14_framed_lines", with_(EVENT) + "SELECT kind AS type, job_id AS id FROM ev WHERE event_id % 3 = 0")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    """Lines back to events; lines without the prefix and broken ones are skipped."""
    line = stateful.event_line(type=F.col("kind"), id=F.col("job_id"))
    three = F.col("event_id") % 3
    rows = domain.feedback_events(spark, sf).select(F.when(three == 0, line).when(three == 1, F.substring(line, 1, 12)).otherwise(F.concat(F.lit(": "), line)).alias("value"))
    return stateful.framed(rows, "type string, id long")


EMISSION = with_(EVENT) + """, e AS (SELECT job_id AS key, event_id AS seq, kind = 'view' AS stale FROM ev),
f AS (SELECT key, min(seq) AS first, arg_min(stale, seq) AS first_stale, min(seq) FILTER (NOT stale) AS fresh FROM e GROUP BY key)
"""


def _emissions(spark: SparkSession, sf: str) -> DataFrame:
    return domain.feedback_events(spark, sf).select(F.col("job_id").alias("key"), F.col("event_id").alias("seq"), (F.col("kind") == "view").alias("stale"))


@query(
    "w1_w2_emit_once",
    EMISSION + "SELECT key, first AS seq, first_stale AS stale FROM f UNION ALL SELECT key, fresh, false FROM f WHERE first_stale AND fresh IS NOT NULL",
)
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.emitted(_emissions(spark, sf))


@query("w3_merged_stream", EMISSION + "SELECT key, CASE WHEN first_stale AND fresh IS NOT NULL THEN fresh ELSE first END AS seq, first_stale AND fresh IS NULL AS stale FROM f")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.merged(_emissions(spark, sf))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1000).cast("long")
    return domain.feedback_events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), ms.alias("ms"), F.col("kind").isin("error", "click", "view").alias("failed"))


def _recursive(step: str, start: str, out: str) -> str:
    return (
        with_(EVENT).replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", i AS (SELECT user_id AS key, event_id AS seq, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, kind IN ('error', 'click', 'view') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM ev),
s AS (SELECT {start} FROM i WHERE r = 1 UNION ALL SELECT {step} FROM s JOIN i ON i.key = s.key AND i.r = s.r + 1)
SELECT {out} FROM s"""
    )


@query(
    "w4_circuit_breaker",
    _recursive(
        "i.key, i.seq, i.ms, i.r, CASE WHEN NOT i.failed THEN 0 WHEN s.failures + 1 >= 3 THEN 0 ELSE s.failures + 1 END, CASE WHEN NOT i.failed THEN 0 WHEN s.failures + 1 >= 3 THEN i.ms + 600000 ELSE s.paused_until END, i.ms < s.paused_until",
        "key, seq, ms, r, CASE WHEN failed THEN 1 ELSE 0 END AS failures, CAST(0 AS BIGINT) AS paused_until, false AS blocked",
        "key, seq, ms, CAST(failures AS INT) AS failures, paused_until, blocked",
    ),
)
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.in_batch(_outcomes(spark, sf), stateful.breaker_step, stateful.OUTCOME)


@query(
    "w5_rate_limit",
    _recursive(
        "i.key, i.seq, i.ms, i.r, CASE WHEN i.ms - s.last >= 10000 THEN i.ms ELSE s.last END, i.ms - s.last >= 10000",
        "key, seq, ms, r, ms AS last, true AS accepted",
        "key, seq, ms, accepted",
    ),
)
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return stateful.in_batch(_outcomes(spark, sf).drop("failed"), stateful.limit_step, stateful.ACCEPTED)


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    """Invented calls over the events: a call every 40 ms, up to seven seconds long."""
    return domain.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") * 40).alias("ms"), (F.col("event_id") * 37 % 7000).alias("took"))


def _recursive_calls(start: str, step: str, out: str) -> str:
    return f"""WITH RECURSIVE i AS (SELECT user_id AS key, event_id AS seq, event_id * 40 AS ms, event_id * 37 % 7000 AS took, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT {start} FROM i WHERE r = 1 UNION ALL SELECT {step} FROM s JOIN i ON i.key = s.key AND i.r = s.r + 1)
SELECT {out} FROM s"""


_BEGIN = "greatest(i.ms, s.one, s.started + 500)"


@query(
    "w6_polite_queues",
    _recursive_calls(
        "key, seq, r, ms AS started, CAST(0 AS BIGINT) AS one, ms + took AS other",
        f"i.key, i.seq, i.r, {_BEGIN}, least(s.other, {_BEGIN} + i.took), greatest(s.other, {_BEGIN} + i.took)",
        "key, seq, started",
    ),
)
def w6(spark: SparkSession, sf: str) -> DataFrame:
    """When each request of a host starts, with two at a time and half a second between starts."""
    return stateful.in_batch(_calls(spark, sf), stateful.polite_step, stateful.STARTED)


@query(
    "w13_single_flights",
    _recursive_calls(
        "key, seq, ms, r, ms + took AS until, true AS accepted",
        "i.key, i.seq, i.ms, i.r, CASE WHEN i.ms >= s.until THEN i.ms + i.took ELSE s.until END, i.ms >= s.until",
        "key, seq, ms, accepted",
    ),
)
def w13(spark: SparkSession, sf: str) -> DataFrame:
    """Which calls to learn start a run: none while the user's last run still goes on."""
    return stateful.in_batch(_calls(spark, sf), stateful.flight_step, stateful.FLOWN)


@query(
    "w7_retried_requests",
    """WITH a AS (SELECT event_id // 3 AS request, event_id % 3 + 1 AS n, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 429 WHEN 'purchase' THEN 404 WHEN 'signup' THEN 503 END AS status FROM events),
f AS (SELECT request, coalesce(min(n) FILTER (n = 3 OR status IN (200, 404)), max(n)) AS tries FROM a GROUP BY request)
SELECT a.request, CAST(max(a.status) FILTER (a.n = f.tries) AS INT) AS status, CAST(any_value(f.tries) AS INT) AS tries,
  CAST(coalesce(sum(CASE WHEN a.status IS NULL THEN 1000 * a.n ELSE 2000 * a.n END) FILTER (a.n < 3 AND (a.status IS NULL OR a.status IN (429, 503))), 0) AS BIGINT) AS waited, coalesce(max(a.status) FILTER (a.n = f.tries) = 200, false) AS ok
FROM a JOIN f ON f.request = a.request AND a.n <= f.tries GROUP BY a.request""",
)
def w7(spark: SparkSession, sf: str) -> DataFrame:
    """What became of each request, after how many attempts and how long a wait."""
    status = F.when(F.col("event_type") == "click", 200).when(F.col("event_type") == "view", 429).when(F.col("event_type") == "purchase", 404).when(F.col("event_type") == "signup", 503)
    log = domain.read(spark, sf, "events").select(F.floor(F.col("event_id") / 3).cast("long").alias("request"), (F.col("event_id") % 3 + 1).cast("int").alias("n"), status.alias("status"))
    return crawl.retried(log)


READING = "r AS (SELECT user_id % 12 AS source, event_id // 40 AS page, event_id AS position, CASE WHEN event_id % 997 = 996 THEN 'stopped' WHEN event_type = 'error' THEN 'lost' ELSE 'stored' END AS outcome FROM events)"


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("event_id") % 997 == 996, "stopped").when(F.col("event_type") == "error", "lost").otherwise("stored")
    return domain.read(spark, sf, "events").select((F.col("user_id") % 12).alias("source"), F.floor(F.col("event_id") / 40).cast("long").alias("page"), F.col("event_id").alias("position"), outcome.alias("outcome"))


@query(
    "w8_source_runs",
    f"""WITH {READING}, e AS (SELECT source, min(position) FILTER (outcome = 'stopped') AS stop FROM r GROUP BY source),
p AS (SELECT r.*, e.stop, e.stop IS NULL OR position < e.stop AS reached FROM r JOIN e USING (source)),
b AS (SELECT source, stop, page, count(*) FILTER (reached AND outcome = 'stored') AS stored, count(*) FILTER (reached AND outcome = 'lost') AS lost, CAST(ceil(count(*) FILTER (reached) / 4) AS BIGINT) AS batches FROM p GROUP BY ALL)
SELECT source, CAST(sum(stored) AS BIGINT) AS stored, CAST(sum(lost) AS BIGINT) AS lost, CAST(sum(batches) AS BIGINT) AS batches, bool_or(stop IS NOT NULL) AS failed FROM b GROUP BY source""",
)
def w8(spark: SparkSession, sf: str) -> DataFrame:
    """What each source's run stored and lost, and whether it broke off."""
    return crawl.source_runs(_readings(spark, sf))


@query("w8_detail_batches", f"WITH {READING} SELECT source, page, position, CAST((row_number() OVER (PARTITION BY source, page ORDER BY position) - 1) // 4 AS BIGINT) AS batch FROM r")
def w8_batches(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.detail_batches(_readings(spark, sf).drop("outcome"))


@query(
    "w10_refresh_starts",
    "SELECT user_id AS key, event_id AS seq, CAST(5 + 180 * coalesce(sum(greatest(1, ceil((event_id * 37 % 700) / 180))) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS started FROM events",
)
def w10(spark: SparkSession, sf: str) -> DataFrame:
    """When each refresh begins if it takes as long as told: every three hours, later where one runs over."""
    runs = domain.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 700).alias("took"))
    return crawl.refresh_starts(runs).select("key", "seq", "started")


@query("o4_unjudged_first_ten", with_(JOB, EVENT) + "SELECT id FROM job WHERE id NOT IN (SELECT job_id FROM ev WHERE kind = 'view' AND user_id = " + str(domain.USER) + ") ORDER BY id LIMIT 10")
def o4(spark: SparkSession, sf: str) -> DataFrame:
    judged = domain.feedback_events(spark, sf).filter((F.col("kind") == "view") & (F.col("user_id") == domain.USER)).select(F.col("job_id").alias("id"))
    return domain.job_postings(spark, sf).join(judged, "id", "left_anti").orderBy("id").limit(10).select("id")


@query("o5_first_place_last_value", with_(EVENT) + "SELECT job_id AS key, min(event_id) AS place, arg_max(value, event_id) AS value FROM ev GROUP BY job_id")
def o5(spark: SparkSession, sf: str) -> DataFrame:
    return domain.feedback_events(spark, sf).groupBy(F.col("job_id").alias("key")).agg(F.min("event_id").alias("place"), F.max_by("value", "event_id").alias("value"))


@query("o6_keep_first", with_(EVENT) + "SELECT job_id AS key, event_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id) = 1")
def o6(spark: SparkSession, sf: str) -> DataFrame:
    return reports.earliest(domain.feedback_events(spark, sf).select(F.col("job_id").alias("key"), "event_id", "value"), ["key"], [F.col("event_id")])


@query(
    "o7_two_key_dedupe",
    with_(EVENT) + ", once AS (SELECT * FROM ev WHERE kind <> 'signup' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id) = 1) SELECT event_id, job_id, user_id FROM once QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
)
def o7(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a filter drops are not seen by either key."""
    good = domain.feedback_events(spark, sf).filter("kind <> 'signup'")
    return reports.earliest(reports.earliest(good, ["job_id"], [F.col("event_id")]), ["user_id"], [F.col("event_id")]).select("event_id", "job_id", "user_id")


@query("o8_distinct_in_order", with_(EVENT) + ", g AS (SELECT user_id, job_id, min(event_id) AS first FROM ev GROUP BY user_id, job_id) SELECT user_id, array_to_string(list(job_id ORDER BY first), ',') AS jobs FROM g GROUP BY user_id")
def o8(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain.feedback_events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "job_id"))).alias("all"))
    return rows.select("user_id", F.array_join(F.array_distinct(F.transform("all", lambda e: e["job_id"])), ",").alias("jobs"))


@query("o12_first_match_wins", with_(EVENT) + "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN kind = 'view' THEN 'seen' WHEN user_id % 2 = 0 THEN 'even' ELSE 'other' END AS rule FROM ev")
def o12(spark: SparkSession, sf: str) -> DataFrame:
    rule = F.when(F.col("value") > 100, "high").when(F.col("kind") == "view", "seen").when(F.col("user_id") % 2 == 0, "even").otherwise("other")
    return domain.feedback_events(spark, sf).select("event_id", rule.alias("rule"))


@query(
    "o13_paging_stops",
    with_(JOB) + f", pages AS (SELECT id // 25 AS page, bool_and(scraped_at > TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY) AS fresh FROM job GROUP BY 1) SELECT page FROM pages WHERE page <= coalesce((SELECT min(page) FROM pages WHERE fresh), 1000000)",
)
def o13(spark: SparkSession, sf: str) -> DataFrame:
    """The pages that an incremental read takes: up to the first one that is fresh as a whole."""
    page = F.floor(F.col("id") / 25).cast("long")
    day = at(AS_OF) - F.make_dt_interval(F.lit(5))
    pages = domain.job_postings(spark, sf).groupBy(page.alias("page")).agg(F.bool_and(F.col("scraped_at") > day).alias("fresh"))
    last = pages.filter("fresh").agg(F.coalesce(F.min("page"), F.lit(1_000_000)).alias("last"))
    return pages.join(F.broadcast(last), F.col("page") <= F.col("last")).select("page")


@query("p15_owned_rows", with_(APPLICATION) + f"SELECT id, status FROM app WHERE user_id = {domain.USER} AND id IN (SELECT id FROM app WHERE id % 2 = 0 OR user_id = {domain.USER})")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    """What a user may see: every read and write of a user's rows goes through the owner's id."""
    return domain.applications(spark, sf).filter(F.col("user_id") == domain.USER).select("id", "status")


@query(
    "w9_progress",
    with_(EVENT) + "SELECT user_id, count(*) FILTER (kind = 'purchase') AS done, count(*) AS total, CAST(floor(100.0 * count(*) FILTER (kind = 'purchase') / count(*) + 0.5) AS BIGINT) AS percent, count(DISTINCT CASE WHEN kind = 'error' THEN job_id END) AS reasons FROM ev GROUP BY user_id",
)
def w9(spark: SparkSession, sf: str) -> DataFrame:
    """How far each run has come, and how many different reasons it gave for skipping."""
    from ..functions.text import js_round

    done = F.count_if(F.col("kind") == "purchase")
    out = domain.feedback_events(spark, sf).groupBy("user_id").agg(done.alias("done"), F.count("*").alias("total"), F.countDistinct(F.when(F.col("kind") == "error", F.col("job_id"))).alias("reasons"))
    return out.withColumn("percent", js_round(F.col("done") / F.col("total") * 100).cast("long"))


STEPS = {"view": "PENDING", "click": "APPLYING", "error": "WAITING_FOR_USER", "purchase": "APPLIED"}


@query(
    "w12_application_states",
    with_(EVENT)
    + """, s AS (SELECT user_id, job_id, event_id, ts, CASE kind WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'APPLYING' WHEN 'error' THEN 'WAITING_FOR_USER' ELSE 'APPLIED' END AS status FROM ev WHERE kind <> 'signup'),
l AS (SELECT user_id, job_id, arg_max(status, event_id) AS status, arg_max(ts, event_id) AS ts FROM s GROUP BY user_id, job_id)
SELECT user_id, job_id, CASE WHEN status = 'WAITING_FOR_USER' AND ts < TIMESTAMP '2024-01-10' THEN 'NEEDS_MANUAL' ELSE status END AS status FROM l""",
)
def w12(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each application from its log; a wait for the user that lasts too long ends in manual work."""
    steps = F.create_map(*(F.lit(x) for pair in STEPS.items() for x in pair))
    log = domain.feedback_events(spark, sf).filter("kind <> 'signup'").select("user_id", "job_id", "event_id", "ts", F.element_at(steps, F.col("kind")).alias("status"))
    now = lifecycle.latest(log, ["user_id", "job_id"], ["event_id"])
    late = (F.col("status") == "WAITING_FOR_USER") & (F.col("ts") < at("2024-01-10 00:00:00"))
    return now.select("user_id", "job_id", F.when(late, "NEEDS_MANUAL").otherwise(F.col("status")).alias("status"))


@query("k15_new_samples", "SELECT min(conv_id * 100 + turn) AS first, md5(text) AS text FROM conversations GROUP BY text")
def k15(spark: SparkSession, sf: str) -> DataFrame:
    """Samples are kept once a text, the first one."""
    rows = domain.read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("first"), "text")
    return rows.groupBy("text").agg(F.min("first").alias("first")).select("first", F.md5("text").alias("text"))


@query("p18_evidence_files", "SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages WHERE regexp_matches(regexp_extract(url, '[^/]*$'), '^[A-Za-z0-9_.-]+$')")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    """Names that are safe to serve."""
    name = F.regexp_extract("url", "[^/]*$", 0)
    return domain.read(spark, sf, "pages").select("page_id", name.alias("name")).filter(F.rlike("name", F.lit("^[A-Za-z0-9_.-]+$")))


@query("p10_thresholds", with_(JOB) + "SELECT count(*) FILTER (p >= 0.3) AS kept, count(*) FILTER (p >= 0.3 AND q >= 0.3) AS kept_after FROM (SELECT (id % 100) / 100.0 AS p, (id % 100) / 100.0 * 0.7 + (id % 7) / 7.0 * 0.3 AS q FROM job)")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    """A threshold before the ranker spares its work, and one after it decides."""
    p = (F.col("id") % 100) / F.lit(100.0)
    q = p * 0.7 + (F.col("id") % 7) / F.lit(7.0) * 0.3
    return domain.job_postings(spark, sf).select(p.alias("p"), q.alias("q")).agg(F.count_if(F.col("p") >= 0.3).alias("kept"), F.count_if((F.col("p") >= 0.3) & (F.col("q") >= 0.3)).alias("kept_after"))
