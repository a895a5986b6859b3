"""The domain's tables, projected from the provided ones.

Reads keep to the columns that a view needs, so scans stay narrow. Time is an argument everywhere: AS_OF stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionaries import SOURCES, STATUSES

AS_OF = "2024-04-01 00:00:00"
BASE = "2024-01-01 00:00:00"
ORDERS_AS_OF = "2001-08-01 00:00:00"
USER = 7

TITLES = (
    "React developer",
    "Senior Python engineer",
    "Frontend developer (React)",
    "Data engineer",
    "DevOps engineer",
    "Junior QA tester",
    "Java backend developer",
    "Lead platform architect",
    "Medior Node.js developer",
    "Product designer",
)
PLACES = ("Praha, Česká republika", "Brno", "Remote", "Ostrava - hybrid", "Berlin, Germany", "Plzeň", "", "Olomouc", "Remote, Poland", "Kolín")
TEXTS = (
    "React TypeScript and GraphQL, home office possible",
    "Python, Django, PostgreSQL and Docker on AWS",
    "JavaScript, HTML, CSS and Next.js single-page applications",
    "Spark, Kafka, Airflow and SQL pipelines",
    "Kubernetes, Terraform and CI/CD",
    "Playwright, Cypress and manual testing",
    "Java, Spring Boot and MySQL microservices",
)


def at(c: Column | str) -> Column:
    """A literal time, or hours after BASE; without a zone, so sessions' zones do not matter."""
    if isinstance(c, str):
        return F.to_timestamp_ntz(F.lit(c))
    return F.to_timestamp_ntz(F.lit(BASE)) + F.make_dt_interval(F.lit(0), c.cast("int"))


def pick(values: tuple[str, ...], at_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(at_, F.lit(len(values))) + 1).cast("int"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def job_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings, one for each part."""
    k = F.col("p_partkey")
    price = (F.floor(F.col("p_retailprice")) * 40).cast("int")
    source = pick(SOURCES, k)
    return read(spark, sf_dir, "part").select(
        k.alias("id"),
        pick(TITLES, k).alias("title"),
        F.col("p_brand").alias("company"),
        F.nullif(pick(PLACES, F.col("p_size")), F.lit("")).alias("location"),
        F.concat(pick(TEXTS, F.floor(k / 3).cast("long")), F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_type")).alias("description"),
        source.alias("source"),
        F.concat(F.lit("https://www."), F.lower(source), F.lit(".example/job/"), k, F.lit("?utm_source=x&b=2&a="), k % 5).alias("source_url"),
        F.when(k % 3 != 0, F.concat(price, F.lit(" - "), price + 20000, F.lit(" Kč / měsíc"))).alias("salary"),
        F.when(k % 5 == 0, "Remote").when(k % 5 == 1, "Hybrid").when(k % 5 == 2, "Full office").alias("work_type"),
        F.lit("CZ").alias("country"),
        at(k % 2000).alias("first_seen_at"),
        at(k % 2000 + (k % 7) * 24).alias("scraped_at"),
        F.when(k % 4 != 0, at(k % 2000 - (k % 40) * 24)).alias("posted_at"),
        F.when(k % 11 == 0, at(k % 2000 + 240)).alias("expired_at"),
        F.when(k % 13 != 0, F.concat(F.col("p_brand"), F.lit("|"), pick(TITLES, k))).alias("group_key"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications, one for each order, to the posting of the order's first part; orders without a line have none."""
    parts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("job_id"))
    o = F.col("o_orderkey")
    return (
        read(spark, sf_dir, "orders")
        .join(parts, o == F.col("l_orderkey"), "left")
        .select(o.alias("id"), F.col("o_custkey").alias("user_id"), "job_id", pick(STATUSES, o).alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("notes"))
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users did with jobs: (event_id, user_id, job_id, kind, value, ts), the job from the event's properties."""
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("job_id"), F.col("event_type").alias("kind"), "value", "ts"
    )


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, job_id) of jobs that a user's clicks, each a toggle, leave favourite."""
    clicks = feedback_events(spark, sf_dir).filter("kind = 'click'")
    return clicks.groupBy("user_id", "job_id").agg((F.count("*") % 2).alias("odd")).filter("odd = 1").select("user_id", "job_id")


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interviews of applications in that status, a week after they were made."""
    a = applications(spark, sf_dir).filter("status = 'INTERVIEW'")
    return a.select(F.col("id").alias("application_id"), (F.col("created_at") + F.expr("INTERVAL 7 DAYS")).alias("scheduled_at"), (F.col("id") % 90).cast("int").alias("duration_minutes"))


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' own dates, from purchase events."""
    e = feedback_events(spark, sf_dir).filter("kind = 'purchase'")
    return e.select(F.col("event_id").alias("id"), "user_id", F.concat(F.lit("event "), "event_id").alias("title"), F.col("ts").alias("scheduled_at"), F.lit(60).alias("duration_minutes"))
