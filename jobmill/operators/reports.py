"""Counts and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import HIDDEN_WHEN_EMPTY, SOURCES, STATUSES
from ..functions.text import js_round


def enum(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    """An enumeration as rows (name, ordinal)."""
    rows = F.array(*(F.struct(F.lit(v).alias(name), F.lit(k).alias("ordinal")) for k, v in enumerate(values)))
    return spark.range(1).select(F.inline(rows))


def by_status(applications: DataFrame) -> DataFrame:
    return applications.groupBy("status").agg(F.count("*").alias("n"))


def status_counts(applications: DataFrame) -> DataFrame:
    """A row for every status, also those that count nothing."""
    return enum(applications.sparkSession, STATUSES, "status").join(by_status(applications), "status", "left").select("status", "ordinal", F.coalesce("n", F.lit(0)).alias("n"))


def status_tabs(applications: DataFrame, active: str = "") -> DataFrame:
    """Tabs with their counts: all first, and no empty ones of the statuses that are hidden so, unless active."""
    counts = status_counts(applications)
    shown = counts.filter((F.col("n") > 0) | (F.col("status") == active) | ~F.col("status").isin(*HIDDEN_WHEN_EMPTY))
    everything = counts.agg(F.sum("n").alias("n")).select(F.lit("ALL").alias("status"), F.lit(-1).alias("ordinal"), "n")
    return everything.union(shown.select("status", "ordinal", "n"))


def weekly(applications: DataFrame, as_of: Column, weeks: int = 8) -> DataFrame:
    """Applications by the Monday of their week, made after `weeks` weeks ago; weeks without any are left out."""
    recent = applications.filter(F.col("created_at") > as_of - F.make_dt_interval(F.lit(7 * weeks)))
    return recent.groupBy(F.date_format(F.date_trunc("week", "created_at"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"))


def by_source(applications: DataFrame, postings: DataFrame) -> DataFrame:
    return applications.join(postings.select(F.col("id").alias("job_id"), "source"), "job_id").groupBy("source").agg(F.count("*").alias("n"))


def totals(applications: DataFrame) -> DataFrame:
    """One row: all applications and the share, in whole percent, that is in interview now; 0 of none."""
    counts = applications.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "INTERVIEW").alias("interviews"))
    rate = F.when(F.col("total") > 0, js_round(F.col("interviews") / F.col("total") * 100)).otherwise(0)
    return counts.select("total", "interviews", rate.cast("long").alias("interview_rate"))


def sources_in_order(postings: DataFrame) -> DataFrame:
    """The distinct sources of postings with their place in the enumeration."""
    return enum(postings.sparkSession, SOURCES, "source").join(postings.select("source").distinct(), "source", "left_semi")


def references(postings: DataFrame, applications: DataFrame, favourites: DataFrame) -> DataFrame:
    """(id, applications, favourites) of each posting: how many refer to it. Each side is counted before the join."""
    count = lambda df, name: df.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias(name))
    out = postings.select("id").join(count(applications, "applications"), "id", "left").join(count(favourites, "favourites"), "id", "left")
    return out.fillna(0, ["applications", "favourites"])


def obstacle_summary(attempts: DataFrame, obstacles: DataFrame) -> DataFrame:
    """(host, attempts, captchas, logins, blocker_host) of hosts with attempts (host, application_id).

    An obstacle (application_id, kind, host, seq) belongs to its application's host; applications count once a kind. The blocker is the host most
    often in the way, the first seen of equals, and null where it is the board itself or there is none.
    """
    tries = attempts.filter(F.coalesce("host", F.lit("")) != "").groupBy("host").agg(F.countDistinct("application_id").alias("attempts"))
    own = obstacles.withColumnRenamed("host", "at").join(attempts.select("host", "application_id").distinct(), "application_id")
    kinds = own.groupBy("host").agg(
        F.countDistinct(F.when(F.col("kind") == "CAPTCHA", F.col("application_id"))).alias("captchas"),
        F.countDistinct(F.when(F.col("kind") != "CAPTCHA", F.col("application_id"))).alias("logins"),
    )
    counts = own.groupBy("host", "at").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    blocker = counts.groupBy("host").agg(F.max_by("at", F.struct("n", -F.col("first"))).alias("blocker"))
    out = tries.join(kinds, "host", "left").join(blocker, "host", "left")
    cap = lambda c: F.least(F.col("attempts"), F.coalesce(c, F.lit(0)))
    return out.select("host", "attempts", cap("captchas").alias("captchas"), cap("logins").alias("logins"), F.nullif(F.col("blocker"), F.col("host")).alias("blocker_host"))


def calendar(interviews: DataFrame, events: DataFrame, applications: DataFrame, postings: DataFrame, year: int, month: int, pad_days: int = 1) -> DataFrame:
    """Interviews and own events of a month of UTC, padded so that it covers the month in every zone; half-open."""
    first = F.make_timestamp_ntz(F.lit(year), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    low, high = first - F.make_dt_interval(F.lit(pad_days)), first + F.make_ym_interval(F.lit(0), F.lit(1)) + F.make_dt_interval(F.lit(pad_days))
    inside = lambda df: df.filter((F.col("scheduled_at") >= low) & (F.col("scheduled_at") < high))
    a = applications.select(F.col("id").alias("application_id"), "user_id", "job_id")
    p = postings.select(F.col("id").alias("job_id"), F.col("company").alias("title"), F.col("title").alias("subtitle"))
    dates = inside(interviews).join(a, "application_id").join(p, "job_id")
    dates = dates.select(F.col("application_id").alias("id"), F.lit("interview").alias("type"), "user_id", "title", "subtitle", "scheduled_at", "duration_minutes")
    own = inside(events).select("id", F.lit("event").alias("type"), "user_id", "title", "scheduled_at", "duration_minutes")
    return dates.unionByName(own, allowMissingColumns=True)


def by_day(entries: DataFrame) -> DataFrame:
    """Entries of each user and day in their order, with the day's place in a week that begins on Monday."""
    day = F.to_date("scheduled_at")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("scheduled_at", "type", "id"))), lambda e: F.concat(e["type"], F.lit(":"), e["id"]))
    return entries.groupBy("user_id", day.alias("day")).agg(F.array_join(listed, ",").alias("entries"), F.count("*").alias("n")).withColumn(
        "weekday", F.pmod(F.dayofweek("day") + 5, F.lit(7))
    )


def mismatches(results: DataFrame) -> DataFrame:
    """How often an expected label came out as another, the most frequent first."""
    wrong = results.filter(~F.col("expected").eqNullSafe(F.col("actual")))
    return wrong.groupBy("expected", "actual").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "expected", "actual")


def earliest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
