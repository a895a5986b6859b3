"""The life of a posting: upserts, counters, toggles, expiry, purge. Tables are folded, not changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import references

KEPT_FIRST = ("id", "source", "first_seen_at")


def upsert(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Postings by source_url after an upsert of `new` (the same columns, in order of `seq`).

    New fields replace old ones; id, source and first_seen_at stay; scraped_at becomes now and expired_at null; an apply_path stays where the
    new row has none.
    """
    fields = [c for c in old.columns if c not in ("source_url", *KEPT_FIRST, "scraped_at", "expired_at", "apply_path", "seq")]
    both = old.withColumn("seq", F.lit(-1).cast("long")).withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)), allowMissingColumns=True)
    path = F.max_by("apply_path", F.when(F.col("apply_path").isNotNull(), F.col("seq")))
    out = both.groupBy("source_url").agg(
        *(F.min_by(c, "seq").alias(c) for c in KEPT_FIRST),
        *(F.max_by(c, "seq").alias(c) for c in fields),
        path.alias("apply_path"),
        F.max("fresh").alias("fresh"),
        F.min_by("scraped_at", "seq").alias("scraped_at"),
        F.min_by("expired_at", "seq").alias("expired_at"),
    )
    return out.withColumn("scraped_at", F.when(F.col("fresh"), now).otherwise(F.col("scraped_at"))).withColumn("expired_at", F.when(~F.col("fresh"), F.col("expired_at"))).drop("fresh")


def host_counters(visits: DataFrame) -> DataFrame:
    """(host, seen, last_seen_at); empty hosts are ignored."""
    return visits.filter(F.coalesce("host", F.lit("")) != "").groupBy("host").agg(F.count("*").alias("seen"), F.max("at").alias("last_seen_at"))


def toggled(log: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that an odd number of toggles leaves set."""
    return log.groupBy(*keys).agg((F.count("*") % 2).alias("odd")).filter("odd = 1").select(*keys)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: keyed writes as a view of their log."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def retire(gone: DataFrame, applications: DataFrame, favourites: DataFrame) -> DataFrame:
    """(id, outcome) of postings that are gone: removed without references, else expired."""
    refs = references(gone, applications, favourites)
    return refs.select("id", F.when((F.col("applications") == 0) & (F.col("favourites") == 0), "removed").otherwise("expired").alias("outcome"))


def refresh(stale_postings: DataFrame, fetched: DataFrame, applications: DataFrame, favourites: DataFrame) -> DataFrame:
    """(id, outcome) of a refresh run: fetched (id, status, found) tells what reading each posting gave; sources that can't be read give no row."""
    tried = stale_postings.select("id").join(fetched, "id", "left")
    gone = F.col("status").isin(404, 410) | ((F.col("status") == 200) & ~F.col("found"))
    retired = retire(tried.filter(gone).select("id"), applications, favourites).withColumnRenamed("outcome", "retired")
    outcome = F.when(F.col("status").isNull(), "skipped").when(gone, F.col("retired")).when(F.col("status") == 200, "updated").otherwise("failed")
    return tried.join(retired, "id", "left").select("id", outcome.alias("outcome"))


def report(outcomes: DataFrame) -> DataFrame:
    """One row of a refresh run's counts; checked counts skipped postings too."""
    return outcomes.agg(F.count("*").alias("checked"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("updated", "expired", "removed", "failed")))


def purgeable(postings: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    """Postings last scraped over `days` days ago."""
    return postings.filter(F.col("scraped_at") < as_of - F.make_dt_interval(F.lit(days)))


def swept(applications: DataFrame, live_ids: DataFrame) -> DataFrame:
    """Applications with runs that no process holds any more handed back: those in work become NEEDS_MANUAL."""
    out = applications.join(live_ids.select("id").distinct().withColumn("live", F.lit(True)), "id", "left")
    lost = F.col("status").isin("APPLYING", "WAITING_FOR_USER") & F.col("live").isNull()
    return out.withColumn("status", F.when(lost, "NEEDS_MANUAL").otherwise(F.col("status"))).drop("live")
