"""Steps of a crawl over its logs and captures: retries, batches of details, runs of a source, pages of a listing, the refresh clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_or_empty

ATTEMPTS, THROTTLED = 3, (429, 503)
THROTTLED_MS, NETWORK_MS = 2_000, 1_000
BATCH, FULL_PAGE = 4, 10
FIRST_RUN, EVERY = 5, 180


def retried(attempts: DataFrame) -> DataFrame:
    """(request, status, tries, waited, ok) of attempts (request, n, status), n from 1 and status null where the network failed.

    A throttled or failed attempt is followed by a longer wait and another one, three attempts at most; any other answer is final.
    Later attempts don't count; a request whose log ends before it is settled has the last attempt's status.
    """
    status = F.col("status")
    good = status.between(200, 299)
    pause = F.when(status.isNull(), NETWORK_MS * F.col("n")).when(status.isin(*THROTTLED), THROTTLED_MS * F.col("n"))
    rows = attempts.filter(F.col("n").between(1, ATTEMPTS)).withColumn("final", (F.col("n") == ATTEMPTS) | pause.isNull())
    at = lambda n: (F.col("n") == n)
    pauses = [F.max(F.when(at(n) & ~F.col("final"), pause)).alias(f"pause_{n}") for n in range(1, ATTEMPTS)]
    last = F.coalesce(F.min(F.when(F.col("final"), F.col("n"))), F.max("n")).alias("tries")
    codes = [F.max(F.when(at(n), status)).alias(f"status_{n}") for n in range(1, ATTEMPTS + 1)]
    out = rows.groupBy("request").agg(last, *pauses, *codes)
    waits = (F.when(F.col("tries") >= n, F.coalesce(F.col(f"pause_{n}"), F.lit(0))).otherwise(0) for n in range(1, ATTEMPTS))
    said = F.coalesce(*(F.when(F.col("tries") == n, F.col(f"status_{n}")) for n in range(1, ATTEMPTS + 1)))
    return out.select("request", said.alias("status"), "tries", sum(waits, F.lit(0)).cast("long").alias("waited")).withColumn("ok", F.coalesce(F.col("status").between(200, 299), F.lit(False)))


def detail_batches(listings: DataFrame, size: int = BATCH) -> DataFrame:
    """listings (source, page, position, ...) with `batch`: details of a page are read so many at a time, in order."""
    place = F.row_number().over(Window.partitionBy("source", "page").orderBy("position"))
    return listings.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def source_runs(readings: DataFrame, size: int = BATCH) -> DataFrame:
    """(source, stored, lost, batches, failed) of readings (source, page, position, outcome).

    Sources run apart: one that stops ("stopped") keeps what it stored before, and no other source notices. A posting that can't be
    read ("lost") costs itself alone. `batches` counts the batches of details, page by page; nulls in outcome count as stored.
    """
    outcome = F.coalesce("outcome", F.lit("stored"))
    place = F.struct("page", "position")
    ends = readings.groupBy("source").agg(F.min(F.when(outcome == "stopped", place)).alias("end"))
    pages = readings.join(ends, readings["source"].eqNullSafe(ends["source"])).drop(ends["source"])
    reached = F.col("end").isNull() | (place < F.col("end"))
    count = lambda word: F.count_if(reached & (outcome == word)).alias(word)
    by_page = pages.groupBy("source", "page").agg(count("stored"), count("lost"), F.count_if(reached).alias("n"), F.bool_or(F.col("end").isNotNull()).alias("failed"))
    return by_page.groupBy("source").agg(F.sum("stored").alias("stored"), F.sum("lost").alias("lost"), F.sum(F.ceil(F.col("n") / size)).alias("batches"), F.bool_or("failed").alias("failed"))


def refresh_starts(runs: DataFrame, first: int = FIRST_RUN, every: int = EVERY) -> DataFrame:
    """runs (key, seq, took) with `started`: the minute each begins, on the clock first, first + every, ...; ticks during a run are left out."""
    ticks = F.greatest(F.lit(1), F.ceil(F.coalesce("took", F.lit(0)) / every))
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("started", (F.lit(first) + every * F.coalesce(F.sum(ticks).over(before), F.lit(0))).cast("long"))


def browsed(pages: DataFrame, matches: Column, full: int = FULL_PAGE) -> DataFrame:
    """The matching cards of pages (search, page, links, cards), each address once, first place first: (search, page, place, card fields).

    Reading stops behind the first page with fewer than `full` links; `matches` is a condition on the title.
    """
    last = pages.groupBy("search").agg(F.min(F.when(F.col("links") < full, F.col("page"))).alias("last"))
    read = pages.join(last, "search").filter(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    cards = read.select("search", "page", F.posexplode("cards").alias("place", "card")).select("search", "page", "place", "card.*").filter(matches)
    return first_by_place(cards, ["search", "url"], ["page", "place"])


def first_by_place(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """The first row of each key; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*place)).alias("row")).select(*keys, "row.*").select(*rows.columns)


def first_page_with_cards(pages: DataFrame, matches: Column) -> DataFrame:
    """The matching cards of the first page of each search that has any: pages (search, rank, allowed, cards).

    Pages are tried by rank; one that robots rules forbid ends the search.
    """
    cards = pages.select("search", "rank", F.posexplode("cards").alias("place", "card")).select("search", "rank", "place", "card.*").filter(matches)
    closed = pages.groupBy("search").agg(F.min(F.when(~F.coalesce("allowed", F.lit(False)), F.col("rank"))).alias("closed"))
    found = cards.groupBy("search").agg(F.min("rank").alias("rank"))
    chosen = found.join(closed, "search").filter(F.col("closed").isNull() | (F.col("rank") < F.col("closed"))).select("search", "rank")
    return cards.join(chosen, ["search", "rank"])


def described(listing: list[str], static: Column, rendered: Column) -> Column:
    """A posting's description: the page as served, else as rendered, else its main text, else its meta line, else the listing's own words.

    static and rendered are html.detail_of's structs, null where the page could not be read.
    """
    own = F.concat_ws(" — ", *(F.nullif(text_or_empty(c), F.lit("")) for c in listing))
    tried = (static["body"], rendered["body"], rendered["main"], static["meta"])
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in tried), own)
