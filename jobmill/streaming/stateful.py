"""Keyed state on streams: emit once, circuit breaker, rate limit, polite queues, single flights, framed lines; each with a batch form of the same step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAUSE_AFTER, PAUSE_MS = 3, 600_000
GAP_MS = 10_000
SLOTS_GAP_MS = 500

EMITTED = "key long, seq long, stale boolean"
EMIT_STATE = "stale int"
OUTCOME = "key long, seq long, ms long, failures int, paused_until long, blocked boolean"
OUTCOME_STATE = "failures int, until long"
ACCEPTED = "key long, seq long, ms long, accepted boolean"
ACCEPT_STATE = "last long"
STARTED = "key long, seq long, started long"
QUEUE_STATE = "one long, other long, allowed long"
FLOWN = "key long, seq long, ms long, accepted boolean"
FLIGHT_STATE = "until long"


def emit_step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
    """Emits a key's first row, and once more the first fresh one after a stale one; rows (key, seq, stale) come in order."""
    out = []
    for row in rows.itertuples():
        if state is None or (state[0] == 1 and not row.stale):
            state = (int(row.stale),)
            out.append((row.key, row.seq, bool(row.stale)))
    return state, out


def breaker_step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
    """Three failures in a row pause a source for ten minutes, a success ends pause and count; rows (key, seq, ms, failed)."""
    failures, until = state or (0, 0)
    out = []
    for row in rows.itertuples():
        blocked = row.ms < until
        if row.failed:
            failures += 1
            if failures >= PAUSE_AFTER:
                failures, until = 0, row.ms + PAUSE_MS
        else:
            failures = until = 0
        out.append((row.key, row.seq, row.ms, failures, until, blocked))
    return (failures, until), out


def limit_step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
    """Accepts a call ten seconds or more after the last accepted one; refused calls do not move the clock. rows (key, seq, ms)."""
    last = state[0] if state else None
    out = []
    for row in rows.itertuples():
        good = last is None or row.ms - last >= GAP_MS
        last = row.ms if good else last
        out.append((row.key, row.seq, row.ms, good))
    return (last,), out


def polite_step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
    """Two requests of a host at most at the same time, half a second at least between two starts; rows (key, seq, ms, took) in the order they queue."""
    one, other, allowed = state or (0, 0, 0)
    out = []
    for row in rows.itertuples():
        start = max(row.ms, min(one, other), allowed)
        one, other, allowed = max(one, other), start + row.took, start + SLOTS_GAP_MS
        out.append((row.key, row.seq, start))
    return (one, other, allowed), out


def flight_step(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
    """One flight of a key at a time: a call during a flight is dropped, not queued. rows (key, seq, ms, took)."""
    until = state[0] if state else None
    out = []
    for row in rows.itertuples():
        free = until is None or row.ms >= until
        until = row.ms + row.took if free else until
        out.append((row.key, row.seq, row.ms, free))
    return (until,), out


Step = Callable[[tuple | None, pd.DataFrame], tuple[tuple | None, list[tuple]]]


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def in_batch(rows: DataFrame, step: Step, schema: str) -> DataFrame:
    """A step over all rows of each key in the order of seq; rows come sorted and in Arrow batches, so that a key of any size holds one batch in memory."""
    names = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for batch in batches:
            out: list[tuple] = []
            for key, part in batch.groupby("key", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                state, made = step(state if key == last else None, part)
                last = key
                out += made
            yield pd.DataFrame(out, columns=names)

    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, schema)


def on_stream(rows: DataFrame, step: Step, schema: str, state_schema: str) -> DataFrame:
    """The same step on a stream: each trigger's rows of a key in the order of seq, the state kept between triggers."""
    names = _names(schema)

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(groups)).sort_values("seq")
        now, out = step(state.get if state.exists else None, group)
        if now is not None:
            state.update(now)
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("key").applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def emitted(items: DataFrame) -> DataFrame:
    """emit_step over a whole table, as a fold: each key's first row, and the first fresh one if a stale one came first."""
    first = items.groupBy("key").agg(F.min(F.struct("seq", "stale")).alias("first"), F.min(F.when(~F.col("stale"), F.col("seq"))).alias("fresh"))
    again = F.when(F.col("first.stale") & F.col("fresh").isNotNull(), F.struct(F.col("fresh").alias("seq"), F.lit(False).alias("stale")))
    return first.select("key", F.inline(F.array_compact(F.array("first", again))))


def merged(items: DataFrame) -> DataFrame:
    """One row (key, seq, stale) for each key: the first fresh one if a stale one came first, else the first."""
    first = items.groupBy("key").agg(F.min(F.struct("seq", "stale")).alias("first"), F.min(F.when(~F.col("stale"), F.col("seq"))).alias("fresh"))
    upgraded = F.col("first.stale") & F.col("fresh").isNotNull()
    return first.select("key", F.when(upgraded, F.col("fresh")).otherwise(F.col("first.seq")).alias("seq"), (F.col("first.stale") & ~upgraded).alias("stale"))


def framed(lines: DataFrame, schema: str) -> DataFrame:
    """The events of a stream or table of text lines (value): those that begin with "data: " and hold JSON; others are skipped."""
    body = F.when(F.startswith("value", F.lit("data: ")), F.substring("value", 7, 2_000_000_000))
    return lines.select(F.from_json(body, schema).alias("event")).filter("event is not null and event.type is not null").select("event.*")


def event_line(**fields: Column) -> Column:
    """An event as a framed line."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*(c.alias(name) for name, c in fields.items()))))


def weekly_counts(events: DataFrame, ts: str, late: str = "2 days") -> DataFrame:
    """Counts by week on a stream, with a watermark: an addition to the batch report."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "n")
