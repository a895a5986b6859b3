"""Steps of a crawl against plain loops, on streams and in batch, over nulls, repeats and empty tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobmill.functions import profile
from jobmill.operators import crawl, forms, learning
from jobmill.streaming import stateful

STEPS = {
    "emit": (stateful.emit_step, stateful.EMITTED, stateful.EMIT_STATE, "key long, seq long, stale boolean"),
    "breaker": (stateful.breaker_step, stateful.OUTCOME, stateful.OUTCOME_STATE, "key long, seq long, ms long, failed boolean"),
    "limit": (stateful.limit_step, stateful.ACCEPTED, stateful.ACCEPT_STATE, "key long, seq long, ms long"),
    "polite": (stateful.polite_step, stateful.STARTED, stateful.QUEUE_STATE, "key long, seq long, ms long, took long"),
    "flight": (stateful.flight_step, stateful.FLOWN, stateful.FLIGHT_STATE, "key long, seq long, ms long, took long"),
}


def calls(name, n=60):
    draw = random.Random(3)
    rows = []
    for seq in range(n):
        last = {"emit": (draw.random() < 0.5,), "breaker": (seq * 9_000, draw.random() < 0.8), "limit": (seq * 4_000,)}.get(name, (seq * 300, draw.randrange(0, 4_000)))
        rows.append((draw.choice([1, 1, 1, 2, 3]), seq, *last))
    return rows


@pytest.mark.parametrize("name", sorted(STEPS))
def test_stream_and_batch_are_the_step_over_each_key(spark, tmp_path, name):
    step, out, state, schema = STEPS[name]
    rows = calls(name)
    names = [part.split()[0] for part in schema.split(", ")]
    wanted = sorted(r for key in {r[0] for r in rows} for r in step(None, pd.DataFrame([x for x in rows if x[0] == key], columns=names))[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(tuple, stateful.in_batch(spark.createDataFrame(rows[::-1], schema), step, out).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == wanted
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.on_stream(stream, step, out, state).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table(name).collect())) == wanted


def test_framed_lines_on_a_stream(spark, tmp_path):
    lines = ['data: {"type": "job", "id": 1}', ": ping", 'data: {"ty', "", 'data: {"id": 2}', 'data: {"type": "end", "id": null}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    out = stateful.framed(spark.readStream.text(str(tmp_path / "in")), "type string, id long")
    q = out.writeStream.format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    wanted = [("end", None), ("job", 1)]
    assert sorted(map(tuple, spark.table("framed").collect())) == wanted
    assert sorted(map(tuple, stateful.framed(spark.createDataFrame([(x,) for x in [*lines, None]], "value string"), "type string, id long").collect())) == wanted


def test_polite_queue_never_holds_three_nor_hurries():
    rows = pd.DataFrame([(1, k, k * 120, 900 if k % 3 else 2_500) for k in range(50)], columns=["key", "seq", "ms", "took"])
    starts = [s for _, _, s in stateful.polite_step(None, rows)[1]]
    ends = [s + t for s, t in zip(starts, rows["took"], strict=True)]
    assert all(b - a >= 500 for a, b in zip(starts, starts[1:], strict=False))
    assert all(sum(starts[j] <= starts[k] < ends[j] for j in range(50)) <= 2 for k in range(50))


def test_keys_without_rows_and_without_a_name(spark):
    schema = "key long, seq long, ms long"
    assert stateful.in_batch(spark.createDataFrame([], schema), stateful.limit_step, stateful.ACCEPTED).count() == 0
    got = stateful.in_batch(spark.createDataFrame([(None, 1, 0), (None, 2, 5), (1, 3, 6)], schema), stateful.limit_step, stateful.ACCEPTED).collect()
    assert sorted((r.seq, r.accepted) for r in got) == [(1, True), (2, False), (3, True)]


def test_retries(spark):
    rows = [
        (1, 1, 200), (2, 1, None), (2, 2, 429), (2, 3, 503), (3, 1, 503), (3, 2, 404), (3, 3, 200), (4, 1, None), (4, 2, None), (4, 3, None),
        (5, 1, 429), (6, 1, 301), (6, 2, 200), (7, 1, None), (7, 2, 204), (7, 4, 500),
    ]
    out = {r.request: tuple(r)[1:] for r in crawl.retried(spark.createDataFrame(rows, "request int, n int, status int")).collect()}
    assert out == {
        1: (200, 1, 0, True), 2: (503, 3, 5_000, False), 3: (404, 2, 2_000, False), 4: (None, 3, 3_000, False),
        5: (429, 1, 2_000, False), 6: (301, 1, 0, False), 7: (204, 2, 1_000, True),
    }


def test_one_source_does_not_stop_another(spark):
    rows = [("a", 1, k, "stopped" if k == 6 else "lost" if k == 2 else None) for k in range(9)] + [("a", 2, 0, "stored"), ("b", 1, 1, "stored"), (None, 1, 1, "lost")]
    out = {r.source: tuple(r)[1:] for r in crawl.source_runs(spark.createDataFrame(rows, "source string, page int, position int, outcome string")).collect()}
    assert out == {"a": (5, 1, 2, True), "b": (1, 0, 1, False), None: (0, 1, 1, False)}


def test_embedding_goes_by_sixteen_and_gives_up_for_later(spark):
    texts = spark.createDataFrame([(k, None if k == 3 else "x" * k) for k in range(40)], "id long, text string").coalesce(1)

    def model(batch):
        if len(batch) > 16 or max(map(len, batch)) > 35:
            raise RuntimeError("too much")
        return [[len(t), len(batch)] for t in batch]

    got = {r.id: r.vector for r in learning.embedded(texts, model).collect()}
    assert got == {k: [0.0 if k == 3 else float(k), 16.0] for k in range(32)}
    cache = spark.createDataFrame([(k, "m") for k in got] + [(39, "other")], "id long, model string")
    assert sorted(r.id for r in learning.missing_vectors(texts, cache, "m").collect()) == list(range(32, 40))
    assert learning.embedded(texts.limit(0), model).count() == 0


def test_same_field_again(spark):
    schema = "form int, pos int, frame int, tag string, type string, name string, label string, placeholder string, aria_label string"
    old = [(1, 0, 0, "input", None, "mail", "A", None, None), (1, 1, 0, "input", None, "", "A", None, None), (1, 2, 0, "input", "text", "gone", "B", None, None), (1, 3, 1, "input", None, "mail", "A", None, None)]
    new = [(1, 5, 0, "input", None, "other", "A", None, None), (1, 6, 0, "input", None, None, "A", None, None), (1, 7, 0, "input", None, "mail", "Z", None, None), (2, 0, 1, "input", None, "mail", "A", None, None)]
    out = forms.relocated(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    # A name meets that name or a nameless field that says the same; a nameless field meets whatever says the same.
    assert {r.pos: r.now for r in out.collect()} == {0: 6, 1: 5, 2: None, 3: None}
    assert out.columns[:-1] == [part.split()[0] for part in schema.split(", ")]


def test_title_lines_keep_to_their_lengths(spark):
    edge = ["dev", "Lead", "Analyst " + "x" * 62, "Analyst " + "x" * 63, "* Tester", "Tester https://x", "Tester • QA", *(f"Engineer {k}" for k in range(9))]
    row = spark.createDataFrame([("\n".join(edge),)], "cv string").select(profile.title_lines("cv").alias("t")).first()
    assert row.t == ["Lead", "Analyst " + "x" * 62, "Engineer 0", "Engineer 1", "Engineer 2"]


@pytest.mark.parametrize("years,level", [(None, None), (1, "junior"), (2, "junior"), (3, "mid"), (6, "mid"), (7, "senior"), (45, "senior"), (46, None)])
def test_level_of_years(spark, years, level):
    said = f"{years} years of work" if years else "no figure"
    assert spark.range(1).select(profile.level_of_years(F.lit(said)).alias("x")).first().x == level
