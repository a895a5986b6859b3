import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobmill.operators import learning
from jobmill.sources import html
from jobmill.streaming import stateful


def samples(n: int):
    rng = np.random.default_rng(1)
    y = np.arange(n) % 2
    x = rng.normal(size=(n, 14)) * 0.1
    x[:, 1] += y
    return x, y.astype(float), np.ones(n)


def test_ranker_learns_what_is_liked():
    x, y, w = samples(20)
    m = learning.train_ranker(x, y, w)
    z = (x - np.array(m["mean"])) / np.array(m["std"])
    fit = 1 / (1 + np.exp(-(np.tanh(z @ np.array(m["hidden"]).T + m["bias"]) @ np.array(m["out"]) + m["shift"])))
    assert (fit[y == 1] > 0.8).all() and (fit[y == 0] < 0.2).all()


def test_users_side_by_side_learn_as_alone():
    """Also against the steps written out row by row."""
    users = [samples(n) for n in (20, 7, 9, 33)]
    together = learning.train_rankers(users)
    assert together[1] is None
    for (x, y, w), model in zip(users, together, strict=True):
        alone = learning.train_ranker(x, y, w)
        assert (alone is None) == (model is None)
        if model:
            for name in ("mean", "std", "hidden", "bias", "out", "shift"):
                assert np.allclose(model[name], alone[name], rtol=0, atol=1e-9)
    x, y, w = users[0]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    draw = learning._lcg(learning.SEED)
    hidden = np.array([[(next(draw) - 0.5) * 0.5 for _ in range(14)] for _ in range(learning.HIDDEN)])
    out, bias, shift = np.array([(next(draw) - 0.5) * 0.5 for _ in range(learning.HIDDEN)]), np.zeros(learning.HIDDEN), 0.0
    for _ in range(learning.EPOCHS):
        for row, label in zip(z, y, strict=True):
            h = np.tanh(hidden @ row + bias)
            g = 1 / (1 + np.exp(-(h @ out + shift))) - label
            back = g * out * (1 - h * h)
            out = out - learning.RATE * (g * h + learning.DECAY * out)
            hidden = hidden - learning.RATE * (np.outer(back, row) + learning.DECAY * hidden)
            bias, shift = bias - learning.RATE * back, shift - learning.RATE * g
    assert np.allclose(hidden, together[0]["hidden"], atol=1e-6) and np.allclose(out, together[0]["out"], atol=1e-6)


@pytest.mark.parametrize("n,positives", [(7, 4), (12, 2), (12, 10)])
def test_too_little_to_learn_from(n, positives):
    x, _, w = samples(n)
    assert learning.train_ranker(x, (np.arange(n) < positives).astype(float), w) is None


def test_prediction_in_expressions_equals_numpy(spark):
    x, y, w = samples(16)
    rows = [(1, k, x[k].tolist(), float(y[k]), 1.0) for k in range(16)]
    data = spark.createDataFrame(rows, "user_id long, job_id long, features array<double>, label double, weight double")
    model = learning.rankers(data)
    out = data.join(model.select(F.struct("mean", "std", "hidden", "bias", "out", "shift").alias("m"))).select("job_id", learning.predicted(F.col("features"), F.col("m")).alias("p"))
    m = learning.train_ranker(x, y, w)
    z = (x - np.array(m["mean"])) / np.array(m["std"])
    fit = 1 / (1 + np.exp(-(np.tanh(z @ np.array(m["hidden"]).T + m["bias"]) @ np.array(m["out"]) + m["shift"])))
    for r in out.collect():
        assert abs(r.p - fit[r.job_id]) < 1e-9


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 3, k, k % 4 < 2) for k in range(30)]
    schema = "key long, seq long, stale boolean"
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.on_stream(stream, stateful.emit_step, stateful.EMITTED, stateful.EMIT_STATE)
    q = out.writeStream.format("memory").queryName("emitted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("emitted").collect()))
    batch = stateful.in_batch(spark.createDataFrame(rows, schema), stateful.emit_step, stateful.EMITTED)
    assert got == sorted(map(tuple, batch.collect()))
    merged = {r.key: (r.seq, r.stale) for r in stateful.merged(spark.createDataFrame(rows, schema)).collect()}
    last = {}
    for key, seq, stale in got:
        last[key] = max(last.get(key, (-1, True)), (seq, stale))
    assert merged == last


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/abp \"'=&;!-\n", max_size=80))
def test_any_markup_parses(text):
    root = html.parse(text)
    assert isinstance(html.main_text(root), str) and isinstance(html.emails(root), list)


def test_rate_limit_counts_from_the_last_accepted_call():
    import pandas as pd

    rows = pd.DataFrame({"key": 1, "seq": range(4), "ms": [0, 9000, 12000, 21000]})
    _, out = stateful.limit_step(None, rows)
    assert [r[3] for r in out] == [True, False, True, False]


def test_every_user_with_enough_feedback_gets_a_ranker(spark, monkeypatch):
    from jobmill.plans import q_learn

    rows = [(user, k, [float(k == i) + user for i in range(3)], float(k % 2), 1.0) for user in (3, 8, 700) for k in range(8 if user != 3 else 7)]
    data = spark.createDataFrame(rows, "user_id long, job_id long, features array<double>, label double, weight double")
    monkeypatch.setattr(q_learn, "_samples", lambda spark, sf: data)
    assert sorted(r.user_id for r in q_learn.r14(spark, "").select("user_id").collect()) == [8, 700]


def test_samples_are_chosen_from_all_conversations(spark, tmp_path):
    from jobmill.plans import q_drafts

    turns = [(c, t, "assistant", "x") for c in (25, 300) for t in (0, 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r.conv_id, r.turn) for r in q_drafts.t11(spark, str(tmp_path)).collect()]
    assert len(got) == 3 and {(25, 0), (300, 0)} < set(got)
