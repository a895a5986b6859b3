"""Learning from feedback: labels, the ranker, similarity, blending."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import DISMISSED_WEIGHT, FAVOURITE_WEIGHT, JUDGED_WEIGHT, STATUS_WEIGHTS
from ..functions.text import js_round

HIDDEN, EPOCHS, RATE, DECAY, SEED = 6, 400, 0.05, 0.001, 7
LEAST, LEAST_OF_A_CLASS, FLOOR = 8, 3, 1e-6


def labels(favourites: DataFrame, applications: DataFrame, feedback: DataFrame) -> DataFrame:
    """(user_id, job_id, label, weight): the heaviest signal of each user and job, the first kind of equals.

    favourites (user_id, job_id); applications (user_id, job_id, status); feedback (user_id, job_id, signal, score), DISMISSED or
    MODEL_JUDGED with a score. Statuses without a weight count as favourites do; judgements without a score are no signal.
    """
    weights = F.create_map(*(F.lit(x) for pair in STATUS_WEIGHTS.items() for x in pair))
    one = lambda label, weight, kind: (label.cast("double").alias("label"), weight.cast("double").alias("weight"), F.lit(kind).alias("kind"))
    a = favourites.select("user_id", "job_id", *one(F.lit(1), F.lit(FAVOURITE_WEIGHT), 0))
    b = applications.filter("job_id is not null").select("user_id", "job_id", *one(F.lit(1), F.coalesce(F.try_element_at(weights, "status"), F.lit(FAVOURITE_WEIGHT)), 1))
    dismissed = F.col("signal") == "DISMISSED"
    c = feedback.filter(dismissed | F.col("score").isNotNull()).select(
        "user_id", "job_id", *one(F.when(dismissed, 0.0).otherwise(F.col("score")), F.when(dismissed, DISMISSED_WEIGHT).otherwise(JUDGED_WEIGHT), 2)
    )
    best = F.max_by(F.struct("label", "weight"), F.struct("weight", -F.col("kind"), "label"))
    return a.union(b).union(c).groupBy("user_id", "job_id").agg(best.alias("best")).select("user_id", "job_id", "best.*")


BATCH = 16


def missing_vectors(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The texts (id, ...) that have no vector of this model in the cache (id, model, ...)."""
    return texts.join(cache.filter(F.col("model") == model).select("id"), "id", "left_anti")


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """(id, vector) of texts (id, text), `batch` texts to a call of the model.

    A call that fails leaves its texts and those behind it in the same task without a row; they are missing in the cache still, so the
    next run asks again. A null text is embedded as an empty one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    vectors = embed([t or "" for t in part["text"]])
                except Exception:  # noqa: BLE001 - the model is the caller's, any failure of it means later
                    return
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": [list(map(float, v)) for v in vectors]})

    return texts.select(F.col("id").cast("long").alias("id"), "text").mapInPandas(run, "id long, vector array<double>")


def trainable(samples: DataFrame) -> DataFrame:
    """(user_id, samples, positives, trainable) of labelled rows."""
    out = samples.groupBy("user_id").agg(F.count("*").alias("samples"), F.count_if(F.col("label") >= 0.5).alias("positives"))
    n, p = F.col("samples"), F.col("positives")
    return out.withColumn("trainable", (n >= LEAST) & (p >= LEAST_OF_A_CLASS) & (n - p >= LEAST_OF_A_CLASS))


def feature_stats(samples: DataFrame, width: int) -> DataFrame:
    """Mean and population deviation, FLOOR at least, of each place of `features`."""
    values = samples.select(F.posexplode("features").alias("place", "value")).filter(F.col("place") < width)
    return values.groupBy("place").agg(F.avg("value").alias("mean"), F.greatest(F.lit(FLOOR), F.stddev_pop("value")).alias("std"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty vectors, vectors of different length and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def centroid(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean vector of each key, place by place."""
    parts = vectors.select(*keys, F.posexplode(vector).alias("place", "value")).groupBy(*keys, "place").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda p: p["value"]).alias("centroid"))


def guard_threshold(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, threshold): the mean similarity of each vector to the centroid of the others, less a margin, between 0.5 and 0.85.

    The others' centroid comes from sums, so a pool costs as many rows as it has vectors.
    """
    middle = centroid(vectors, keys, vector)
    n = vectors.groupBy(*keys).agg(F.count("*").alias("n"))
    rest = lambda c, v, k: (c * k - v.cast("double")) / (k - 1)
    joined = vectors.join(middle, keys).join(n, keys)
    others = F.zip_with("centroid", vector, lambda c, v: rest(c, v, F.col("n")))
    loo = joined.filter("n > 1").select(*keys, "n", cosine(F.col(vector).cast("array<double>"), others).alias("s")).groupBy(*keys, "n").agg(F.avg("s").alias("mean"))
    margin = F.lit(0.08) + F.when(F.col("n") < 10, 0.05).otherwise(0.0)
    found = loo.select(*keys, F.least(F.lit(0.85), F.greatest(F.lit(0.5), F.col("mean") - margin)).alias("threshold"))
    return n.join(found, keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def _lcg(seed: int):
    state = seed
    while True:
        state = (state * 1664525 + 1013904223) % 2**32
        yield state / 2**32


def train_rankers(users: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[dict[str, list] | None]:
    """A network of HIDDEN tanh units and a sigmoid for each user's (features, labels, weights), by weighted gradient steps row after row; None where there is too little to learn from.

    Steps of one user follow each other, so users take theirs side by side: longer histories first, and a user stops when the rows of an epoch are through.
    """
    made: list[dict[str, list] | None] = [None] * len(users)
    counts = [(len(y), int((y >= 0.5).sum())) for _, y, _ in users]
    able = [k for k, (n, p) in enumerate(counts) if n >= LEAST and p >= LEAST_OF_A_CLASS and n - p >= LEAST_OF_A_CLASS]
    able.sort(key=lambda k: -counts[k][0])
    if not able:
        return made
    sizes = np.array([counts[k][0] for k in able])
    width = users[able[0]][0].shape[1]
    means = [users[k][0].mean(axis=0) for k in able]
    stds = [np.maximum(FLOOR, users[k][0].std(axis=0)) for k in able]
    z, y, scale = np.zeros((len(able), sizes[0], width)), np.zeros((len(able), sizes[0])), np.zeros((len(able), sizes[0]))
    for u, k in enumerate(able):
        x, label, weight = users[k]
        z[u, : len(x)], y[u, : len(x)], scale[u, : len(x)] = (x - means[u]) / stds[u], label, weight * len(label) / weight.sum()
    draw = _lcg(SEED)
    first = np.array([[(next(draw) - 0.5) * 0.5 for _ in range(width)] for _ in range(HIDDEN)])
    last = np.array([(next(draw) - 0.5) * 0.5 for _ in range(HIDDEN)])
    hidden, out = np.tile(first, (len(able), 1, 1)), np.tile(last, (len(able), 1))
    bias, shift = np.zeros((len(able), HIDDEN)), np.zeros(len(able))
    active = [int((sizes > r).sum()) for r in range(sizes[0])]
    for _ in range(EPOCHS):
        for r, u in enumerate(active):
            row = z[:u, r]
            h = np.tanh((hidden[:u] @ row[:, :, None])[:, :, 0] + bias[:u])
            g = (1 / (1 + np.exp(-((h * out[:u]).sum(axis=1) + shift[:u]))) - y[:u, r]) * scale[:u, r]
            back = g[:, None] * out[:u] * (1 - h * h)
            out[:u] -= RATE * (g[:, None] * h + DECAY * out[:u])
            hidden[:u] -= RATE * (back[:, :, None] * row[:, None, :] + DECAY * hidden[:u])
            bias[:u] -= RATE * back
            shift[:u] -= RATE * g
    for u, k in enumerate(able):
        parts = {"mean": means[u], "std": stds[u], "hidden": hidden[u], "bias": bias[u], "out": out[u]}
        made[k] = {name: a.tolist() for name, a in parts.items()} | {"shift": float(shift[u]), "samples": counts[k][0], "positives": counts[k][1]}
    return made


def train_ranker(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, list] | None:
    """train_rankers for one user."""
    return train_rankers([(x, y, weight)])[0]


MODEL = "mean array<double>, std array<double>, hidden array<array<double>>, bias array<double>, out array<double>, shift double, samples long, positives long"


def rankers(samples: DataFrame) -> DataFrame:
    """A model for each user with enough samples (user_id, job_id, kind of order, features, label, weight), in the order of job_id."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            users = [(np.array([r["features"] for r in own], dtype=float), np.array([r["label"] for r in own], dtype=float), np.array([r["weight"] for r in own], dtype=float)) for own in rows["rows"]]
            made = [{"user_id": user, **m} for user, m in zip(rows["user_id"], train_rankers(users), strict=True) if m]
            yield pd.DataFrame(made, columns=["user_id", *_FIELDS])

    row = F.struct("job_id", "features", "label", "weight")
    return samples.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).mapInPandas(fit, f"user_id long, {MODEL}")


_FIELDS = ["mean", "std", "hidden", "bias", "out", "shift", "samples", "positives"]


def predicted(features: Column, model: Column) -> Column:
    """The ranker's fit of a feature array, in expressions only."""
    z = F.zip_with(F.zip_with(features, model["mean"], lambda f, m: f - m), model["std"], lambda f, s: f / s)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    h = F.transform(F.arrays_zip(model["hidden"].alias("w"), model["bias"].alias("b")), lambda u: F.tanh(dot(u["w"], z) + u["b"]))
    return 1 / (1 + F.exp(-(dot(h, model["out"]) + model["shift"])))


def blended(score: Column, fit: Column, samples: Column) -> tuple[Column, Column]:
    """(score, reason): the ranker's share grows with its samples up to a half; a reason only for a change of 2 percent or more."""
    share = F.least(F.lit(0.5), samples / 200)
    mixed = score * (1 - share) + fit * share
    delta = js_round((mixed - score) * 100).cast("long")
    sign = F.when(delta > 0, "+").otherwise("")
    reason = F.when(F.abs(delta) >= 2, F.concat(F.lit("Learned from your feedback ("), sign, delta, F.lit(" %)")))
    return js_round(mixed, 1000), reason
