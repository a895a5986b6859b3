"""Toxicity: a convolutional text classifier in numpy.

Words are hashed into BUCKETS embeddings, and so are their first PREFIX bytes, which words of a stem share; a word's embedding is the sum of both; filters of several widths slide over them, each keeps its largest answer
over the whole text, and a logistic unit weighs what they kept. Because a filter is linear before its maximum,
scoring adds rows of tables (embedding times filter slice, one table for each place in a filter), so
a text of any length costs a few gathers a word. Training uses Adam; only the places of the maxima get a gradient.

Labels are learnt from every labelled row outside the held-out fold. The rows are dealt by doc_id into shards of about SHARD rows. The first shard
is learnt alone, EPOCHS times over; then, in each of ROUNDS rounds, every shard goes on from the same model over its own rows once, and the shards'
models and Adam's moments are averaged: an embedding by the shards' texts that have its bucket, all else by their rows. With one shard this is plain
training. A fifth of the labelled rows is held back to calibrate a threshold for each language; the score itself never sees labels, language, source or doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import COUNT_SCHEMA, MARKS, Scratch, count_rows, lean, mix, summed_counts, text_slices, tuned, word_hashes

BUCKETS = 1 << 15
DIM = 12
#: A word's first bytes, hashed apart, let words of one stem share what is learnt.
PREFIX = 4
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Labelled rows of a shard, about.
SHARD = 16_384
#: Bits of a filter that drops most rows without a label before texts are hashed and moved; which ones have one, a join says.
FILTER_BITS = 25
#: Words that a task holds and learns from at a time; a shard of more goes in several runs, a longer text alone.
SAMPLE_WORDS = 8_000_000
#: Places that filters slide over at a time while learning; a longer text goes in several runs, which its maxima outlast.
LONGEST = 200_000
#: Buckets in fewer texts keep a zero embedding: what they would learn is those texts.
LEAST_TEXTS = 5
#: Passes over the first shard, and rounds over all shards after it.
EPOCHS = 8
ROUNDS = 4
BATCH = 48
RATE = 0.01
#: Calibration rows are counted by bins of their score, which keep their lowest and highest one.
BINS = 1 << 14
#: Calibration rows that a language needs for a threshold of its own; others take the one of all.
OWN_THRESHOLD = 40
_PAD = BUCKETS


@dataclass
class Model:
    embedding: np.ndarray  # (BUCKETS + 1, DIM), the last row zero
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS,)
    out: np.ndarray
    shift: float

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embedding @ w[o] for o in range(len(w))] for w in self.filters]


def bucket_slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of the words and of their stems, a row a word, of a run of texts; words of each)."""
    for _, _, data, offsets in text_slices(texts):
        hashes, counts, stems = word_hashes(data, offsets, gap=MARKS, prefix=PREFIX)
        yield np.stack([hashes >> np.uint64(49), stems >> np.uint64(49)], axis=1).astype(np.int32) % BUCKETS, counts


def _padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with padding behind each text, each text's first place, and its places (one at least)."""
    places = np.maximum(counts, 1)
    room = places + max(WIDTHS) - 1
    first = np.cumsum(room) - room
    flat = np.full((int(room.sum()), 2), _PAD, dtype=np.int32)
    flat[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
    return flat, first, places


def _answers(tables: list[np.ndarray], flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = tables[0][flat[at, 0]]
    total += tables[0][flat[at, 1]]
    for o in range(1, len(tables)):
        for k in range(2):
            total += tables[o][flat[at + o, k]]
    return total


def probabilities(tables: list[list[np.ndarray]], model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    flat, first, places = _padded(ids, counts)
    at = np.repeat(first - (np.cumsum(places) - places), places) + np.arange(int(places.sum()))
    begin = np.cumsum(places) - places
    pooled = np.concatenate([np.maximum.reduceat(_answers(t, flat, at), begin, axis=0) for t in tables], axis=1)
    logits = np.maximum(pooled + model.bias, 0) @ model.out + model.shift
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


@dataclass
class Slopes:
    """The mean log loss's derivatives by the parts of a model; `embedding` has those of the rows `words` only."""

    filters: list[np.ndarray]
    words: np.ndarray
    embedding: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    shift: np.ndarray


def _peaks(tables: list[np.ndarray], flat: np.ndarray, first: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest answer, its first place in flat), each a row a text with an entry for each filter, over at most LONGEST places at a time."""
    best = np.empty((len(places), tables[0].shape[1]), tables[0].dtype)
    where = np.empty(best.shape, np.int64)
    total = np.cumsum(places)
    i = 0
    while i < len(places):
        j = max(i + 1, int(np.searchsorted(total, total[i] - places[i] + LONGEST, side="right")))
        own, begin = places[i:j], np.cumsum(places[i:j]) - places[i:j]
        if own.sum() <= LONGEST:
            at = np.repeat(first[i:j] - begin, own) + np.arange(int(own.sum()))
            answers = _answers(tables, flat, at)
            top = np.stack([answers[e : e + n].argmax(axis=0) + e for e, n in zip(begin, own, strict=True)])
            best[i:j], where[i:j] = np.take_along_axis(answers, top, axis=0), at[top]
        else:
            best[i] = -np.inf
            for lo in range(0, int(own[0]), LONGEST):
                at = first[i] + np.arange(lo, min(lo + LONGEST, int(own[0])))
                answers = _answers(tables, flat, at)
                top = answers.argmax(axis=0)
                value = np.take_along_axis(answers, top[None], axis=0)[0]
                where[i] = np.where(value > best[i], at[top], where[i])
                best[i] = np.maximum(value, best[i])
        i = j
    return best, where


def gradients(model: Model, texts: list[np.ndarray], labels: np.ndarray) -> Slopes:
    """At the model as it is, over one batch. Max pooling passes a derivative to the place that gave the maximum."""
    counts = np.array([len(x) for x in texts])
    flat, first, places = _padded(np.concatenate(texts), counts)
    pooled, where = [], []
    place_of = np.zeros(BUCKETS + 1, dtype=np.int32)
    place_of[flat] = 1
    own = np.flatnonzero(place_of)
    place_of[own] = np.arange(len(own))
    back = place_of[flat]
    for w in model.filters:
        best, place = _peaks([model.embedding[own] @ w[o] for o in range(len(w))], back, first, places)
        pooled.append(best)
        where.append(place)
    raw = np.concatenate(pooled, axis=1) + model.bias
    kept = np.maximum(raw, 0)
    p = 1 / (1 + np.exp(-np.clip(kept @ model.out + model.shift, -30, 30)))
    d = ((p - labels) / len(texts)).astype(model.out.dtype)
    back_raw = d[:, None] * model.out * (raw > 0)
    by_filter, rows, grads = [], [], []
    for f, w in enumerate(model.filters):
        g = back_raw[:, f * FILTERS : (f + 1) * FILTERS]
        dw = np.zeros_like(w)
        for o in range(len(w)):
            words = flat[where[f] + o]
            dw[o] = np.einsum("bfd,bf->df", model.embedding[words].sum(axis=2), g)
            back_words = (g[:, :, None] * w[o].T[None]).reshape(-1, DIM)
            for k in range(2):
                rows.append(words[:, :, k].reshape(-1))
                grads.append(back_words)
        by_filter.append(dw)
    used, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    sums = np.zeros((len(used), DIM), model.embedding.dtype)
    np.add.at(sums, inverse, np.concatenate(grads))
    return Slopes(by_filter, used, sums, kept.T @ d, back_raw.sum(axis=0), d.sum(keepdims=True))


@dataclass
class Learner:
    """A model that is being learnt, by the names of its arrays, and Adam's two moments of each."""

    arrays: dict[str, np.ndarray]
    moments: dict[str, list[np.ndarray]]
    step: int = 0

    def model(self) -> Model:
        a = self.arrays
        return Model(a["e"], [a[f"w{k}"] for k in range(len(WIDTHS))], a["bias"], a["out"], float(a["shift"][0]))

    def copied(self) -> Learner:
        return Learner({k: v.copy() for k, v in self.arrays.items()}, {k: [m.copy() for m in v] for k, v in self.moments.items()}, self.step)

    def every(self) -> list[tuple[bool, np.ndarray]]:
        """(whether it goes by bucket, array) of all that is averaged, moments included."""
        return [(k == "e", x) for k, v in self.arrays.items() for x in (v, *self.moments[k])]


def begun(seen_in: np.ndarray, n: int, hits: int, seed: int = 11) -> Learner:
    """What learning from n texts, `hits` of them of label 1, begins with; seen_in: texts of each bucket. With one class only, or nothing, it is a constant."""
    rng = np.random.default_rng(seed)
    arrays = {"e": rng.normal(0, 0.3, (BUCKETS + 1, DIM)).astype(np.float32)}
    arrays["e"][seen_in < LEAST_TEXTS] = 0
    for k, w in enumerate(WIDTHS):
        arrays[f"w{k}"] = rng.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32)
    arrays["bias"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    arrays["out"] = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    arrays["shift"] = np.zeros(1, np.float32)
    if 0 < hits < n:
        arrays["shift"][0] = np.log(hits / (n - hits))
    else:
        arrays["out"][:] = 0
        arrays["shift"][0] = 0.0 if not n else (3.0 if hits else -3.0)
    return Learner(arrays, {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in arrays.items()})


def learn(learner: Learner, texts: list[np.ndarray], labels: np.ndarray, seen_in: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
    """Takes learner through texts (bucket arrays) with labels 0 and 1, in batches, so many times over."""

    def adam(name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = learner.moments[name]
        i = slice(None) if rows is None else rows
        m[i] = 0.9 * m[i] + 0.1 * grad
        v[i] = 0.99 * v[i] + 0.01 * grad * grad
        learner.arrays[name][i] -= RATE * (m[i] / (1 - 0.9**learner.step)) / (np.sqrt(v[i] / (1 - 0.99**learner.step)) + 1e-6)

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            chosen = order[lo : lo + BATCH]
            learner.step += 1
            slopes = gradients(learner.model(), [texts[k].astype(np.int32) for k in chosen], labels[chosen])
            for k, g in enumerate(slopes.filters):
                adam(f"w{k}", g + 1e-5 * learner.arrays[f"w{k}"])
            real = seen_in[slopes.words] >= LEAST_TEXTS
            adam("e", slopes.embedding[real], slopes.words[real])
            adam("out", slopes.out + 1e-4 * learner.arrays["out"])
            adam("bias", slopes.bias)
            adam("shift", slopes.shift)


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").reshape(-1, 2) for x in batch.column("ids").to_pylist()]


def _texts_of_buckets(texts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for x in texts:
        out[np.unique(x)] += 1
    return out


def averaged(rows: DataFrame, learner: Learner, seen_in: np.ndarray, turn: int, epochs: int, scratch: Scratch, parts: int = 16) -> Learner:
    """learner after each shard of rows (shard, toxic, ids) went on from it.

    The shards' arrays are written in `parts` columns, and each column is summed apart, in the order of shards. The table goes at once, where
    shuffled arrays would stay on disk until the driver's garbage is collected.
    """
    names = [f"p{k}" for k in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard_rows(held: list) -> pa.RecordBatch:
            shard, own, by_bucket, count = held[0], held[1], held[2], held[3]
            weighted = [(x * by_bucket[:, None] if bucket else x * np.float32(count)).reshape(-1) for bucket, x in own.every()]
            flat = np.concatenate([*weighted, by_bucket, [count, count * own.step]]).astype("<f4")
            pieces = np.array_split(flat, parts)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in pieces)], names=["shard", *names])

        def flush(held: list) -> None:
            texts = held[4]
            if texts:
                held[2] += _texts_of_buckets(texts)
                held[3] += len(texts)
                learn(held[1], texts, np.array(held[5], dtype=np.float32), seen_in, held[6], epochs)
            held[4], held[5], held[7] = [], [], 0

        held: list = []  # shard, its learner, its texts of each bucket, its rows, texts and labels not yet learnt from, random numbers, words
        for batch in batches:
            for shard, x, y in zip(batch.column("shard").to_pylist(), _unpacked(batch), batch.column("toxic").to_pylist(), strict=True):
                if held and held[0] != shard:
                    flush(held)
                    yield shard_rows(held)
                    held = []
                if not held:
                    held = [shard, learner.copied(), np.zeros(BUCKETS + 1, dtype=np.int64), 0, [], [], np.random.default_rng([turn, shard]), 0]
                if held[7] + len(x) > SAMPLE_WORDS:
                    flush(held)
                held[4].append(x)
                held[5].append(y)
                held[7] += len(x)
        if held:
            flush(held)
            yield shard_rows(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(values, "<f4").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "sums"])

    by_shard = scratch.written(rows.select("shard", "toxic", "ids").mapInArrow(lean(run), ", ".join(["shard int", *(f"{x} binary" for x in names)])), "toxicity-sums")
    columns = [by_shard.select(F.lit(k).alias("part"), "shard", F.col(x).alias("sums")).coalesce(1).sortWithinPartitions("shard") for k, x in enumerate(names)]
    apart = rows.sparkSession.range(0, 1, 1, 2).select(F.lit(-1), F.lit(-1), F.lit(b""))  # else Spark sees that all are of one partition, and takes one task for them
    found = reduce(DataFrame.union, [*columns, apart]).mapInArrow(lean(add), "part int, sums binary").collect()
    scratch.drop(by_shard)
    flat = np.concatenate([np.frombuffer(r.sums, "<f8") for r in sorted(found, key=lambda r: r.part) if r.part >= 0])
    by_bucket, (count, steps) = flat[-BUCKETS - 3 : -2, None], flat[-2:]
    out = learner.copied()
    for bucket, x in out.every():
        own, flat = flat[: x.size].reshape(x.shape), flat[x.size :]
        x[:] = np.where(by_bucket > 0, own / np.maximum(by_bucket, 1), x) if bucket else own / count
    out.step = round(steps / count)
    return out


def best_cut(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """The cut with the best F1 between bins of falling scores (lowest and highest score, rows, rows of label 1), in the middle of the gap below it; 0.5 without both classes."""
    if not 0 < hits.sum() < n.sum():
        return 0.5
    k = int((2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())).argmax())
    return float((low[k] + high[k + 1]) / 2) if k + 1 < len(n) else float(low[k])


def calibrated(rows: DataFrame, model: Model) -> dict[str | None, float]:
    """Threshold by language, with the one of all under None, from all of rows (lang, toxic, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            scores = np.array([probabilities(tables, model, x.astype(np.int32), np.array([len(x)]))[0] for x in _unpacked(batch)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(scores)], names=["lang", "toxic", "score"])

    bins = (
        rows.select("lang", "toxic", "ids")
        .mapInArrow(lean(run), "lang string, toxic int, score double")
        .groupBy("lang", F.floor(F.col("score") * BINS).alias("bin"))
        .agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"), F.sum("toxic").alias("hits"))
        .toPandas()
        .sort_values("bin", ascending=False)
    )

    def cut(own) -> float:
        return best_cut(own["low"].to_numpy(), own["high"].to_numpy(), own["n"].to_numpy(np.int64), own["hits"].to_numpy(np.int64))

    thresholds: dict[str | None, float] = {None: cut(bins.groupby("bin", sort=False).agg({"low": "min", "high": "max", "n": "sum", "hits": "sum"}))}
    for lang, own in bins.groupby("lang"):
        if own["n"].sum() >= OWN_THRESHOLD and 0 < own["hits"].sum() < own["n"].sum():
            thresholds[lang] = cut(own)
    return thresholds


def _bits(ids: pa.Array) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame, parts: int = 16) -> np.ndarray:
    """1 << FILTER_BITS bits, packed, of which those of the ids (doc_id long, not null) are set, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            flags[_bits(batch.column(0))] = True
        for k, own in enumerate(np.array_split(np.packbits(flags), parts)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                found[part] = found.get(part, 0) | np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["part", "bits"])

    out = np.zeros((parts, (1 << FILTER_BITS) // 8 // parts), dtype=np.uint8)
    for part, bits in ids.mapInArrow(lean(run), "part int, bits binary").repartition(parts, "part").mapInArrow(join, "part int, bits binary").collect():
        out[part] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(shard, aside, lang, toxic, ids) of every row of docs with a label whose crc32(doc_id as text) mod 5 is not 0; a shard's rows lie together, in an order of their own."""
    learnt_from = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnt_from)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    shards = max(1, -(-known.select("doc_id").distinct().count() // SHARD))
    some = id_filter(known.select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(batch.column("doc_id"))
            batch = batch.filter(pa.array(some[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))
            done = 0
            for ids, counts in bucket_slices(batch.column("text")):
                ends = np.cumsum(counts)
                raw = [ids[e - n : e].astype("<u2").tobytes() for e, n in zip(ends, counts, strict=True)]
                part = batch.slice(done, len(counts)).drop_columns(["text"])
                done += len(counts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, "ids"])

    has_lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = tuned(docs).filter(F.col("doc_id").isNotNull() & learnt_from).select(F.col("doc_id").cast("long").alias("doc_id"), has_lang.alias("lang"), F.col("text").cast("string").alias("text"))
    coded = texts.mapInArrow(lean(run), "doc_id long, lang string, ids binary")
    # Labels and texts are dealt once, together: a document's labels come before its texts, and the largest is theirs.
    marks = known.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("ids"), F.col("toxic").alias("label"))
    both = coded.withColumn("label", F.lit(None).cast("int")).union(marks)
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
    order = ["shard", "draw", "doc_id", "text", "tie"]
    dealt = both.select("*", shard, F.xxhash64("doc_id").alias("draw"), F.col("ids").isNotNull().alias("text"), F.xxhash64("ids", "lang").alias("tie"))
    dealt = dealt.repartition(4 * shards, "shard").sortWithinPartitions(*order)  # fewer shards fall together
    above = Window.partitionBy(*order[:3]).orderBy(*order[3:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumn("toxic", F.max("label").over(above)).filter("text and toxic is not null")
    return scratch.written(rows.select("shard", (F.pmod("draw", F.lit(5)) == 0).alias("aside"), "lang", "toxic", "ids"), "toxicity-rows")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str | None, float]]:
    """(model, threshold by language with the one of all under None) from all labelled rows whose crc32(doc_id as text) mod 5 is not 0, whatever their number and length."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            total += _texts_of_buckets(_unpacked(batch))
        for part, counts in count_rows(total, 4):
            yield pa.RecordBatch.from_arrays([part, counts], names=["part", "counts"])

    with Scratch(docs.sparkSession) as scratch:
        rows = labelled(docs, labels, scratch)
        learning = rows.filter("not aside")
        n, hits, first, last = learning.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.min("shard"), F.max("shard")).first()
        seen_in = summed_counts(learning.select("ids").mapInArrow(seen, COUNT_SCHEMA), BUCKETS + 1, 4)
        learner = begun(seen_in, n, hits)
        if 0 < hits < n:
            learner = averaged(learning.filter(F.col("shard") == first), learner, seen_in, 0, EPOCHS, scratch)
            for turn in range(ROUNDS if last > first else 0):
                learner = averaged(learning, learner, seen_in, turn + 1, 1, scratch)
        return learner.model(), calibrated(rows.filter("aside"), learner.model())


def scored(docs: DataFrame, model: Model, thresholds: dict[str | None, float]) -> DataFrame:
    """docs with `score`, `threshold` (its language's) and `toxic` (score above the threshold), each over the whole text.

    A null or empty text scores as a text of padding. The columns of docs stay, whatever their names; where they
    clash with the new ones, the new ones replace them. Rows may repeat; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("score", "threshold", "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            parts = [probabilities(tables, model, ids, counts) for ids, counts in bucket_slices(batch.column("text"))]
            score = pa.array(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])

    base = tuned(docs).select(*kept).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    out = base.mapInArrow(lean(run), f"{schema}, score double")
    threshold = F.lit(thresholds[None])
    if "lang" in kept:
        for lang, t in thresholds.items():
            if lang is not None:
                threshold = F.when(F.col("lang") == lang, t).otherwise(threshold)
    return out.withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, thresholds = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text", "lang"), model, thresholds)
    return out.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic"
    )
