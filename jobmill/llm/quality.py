"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each whole text. Expectation-maximisation over the counts of vote
patterns, which are few whatever the input, estimates how often each labeller is right on good texts and on each kind of
bad ones, and so the probability that a text with these votes is good. Those posterior labels train a linear scorer on hashed
features alone, byte trigrams and how words come again, which then scores every text by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, lean, mix, text_slices, tuned, word_hashes, written

GOOD, BAD, NONE = 1, 0, 2
BUCKETS = 4096
#: The scorer is fitted on at most so many texts, those with the smallest hash of their votes' class and doc_id.
SAMPLE = 3000
ROUNDS = 200
LABELLERS = ("symbols", "capitals", "repeats", "bars", "words", "sentences", "variety", "shouting", "stutter")

#: Hashed features of how words come again.
AGAIN = 256

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@^_`{|}~\\"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])


def votes(texts: pa.Array) -> Iterator[np.ndarray]:
    """An array (texts, labellers) of votes for each slice of texts. Null and empty texts get no vote."""
    for first, end, data, offsets in text_slices(texts):
        n = end - first
        size = np.maximum(np.diff(offsets), 1)
        hashes, counts = word_hashes(data, offsets)
        words = np.maximum(counts, 1)
        upper, lower = _sums(_UPPER[data], offsets), _sums(_LOWER[data], offsets)
        symbols = _sums(_SYMBOL[data], offsets) / size
        capitals = upper / np.maximum(upper + lower, 1)
        bars = _sums(data == ord("|"), offsets) / words
        stops = (_sums(data == ord("."), offsets)) / words
        shouts = _sums(data == ord("!"), offsets) / words
        ends = np.cumsum(counts)
        distinct = np.array([len(np.unique(hashes[e - c : e])) for e, c in zip(ends, counts, strict=True)]) / words
        same = np.concatenate(([False], hashes[1:] == hashes[:-1])) if len(hashes) else np.zeros(0, bool)
        same[(ends - counts)[counts > 0]] = False
        stutters = np.diff(np.concatenate(([0], np.cumsum(same)))[np.concatenate(([0], ends))]) / words
        own = data.tobytes()
        repeats = np.zeros(n)
        for k in range(n):
            lines = [x for x in own[offsets[k] : offsets[k + 1]].split(b"\n") if x]
            repeats[k] = 1 - len(set(lines)) / len(lines) if lines else 0
        word_size = size / words
        out = np.full((n, len(LABELLERS)), NONE, dtype=np.int8)

        def vote(name: str, bad: np.ndarray, good: np.ndarray) -> None:
            column = out[:, LABELLERS.index(name)]
            column[good] = GOOD
            column[bad] = BAD

        some = counts > 0
        many = counts >= 30
        vote("symbols", some & (symbols > 0.08), many & (symbols < 0.03))
        vote("capitals", some & (capitals > 0.4), many & (capitals < 0.15))
        vote("repeats", repeats > 0.4, many & (repeats < 0.15))
        vote("bars", bars > 0.25, many & (bars < 0.05))
        vote("words", some & ((word_size > 30) | (many & (word_size < 2.5))), many & (word_size > 3.5) & (word_size < 12))
        vote("sentences", many & (stops > 0.6), many & (stops > 0.02) & (stops < 0.3))
        vote("variety", many & (distinct < 0.1 + 3 / words), many & (distinct > 0.3))
        vote("shouting", some & (shouts > 0.3), many & (shouts < 0.05))
        vote("stutter", (counts >= 12) & (stutters > 0.1), many & (stutters < 0.02))
        yield out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of GOOD of each pattern, chance of a bad vote by class and labeller, share of each class) by expectation-maximisation.

    Junk comes in kinds that a labeller each knows, so there is a class of good texts and one of bad texts
    for each labeller: they begin as the texts without a bad vote, and those that the labeller calls bad. A labeller
    that doesn't vote says nothing. No pattern, no posterior.
    """
    kinds = patterns.shape[1]
    shares = np.append(0.8, np.full(kinds, 0.2 / kinds))
    chance = np.full((kinds + 1, kinds), 0.5)
    if not len(patterns):
        return np.zeros(0), chance, shares
    bad, good = (patterns == BAD).astype(float), (patterns == GOOD).astype(float)
    weight = counts / counts.sum()
    some = bad.any(axis=1)
    post = np.column_stack([np.where(some, 0.02, 0.98), np.where(some[:, None], 0.98 * bad / np.maximum(bad.sum(1), 1)[:, None], 0.02 / kinds)])
    for _ in range(rounds):
        mass = weight[:, None] * post
        shares = np.maximum(mass.sum(0), 1e-6)
        shares /= shares.sum()
        # Two pseudo-texts in a thousand keep chances off 0 and 1: on good texts labellers are taken to be right.
        hits, votes_ = mass.T @ bad, mass.T @ (bad + good)
        prior = np.full((kinds + 1, kinds), 0.1)
        prior[0] = 0.002
        chance = np.clip((hits + 0.002 * prior) / (votes_ + 0.002), 1e-4, 1 - 1e-4)
        log = np.log(shares) + bad @ np.log(chance).T + good @ np.log(1 - chance).T
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post[:, 0], chance, shares


def trigram_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the square roots of its shares of hashed byte trigrams; a short text's vector is short, 0 where it has none."""
    for first, end, data, offsets in text_slices(texts):
        d = data.astype(np.uint64)
        codes = (mix(d[:-2] + (d[1:-1] << np.uint64(8)) + (d[2:] << np.uint64(16))) >> np.uint64(52)).astype(np.int64) if len(d) > 2 else np.zeros(0, np.int64)
        for k in range(end - first):
            own = codes[offsets[k] : max(offsets[k], offsets[k + 1] - 2)]
            yield np.sqrt(np.bincount(own, minlength=BUCKETS) / (len(own) + 64)).astype(np.float32)


def again_rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the square roots of its words' shares of hashed (how often the word stood before, how far back it last did), both in powers of two."""
    for first, end, data, offsets in text_slices(texts):
        hashes, counts = word_hashes(data, offsets)
        ends = np.cumsum(counts)
        for k in range(end - first):
            own = hashes[ends[k] - counts[k] : ends[k]]
            n = len(own)
            order = np.argsort(own, kind="stable")
            new = np.ones(n, dtype=bool)
            new[1:] = own[order][1:] != own[order][:-1]
            place = np.arange(n)
            before = place - np.maximum.accumulate(np.where(new, place, 0))
            back = np.where(new, 0, np.diff(order, prepend=0))
            code = np.frexp(before)[1].astype(np.uint64) * np.uint64(64) + np.frexp(back)[1].astype(np.uint64)
            yield np.sqrt(np.bincount((mix(code + np.uint64(1)) % np.uint64(AGAIN)).astype(np.int64), minlength=AGAIN) / (n + 8)).astype(np.float32)


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    for trigrams, again in zip(trigram_rows(texts), again_rows(texts), strict=True):
        yield np.concatenate((trigrams, again))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weights, shift) of a logistic scorer on soft labels y, by Adam on all rows at once; zero without rows."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), np.float32(0)
    if not len(x):
        return w, 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = (p - y) * weight / weight.sum()
        g = np.append(x.T @ d + 1e-4 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), np.float32(b - step[-1])
    return w, float(b)


@dataclass
class Quality:
    posterior: dict[str, float]  # by vote pattern
    chance: np.ndarray  # of a bad vote, by class (good first) and labeller
    shares: np.ndarray
    weights: np.ndarray
    shift: float


def labelled(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with `votes`: a character for each labeller, 1 good, 0 bad, 2 none."""
    chosen = tuned(docs).select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bytes(row + 48).decode() for part in votes(batch.column("__text")) for row in part]
            rest = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(made, pa.string())], names=[*rest.schema.names, "votes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name != "__text")
    return chosen.mapInArrow(lean(run), f"{schema}, votes string")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Quality:
    """Labeller accuracies over all of docs and a scorer fitted on at most `sample` of them.

    Votes of all texts are counted; only the counts of patterns (3 ** labellers at most) reach the driver. The sample takes up to half of its
    rows from patterns that are likely bad, in the order of a hash of doc_id, texts as a whole. Rows that repeat doc_id and text count once
    in it, rows without a doc_id are in no sample.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    voted = written(labelled(docs, ("doc_id", "mark")), "quality-votes")
    rows = voted.groupBy("votes").count().orderBy("votes").collect()
    patterns = np.array([[int(c) for c in r["votes"]] for r in rows], dtype=np.int8).reshape(-1, len(LABELLERS))
    posterior, chance, shares = estimate(patterns, np.array([r["count"] for r in rows], dtype=float))
    by = {r["votes"]: float(p) for r, p in zip(rows, posterior, strict=True)}
    bad = [v for v, p in by.items() if p < 0.5]
    drawn = voted.filter("doc_id is not null").dropDuplicates(["doc_id", "mark"]).withColumn("draw", F.xxhash64("doc_id", "mark"))
    halves = [drawn.filter(k).orderBy("draw", "doc_id", "mark").limit(sample // 2) for k in (F.col("votes").isin(bad), ~F.col("votes").isin(bad))] if by else [drawn]
    chosen = halves[0] if len(halves) == 1 else halves[0].union(halves[1])
    texts = docs.join(F.broadcast(chosen), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])  # at most `sample` rows are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x.astype("<f2").tobytes() for x in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("votes"), pa.array(made, pa.binary())], names=["draw", "votes", "x"])

    found = texts.select("draw", "votes", "text").mapInArrow(run, "draw long, votes string, x binary").orderBy("draw").collect()
    x = np.array([np.frombuffer(r["x"], "<f2") for r in found], dtype=np.float32).reshape(-1, BUCKETS + AGAIN)
    y = np.array([by[r["votes"]] for r in found], dtype=np.float32)
    # The halves weigh as their classes do in all of docs.
    is_bad = np.array([r["votes"] in bad for r in found], dtype=bool)
    all_bad = sum(r["count"] for r in rows if r["votes"] in bad) / max(1, sum(r["count"] for r in rows))
    weight = np.where(is_bad, all_bad / max(is_bad.mean(), 1e-9), (1 - all_bad) / max(1 - is_bad.mean(), 1e-9)) if len(found) else np.zeros(0)
    weights, shift = train(x, y, weight.astype(np.float32))
    return Quality(by, chance, shares, weights, shift)


def scored(docs: DataFrame, model: Quality) -> DataFrame:
    """docs with `votes`, `posterior` (of good, by the votes), `score` (0 to 1, of the whole text) and `good` (score at least 0.5).

    A null or blank text is not good, whatever it scores. The columns of docs stay;
    where they clash with the new ones, the new ones replace them. Rows may repeat; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("votes", "posterior", "score", "good")]
    base = tuned(docs).select(*kept).withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            made = [bytes(row + 48).decode() for part in votes(text) for row in part]
            logits = np.array([float(x @ model.weights) for x in features(text)]) + model.shift
            score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            columns = [pa.array(made, pa.string()), pa.array([model.posterior.get(v, 0.5) for v in made], pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "votes", "posterior", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    out = base.mapInArrow(lean(run), f"{schema}, votes string, posterior double, score double")
    return out.withColumn("good", (F.col("score") >= 0.5) & F.rlike(F.coalesce("text", F.lit("")), F.lit(WORD)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, fit(docs)).drop("text")
