"""Mixing sources to target weights by balanced sampling (the cube method).

Each source gets a target of words; its documents are all taken floor(target / size) times and once more with the
same fractional probability. Which ones get the extra copy is drawn by the cube method: a point that holds the
fractional probabilities moves through the null space of the balancing constraints (number of documents and number
of words), each step making one of them 0 or 1, until fewer fractions are left than there are constraints.

The flight runs over blocks of about BLOCK documents of a source; the two fractions that a block leaves at most meet
in the next level's blocks, and so on, until one block a source is left, where the landing drops the
constraints one after the other. A source of any size is so spread over any number of tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, written

BLOCK = 4096
MOST = 3
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 5
_EPS = 1e-9
_FLOWN = ["doc_id", "source", "size", "source_size", "target", "base", "p", "draw", "blocks", "last"]


def flight(p: np.ndarray, rows: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Moves p until no more than len(rows) entries are strictly between 0 and 1, keeping every row @ p and the mean of each entry."""
    p = p.copy()
    m = len(rows)
    pending = iter(np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist())
    draws = iter(rng.random(len(p) + m + 1).tolist())
    active: list[int] = []
    while True:
        while len(active) <= m:
            k = next(pending, None)
            if k is None:
                return _snap(p)
            active.append(k)
        a = np.array([[r[k] for k in active] for r in rows], dtype=float)
        if m == 2:
            u = np.array([a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]])
            if not u.any():  # the rows are in proportion on these entries: keep the first, move two of them
                u = np.array([a[0, 1] or a[1, 1], -(a[0, 0] or a[1, 0]), 0.0]) if a.any() else np.array([1.0, 0.0, 0.0])
        elif m == 1:
            u = np.array([a[0, 1], -a[0, 0]]) if a.any() else np.array([1.0, 0.0])
        else:
            u = np.array([1.0])
        u = u / np.abs(u).max()
        now = p[active]
        up = min((1 - x) / d if d > 0 else -x / d for x, d in zip(now, u, strict=True) if d)
        down = min(x / d if d > 0 else (x - 1) / d for x, d in zip(now, u, strict=True) if d)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        now = _snap(now + step * u)
        p[active] = now
        active = [k for k, x in zip(active, now.tolist(), strict=True) if 0 < x < 1]


def settle_large(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, share: float = 0.002) -> np.ndarray:
    """p with the entries settled that hold more than `share` of all words, so that none of them is left for the landing.

    A step moves one large entry against all the others that are open, in the null space of the words.
    """
    p = _snap(p.copy())
    for k in np.argsort(-size, kind="stable"):
        if size[k] <= share * size.sum():
            break
        while 0 < p[k] < 1:
            rest = (p > 0) & (p < 1) & (size > 0)
            rest[k] = False
            if not rest.any():
                return p
            pull = size[k] / size[rest].sum()
            up = min(1 - p[k], p[rest].min() / pull)
            down = min(p[k], (1 - p[rest]).min() / pull)
            step = up if rng.random() * (up + down) < down else -down
            p[k] += step
            p[rest] -= step * pull
            p = _snap(p)
    return p


def _snap(p: np.ndarray) -> np.ndarray:
    return np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, documents, target) of rows (source, size).

    Sources by code point, null last, weigh WEIGHTS in turn and share all words; a target stops at MOST times its
    source's size and the excess is shared anew by weight. That is a level t with sum(min(weight t, MOST size)) = all words,
    found by one pass over the sources in the order in which they reach their limit.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    limit = (F.col("source_size") * MOST).cast("double")
    by = by.withColumn("weight", weight).withColumn("limit", limit).withColumn("full_at", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    rising = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    by = by.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    by = by.withColumn("before", F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    by = by.withColumn("top", F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"])
    target = F.when(F.col("top").isNull() | (F.col("full_at") <= F.col("top")), F.col("limit")).otherwise(F.col("weight") * F.col("top"))
    return by.select("source", "source_size", "documents", target.alias("target"))


def _fly(rows: pa.Table, columns: list[str]) -> pa.Table:
    more = [(c, "ascending") for c in columns[len(_FLOWN) :]]
    rows = rows.sort_by([("draw", "ascending"), ("doc_id", "ascending"), ("size", "descending"), *more])
    size = rows["size"].to_numpy().astype(float)
    rng = np.random.default_rng([SEED, rows["draw"][0].as_py() & (2**63 - 1), len(size)])
    documents, words = np.ones(len(size)), size / max(size.max(), 1.0)
    p = flight(settle_large(rows["p"].to_numpy(), size, rng), [documents, words], rng)
    if rows["last"][0].as_py():  # the landing gives up the number of documents, then that of words
        p = flight(p, [words], rng)
        p = flight(p, [], rng)
    return rows.select(columns).set_column(columns.index("p"), "p", pa.array(p))


def mixed(docs: DataFrame, block: int = BLOCK, key: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each row of docs (doc_id, text, source; more columns are ignored).

    size is the number of words of the whole text, 0 for null; copies is how often the mix takes the row, MOST at
    most. Null is a source of its own. A source without words has target 0 and nothing taken. Draws hang on doc_id
    alone, so reruns agree; rows without one draw by their place in docs. Rows that repeat a doc_id are taken each by itself. An empty table gives no rows. `key`
    names a long column of docs that tells rows apart; it is handed on, and rows without a doc_id draw by it first.
    """
    spark = docs.sparkSession
    keys = [key] if key else []
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("place"),
        *keys,
    )
    sizes = written(sizes, "mix-sizes")
    sources = written(targets(sizes), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor(rate + _EPS), F.lit(MOST)).cast("int")
    rows = sizes.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("base", base).withColumn("p", F.greatest(rate - F.col("base"), F.lit(0.0)))
    rows = rows.withColumn("draw", F.xxhash64(F.coalesce("doc_id", *keys, "place"), F.lit(SEED))).drop("place")
    rows = rows.withColumn("blocks", F.ceil(F.col("documents") / block).cast("long"))
    schema = "doc_id long, source string, size long, source_size long, target double, base int, p double, draw long, blocks long, last boolean" + "".join(f", {k} long" for k in keys)
    fly = lambda _, rows: _fly(rows, [*_FLOWN, *keys])
    settled = []
    while True:
        rows = rows.withColumn("last", F.col("blocks") == 1).withColumn("block", F.pmod(F.expr("shiftrightunsigned(draw, 3)"), F.col("blocks")))
        open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
        flown = rows.filter(open_).groupBy("source", "block").applyInArrow(fly, schema)
        settled.append(rows.filter(~open_).select(*flown.columns))
        rows = written(flown, "mix-level")
        settled.append(rows.filter(~open_))
        left = rows.filter(open_)
        count = left.groupBy("source").agg(F.count("*").alias("left"))
        if count.isEmpty():
            break
        left = left.drop("blocks", "last").join(count.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        # A new draw mixes the fractions of different blocks.
        rows = left.withColumn("blocks", F.ceil(F.col("left") / block).cast("long")).withColumn("draw", F.xxhash64("draw", F.lit(SEED)))
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + (F.col("p") > 0.5).cast("int")).alias("copies"), *keys)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
