"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one point. Points are dealt by hash into shards of about SHARD; each shard holds its graph as flat
arrays: the points of each layer, and up to 2 * `degree` neighbours of each, padded with -1.
A layer's neighbours are chosen among the nearest points of the layer by the diversity rule (a neighbour must be nearer to the point than to any
neighbour chosen before), with the nearest of the rest filling up, and links run both ways as far as room allows. As a shard is small, the nearest points
come from blocks of matrix products rather than from searches, which builds the same kind of graph faster in numpy.

Vectors in tight clusters leave a layer in islands that no link joins. So a layer's points go on to the next one up not only by
chance: of each island at least one does, the one nearest to its middle. The highest layer is read whole. A search keeps a beam on every layer
and starts on the next lower one from all the points it holds, so that it comes into every island that is near.

Queries go in blocks, and each shard answers a block at once; the shards' results are merged. Distances of results are taken in double
precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SHARD = 8192
DEGREE = 16
CANDIDATES = 64
BEAM = 96
#: The beam on upper layers, and the points of a layer that is read whole.
UPPER_BEAM = 48
TOP = 64
K = 10
#: Queries that go to a shard together, and those that are searched side by side.
QUERY_BLOCK = 16_384
SIDE_BY_SIDE = 512


def _nearest(x: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """For each point of `among` its k nearest other points of `among`, as places in `among`, nearest first."""
    v = x[among]
    norms = (v * v).sum(axis=1)
    out = np.empty((len(among), min(k, len(among) - 1)), dtype=np.int32)
    for lo in range(0, len(among), 512):
        d = norms[None, :] - 2 * (v[lo : lo + 512] @ v.T)
        rows = np.arange(len(d))
        d[rows, lo + rows] = np.inf
        near = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < len(among) - 1 else np.argsort(d, axis=1)[:, : out.shape[1]]
        out[lo : lo + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
    return out


def _linked(x: np.ndarray, among: np.ndarray, degree: int, candidates: int) -> np.ndarray:
    """The neighbours of each point of a layer, as places in `among`, padded with -1."""
    table = np.full((len(among), 2 * degree), -1, dtype=np.int32)
    if len(among) < 2:
        return table
    near = _nearest(x, among, candidates)
    v = x[among]
    width = min(degree, near.shape[1])
    for lo in range(0, len(among), 512):  # all points of a block take their decisions side by side
        block = near[lo : lo + 512]
        w = v[block]
        to_point = ((w - v[lo : lo + 512, None, :]) ** 2).sum(axis=2)
        chosen = np.zeros(block.shape, dtype=bool)
        for j in range(block.shape[1]):
            gap = ((w[:, :j] - w[:, j : j + 1]) ** 2).sum(axis=2) if j else np.zeros((len(block), 0))
            clash = (chosen[:, :j] & (gap < to_point[:, j : j + 1])).any(axis=1)
            chosen[:, j] = ~clash & (chosen[:, :j].sum(axis=1) < degree)
        order = np.argsort(~chosen, axis=1, kind="stable")  # the diverse ones first, then the nearest of the rest
        table[lo : lo + 512, :width] = np.take_along_axis(block, order, axis=1)[:, :width]
    used = np.full(len(among), width)
    for a in range(len(among)):  # and back
        for b in table[a, :width].tolist():
            if used[b] < 2 * degree and a not in table[b, : used[b]]:
                table[b, used[b]] = a
                used[b] += 1
    return table


def _islands(table: np.ndarray) -> np.ndarray:
    """The smallest place that links, taken either way, reach from each place."""
    label = np.arange(len(table))
    ends, other = np.nonzero(table >= 0)[0], table[table >= 0]
    while True:
        low = label.copy()
        np.minimum.at(low, ends, label[other])
        np.minimum.at(low, other, label[ends])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def build(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, seed: int = 7) -> dict[str, np.ndarray]:
    """The flat arrays of a graph over the rows of x: `members` (points of all layers, lowest layer first), `starts` and `links`."""
    rng = np.random.default_rng([seed, len(x)])
    among, members, links, starts = np.arange(len(x)), [], [], [0]
    while len(among):
        table = _linked(x, among, degree, candidates)
        members.append(among.astype(np.int32))
        links.append(np.where(table >= 0, among[table], -1).astype(np.int32))
        starts.append(starts[-1] + len(among))
        if len(among) <= TOP:
            break
        # Of each island its point nearest to the middle; others by chance.
        island = np.unique(_islands(table), return_inverse=True)[1]
        sizes = np.bincount(island)
        middle = np.stack([np.bincount(island, weights=c) for c in x[among].T], axis=1) / sizes[:, None]
        off = ((x[among] - middle[island]) ** 2).sum(axis=1)
        order = np.lexsort((off, island))
        up = rng.random(len(among)) < 1 / degree
        up[order[np.cumsum(sizes) - sizes]] = True
        if up.sum() > len(among) // 2:
            break
        among = among[up]
    empty = np.zeros(0, np.int32)
    return {
        "members": np.concatenate(members) if members else empty,
        "starts": np.array(starts, dtype=np.int32),
        "links": np.concatenate([t.reshape(-1) for t in links]) if links else empty,
    }


def _beam(x: np.ndarray, norms: np.ndarray, queries: np.ndarray, table: np.ndarray, place: np.ndarray, ids: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` points of a layer nearest to each query that links reach from the points `ids`, and their distances less the query's own square."""
    n = len(x)

    def distance(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.where(rows >= 0, norms[rows] - 2 * np.einsum("qmd,qd->qm", x[rows], q, optimize=True), np.inf)

    every = np.arange(len(queries))[:, None]
    seen = np.zeros((len(queries), n + 1), dtype=bool)
    seen[:, n] = True  # the place of the padding
    seen[every, np.where(ids >= 0, ids, n)] = True
    dist = distance(ids, queries)
    done = ~np.isfinite(dist)
    if ids.shape[1] < beam:
        more = ((0, 0), (0, beam - ids.shape[1]))
        ids, dist, done = np.pad(ids, more, constant_values=-1), np.pad(dist, more, constant_values=np.inf), np.pad(done, more, constant_values=True)
    while True:
        waiting = np.where(done, np.inf, dist)
        j = waiting.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(waiting[every[:, 0], j]))
        if not len(live):
            return ids, dist
        point = ids[live, j[live]]
        done[live, j[live]] = True
        near = table[place[point]].astype(np.int64)
        new = ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, n)] = True
        near = np.where(new & (near >= 0), near, -1)
        d = distance(near, queries[live])
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_done = np.concatenate([done[live], ~np.isfinite(d)], axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, keep, axis=1)
        dist[live] = np.take_along_axis(all_d, keep, axis=1)
        done[live] = np.take_along_axis(all_done, keep, axis=1)


def search(x: np.ndarray, graph: dict[str, np.ndarray], queries: np.ndarray, k: int, beam: int = BEAM, degree: int = DEGREE) -> np.ndarray:
    """The places of the k points nearest to each query that the graph finds, nearest first; -1 where there are fewer."""
    n, starts, members = len(x), graph["starts"], graph["members"]
    out = np.full((len(queries), k), -1, dtype=np.int64)
    if not n or not len(queries):
        return out
    norms = (x * x).sum(axis=1)
    links = graph["links"].reshape(-1, 2 * degree)
    top = members[starts[-2] : starts[-1]].astype(np.int64)
    for lo in range(0, len(queries), SIDE_BY_SIDE):
        q = queries[lo : lo + SIDE_BY_SIDE]
        d = norms[top][None, :] - 2 * (q @ x[top].T)
        ids = top[np.argsort(d, axis=1, kind="stable")[:, :UPPER_BEAM]]
        for h in range(len(starts) - 2, -1, -1):
            place = np.full(n, -1)
            place[members[starts[h] : starts[h + 1]]] = np.arange(starts[h + 1] - starts[h])
            ids, dist = _beam(x, norms, q, links[starts[h] : starts[h + 1]], place, ids, max(k, beam) if h == 0 else UPPER_BEAM)
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        out[lo : lo + SIDE_BY_SIDE, : order.shape[1]] = np.take_along_axis(ids, order, axis=1)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part. Null ids, and vectors that are null, empty, zero or hold null, NaN or infinite components, do not."""
    sound = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter("vec_id is not null and v is not null").filter(F.forall("v", sound) & F.exists("v", lambda c: c != 0))


def _single(x: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """x and others in single precision, moved to x's middle and scaled to its extent, so that far-off or large vectors lose no more digits than others."""
    middle = x.mean(axis=0) if len(x) else 0.0
    extent = float(np.abs(x - middle).max(initial=0.0)) or 1.0
    return tuple(((a - middle) / extent).astype(np.float32) for a in (x, *others))


def build_index(rows: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """Shards of the index over rows (vec_id, v): dim, shard, the points' vectors, their smallest k + 1 ids, and the graph's arrays.

    Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest; the others are cut where they are read.
    """
    first = Window.partitionBy("v").orderBy("vec_id")
    points = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = written(points.withColumn("dim", F.size("v").cast("long")), "ann-points")
    sizes = points.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards"))
    dealt = points.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")))  # a row for each dimension

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        n, dim = table.num_rows, key[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
        ids = table.column("ids").combine_chunks()
        graph = build(*_single(x))
        row = {"dim": dim, "shard": key[1].as_py(), "n": n, "v": x.astype("<f8").tobytes(), "ids": ids.flatten().to_numpy().astype("<i8").tobytes(), "id_counts": np.diff(ids.offsets.to_numpy()).astype("<i4").tobytes()}
        row |= {name: a.astype("<i4").tobytes() for name, a in graph.items()}
        return pa.Table.from_pylist([row])

    schema = "dim long, shard long, n long, v binary, ids binary, id_counts binary, members binary, starts binary, links binary"
    made = dealt.select("dim", "shard", "v", "ids", F.col("ids")[0].alias("first")).groupBy("dim", "shard").applyInArrow(run, schema)
    return written(made, "ann-index")


def search_index(index: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that the index finds for each of queries (vec_id, v), nearest first.

    The query's own row is no candidate. Ties go to the smaller vec_id. Queries are packed in blocks; every shard of their dimension answers each block.
    """
    queries = written(queries.withColumn("dim", F.size("v").cast("long")), "ann-queries")
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    packed = (
        queries.join(F.broadcast(blocks), "dim")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        .groupBy("dim", "block")
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    )
    shards = index.join(F.broadcast(blocks), "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    work = shards.join(packed, ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(name)[i] for name in ("dim", "n", "v", "ids", "id_counts", "members", "starts", "links")}
                dim, n = row["dim"].as_py(), row["n"].as_py()
                x = np.frombuffer(row["v"].as_buffer(), "<f8").reshape(n, dim)
                graph = {name: np.frombuffer(row[name].as_buffer(), "<i4") for name in ("members", "starts", "links")}
                ids = np.frombuffer(row["ids"].as_buffer(), "<i8")
                ends = np.cumsum(np.frombuffer(row["id_counts"].as_buffer(), "<i4"))
                begins = np.concatenate(([0], ends[:-1]))
                held = batch.column("queries")[i].values
                names = held.field("vec_id").to_numpy()
                q = held.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(names), dim)
                single, asked = _single(x, q)
                found = search(single, graph, asked, k + 1)
                out = []
                for j, query in enumerate(names.tolist()):
                    near = found[j][found[j] >= 0]
                    score = np.sqrt(((x[near] - q[j]) ** 2).sum(axis=1))
                    pairs = [(s, v) for p, s in zip(near.tolist(), score.tolist(), strict=True) for v in ids[begins[p] : ends[p]].tolist() if v != query]
                    out += [(query, v, s) for s, v in sorted(pairs)[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    per_shard = work.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return per_shard.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int, k: int = K) -> DataFrame:
    """The k nearest rows to each row of vectors (vec_id, embedding) whose vec_id is divisible by `every`; see search_index.

    Only vectors of equal length are compared. Repeated rows count once. Empty tables and tables without a query give no rows.
    """
    rows = written(usable(vectors), "ann-vectors")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    return search_index(build_index(rows, k), queries, k)


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 100)
