"""N-gram Jaccard join: which texts share most of their word shingles.

Rare-first prefix filtering: a document's shingles are put in one global order, rare ones first,
and two sets of Jaccard similarity t or more must share one of their first n - ceil(t n) + 1.
Only those prefixes are joined, and of them only shingles that stand in two sets or more. A pair must also pass

* the length filter: the smaller set has at least t times the larger one's size;
* the positional filter: at their first shared shingle, what stands before it on either side
  is in one set only, so the two positions may add up to (1 - t) / (1 + t) of both sizes at most;
* the suffix filter: a lower bound of the sets' difference by hash partition. The bound is taken from parity sketches of
  the whole sets, which need no copy for each position: it is never more than positions and suffixes together give.

What is left is verified on the whole sets, once per pair. Equal sets are one class from the start; a class is known by a
64-bit key, and should two different sets ever share one, all keys are made anew with another salt.
Rounds verify each prefix list against one member, so a large group of near copies becomes one component
by a few pairs a member; lists within one component are then done. The last round joins with themselves the lists
that still span two components, so no link that matters is lost.

How the work is laid out, at any size alike:

* one text a class goes into blocks by a hash of its key, a table in buckets. All later reads of texts are by block, so
  that neither the counts nor the fetching of sets for verification moves texts again;
* the counts behind the order are exact but for 40-bit hashes, and made by ranges of hashes: a block sends its sorted
  distinct hashes, differences in 5 bytes each, to the ranges and gets a byte for each back. Nothing is broadcast or
  collected, and a range's size is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, mix, text_slices, word_hashes, written
from .graph import components

SKETCH = 8  # longs
RECENT = 8
#: Rounds against list heads before what is left is joined with itself.
STARS = 2
#: Fewer possible pairs than so many for each row of the lists still open, and they are joined with themselves at once.
PAIRS_A_ROW = 8
#: Steps that verify one candidate a member before the rest is verified.
STEPS = 1
#: Text bytes of a block, shingles of a range, on average.
BLOCK_BYTES = 2 << 20
RANGE_SHINGLES = 2_000_000

_A, _B, _C = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingle_sets(texts: pa.Array, words: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `words` words.

    A text of fewer words has its whole sequence as one; one without words, or null, an empty set.
    """
    for first, end, data, offsets in text_slices(texts):
        hashes, counts = word_hashes(data, offsets)
        ends = np.cumsum(counts)
        for k in range(end - first):
            own = hashes[ends[k] - counts[k] : ends[k]]
            n = max(1, len(own) - words + 1) if len(own) else 0
            total = np.full(n, min(len(own), words) * int(_C) % 2**64, dtype=np.uint64)
            for i in range(min(words, len(own))):
                total = mix(total * _A + own[i : i + n] + _B)
            total.sort()
            yield total[np.concatenate(([True], total[1:] != total[:-1]))] if n > 1 else total


def _named(s: np.ndarray, salt: int) -> tuple[bytes, int]:
    """(128-bit digest, key) of a set."""
    d = hashlib.blake2b(s, digest_size=24, salt=salt.to_bytes(16, "little")).digest()
    return d[:16], int.from_bytes(d[16:], "little", signed=True)


def _signed(words: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), *_named(s, salt)) for s in shingle_sets(batch.column("text"), words)]
            sizes, digests, keys = zip(*sets, strict=True) if sets else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), batch.column("bytes")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "key", "bytes"])

    return lean(run)


def _texts(words: int, salt: int, blocks: int):
    """(block, key, text) of each set's text; copies within a task go once, up to a million sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, rows = [], []
            for k, s in enumerate(shingle_sets(batch.column("text"), words)):
                key = _named(s, salt)[1] if len(s) else None
                if key is None or key in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                keys.append(key)
                rows.append(k)
            if rows:
                numbers = np.array(keys, dtype=np.int64)
                texts = batch.column("text").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(numbers % blocks, pa.int64()), pa.array(numbers), texts], names=["block", "key", "text"])

    return lean(run)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, keys, ends, texts): a row for each block, its distinct sets' texts end to end. Rows come in the order of blocks."""
    now, texts = None, {}

    def out() -> pa.RecordBatch:
        keys = np.fromiter(texts, np.int64, len(texts))
        ends = np.cumsum([len(t) for t in texts.values()], dtype=np.int64)
        columns = [pa.array([now], pa.int64())] + [pa.array([x], pa.binary()) for x in (keys.tobytes(), ends.tobytes(), b"".join(texts.values()))]
        return pa.RecordBatch.from_arrays(columns, names=["block", "keys", "ends", "texts"])

    for batch in batches:
        for block, key, text in zip(batch.column("block").to_pylist(), batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            if block != now:
                if texts:
                    yield out()
                now, texts = block, {}
            if key not in texts:
                texts[key] = text.as_py()
    if texts:
        yield out()


def _block_texts(keys: pa.Scalar, ends: pa.Scalar, texts: pa.Scalar) -> tuple[np.ndarray, pa.Array]:
    own = np.frombuffer(keys.as_buffer(), np.int64)
    offsets = np.concatenate(([0], np.frombuffer(ends.as_buffer(), np.int64)))
    return own, pa.Array.from_buffers(pa.large_string(), len(own), [None, pa.py_buffer(offsets), texts.as_buffer()])


def _ranged(words: int, ranges: int):
    """(range, block, hashes, copies): a block's distinct 40-bit hashes by range, as differences in 5 planes of bytes, and in how many sets of the block each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *parts in zip(*(batch.column(c) for c in ("block", "keys", "ends", "texts")), strict=True):
                flat = np.concatenate([s >> np.uint64(24) for s in shingle_sets(_block_texts(*parts)[1], words)])
                hashes, copies = np.unique(flat, return_counts=True)
                numbers, first = np.unique((hashes * np.uint64(ranges)) >> np.uint64(40), return_index=True)
                runs, counts = [], []
                for a, b in zip(first, [*first[1:], len(hashes)], strict=True):
                    gaps = np.diff(hashes[a:b], prepend=np.uint64(0)).astype("<u8")
                    runs.append(gaps.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes())
                    counts.append(np.minimum(copies[a:b], 255).astype(np.uint8).tobytes())
                columns = [pa.array(numbers.astype(np.int64)), pa.array(np.full(len(numbers), block.as_py()), pa.int64()), pa.array(runs, pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "block", "hashes", "copies"])

    return lean(run)


def _leveled(rows: pa.Table) -> pa.Table:
    """(block, range, levels) from all of a range's rows: a byte for each hash, 0 if it is in one set only, growing with the number of sets."""
    hashes, copies = [], []
    for run, count in zip(rows["hashes"], rows["copies"], strict=True):
        planes = np.frombuffer(run.as_buffer(), np.uint8).reshape(5, -1)
        gaps = np.zeros((planes.shape[1], 8), np.uint8)
        gaps[:, :5] = planes.T
        hashes.append(np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64))
        copies.append(np.frombuffer(count.as_buffer(), np.uint8))
    sizes = np.cumsum([0, *map(len, hashes)])
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    found = np.bincount(at, weights=np.concatenate(copies))
    levels = np.minimum(255, np.ceil(6 * np.log2(found))).astype(np.uint8)[at]
    runs = [levels[a:b].tobytes() for a, b in zip(sizes, sizes[1:], strict=False)]
    return pa.table([rows["block"], rows["range"], pa.array(runs, pa.binary())], names=["block", "range", "levels"])


def _prefixes(words: int, num: int, den: int):
    """(key, n, sketch, tokens, at) of a block's sets: the shingles of the prefix that other sets may share, with their positions."""
    names = ["key", "n", *(f"s{i}" for i in range(SKETCH)), "tokens", "at"]

    def run(block: pa.Table, levels: pa.Table) -> pa.Table:
        if not block.num_rows:
            raise ValueError("levels of a block that is not there")
        keys, texts = _block_texts(*(block[c][0] for c in ("keys", "ends", "texts")))
        sets = list(shingle_sets(texts, words))
        hashes, at = np.unique(np.concatenate([s >> np.uint64(24) for s in sets]), return_inverse=True)
        level = np.frombuffer(b"".join(levels.sort_by("range")["levels"].to_pylist()), np.uint8)
        if len(level) != len(hashes):
            raise ValueError("a block's levels don't fit its shingles")
        level = level[at]
        rows, first = [], 0
        for key, s in zip(keys, sets, strict=True):
            own = level[first : first + len(s)]
            first += len(s)
            keep = len(s) - -(-num * len(s) // den) + 1
            order = np.argsort((own.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[:keep]
            shared = np.flatnonzero(own[order])
            if len(shared):
                bits = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                rows.append((key, len(s), np.packbits(bits.astype(np.uint8)), s[order[shared]].view(np.int64), shared))
        longs = np.stack([r[2] for r in rows]).view(np.int64) if rows else np.zeros((0, SKETCH), np.int64)
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
        columns += [pa.array(np.ascontiguousarray(longs[:, i])) for i in range(SKETCH)]
        columns += [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (3, 4)]
        return pa.table(columns, names=names)

    return run, "key long, n long, " + ", ".join(f"s{i} long" for i in range(SKETCH)) + ", tokens array<long>, at array<long>"


def _sets(words: int):
    """(key, items) of the wanted keys of a block."""

    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        keys, items = [], []
        if wanted.num_rows and block.num_rows:
            own, texts = _block_texts(*(block[c][0] for c in ("keys", "ends", "texts")))
            rows = np.flatnonzero(np.isin(own, wanted["key"].to_numpy()))
            keys = own[rows]
            items = [s.tobytes() for s in shingle_sets(texts.take(pa.array(rows)), words)]
        return pa.table([pa.array(keys, pa.int64()), pa.array(items, pa.binary())], names=["key", "items"])

    return run


def _verified(num: int, den: int):
    """Whole sets against each other: den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("items_a"), batch.column("items_b")
            good = np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                good[i] = den * both >= num * (len(x) + len(y) - both)
            yield batch.select(["ka", "kb"]).filter(pa.array(good))

    return lean(run)


def _sketch_gap(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)))


def ngram_links(docs: DataFrame, words: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_size) of each row of docs (doc_id, text; more columns are ignored).

    Rows link when the Jaccard similarity of their sets of `words`-word shingles is num/den or more;
    component_id is the smallest doc_id reachable by links, the row's own included. Sets are of whole
    lower-cased (A-Z) texts. A null or blank text has an empty set and links with nothing. A row with
    a null doc_id keeps its own set size and takes part like any other; it gives no id to a component.
    Rows that repeat a doc_id are documents of their own. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("bytes"))
    salt = 0
    while True:
        rows = written(docs.mapInArrow(_signed(words, salt), "doc_id long, n long, digest binary, key long, bytes long"), "ngram-rows")
        grouped = rows.filter("n > 0").groupBy("key")
        ends = [F.min("digest").alias("low"), F.max("digest").alias("high")]
        classes = written(grouped.agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.max("n").alias("n"), F.max("bytes").alias("bytes"), *ends), "ngram-classes")
        sums = classes.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count_if(F.col("low") != F.col("high")).alias("clashes")).first()
        if not sums["clashes"]:
            break
        salt += 1
    with Scratch(docs.sparkSession) as scratch:
        labels = written(_labels(docs, sums["bytes"] or 0, sums["n"] or 0, (words, salt, num, den), scratch), "ngram-components")
    named = classes.join(labels, "key", "left").select("key", "rep", "class_size", F.coalesce("label", "key").alias("label"))
    best = named.groupBy("label").agg(F.min("rep").alias("component"))
    whole = named.join(best, "label").select("key", "component", "class_size")
    # Blank texts have no class; apart, they don't meet in one task.
    blank = rows.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component"), F.lit(1).cast("long").alias("class_size"))
    found = rows.filter("n > 0").join(whole, "key").select("doc_id", "n", "component", "class_size").union(blank)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "class_size")


def _pairs_of(x: str, y: str, num: int, den: int) -> Column:
    """The length and positional filters on list rows x and y."""
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    long_enough = F.least(f"{x}.n", f"{y}.n") * den >= F.greatest(f"{x}.n", f"{y}.n") * num
    return long_enough & ((F.col(f"{x}.pos") + F.col(f"{y}.pos")) * (den + num) <= both * (den - num))


def _sketch_fits(x: str, y: str, num: int, den: int) -> Column:
    """The suffix filter on rows x and y that carry n and a sketch."""
    return _sketch_gap(x, y) * (den + num) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (den - num)


def _labels(docs: DataFrame, size: int, shingles: int, how: tuple[int, int, int, int], scratch: Scratch) -> DataFrame:
    """(key, label): the smallest key that links reach from each key that has a link. size, shingles: of all classes."""
    words, salt, num, den = how
    spark = scratch.spark
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // 16)))
    texts = docs.select("text").mapInArrow(_texts(words, salt, n_blocks), "block long, key long, text string")
    packed = texts.repartition(buckets, "block").sortWithinPartitions("block").mapInArrow(lean(_packed), "block long, keys binary, ends binary, texts binary")
    blocks = scratch.bucketed(packed, "ngram-blocks", buckets, "block")
    ranged = blocks.mapInArrow(_ranged(words, max(1, -(-shingles // RANGE_SHINGLES))), "range long, block long, hashes binary, copies binary")
    levels = ranged.groupBy("range").applyInArrow(_leveled, "block long, range long, levels binary")
    run, schema = _prefixes(words, num, den)
    sets = scratch.written(blocks.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(run, schema), "ngram-prefixes")
    sketches = sets.drop("tokens", "at")
    postings = sets.select("key", "n", F.explode(F.arrays_zip("tokens", "at")).alias("p")).select(F.col("p.tokens").alias("token"), "key", "n", F.col("p.at").alias("pos"))
    shared = postings.groupBy("token").agg(F.count("*").alias("members"), F.min("pos").alias("low")).filter("members > 1")
    # Where even the member with the shingle earliest stands too late for a row, no pair of that list passes the positional filter.
    early = (F.col("pos") + F.col("low")) * num <= F.col("n") * (den - num)
    open_lists = lists = scratch.written(postings.join(shared, "token").filter(early).select("token", "key", "n", "pos", "members", F.col("key").alias("label")), "ngram-lists")
    verify = lambda pairs: scratch.written(_linked(blocks, pairs, n_blocks, words, num, den), "ngram-links")
    labels = done = None
    for turn in range(STARS):
        heads = open_lists.groupBy("token").agg(F.min(F.struct(F.col("pos" if turn == 0 else "n").alias("rank"), "key", "n", "pos", "label")).alias("head"))
        heads = heads.select("token", "head.key", "head.n", "head.pos", "head.label")
        star = open_lists.alias("x").join(heads.alias("y"), "token").filter((F.col("x.label") != F.col("y.label")) & _pairs_of("x", "y", num, den))
        pairs = star.select(F.least("x.key", "y.key").alias("ka"), F.greatest("x.key", "y.key").alias("kb")).distinct()
        pairs = pairs.join(done, ["ka", "kb"], "left_anti") if done is not None else pairs
        fit = pairs.join(sketches.alias("x"), F.col("ka") == F.col("x.key")).join(sketches.alias("y"), F.col("kb") == F.col("y.key"))
        pairs = scratch.written(fit.filter(_sketch_fits("x", "y", num, den)).select("ka", "kb"), "ngram-pairs")
        found = verify(pairs)
        done = pairs if done is None else done.union(pairs)
        labels = _merged(labels, found, scratch)
        # The first round sees all of a list of two.
        lists_now = open_lists.filter("members > 2").drop("label").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        lists_now = scratch.written(lists_now.select(open_lists.columns), "ngram-labelled")
        spans = lists_now.groupBy("token").agg(F.min("label").alias("lowest"), F.max("label").alias("highest"), F.count("*").alias("m")).filter("lowest <> highest")
        left = spans.agg(F.sum("m").alias("rows"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs")).first()
        if not left["rows"]:
            return labels
        scratch.drop(open_lists)
        open_lists = scratch.written(lists_now.join(spans.select("token"), "token", "left_semi"), "ngram-open")
        scratch.drop(lists_now)
        if left["pairs"] <= PAIRS_A_ROW * left["rows"] or found.isEmpty():
            break
    del lists
    # Whatever may still link two components.
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(-RECENT, -1)
    last = open_lists.withColumn("recent", F.collect_list("token").over(before))
    last = scratch.written(last.join(sketches.drop("n"), "key"), "ngram-last")
    either = ~F.arrays_overlap("x.recent", "y.recent")  # else a shingle before this one gives the pair
    cross = last.alias("x").join(
        last.alias("y"),
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.key") < F.col("y.key"))
        & (F.col("x.label") != F.col("y.label"))
        & _pairs_of("x", "y", num, den)
        & _sketch_fits("x", "y", num, den)
        & either,
    )
    left_over = scratch.written(cross.select(F.col("x.key").alias("ka"), F.col("y.key").alias("kb")).distinct().join(done, ["ka", "kb"], "left_anti"), "ngram-left")
    # In a group of near copies a pair for each member tells as much as all of them: first everyone's smallest neighbour.
    for _ in range(STEPS):
        if left_over.isEmpty():
            return labels
        ends = left_over.union(left_over.select("kb", "ka")).toDF("node", "other").groupBy("node").agg(F.min("other").alias("other"))
        some = scratch.written(ends.select(F.least("node", "other").alias("ka"), F.greatest("node", "other").alias("kb")).distinct(), "ngram-pairs")
        labels = _merged(labels, verify(some), scratch)
        of = lambda key, label: labels.select(F.col("key").alias(key), F.col("label").alias(label))  # noqa: B023, E731
        rest = left_over.join(some, ["ka", "kb"], "left_anti").join(of("ka", "la"), "ka", "left").join(of("kb", "lb"), "kb", "left")
        left_over = scratch.written(rest.filter(F.coalesce("la", "ka") != F.coalesce("lb", "kb")).select("ka", "kb"), "ngram-left")
    return _merged(labels, verify(left_over), scratch)


def _merged(labels: DataFrame | None, found: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (key, label) after new links (ka, kb): only links between different labels, each once, are followed."""
    if labels is None:
        return components(found.select(F.col("ka").alias("a"), F.col("kb").alias("b")), scratch).select(F.col("node").alias("key"), "label")
    of = lambda key, label: labels.select(F.col("key").alias(key), F.col("label").alias(label))
    ends = found.join(of("ka", "la"), "ka", "left").join(of("kb", "lb"), "kb", "left").select(F.coalesce("la", "ka").alias("a"), F.coalesce("lb", "kb").alias("b"))
    moved = components(ends.filter("a <> b").distinct(), scratch).select("node", "label")
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    new = moved.withColumnRenamed("node", "key").join(labels.select("key"), "key", "left_anti")
    return scratch.written(old.union(new), "ngram-labels")


def _linked(blocks: DataFrame, pairs: DataFrame, n_blocks: int, words: int, num: int, den: int) -> DataFrame:
    """Of pairs (ka, kb) of keys, those whose whole sets are near. Sets come from the blocks that hold them."""
    wanted = pairs.select(F.col("ka").alias("key")).union(pairs.select("kb")).distinct().withColumn("block", F.pmod("key", F.lit(n_blocks)).cast("long"))
    sets = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_sets(words), "key long, items binary")
    left = sets.select(F.col("key").alias("ka"), F.col("items").alias("items_a"))
    right = sets.select(F.col("key").alias("kb"), F.col("items").alias("items_b"))
    both = pairs.join(left, "ka").join(right, "kb").select("ka", "kb", "items_a", "items_b")
    return both.mapInArrow(_verified(num, den), "ka long, kb long")


#: For DuckDB. Every shingle is compared as text and every linked pair is listed.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
same AS (SELECT list_sort(s) AS s, count(*) AS class_size FROM sets WHERE len(s) > 0 GROUP BY 1)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(class_size, 1) AS BIGINT) AS class_size
FROM sets JOIN low USING (doc_id) LEFT JOIN same ON same.s = list_sort(sets.s)
"""


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_links(docs.select("doc_id", "text"))
