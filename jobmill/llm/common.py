"""Pieces the training-data operators share: scratch tables and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The words of the contracts: runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a task turns into numpy arrays at a time; a longer text goes alone.
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local master, where all run on one machine; else an error."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="jobmill-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Spark's own file systems; a folder that is gone is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that Spark hands to Python at a time: texts are long, so far fewer than Spark's own 10,000.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tuned(df: DataFrame) -> DataFrame:
    """df, its session set to hand small batches to Python where it still has Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, "10000") == "10000":
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Hands freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """A task's generator that gives freed memory back to the system when it ends: workers live on and share the executor's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def larger(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there, and a lost executor loses nothing."""
    spark = tuned(df).sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that only a part of a job needs: written like written()'s, and deleted when the part is done.

        with Scratch(spark) as scratch:
            pairs = scratch.written(df, "pairs")
            again = scratch.written(pairs.filter(...), "again")
            scratch.drop(pairs)
            result = written(again..., "result")  # stays
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.tables: list[tuple[str, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        for df, _ in list(self.paths.values()):
            self.drop(df)
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, path)

    def _path(self, name: str) -> str:
        return f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = self._path(name)
        tuned(df).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def bucketed(self, df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
        """df, which is dealt by `column` over so many partitions, as a table in buckets: joins and groups on that column don't shuffle it again."""
        path = self._path(name)
        table = "jobmill_" + path.rpartition("/")[2].replace("-", "_")
        tuned(df).write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(buckets, column).saveAsTable(table)
        self.tables.append((table, path))
        return self.spark.table(table)

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if df is not None and id(df) in self.paths:
                removed(self.spark, self.paths.pop(id(df))[1])


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (the one of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        yield i, j, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


#: A second way to cut words: ASCII letters and digits and all bytes beyond ASCII stand in words.
MARKS = np.ones(256, dtype=bool)
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = MARKS[128:] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, gap: np.ndarray = _GAP, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """(64-bit hash of each word, number of words of each text) of texts laid end to end; bytes in `gap` part words.

    A word's hash is a sum of random byte values times powers of an odd base, taken from running
    sums modulo 2**64, so that no step loops over words.
    """
    n = len(offsets) - 1
    if not len(data):
        return (np.zeros(0, np.uint64), np.zeros(n, np.int64), np.zeros(0, np.uint64))[: 2 + bool(prefix)]
    if lower:
        data = _LOWER[data]
    word = ~gap[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    opens[inner] = word[inner]
    starts = np.flatnonzero(opens)
    powers = np.full(len(data), _BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(np.where(word, _BYTE[data], np.uint64(0)) * powers, out=sums[1:])
    # Up to the next start there are only this word's bytes and gaps, which count as zero.
    after = np.append(starts[1:], len(data))
    inverse = np.full(len(data), _BASE_INV, dtype=np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    hashes = mix((sums[after] - sums[starts]) * inverse[starts])
    counts = np.diff(np.searchsorted(starts, offsets))
    if not prefix:
        return hashes, counts
    inside = np.minimum(starts + prefix, after)
    return hashes, counts, mix((sums[inside] - sums[starts]) * inverse[starts] + np.uint64(prefix))


COUNT_SCHEMA = "part int, counts binary"


def count_rows(total: np.ndarray, parts: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(part, counts) of a task's counters, one of `parts` equal ranges at a time. A range's first byte is the width of its counters."""
    size = -(-len(total) // parts)
    for k in range(parts):
        own = total[k * size : (k + 1) * size]
        width = next(w for w in (1, 2, 4, 8) if int(own.max(initial=0)) < 1 << (8 * w - 1))
        padded = np.zeros(size, dtype=f"<i{width}")
        padded[: len(own)] = own
        yield pa.array([k], pa.int32()), pa.array([bytes([width]) + padded.tobytes()], pa.binary())


def summed_counts(rows: DataFrame, size: int, parts: int) -> np.ndarray:
    """The sum of all tasks' count_rows: `size` counters, whatever the input. Ranges are summed apart, one batch at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, f"<i{counts[0]}", offset=1).astype(np.int64)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["part", "counts"])

    out = np.zeros((parts, -(-size // parts)), dtype=np.int64)
    for part, counts in rows.select("part", "counts").repartition(parts, "part").mapInArrow(add, COUNT_SCHEMA).collect():
        out[part] = np.frombuffer(counts, "<i8")
    return out.reshape(-1)[:size]


def gathered(values: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs values[offsets[i] : offsets[i] + lengths[i]], laid end to end."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = np.repeat(offsets - (np.cumsum(lengths) - lengths), lengths)
    return values[shift + np.arange(total)]


def kept_in_process(name: str, make):
    """What make() gave in this Python process before, for tasks that share a worker; functions themselves come anew with each task."""
    holder = sys.modules.setdefault("_jobmill_kept", types.ModuleType("_jobmill_kept"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


class ChunkTable:
    """Distinct chunks of text with the ids that a tokenizer gives each: what was met before is looked up.

    `encode` turns a list of chunks (bytes) into (all ids, ids of each chunk, whether each decodes to itself). The table is dropped and begun
    anew beyond `most` chunks or MOST_BYTES, so that a worker's memory has a bound whatever it reads: some ENTRY_BYTES a chunk besides its text.
    """

    MOST_BYTES = 40 << 20
    #: A dictionary's slot, a bytes object, a number and the arrays' share.
    ENTRY_BYTES = 240

    def __init__(self, encode, most: int = 1_500_000) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held = 0
        self.used = self.rows = 0
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.offsets = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)
        self.plain = np.zeros(1 << 14, dtype=bool)

    @staticmethod
    def _grown(a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros(max(need, len(a) + len(a) // 2), dtype=a.dtype)
        out[: len(a)] = a
        return out

    def lookup(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The table's row of each chunk that begins at `starts` and runs to the next, or to the end."""
        if len(self.at) > self.most or self.held > self.MOST_BYTES:
            self.clear()
        ends = np.append(starts, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh = [distinct[k] for k in missing]
            ids, lengths, plain = self.encode(fresh)
            rows, used = self.rows + len(fresh), self.used + len(ids)
            self.ids = self._grown(self.ids, used)
            self.offsets, self.lengths, self.plain = (self._grown(a, rows) for a in (self.offsets, self.lengths, self.plain))
            self.ids[self.used : used] = ids
            self.offsets[self.rows : rows] = self.used + np.cumsum(lengths) - lengths
            self.lengths[self.rows : rows] = lengths
            self.plain[self.rows : rows] = plain
            found[missing] = np.arange(self.rows, rows)
            self.at.update(zip(fresh, range(self.rows, rows), strict=True))
            self.held += sum(map(len, fresh))
            self.rows, self.used = rows, used
        return found[coded.indices.to_numpy(zero_copy_only=False)]
