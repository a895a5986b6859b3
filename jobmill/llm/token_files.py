"""Token ids in files: frequency-ranked ids, one or two bytes each, with the control bits apart.

An id's rank by corpus frequency takes 1 to 4 bytes; two control bits an id say how many, four ids to a
control byte, and all control bytes of a block stand before its data. A block holds whole documents in
ascending doc_id order; a file's rows are blocks, and files follow each other in that order too. The files are Parquet files that
Spark commits, so they live wherever Spark writes and a lost task leaves nothing behind; the ids in the order of their ranks lie beside them. Decoding looks lengths
up by control byte in a table of 256 rows and gathers the data bytes, all in numpy.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ChunkTable, count_rows, gathered, kept_in_process, larger, lean, scratch_dir, summed_counts, text_slices, tuned, written

VOCABULARY = "byte_bpe_50k.json"
END = 0
BLOCK_TOKENS = 1 << 17
PARTS = 16
_SLICE = 8 << 20
_LENGTHS = np.array([[(c >> (2 * i)) % 4 + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[33:127] = ~_LETTER[33:127]
_PUNCTUATION[48:58] = False
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray, special: bool) -> np.ndarray:
    """Where chunks begin that the byte-level pattern never joins: white space after a visible character, and
    ASCII punctuation after an ASCII letter (not where a text holds the special token, which has both)."""
    opens = np.zeros(len(data), dtype=bool)
    last = data[:-1]
    after = _VISIBLE[last] | (last >= 128)
    # A character of two or three bytes that may be white space: no cut behind it.
    after[1:] &= ~((last[1:] >= 128) & (last[:-1] == 0xC2))
    after[2:] &= ~((last[2:] >= 128) & (last[:-2] >= 0xE1) & (last[:-2] <= 0xE3))
    opens[1:] = _SPACE[data[1:]] & after
    if not special:
        opens[1:] |= _PUNCTUATION[data[1:]] & _LETTER[last]
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(opens)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = lengths - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | (quads[:, 1] << 2) | (quads[:, 2] << 4) | (quads[:, 3] << 6)
    kept = np.arange(4, dtype=np.uint8) < lengths[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = lengths > k
        if more.any():
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class _Coder:
    """Chunks to ids by the library. Single words go to it many at a time, a line each: the pattern makes every line
    feed a token of its own and parts there, so the ids between two line feeds are those of the word alone."""

    LINES = 20_000

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.specials = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        feed = tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.table = ChunkTable(self.encode)

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [c.decode() for c in chunks]
        parts: list[np.ndarray | None] = [None] * len(texts)
        words = [k for k, t in enumerate(texts) if self.feed is not None and len(t.split()) == 1 and not t[-1].isspace() and (t[0] == " " or not t[0].isspace()) and not t[1:2].isspace()]
        for lo in range(0, len(words), self.LINES):
            some = words[lo : lo + self.LINES]
            ids = np.array(self.tokenizer.encode("\n".join([texts[k] for k in some]), add_special_tokens=False).ids, dtype=np.uint32)
            lines = np.split(ids, np.flatnonzero(ids == self.feed))
            if len(lines) == len(some):
                for j, (k, line) in enumerate(zip(some, lines, strict=True)):
                    parts[k] = line[1:] if j else line
        rest = [k for k, p in enumerate(parts) if p is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
            parts[k] = np.array(e.ids, dtype=np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), lengths, np.ones(len(parts), dtype=bool)


def token_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, n, ids) for the documents, and rows (part, counts) with each task's counts of ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = kept_in_process(f"bytes {vocabulary}", lambda: _Coder(Tokenizer.from_file(vocabulary)))
        size, specials, table = coder.size, coder.specials, coder.table
        width = "<u2" if size <= 1 << 16 else "<u4"
        total = np.zeros(size, dtype=np.int64)
        for batch in larger(batches, _SLICE):
            for first, end, data, offsets in text_slices(batch.column("text"), 2 * _SLICE):
                own = data.tobytes()
                starts = chunk_starts(data, offsets, any(s in own for s in specials)) if len(data) else np.zeros(0, np.int64)
                found = table.lookup(data, starts) if len(starts) else starts
                lengths = table.lengths[found]
                ids = gathered(table.ids, table.offsets[found], lengths)
                total += np.bincount(ids, minlength=size)
                total[END] += end - first
                bounds = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets)]
                counts = np.diff(bounds) + 1
                raw, last = ids.astype(width), np.array([END], dtype=width)
                rows = [np.concatenate((raw[bounds[k] : bounds[k + 1]], last)).tobytes() for k in range(end - first)]
                part = batch.column("doc_id").slice(first, end - first)
                none = pa.nulls(end - first)
                yield pa.RecordBatch.from_arrays([part, pa.array(counts), pa.array(rows, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if total.any():
            none = pa.nulls(1)
            for part, counts in count_rows(total, PARTS):
                yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), part, counts], schema=schema)

    chosen = tuned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(lean(run), "doc_id long, n long, ids binary, part int, counts binary")


def write_token_files(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> str:
    """Writes the files for docs (doc_id, text; more columns are ignored) and returns their folder, `path` or a new one in the shared folder.

    `blocks` in it holds the coded ids, `ranks` one row with the id of each rank, so that the folder can be read by itself.
    Every text ends in the id END; a null text is empty. Rows with a null doc_id come first, rows that repeat
    a doc_id in the order of their ids. An empty table gives no blocks.
    """
    from tokenizers import Tokenizer

    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    size = Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True)
    wide = size > 1 << 16
    encoded = written(token_ids(docs, vocabulary), "token-ids")
    counts = summed_counts(encoded.filter("part is not null"), size, PARTS)
    order = np.lexsort((np.arange(size), -counts)).astype(np.uint32)
    rank = np.empty(size, dtype=np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, block = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        docs: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal start, block
            sizes = [len(x) // (4 if wide else 2) for x in ids]
            ranks = rank[np.frombuffer(b"".join(ids), "<u4" if wide else "<u2")]
            control, data = encode_block(ranks)
            row = {"shard": shard, "block": block, "start": start, "n": len(ranks), "doc_ids": list(docs), "sizes": sizes, "control": control, "data": data}
            start, block = start + len(ranks), block + 1
            ids.clear()
            docs.clear()
            return pa.RecordBatch.from_pylist([row], schema=block_schema)

        held = 0
        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc_id)
                ids.append(x)
                held += len(x)
                if held >= 2 * BLOCK_TOKENS:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    block_schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]
    )
    rows = encoded.filter("n is not null").select("doc_id", "ids")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(run, "shard int, block int, start long, n long, doc_ids array<long>, sizes array<long>, control binary, data binary")
    path = path or f"{scratch_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    docs.sparkSession.createDataFrame([(order.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files of a folder; ids are little-endian unsigned 32-bit.

    What is broadcast is a row of two numbers for each file, of which there are no more than shuffle partitions, and 4 bytes for each id of the vocabulary.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    order = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()["ids"], "<u4")
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = order[decode_block(row["control"], row["data"], row["n"])].astype("<u4")
                sizes = np.array(row["sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                raw = ids.tobytes()
                values = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                first = row["base"] + row["start"]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(F.broadcast(base), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
