"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a whitespace marker after another character, so merges never cross from a
character to a marker: each marked word (its markers and what follows them) is segmented on its own, and
its ids are joined back by position. A line feed that no piece holds parts chunks in the same way.
Each worker keeps a bounded table of the chunks it has met; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkTable, gathered, give_back, kept_in_process, lean, text_slices, tuned

MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_SLICE = 2 << 20
#: Chunks that a worker's table holds: some 100 MB.
MOST_CHUNKS = 400_000


class _Segmenter:
    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        self.lines = not any("\n" in p for p in pieces)
        probe = " \n  a"
        if sp.decode(sp.encode(probe)) != probe or sp.id_to_piece(sp.encode("\n")[0]) != _MARK:
            raise ValueError("this model does not keep white space or adds no marker in front")
        self.table = ChunkTable(self._segment, MOST_CHUNKS)

    def _segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, ids of each chunk, and whether they decode to it. The library puts a marker before what it
        encodes: a chunk with a marker of its own leaves that one to it, the others drop the added one."""
        texts = [c.decode() for c in chunks]
        marked = [t.startswith(" ") for t in texts]
        ids = self.sp.encode([t[1:] if m else t for t, m in zip(texts, marked, strict=True)], num_threads=1)
        ids = [(x or [self.sp.piece_to_id(_MARK)]) if m else x[1:] for x, m in zip(ids, marked, strict=True)]
        back = self.sp.decode(ids)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        plain = [(" " + b if m else b) == t for b, t, m in zip(back, texts, marked, strict=True)]
        return np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths, np.array(plain, dtype=bool)

    def run(self, texts: pa.Array) -> Iterator[tuple[list[bytes], list[str]]]:
        """(ids as little-endian 32-bit numbers with begin and end, decoded text) of the texts, slice by slice."""
        bos, eos = (np.array([x], dtype="<u4").tobytes() for x in (self.sp.bos_id(), self.sp.eos_id()))
        for first, end, data, offsets in text_slices(texts, _SLICE):
            lengths = np.diff(offsets)
            own = data.tobytes()
            rows = [own[offsets[k] : offsets[k + 1]].replace(_MARK.encode(), b" ") for k in range(end - first)]
            blob = np.frombuffer(b"".join(b" " + r for r in rows if r), np.uint8)
            sizes = np.array([len(r) + bool(r) for r in rows], dtype=np.int64)
            at = np.cumsum(sizes) - sizes
            if not len(blob):
                yield [bos + eos] * len(rows), [""] * len(rows)
                continue
            opens = blob == 32
            opens[1:] &= blob[:-1] != 32
            if self.lines:
                breaks = blob == 10
                breaks[1:] &= blob[:-1] != 10
                opens |= breaks
            opens[at[lengths > 0]] = True
            starts = np.flatnonzero(opens)
            found = self.table.lookup(blob, starts)
            ids = gathered(self.table.ids, self.table.offsets[found], self.table.lengths[found]).astype("<u4").tobytes()
            bounds = np.searchsorted(starts, np.append(at, len(blob)))
            tokens = np.concatenate(([0], np.cumsum(self.table.lengths[found])))[bounds] * 4
            exact = np.concatenate(([0], np.cumsum(~self.table.plain[found])))[bounds]
            out_ids, out_texts = [], []
            for k, row in enumerate(rows):
                mine = ids[tokens[k] : tokens[k + 1]]
                out_ids.append(bos + mine + eos)
                same = exact[k] == exact[k + 1]  # then the decoded chunks are the chunks
                out_texts.append(row.decode() if same else self.sp.decode(np.frombuffer(mine, "<u4").tolist()))
            yield out_ids, out_texts


def sentencepiece_round_trip(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",), compare: bool = False) -> DataFrame:
    """The columns `keep` of docs with `ids` (binary: little-endian unsigned 32-bit, with begin and end ids) and `decoded`;
    with `compare`, `same` (whether decoding gives the text itself, null counting as empty) in place of the decoded text.

    Ids are those of the sentencepiece library without sampling, `decoded` what its decode gives for them. A null
    text counts as empty: begin and end id, and an empty text. Rows may repeat; an empty table gives no rows.
    `model` is a file that every executor has; further columns of docs are dropped.
    """
    path = model or public_tokenizers.path(MODEL)
    chosen = tuned(docs).select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segmenter = kept_in_process(f"pieces {path}", lambda: _Segmenter(path))
            first = 0
            for ids, texts in segmenter.run(batch.column("__text")):
                part = batch.slice(first, len(ids)).drop_columns(["__text"])
                last = pa.array(texts, pa.string())
                if compare:
                    last = pc.equal(batch.column("__text").slice(first, len(ids)).fill_null(""), last)
                first += len(ids)
                columns = [*part.columns, pa.array(ids, pa.binary()), last]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "ids", "same" if compare else "decoded"])
            give_back()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name != "__text")
    return chosen.mapInArrow(lean(run), f"{kept}, ids binary, " + ("same boolean" if compare else "decoded string"))


def digests(encoded: DataFrame) -> DataFrame:
    """The query's columns from a round trip's ids and texts."""
    return encoded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(sentencepiece_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet")))
