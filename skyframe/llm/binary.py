"""Token-ID output in patched frame-of-reference blocks.

A shard (one range of document ids, one task) is a run of chunks; a chunk holds the ids of whole documents, a few hundred
thousand at a time, and is a row of a Parquet table that Spark writes and commits, so that retried tasks and remote stores are
no special case. Its payload is self-contained:

    magic "PFR1", u32 n_ids, u32 block length, u32 n_blocks
    u32 minimum of each block, u8 width of each block, u32 number of exceptions of each block
    u32 start of each block's words (the index; one more entry for the end)
    the packed words of all blocks, then u16 positions and u32 high parts of all exceptions

Ids lose their block's minimum and keep `width` low bits, with width the smallest that fits the block's `percentile` of ids; what
does not fit leaves its high bits in the exceptions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"PFR1"
LANES = 32  # so many ids of width w fill w 32-bit words
END_ID = 2
U32 = np.dtype("<u4")


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """v: (n, 32) ids below 2**width; returns (n, width) words."""
    out = np.zeros((len(v), width), np.uint64)
    for lane in range(LANES):
        word, shift = divmod(lane * width, 32)
        wide = v[:, lane].astype(np.uint64) << np.uint64(shift)
        out[:, word] |= wide & np.uint64(0xFFFFFFFF)
        if shift + width > 32:
            out[:, word + 1] |= wide >> np.uint64(32)
    return out.astype(U32)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _pack."""
    out = np.empty((len(words), LANES), np.uint64)
    wide, mask = words.astype(np.uint64), np.uint64((1 << width) - 1)
    for lane in range(LANES):
        word, shift = divmod(lane * width, 32)
        v = wide[:, word] >> np.uint64(shift)
        if shift + width > 32:
            v = v | wide[:, word + 1] << np.uint64(32 - shift)
        out[:, lane] = v & mask
    return out.astype(U32)


def pack_ids(ids: np.ndarray, block: int = 1024, percentile: float = 0.95) -> bytes:
    """The payload of these ids. block: a multiple of 32, at most 65536."""
    n, ids = len(ids), np.ascontiguousarray(ids, U32)
    n_blocks = -(-n // block)
    rows = np.empty(n_blocks * block, U32)
    rows[:n] = ids
    rows[n:] = ids[-1] if n else 0
    rows = rows.reshape(n_blocks, block)
    low = rows.min(axis=1) if n else np.zeros(0, U32)
    rows = rows - low[:, None]
    bits = np.frexp(rows.astype(np.float64))[1].astype(np.uint8)
    at = min(block - 1, int(percentile * block))
    width = np.maximum(np.partition(bits, at, axis=1)[:, at], 1) if n else np.zeros(0, np.uint8)
    odd = bits > width[:, None]
    n_odd = odd.sum(axis=1).astype(U32)
    where = np.nonzero(odd)
    high = (rows[where] >> width[where[0]].astype(U32)).astype(U32)
    lengths = width.astype(np.int64) * (block // LANES)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    words = np.empty(int(starts[-1]), U32)
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        kept = rows[of] & np.uint32(((1 << w) - 1) & 0xFFFFFFFF)
        packed = _pack(kept.reshape(-1, LANES), w).reshape(len(of), -1)
        words[(starts[of][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    head = np.array([n, block, n_blocks], U32).tobytes()
    return b"".join([MAGIC, head, low.tobytes(), width.tobytes(), n_odd.tobytes(), starts.astype(U32).tobytes(), words.tobytes(), where[1].astype("<u2").tobytes(), high.tobytes()])


class Payload:
    """Reads a payload, whole or by block."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a patched frame-of-reference payload")
        self.n, self.block, k = np.frombuffer(raw, U32, 3, 4).tolist()
        at = 16
        self.low = np.frombuffer(raw, U32, k, at)
        self.width = np.frombuffer(raw, np.uint8, k, at := at + 4 * k)
        self.n_odd = np.frombuffer(raw, U32, k, at := at + k)
        self.starts = np.frombuffer(raw, U32, k + 1, at := at + 4 * k).astype(np.int64)
        self.words = np.frombuffer(raw, U32, int(self.starts[-1]), at := at + 4 * k + 4)
        odd = int(self.n_odd.sum())
        self.position = np.frombuffer(raw, "<u2", odd, at := at + 4 * len(self.words))
        self.high = np.frombuffer(raw, U32, odd, at + 2 * odd)
        self.odd_starts = np.concatenate([[0], np.cumsum(self.n_odd, dtype=np.int64)])

    def blocks(self, of: np.ndarray) -> np.ndarray:
        """The ids of these blocks, a row each; the last block of a payload is padded."""
        out = np.empty((len(of), self.block), U32)
        for w in np.unique(self.width[of]).tolist():
            here = np.flatnonzero(self.width[of] == w)
            words = self.words[self.starts[of[here]][:, None] + np.arange(w * (self.block // LANES))]
            out[here] = _unpack(words.reshape(-1, w), w).reshape(len(here), -1)
        for row, b in enumerate(of.tolist()):
            at = slice(*self.odd_starts[b : b + 2])
            out[row, self.position[at]] |= self.high[at] << np.uint32(self.width[b])
        return out + self.low[of][:, None]

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin to end, from the blocks that hold them."""
        end = self.n if end is None else min(end, self.n)
        if begin >= end:
            return np.zeros(0, U32)
        first = begin // self.block
        rows = self.blocks(np.arange(first, -(-end // self.block)))
        return rows.ravel()[begin - first * self.block : end - first * self.block]


_CHUNK = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
CHUNK_DDL = "shard int, chunk long, shard_start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_token_files(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, vocabulary: str | None = None, chunk_ids: int = 1 << 18, block: int = 1024, percentile: float = 0.95) -> None:
    """Encodes every whole text, appends end_id and writes the ids in ascending doc_id order to `path`.

    Null texts count as empty; null ids come first; rows of one id stand together, ordered by text; other columns don't matter.
    A chunk holds chunk_ids ids, or one document if that is longer.
    """
    common.ready(docs.sparkSession)
    end = np.array([end_id], U32).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, chunk, start = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        held: list[bytes] = []
        lengths: list[int] = []

        def row(k: int, start: int) -> pa.RecordBatch:
            values = [shard], [k], [start], [sum(lengths)], [ids], [lengths], [pack_ids(np.frombuffer(b"".join(held), U32), block, percentile)]
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, _CHUNK, strict=True)], schema=_CHUNK)

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = enc(b) + end
                    ids.append(i)
                    held.append(raw)
                    lengths.append(len(raw) // 4)
                    size += lengths[-1]
                    if size >= chunk_ids:
                        yield row(chunk, start)
                        chunk, start, size = chunk + 1, start + size, 0
                        ids, held, lengths = [], [], []
        if ids:
            yield row(chunk, start)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.utf8(F.col(text)).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, CHUNK_DDL).write.parquet(path)


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _chunks(df: DataFrame) -> DataFrame:
    """The chunks with the number of ids before each: one total per shard, so the broadcast has a row per file written."""
    totals = df.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("shard", before.alias("shard_base"))
    return df.join(F.broadcast(bases), "shard").withColumn("base", F.col("shard_base") + F.col("shard_start"))


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents of the files at `path`, with ids as an array."""
    common.ready(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def decode(batch: pa.RecordBatch) -> Iterator[tuple]:
        for base, docs, lengths, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            ids, at = Payload(raw).ids(), 0
            for i, n in zip(docs, lengths, strict=True):
                yield i, base + at, ids[at : at + n].astype(np.int64)
                at += n

    rows = _chunks(spark.read.schema(CHUNK_DDL).parquet(path)).select("base", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(common.arrow_rows(decode, schema, 1), "doc_id long, start long, ids array<long>")


def token_file_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of the files at `path`."""
    common.ready(spark)

    def decode(batch: pa.RecordBatch) -> Iterator[tuple]:
        for base, docs, lengths, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            ids, at = memoryview(Payload(raw).ids().tobytes()), 0
            for i, n in zip(docs, lengths, strict=True):
                yield i, base + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])
                at += n

    rows = _chunks(spark.read.schema(CHUNK_DDL).parquet(path)).select("base", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(common.arrow_rows(decode, _READ, 1), "doc_id long, start long, n_tokens long, ids_crc32 long")
