"""What the operators share: scratch tables, word counting, Arrow task helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.split() without arguments cuts at exactly these six characters.
SPACES = b" \t\n\x0b\x0c\r"
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64m", "64MB")
#: The paths made in each open block of passing(), from the outermost in; every thread has blocks of its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
_ROOT = str(Path(__file__).resolve().parents[2])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one where that is unset and the master is local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_skyframe_scratch", None)
    if own is None:
        own = spark.sparkContext._skyframe_scratch = tempfile.mkdtemp(prefix="skyframe-")
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below scratch_root."""
    return f"{scratch_root(spark).rstrip('/')}/skyframe/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, which cuts its lineage: lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if scopes := _scopes.get():
        scopes[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._skyframe_path = path
    return table


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """The tables that materialise() makes in this block are deleted when it ends; not those given to the function that it hands out, which go to the block around it."""
    made: list[str] = []
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._skyframe_path)
        return table

    outer = _scopes.get()
    _scopes.set((*outer, made))
    try:
        yield keep
    finally:
        _scopes.set(outer)
        if outer:
            outer[-1].extend(kept)
        _delete(spark, [p for p in made if p not in kept])


def remove(table: DataFrame) -> None:
    """Deletes the files of a table of materialise() that nothing reads any more."""
    _delete(table.sparkSession, [table._skyframe_path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package whatever the driver's working directory is, and get texts in small batches.

    Batches are a few MB instead of Spark's default of 64, as a task holds one on both sides; a session's own setting stays.
    """
    if spark.conf.get(_BATCH, None) in _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "4m")
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    """A text's bytes, empty for null: what the Arrow tasks take."""
    return F.coalesce(text, F.lit("")).cast("binary")


def arrow_rows(
    rows: Callable[[pa.RecordBatch], Iterator[tuple]], schema: pa.Schema, many: int = 256
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that hands over slices of few rows, so that memory holds few texts, and packs the tuples it gets back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, many):
                out = list(rows(batch.slice(at, many)))
                if out:
                    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def byte_table(separators: bytes | range, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, whether it belongs to a word, and what stands for it in the word (A-Z lower-cased on request)."""
    solid, as_is = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    solid[list(separators)] = False
    if lower:
        as_is[65:91] += 32
    return solid, as_is


def word_table(texts: pa.Array, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """The words of a batch of UTF-8 texts (binary, without nulls) in order: the position of each one's text, and the words as bytes.

    Works on the batch's bytes as a whole, without an object for each word; separators are ASCII, so that no character is cut.
    """
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    solid = table[0][raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[ends] = True
    begins[1:-1] |= ~solid[:-1]
    begins[-1] = True
    first = np.flatnonzero(solid & begins[:-1])
    after = np.ones(len(raw), bool)
    after[:-1] = ~solid[1:]
    last = np.flatnonzero(solid & (after | _borders(ends, len(raw))))
    starts = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(starts), pa.py_buffer(table[1][raw[solid]])])
    return np.searchsorted(ends, first, side="right") - 1, words


def small_batches(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose texts have about `most` bytes together, a row at least; a worker that waits keeps no freed memory."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy()
        part = np.cumsum(lengths, dtype=np.int64) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if low < high:
                yield b.slice(low, high - low)
        pa.default_memory_pool().release_unused()


def _borders(ends: np.ndarray, n: int) -> np.ndarray:
    """Whether a text ends behind each of n bytes."""
    out = np.zeros(n, bool)
    out[ends[ends > 0] - 1] = True
    return out


def merged_runs(tables: Iterable[pa.Table], keys: list[str], sums: list[str], most: int = 100_000) -> Iterator[pa.Table]:
    """The tables with rows of equal keys added up, as far as they meet within about `most` rows: a combiner of bounded memory."""

    def merge(held: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
        return pa.table({c: found[c] for c in keys} | {c: found[f"{c}_sum"] for c in sums})

    held, rows = [], 0
    for t in tables:
        held.append(t)
        rows += t.num_rows
        if rows > most:
            one = merge(held)
            held, rows = [one], one.num_rows
            if rows > most // 2:
                yield one
                held, rows = [], 0
    if held:
        yield merge(held)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
