"""Trajectories in raw files of doubles: one with coefficients, [step, order + 1, 7] for each object in turn, one with times, n_steps + 1 each.

A table says where each object's coefficients begin: (obj_idx, offset, n_steps, status), obj_idx from 0, offset in doubles. Spark checks
it, cuts objects into ranges of steps, and tasks read these, a batch of bounded rows at a time. Paths are local ones that all executors
mount, or addresses of a file system that Arrow opens (hdfs://, s3://, gs://, file://).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime, schema

#: Steps of one range: what a task holds at a time, and how finely an object of many steps is dealt.
RANGE_STEPS = 4096
_BLOCK = 4096
_WIDTH = len(schema.COORDS)
_SEGMENTS = pa.schema([("obj_idx", pa.int64()), ("step_idx", pa.int32()), ("t_begin", pa.float64()), ("t_end", pa.float64())] + [(c, pa.list_(pa.float64())) for c in schema.COORDS])


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def n_doubles(path: str) -> float:
    """How many doubles a file holds; not a whole number if it is cut short."""
    where, name = _file(path)
    size = where.get_file_info(name).size
    if size is None:
        raise FileNotFoundError(path)
    return size / 8


def placed(table: DataFrame, order: int) -> DataFrame:
    """The table with what its offsets have to be (`expected`), and where times begin (`time_offset`).

    Sums run over blocks of objects and over the blocks' totals, so that no task sees all objects.
    """
    steps = F.coalesce(F.col("n_steps"), F.lit(0)).cast("long")
    rows = table.select(F.col("obj_idx").cast("long"), F.col("offset").cast("long"), F.col("n_steps").cast("long"), F.col("status").cast("int"))
    rows = rows.withColumns({"_size": steps * (order + 1) * _WIDTH, "_times": F.when(steps > 0, steps + 1).otherwise(0), "_block": F.floor(F.col("obj_idx") / _BLOCK)})
    totals = rows.groupBy("_block").agg(F.sum("_size").alias("s"), F.sum("_times").alias("t"))
    blocks = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", *(F.coalesce(F.sum(c).over(blocks), F.lit(0)).alias(f"_{c}0") for c in "st"))
    inside = Window.partitionBy("_block").orderBy("obj_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = {to: F.col(base) + F.coalesce(F.sum(c).over(inside), F.lit(0)) for to, base, c in (("expected", "_s0", "_size"), ("time_offset", "_t0", "_times"))}
    return rows.join(totals, "_block").select("obj_idx", "offset", "n_steps", "status", "_size", "_times", *(v.alias(k) for k, v in at.items()))


def broken_offsets(table: DataFrame, order: int, n_values: float, n_times: float) -> list[str]:
    """The rules that a table of offsets breaks, from one pass over it; one row comes to the driver."""
    odd = lambda c: F.coalesce(c, F.lit(True)).cast("int")
    facts = placed(table, order).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("obj_idx").alias("ids"),
        F.max("obj_idx").alias("last"),
        F.min("obj_idx").alias("first"),
        F.sum(odd(F.col("n_steps") < 0)).alias("negative"),
        F.sum(odd(F.col("offset") != F.col("expected"))).alias("moved"),
        F.sum("_size").alias("size"),
        F.sum("_times").alias("times"),
    ).first()
    rules = {
        "a table has one object at least": facts["n"] > 0,
        "objects are numbered from 0, once each": facts["n"] == 0 or (facts["ids"] == facts["n"] and (facts["first"], facts["last"]) == (0, facts["n"] - 1)),
        "no negative or missing numbers of steps": not facts["negative"],
        "offsets have to begin at 0 and be contiguous": not facts["moved"],
        "file sizes have to match the offsets": (facts["size"] or 0, facts["times"] or 0) == (n_values, n_times),
    }
    return [rule for rule, kept in rules.items() if not kept]


def segments(spark: SparkSession, table: DataFrame, traj: str, time: str, order: int, range_steps: int = RANGE_STEPS) -> DataFrame:
    """The segments of all objects of a table that broken_offsets() finds nothing in.

    Ranges are dealt evenly, whatever the objects' lengths.
    """
    runtime.ready(spark)
    width = (order + 1) * _WIDTH

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = []
        for path in (traj, time):
            where, name = _file(path)
            files.append(where.open_input_file(name))
        for b in batches:
            for i, k, n, c0, t0 in zip(*(b.column(c).to_pylist() for c in ("obj_idx", "first", "n", "value", "time")), strict=True):
                c = np.frombuffer(files[0].read_at(8 * n * width, 8 * c0)).reshape(n, order + 1, _WIDTH)
                t = np.frombuffer(files[1].read_at(8 * (n + 1), 8 * t0))
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * (order + 1))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(c[:, :, d]).ravel())) for d in range(_WIDTH)]
                ids = [pa.array(np.full(n, i, np.int64)), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array(t[:-1]), pa.array(t[1:])]
                yield pa.RecordBatch.from_arrays(ids + lists, schema=_SEGMENTS)
        for f in files:
            f.close()

    rows = placed(table, order).filter("n_steps > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_steps") - 1, F.lit(range_steps).cast("long"))))
    rows = rows.select("obj_idx", "first", F.least(F.lit(range_steps), F.col("n_steps") - F.col("first")).alias("n"), (F.col("offset") + F.col("first") * width).alias("value"), (F.col("time_offset") + F.col("first")).alias("time"))
    return rows.repartition("obj_idx", "first").mapInArrow(read, schema.SEGMENTS)
