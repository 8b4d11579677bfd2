"""Positions and velocities of many objects at many times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import runtime, schema
from ..functions import poly


#: A time range holds so many of the longest segments.
RANGE = 64


def range_width(segments: DataFrame) -> DataFrame:
    """One row: the width of a time range."""
    return segments.agg(F.coalesce(RANGE * F.max(F.col("t_end") - F.col("t_begin")), F.lit(1.0)).alias("_width"))


def _place(t: str) -> Column:
    return F.floor(F.col(t) / F.col("_width"))


def _points(wanted: DataFrame, width: DataFrame) -> DataFrame:
    """(_key, _range, _t, _p): each row of wanted as a struct, with its object and time range. A time that isn't finite is an error."""
    bad = F.isnull("t") | F.isnan("t") | (F.abs(F.col("t")) == float("inf"))
    t = F.when(bad, F.raise_error(F.lit("evaluation times have to be finite"))).otherwise(F.col("t")).cast("double")
    rows = wanted.select(F.col("obj_idx").alias("_key"), t.alias("_t"), F.struct(*wanted.columns).alias("_p"))
    return rows.join(F.broadcast(width)).withColumn("_range", _place("_t")).drop("_width")  # one row on the right


def _begun(segments: DataFrame, width: DataFrame) -> DataFrame:
    """(_key, _range, _t, _since, _until, _s): each segment as a struct, once for every time range that it touches; _t: where it begins in the range; _since, _until: its ends."""
    rows = segments.select(F.col("obj_idx").alias("_key"), "t_begin", "t_end", *schema.COORDS).join(F.broadcast(width))
    rows = rows.withColumn("_range", F.explode(F.sequence(_place("t_begin"), _place("t_end"))))
    t = F.greatest("t_begin", F.col("_range") * F.col("_width"))
    return rows.select("_key", "_range", t.alias("_t"), F.col("t_begin").alias("_since"), F.col("t_end").alias("_until"), F.struct("t_begin", "t_end", *schema.COORDS).alias("_s"))


def _states(met: DataFrame, order: int) -> DataFrame:
    """The columns of _p and the seven variables that _s has at _t, NaN without one."""
    h = F.col("_t") - F.col("_s.t_begin")
    values = [F.coalesce(poly.horner(F.col(f"_s.{c}"), h, order), F.lit(float("nan"))).alias(c) for c in schema.COORDS]
    return met.select("_p.*", *values)


def state_eval(segments: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """Adds the seven variables to each row of wanted (obj_idx, t, ...): a merge of times with half-open segments.

    Every row of wanted comes back once: NaN where the object has no segment with t_begin <= t < t_end. A time that isn't finite is
    an error. Points and segments meet by object and time range, and each point takes the last segment that began: rows are read once
    each, whatever the number of segments and points of an object. A segment is listed in every range that it touches, so that ranges
    need nothing of each other. Segments of an object don't overlap; if they do, the one that began last counts.
    """
    width = range_width(segments)
    both = _begun(segments, width).drop("_until").unionByName(_points(wanted, width), allowMissingColumns=True)
    earlier = Window.partitionBy("_key", "_range").orderBy("_t", F.col("_p").isNotNull(), "_since").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_last", F.last("_s", True).over(earlier)).filter("_p IS NOT NULL")
    return _states(met.select("_t", "_p", F.when(F.col("_t") < F.col("_last.t_end"), F.col("_last")).alias("_s")), order)


def state_join(segments: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """state_eval() as an equality join on object and time range, for streams of points, which can't be sorted: each point meets about RANGE segments."""
    width = range_width(segments)
    begun = _begun(segments, width).select(F.col("_key").alias("_obj"), F.col("_range").alias("_at"), "_since", "_until", "_s")
    hit = (F.col("_key") == F.col("_obj")) & (F.col("_range") == F.col("_at")) & (F.col("_t") >= F.col("_since")) & (F.col("_t") < F.col("_until"))
    return _states(_points(wanted, width).join(begun, hit, "left"), order)


def at_time(objects: DataFrame, t: float) -> DataFrame:
    """Points for state_eval: all objects at one time."""
    return objects.select("obj_idx", F.lit(float(t)).alias("t"))


def at_times(objects: DataFrame, times: list[float]) -> DataFrame:
    """All objects at each of the times, with the time's position k."""
    each = F.posexplode(F.array(*(F.lit(float(t)) for t in times))).alias("k", "t")
    return objects.select("obj_idx", each)


def select_objects(spark, chosen: list[int], times, n_objs: int) -> DataFrame:
    """Points for chosen objects, in their order and with repeats: times is one number, one per choice, or one list per choice."""
    if any(not 0 <= i < n_objs for i in chosen):
        raise IndexError(f"an object index is beyond {n_objs}")
    if not isinstance(times, (list, tuple)):
        times = [times] * len(chosen)
    if len(times) != len(chosen):
        raise ValueError(f"{len(times)} times for {len(chosen)} objects")
    rows = [(p, int(i), k, float(t)) for p, (i, x) in enumerate(zip(chosen, times, strict=True)) for k, t in enumerate(x if isinstance(x, (list, tuple)) else [x])]
    return spark.createDataFrame(rows, "pos long, obj_idx long, k long, t double")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def roots(rows: DataFrame) -> DataFrame:
    """(obj_idx, root) from rows (obj_idx, c, width) of one order: the places in [0, width) where the polynomial c changes sign, in Arrow batches of all rows at once."""
    runtime.ready(rows.sparkSession)
    schema_out = pa.schema([("obj_idx", pa.int64()), ("root", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, t = poly.real_roots(_matrix(b, "c"), b.column("width").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(b.column("obj_idx").to_numpy()[row]), pa.array(t)], schema=schema_out)

    return rows.select("obj_idx", "c", "width").mapInArrow(run, "obj_idx long, root double")


def distances2(rows: DataFrame) -> DataFrame:
    """(obj_idx, d2) from rows (obj_idx, i_x, i_y, i_z, j_x, j_y, j_z, width): the squared distance of two motions as a polynomial of their order on [0, width]."""
    runtime.ready(rows.sparkSession)
    schema_out = pa.schema([("obj_idx", pa.int64()), ("d2", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, j = (np.stack([_matrix(b, f"{s}_{a}") for a in "xyz"], axis=1) for s in "ij")
                d2 = poly.distance2(i, j, b.column("width").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("obj_idx"), pa.array(d2.tolist(), type=schema_out.field("d2").type)], schema=schema_out)

    return rows.select("obj_idx", *(f"{s}_{a}" for s in "ij" for a in "xyz"), "width").mapInArrow(run, "obj_idx long, d2 array<double>")
