"""Trajectory stores: one row of metadata, a table of objects, and a table of polynomial segments."""

from __future__ import annotations

import hashlib
import math
import uuid
import weakref
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime, schema
from . import raw

VERSION = 2


class StoreError(ValueError):
    """A store's data break one of its rules."""


def check_segments(segments: DataFrame) -> DataFrame:
    """(rule, broken): how many rows break each rule, from one pass over the segments in time order by object."""
    w = Window.partitionBy("obj_idx").orderBy("step_idx")
    rows = segments.withColumns({"_last": F.lag("t_end").over(w), "_nth": F.row_number().over(w)})
    coefficients = F.concat(*schema.COORDS)
    odd = lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf"))
    rules = {
        "order at least 2": F.size("x") < 3,
        "one order for all variables": F.exists(F.array(*(F.size(c) for c in schema.COORDS)), lambda n: n != F.size("x")),
        "finite coefficients": F.exists(coefficients, odd),
        "finite times": odd(F.col("t_begin")) | odd(F.col("t_end")),
        "no negative times": F.col("t_begin") < 0,
        "increasing times": F.col("t_end") <= F.col("t_begin"),
        "steps without gaps": F.col("_last").isNotNull() & (F.col("_last") != F.col("t_begin")),
        "steps numbered from 0": F.col("step_idx") != F.col("_nth") - 1,
    }
    sums = rows.agg(*(F.sum(F.coalesce(v, F.lit(True)).cast("long")).alias(k) for k, v in rules.items()), (F.countDistinct(F.size("x")) - 1).alias("one order for all objects"))
    names = [*rules, "one order for all objects"]
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("long").alias("broken")) for k in names))).alias("r")).select("r.*")


def offsets(segments: DataFrame) -> DataFrame:
    """(obj_idx, n_steps, traj_offset, time_offset): where each object's coefficients and times would begin in one flat array of all.

    Sums run over blocks of objects first and over the blocks' totals next, so that no task sees all objects in order.
    """
    per = segments.groupBy("obj_idx").agg(F.count(F.lit(1)).alias("n_steps"), F.max(F.size("x")).alias("width"))
    per = per.withColumns({"values": F.col("n_steps") * F.col("width") * len(schema.COORDS), "times": F.col("n_steps") + 1, "block": F.floor(F.col("obj_idx") / 4096)})
    totals = per.groupBy("block").agg(F.sum("values").alias("v"), F.sum("times").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("block", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    inside = Window.partitionBy("block").orderBy("obj_idx").rowsBetween(Window.unboundedPreceding, -1)
    out = per.join(totals, "block")
    return out.select("obj_idx", "n_steps", (F.col("v0") + F.coalesce(F.sum("values").over(inside), F.lit(0))).alias("traj_offset"), (F.col("t0") + F.coalesce(F.sum("times").over(inside), F.lit(0))).alias("time_offset"))


def _bucket_table(path: str) -> str:
    """The name of the session's table over a store's buckets."""
    return f"skyframe_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _segments_at(spark: SparkSession, path: str, buckets: int | None) -> DataFrame:
    """The segments below a store's folder. Buckets are known to Spark by a table of the session over the same files."""
    if not buckets:
        return spark.read.schema(schema.SEGMENTS).parquet(f"{path}/segments")
    name, columns = _bucket_table(path), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.SEGMENTS)
    where = f"{path}/segments".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (obj_idx) SORTED BY (obj_idx, step_idx) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def _drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder while the session can; what a stopped session leaves goes with its shared folder."""
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {_bucket_table(path)}")
        runtime.delete(spark, path)


@dataclass(eq=False)
class TrajectoryStore:
    """Objects with piecewise polynomial trajectories. Close it, or use it in a with statement, to drop what isn't persisted."""

    spark: SparkSession
    objects: DataFrame
    segments: DataFrame
    epoch: tuple[float, float] = (0.0, 0.0)
    poly_order: int = 0
    max_t: float = 0.0
    n_objs: int = 0
    path: str | None = None
    persist: bool = False
    detached: bool = field(default=False, init=False)
    #: Deletes a temporary store's folder: when it is detached, when nothing refers to it any more, or when the program ends.
    _drop: weakref.finalize | None = field(default=None, init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.path and not self.persist:
            self._drop = weakref.finalize(self, _drop_folder, self.spark, self.path)

    @classmethod
    def from_frames(cls, objects: DataFrame, segments: DataFrame, epoch: float = 0.0, epoch2: float = 0.0, check: bool = True) -> TrajectoryStore:
        """A store of these tables. Objects without segments are empty trajectories; not all may be."""
        if not (math.isfinite(epoch) and math.isfinite(epoch2)):
            raise StoreError("the epoch has to be finite")
        high = epoch + epoch2
        low = epoch2 - (high - epoch)
        if check:
            broken = [r for r in check_segments(segments).collect() if r["broken"]]
            if broken:
                raise StoreError("; ".join(f"{r['rule']}: {r['broken']} rows" for r in broken))
        n = objects.count()
        if not n:
            raise StoreError("a store has one object at least")
        facts = segments.agg(F.max("t_end"), F.max(F.size("x"))).first()
        if facts[0] is None:
            raise StoreError("all trajectories are empty")
        if check and segments.join(objects, "obj_idx", "left_anti").limit(1).count():
            raise StoreError("segments of unknown objects")
        return cls(objects.sparkSession, objects, segments, (high, low), facts[1] - 1, facts[0], n)

    @classmethod
    def from_arrays(cls, spark: SparkSession, trajs, times, status, epoch: float = 0.0, epoch2: float = 0.0) -> TrajectoryStore:
        """From one [steps, order + 1, 7] array, one [steps + 1] array and one status an object; for data that the driver holds, as in tests."""
        trajs, times, status = [np.asarray(t, float) for t in trajs], [np.asarray(t, float) for t in times], list(status)
        if not len(trajs) == len(times) == len(status):
            raise StoreError("trajectories, times and status differ in number")
        rows = []
        for i, (c, t) in enumerate(zip(trajs, times, strict=True)):
            if c.ndim != 3 or c.shape[2] != len(schema.COORDS) or t.ndim != 1:
                raise StoreError(f"object {i}: arrays of shape {c.shape} and {t.shape}")
            if len(t) != (len(c) + 1 if len(c) else 0):
                raise StoreError(f"object {i}: {len(t)} times for {len(c)} steps")
            rows += [(i, k, float(t[k]), float(t[k + 1]), *(c[k, :, d].tolist() for d in range(len(schema.COORDS)))) for k in range(len(c))]
        objects = spark.createDataFrame([(i, int(s), None, schema.PRIMARY) for i, s in enumerate(status)], schema.OBJECTS)
        return cls.from_frames(objects, spark.createDataFrame(rows, schema.SEGMENTS), epoch, epoch2)

    @classmethod
    def from_datafiles(cls, spark: SparkSession, traj: str, time: str, order: int, offsets: DataFrame | pd.DataFrame, status=None, epoch: float = 0.0, epoch2: float = 0.0) -> TrajectoryStore:
        """From raw files (see raw.py) and where each object begins in them.

        offsets is a table (obj_idx, offset, n_steps, status) that Spark checks; or, for few objects, a pandas frame (offset, n_steps)
        in the order of the objects, with one status each.
        """
        if isinstance(offsets, pd.DataFrame):
            if status is None or len(offsets) != len(status := list(status)):
                raise StoreError("offsets and status differ in number")
            offsets = spark.createDataFrame([(i, int(at), int(n), int(s)) for i, (at, n, s) in enumerate(zip(offsets["offset"], offsets["n_steps"], status, strict=True))], "obj_idx long, offset long, n_steps long, status int")
        if broken := raw.broken_offsets(offsets, order, raw.n_doubles(traj), raw.n_doubles(time)):
            raise StoreError("; ".join(broken))
        objects = offsets.select(F.col("obj_idx").cast("long").alias("obj_idx"), F.col("status").cast("int").alias("status"), F.lit(None).cast("long").alias("norad_id"), F.lit(schema.PRIMARY).alias("otype"))
        return cls.from_frames(objects, raw.segments(spark, offsets, traj, time, order), epoch, epoch2)

    def save(self, path: str, persist: bool = True, buckets: int | None = None) -> TrajectoryStore:
        """Writes the store; its metadata come last and make it complete. One that isn't to persist is deleted when it is detached.

        With buckets, segments lie in that many files by object, so that what groups or joins them by object moves nothing, and one
        object is read from one file; an object of very many steps fills its file alone. Without, files are of like size: small objects
        share one, and a large object is split over several.
        """
        self._open()
        self.objects.write.mode("errorifexists").parquet(f"{path}/objects")
        if buckets:
            writer = self.segments.repartition(buckets, "obj_idx").write.bucketBy(buckets, "obj_idx").sortBy("obj_idx", "step_idx")
            name = _bucket_table(path)
            writer.format("parquet").option("path", f"{path}/segments").saveAsTable(name)
            self.spark.sql(f"DROP TABLE {name}")
        else:
            self.segments.hint("rebalance", "obj_idx").sortWithinPartitions("obj_idx", "step_idx").write.parquet(f"{path}/segments")
        meta = "version int, persist boolean, n_objs long, poly_order int, maxT double, epoch double, epoch2 double, buckets int"
        self.spark.createDataFrame([(VERSION, persist, self.n_objs, self.poly_order, self.max_t, *self.epoch, buckets)], meta).coalesce(1).write.parquet(f"{path}/traj_meta")
        return self._opened(self.spark, path)

    def save_temporary(self, buckets: int | None = None) -> TrajectoryStore:
        """save() below the shared folder that spark.checkpoint.dir names, until the store is detached."""
        return self.save(f"{runtime.scratch_root(self.spark)}/skyframe/store-{uuid.uuid4().hex}", persist=False, buckets=buckets)

    @classmethod
    def _opened(cls, spark: SparkSession, path: str) -> TrajectoryStore:
        meta = spark.read.parquet(f"{path}/traj_meta").first()
        if meta is None or meta["version"] != VERSION:
            raise StoreError(f"{path} holds no store of version {VERSION}")
        return cls(spark, spark.read.parquet(f"{path}/objects"), _segments_at(spark, path, meta["buckets"]), (meta["epoch"], meta["epoch2"]), meta["poly_order"], meta["maxT"], meta["n_objs"], path, meta["persist"])

    @classmethod
    def mount(cls, spark: SparkSession, path: str) -> TrajectoryStore:
        """Opens a store that save() wrote to persist."""
        found = cls._opened(spark, path)
        if not found.persist:
            raise StoreError(f"the store in {path} isn't persistent")
        return found

    def _open(self) -> None:
        if self.detached:
            raise StoreError("the store was detached")

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(coefficients, times, status) of one object."""
        self._open()
        if not 0 <= i < self.n_objs:
            raise IndexError(f"object {i} of {self.n_objs}")
        rows = self.segments.filter(F.col("obj_idx") == i).orderBy("step_idx").collect()
        status = self.objects.filter(F.col("obj_idx") == i).first()["status"]
        c = np.array([[r[v] for v in schema.COORDS] for r in rows], float).reshape(len(rows), len(schema.COORDS), -1).transpose(0, 2, 1) if rows else np.zeros((0, self.poly_order + 1, len(schema.COORDS)))
        return c, np.array([rows[0]["t_begin"], *(r["t_end"] for r in rows)] if rows else []), status

    def hint_release(self) -> None:
        """Frees what the session holds of the store in memory."""
        self._open()
        self.objects.unpersist()
        self.segments.unpersist()

    def detach(self) -> None:
        if not self.detached:
            self.hint_release()
            self.detached = True
            if self._drop:
                self._drop()

    def __enter__(self) -> TrajectoryStore:
        return self

    def __exit__(self, *_) -> None:
        self.detach()
