"""A detection's results as tables: every stage is written once, and read from there by all that follows.

Stages with a detection step lie in one folder a step, so that what asks for a step reads its folder only. Steps are dealt by a
rebalancing hint: small ones share a task, and a large one is split over several tasks and files.
"""

from __future__ import annotations

import logging
import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime, schema
from ..sources.store import TrajectoryStore
from . import conjunctions as cj

LOG = logging.getLogger("skyframe")
VERSION = 2
#: The columns of all stages; a stage without rows has no files to tell them.
STAGES = {
    "objects": "obj_idx long, otype int",
    "aabbs": f"{cj.BOX_DDL}, mcode long",
    "collisions": "cd_idx long, i long, j long",
    "found": cj.FOUND_DDL,
    "conjunctions": schema.CONJUNCTIONS,
    "report": cj.REPORT_DDL,
}
#: Stages in folders by step, with the order within a file.
BY_STEP = {"aabbs": ["mcode", "obj_idx"], "collisions": ["i", "j"], "conjunctions": ["tca", "i", "j"]}


@dataclass
class Conjunctions:
    """The stages of one detection, below a folder that all executors share."""

    spark: SparkSession
    path: str
    threshold: float
    interval: float
    max_t: float

    @classmethod
    def detect(cls, store: TrajectoryStore, threshold: float, interval: float, path: str) -> Conjunctions:
        """Runs all stages over a store, one table each; the last one written makes the folder complete. Times go to the log.

        Without a primary object the search for pairs and all behind it are skipped, and their tables are empty.
        """
        cj.check_parameters(threshold, interval)
        search = cj.check_types(store.objects)
        spark, made = store.spark, cls(store.spark, path, threshold, interval, store.max_t)

        def stage(name: str, rows: DataFrame) -> DataFrame:
            began = time.monotonic()
            rows = rows.select(*spark.createDataFrame([], STAGES[name]).columns)
            if name in BY_STEP:
                rows.hint("rebalance", "cd_idx").sortWithinPartitions("cd_idx", *BY_STEP[name]).write.partitionBy("cd_idx").parquet(f"{path}/{name}")
            else:
                rows.write.parquet(f"{path}/{name}")
            LOG.info("%s: %.1f s", name, time.monotonic() - began)
            return made._table(name)

        objects = stage("objects", store.objects)
        coded = stage("aabbs", cj.morton(cj.aabbs(store.segments, store.max_t, interval, threshold)))
        nothing = {name: spark.createDataFrame([], columns) for name, columns in STAGES.items()}
        stage("collisions", cj.collisions(coded, objects) if search else nothing["collisions"])
        found = stage("found", cj.search_found(coded, objects, store.segments, store.max_t, interval, threshold) if search else nothing["found"])
        stage("conjunctions", cj.told(found))
        stage("report", cj.report_of(found))
        runtime.delete(spark, f"{path}/found")
        meta = "version int, threshold double, interval double, max_t double"
        spark.createDataFrame([(VERSION, threshold, interval, store.max_t)], meta).coalesce(1).write.parquet(f"{path}/meta")
        return made

    @classmethod
    def mount(cls, spark: SparkSession, path: str) -> Conjunctions:
        """Opens what detect() wrote."""
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta is None or meta["version"] != VERSION:
            raise ValueError(f"{path} holds no results of version {VERSION}")
        return cls(spark, path, meta["threshold"], meta["interval"], meta["max_t"])

    def _table(self, name: str) -> DataFrame:
        rows = self.spark.read.schema(STAGES[name]).parquet(f"{self.path}/{name}")
        return rows.select(*self.spark.createDataFrame([], STAGES[name]).columns)

    def _step(self, k: int) -> int:
        if not 0 <= k < self.n_steps:
            raise IndexError(f"detection step {k} of {self.n_steps}")
        return k

    @property
    def n_steps(self) -> int:
        return math.ceil(self.max_t / self.interval)

    @property
    def steps(self) -> DataFrame:
        """(cd_idx, cd_begin, cd_end)."""
        return cj.cd_steps(self.spark, self.max_t, self.interval)

    @property
    def otypes(self) -> DataFrame:
        return self._table("objects")

    @property
    def aabbs(self) -> DataFrame:
        """Boxes of all objects in all steps, infinite where there are no data."""
        return cj.all_boxes(self._table("aabbs").drop("mcode"), self.otypes, self.steps)

    @property
    def global_aabbs(self) -> DataFrame:
        return cj.global_aabbs(self._table("aabbs"))

    @property
    def mcodes(self) -> DataFrame:
        """(cd_idx, obj_idx, mcode) of objects with data."""
        return self._table("aabbs").select("cd_idx", "obj_idx", "mcode")

    @property
    def srt_idx(self) -> DataFrame:
        """(cd_idx, pos, obj_idx, mcode): all objects in Morton order."""
        return cj.morton_order(self._table("aabbs"), self.otypes, self.steps)

    @property
    def srt_aabbs(self) -> DataFrame:
        """(cd_idx, pos, obj_idx, mcode, box): boxes in Morton order, gathered by index."""
        return self.srt_idx.join(self.aabbs, ["cd_idx", "obj_idx"])

    def leaves(self, k: int) -> DataFrame:
        """The groups of equal codes in a step, in unsigned order, with the boxes around them."""
        found = cj.leaves(self._table("aabbs").filter(F.col("cd_idx") == self._step(k)))
        return found.orderBy(F.col("mcode") < 0, "mcode")

    def aabb_collisions(self, k: int) -> DataFrame:
        """(i, j) of a step, in order."""
        return self._table("collisions").filter(F.col("cd_idx") == self._step(k)).select("i", "j").orderBy("i", "j")

    @property
    def conjunctions(self) -> DataFrame:
        """All conjunctions by detection step, time and pair."""
        return cj.listed(self._table("conjunctions"))

    def conjunctions_in(self, k: int) -> DataFrame:
        """The conjunctions of a step, in order."""
        return cj.listed(self._table("conjunctions").filter(F.col("cd_idx") == self._step(k)))

    @property
    def report(self) -> DataFrame:
        """(cd_idx, counters): what the narrow phase did in each step that has windows, counted when it ran."""
        return self._table("report")
