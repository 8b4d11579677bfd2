"""What moves and what one task holds as tables grow."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyframe.operators import conjunctions as cj
from skyframe.operators import propagate
from skyframe.plans import bindings as b
from skyframe.plans import queries as core


def test_elements_are_fitted_once_and_by_many_tasks(spark, small):
    """The query runs each fit once, in as many tasks as shuffles have, however few bytes the elements are."""
    rows = core.QUERIES["sgp4_fit"](spark, small)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "REPARTITION_BY_NUM" in plan
    gpes = b.gpes(spark, small).limit(2).withColumns({"epoch": F.col("epoch_jd1") + F.col("epoch_jd2"), "obj_idx": F.col("norad_id"), "begin": F.lit(2460000.5), "end": F.lit(2460000.6)})
    objects, segments = propagate.propagate(gpes, 2460000.5)
    per = {r.obj_idx: (r.n, r.t) for r in segments.groupBy("obj_idx").agg(F.count("x").alias("n"), F.max("t_end").alias("t")).collect()}
    mine = propagate.objects_of(propagate.fitted(gpes, 2460000.5)).collect()
    assert {r.obj_idx: (r.n_steps, r.t_end) for r in mine} == per and objects.columns == ["obj_idx", "status", "norad_id", "otype"]


def test_segments_of_a_small_file_are_many_tasks(spark, small):
    """A file of few bytes, from which many boxes follow, isn't one task."""
    assert b.segments(spark, small).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_nodes_are_never_broadcast(spark, small):
    """Spark expects the size of the file for tables with a row a leaf or a node; only bounds and depths of steps may be broadcast."""
    coded = cj.morton(cj.aabbs(b.segments(spark, small), b.MAX_T, b.INTERVAL, b.THRESHOLD))
    plan = cj.bvh_tree(coded)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 4


def test_crowded_cells_meet_by_blocks(spark, monkeypatch):
    """Pairs of a cell of many blocks, counts of types, and whole groups of small batches are those of the plain search."""
    draw = np.random.default_rng(17)
    middle = draw.uniform(0, 3, (150, 4))
    coded = cj.morton(spark.createDataFrame([(0, i, *(m - 0.5).tolist(), *(m + 0.5).tolist()) for i, m in enumerate(middle)], cj.BOX_DDL))
    objects = spark.createDataFrame([(i, (1, 2, 4)[i % 3]) for i in range(150)], "obj_idx long, otype int")
    low, high = (middle + s * 0.5 for s in (-1, 1))
    near = {(0, i, j) for i in range(150) for j in range(i + 1, 150) if i % 3 + j % 3 <= 1 and (np.float32(high[i]) >= np.float32(low[j])).all() and (np.float32(low[i]) <= np.float32(high[j])).all()}
    monkeypatch.setattr(cj, "BLOCK", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found, naive = ([tuple(r) for r in f(coded, objects).collect()] for f in (cj.collisions, cj.collisions_naive))
        types = {(r.type_i, r.type_j): r.n for r in cj.collisions_by_type(coded, objects).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(set(found)) == len(naive) and set(found) == set(naive) == near
    assert types == {k: n for k in ((1, 1), (1, 2), (2, 1)) if (n := sum(((1, 2)[i % 3], (1, 2)[j % 3]) == k for _, i, j in near))}


def test_pairs_are_never_moved(spark, small):
    """Between the search for pairs and what it finds there is no shuffle: pairs grow with the square of the boxes."""
    plan = core.QUERIES["aabb_collisions"](spark, small)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Exchange" not in top and "Join" not in top


def test_long_lists_in_cells_are_swept():
    """Lists of segments of two objects meet as in swept(), short and long ones."""
    draw = np.random.default_rng(19)
    n = draw.integers(1, 12, 40)
    first, start, stop = np.cumsum(n) - n, [], []
    for k in n:
        times = np.sort(draw.choice(60, k + 1, replace=False)).astype(float)
        start, stop = [*start, *times[:-1]], [*stop, *times[1:]]
    start, stop = np.array(start), np.array(stop)
    i, j = np.array([(x, y) for x in range(40) for y in range(x + 1, 40)]).T
    p, k, m = cj._swept_rows(i, j, first, n, start)
    ok = np.maximum(start[k], start[m]) < np.minimum(stop[k], stop[m])
    segs = lambda x: range(first[x], first[x] + n[x])
    wanted = sorted((r, a, c) for r, (x, y) in enumerate(zip(i, j, strict=True)) for a in segs(x) for c in segs(y) if max(start[a], start[c]) < min(stop[a], stop[c]))
    assert sorted(zip(p[ok], k[ok], m[ok], strict=True)) == wanted


@pytest.mark.parametrize("name", ["conjunctions", "conjunctions_boundary", "rel_speed", "conj_ids", "tca_utc", "conjunctions_otypes"])
def test_what_is_found_is_never_moved(spark, small, name):
    """Behind the search there is no shuffle, sort or join: conjunctions grow with the square of the objects, too."""
    plan = core.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and not any(x in top for x in ("Exchange", "Join", "Sort", "Window"))


def _passing(n: int, bent: float) -> tuple[list, list]:
    """Objects 2k and 2k + 1 far from all others, the second passing the first at time 1 and, with bent paths, curved; cut anew at several times."""
    objects, segments = [], []
    for k in range(n):
        for moves in (0, 1):
            objects.append((2 * k + moves, 1))
            cuts = [0.0, 2.0] if k % 3 == 0 else [0.0, 1.0, 2.0] if k % 3 == 1 else [0.0, 0.75, 1.0, 1.5]
            for t, end in zip(cuts[:-1], cuts[1:], strict=True):
                at = (t - 1.0) * moves
                x, y = [0.5 * at, 0.5 * moves], [bent * at * at + 0.01 * moves, 2 * bent * at, bent * moves]
                segments.append((2 * k + moves, t, end, *(c + [0.0] * (5 - len(c)) for c in (x, y, [100.0 * k], x[1:], [y[1], 2 * y[2]], [], [100.0 * k + 10]))))
    return objects, segments


@pytest.mark.parametrize("bent", [0.0, 0.125])
def test_minima_at_seams_are_told_once_where_they_are_found(spark, bent):
    """At the ends of segments, of steps and of both, straight and curved: the search in cells tells what pairs searched one by one do after a sort."""
    rows, parts = _passing(9, bent)
    objects = spark.createDataFrame(rows, "obj_idx long, otype int")
    segments = spark.createDataFrame(parts, "obj_idx long, t_begin double, t_end double, " + ", ".join(f"{c} array<double>" for c in ("x", "y", "z", "vx", "vy", "vz", "r")))
    for interval in (0.25, 0.4):
        coded = cj.morton(cj.aabbs(segments, 2.0, interval, 0.2))
        plain = cj.narrow_phase(cj.collisions(coded, objects), segments, 2.0, interval, 0.2)
        found = cj.detected(objects, segments, 2.0, 0.2, interval, ("cd_idx", "i", "j", "tca", "dca"))
        mine, wanted = (sorted((r.i, r.j, round(r.tca, 8), round(r.dca, 8), r.cd_idx) for r in x.collect()) for x in (found, plain))
        assert mine == wanted and [x[:4] for x in mine] == [(2 * k, 2 * k + 1, 1.0, 0.01) for k in range(9)]


@pytest.mark.parametrize("sweep", [True, False])
def test_blocks_of_a_matrix_find_the_pairs_of_rows(monkeypatch, sweep):
    """Groups tested as blocks of a matrix, in tiles of any size, and row by row give each pair of a group that overlaps once."""
    draw = np.random.default_rng(23)
    n = 400
    group = np.sort(draw.integers(0, 6, n)) * (draw.integers(0, 9) + 1)
    middle, half = draw.uniform(0, 4, (n, 4)), draw.uniform(0.1, 1, (n, 4))
    low, high = (middle - half).astype(np.float32), (middle + half).astype(np.float32)
    wide_low, wide_high = low - (draw.uniform(size=(n, 1)) < 0.2), high + np.float32(0.5)
    wide_low = wide_low.astype(np.float32)
    obj, bits = draw.permutation(n), draw.choice([127, 127, 96, 31], n)
    columns = {c: np.zeros(n, np.int64) for c in cj._GROUP} | {"cx": group, "obj_idx": obj, "bits": bits}
    for k, a in enumerate(cj.AXES):
        columns |= {f"ol{a}": low[:, k], f"ou{a}": high[:, k], f"tl{a}": wide_low[:, k], f"tu{a}": wide_high[:, k]}
    batch = pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in columns.items()})
    wanted = sorted(
        (i, j)
        for i in range(n)
        for j in range(n)
        if group[i] == group[j] and obj[i] < obj[j] and bits[i] | bits[j] == 127 and (high[i] >= wide_low[j]).all() and (low[i] <= wide_high[j]).all()
    )
    assert len(wanted) > 500
    for dense, matrix, across in ((2, 64, 8), (2, 1 << 17, 1 << 13), (10**6, 64, 8)):
        for name, value in (("_DENSE", dense), ("_MATRIX", matrix), ("_ACROSS", across), ("_AT_ONCE", 100)):
            monkeypatch.setattr(cj, name, value)
        assert sorted((int(x), int(y)) for i, j in cj.met(batch, sweep) for x, y in zip(i, j, strict=True)) == wanted


def test_naive_search_moves_rows_to_few_blocks(spark, small, monkeypatch):
    """Each row goes to as many groups as its step has blocks, which are large; a small step still has several."""
    assert cj.BLOCK >= 1 << 16
    rows = []
    monkeypatch.setattr(cj, "_grouped", lambda cells, full: rows.append(full) or cells.limit(0))
    cj.collisions_naive(cj.morton(cj.aabbs(b.segments(spark, small), b.MAX_T, b.INTERVAL, b.THRESHOLD)), b.objects(spark, small))
    assert {r["_n"] for r in rows[0].collect()} == {4 * cj.BLOCK}
