"""Stores, evaluation and detection on analytic inputs."""

import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyframe import schema, streaming
from skyframe.functions import poly, timescale
from skyframe.operators import conjunctions as cj
from skyframe.operators import evaluate, propagate, results
from skyframe.sources import catalog
from skyframe.sources.store import StoreError, TrajectoryStore


def line(x, v, begin, end, step=0.1, y=0.0):
    """A body on a straight line x + v t, y apart, in steps, order 3."""
    n = round((end - begin) / step)
    times = np.array([begin + step * k for k in range(n + 1)])
    c = np.zeros((n, 4, 7))
    c[:, 0, 0], c[:, 1, 0], c[:, 0, 3], c[:, 0, 1] = x + v * times[:-1], v, v, y
    c[:, 0, 6], c[:, 1, 6] = np.abs(x + v * times[:-1]), np.sign(x) * v
    return c, times


def store_of(spark, *bodies):
    return TrajectoryStore.from_arrays(spark, [b[0] for b in bodies], [b[1] for b in bodies], [0] * len(bodies))


def found(store, threshold, interval):
    return sorted((r.i, r.j, r.tca, r.dca) for r in cj.detect(store.objects, store.segments, store.max_t, threshold, interval).collect())


def test_rules_of_stores(spark):
    c, t = line(1, -1, 0, 0.5)
    for trajs, times, status in (([], [], []), ([c], [t, t], [0]), ([c], [t[:-1]], [0]), ([c], [t[::-1]], [0]), ([c], [t - 1], [0]), ([c * np.nan], [t], [0]), ([c[:, :2]], [t], [0]), ([c, c[:, :3]], [t, t], [0, 0]), ([c[:0]], [t[:0]], [0])):
        with pytest.raises((StoreError, ValueError)):
            TrajectoryStore.from_arrays(spark, trajs, times, status)
    with pytest.raises(StoreError):
        TrajectoryStore.from_arrays(spark, [c], [t], [0], epoch=math.inf)


def test_store_round_trip(spark, tmp_path):
    store = TrajectoryStore.from_arrays(spark, [line(1, -1, 0, 0.5)[0], np.zeros((0, 4, 7))], [line(1, -1, 0, 0.5)[1], []], [0, 13], epoch=1.0, epoch2=2.0)
    assert (store.n_objs, store.poly_order, store.max_t, store.epoch) == (2, 3, 0.5, (3.0, 0.0))
    kept = store.save(str(tmp_path / "s"))
    c, t, status = kept[0]
    assert np.array_equal(c, line(1, -1, 0, 0.5)[0]) and np.array_equal(t, line(1, -1, 0, 0.5)[1]) and status == 0
    assert kept[1][0].shape == (0, 4, 7) and kept[1][2] == 13
    with pytest.raises(IndexError):
        kept[2]
    with kept:
        pass
    with pytest.raises(StoreError):
        kept[0]
    with pytest.raises(Exception, match="(?i)exist"):
        store.save(str(tmp_path / "s"))


def test_raw_files(spark, tmp_path):
    import pandas as pd

    bodies = [line(1, -1, 0, 0.5), line(2, 1, 0.25, 0.75, 0.25)]
    np.concatenate([b[0].ravel() for b in bodies]).tofile(tmp_path / "c")
    np.concatenate([b[1] for b in bodies]).tofile(tmp_path / "t")
    offsets = pd.DataFrame({"offset": [0, bodies[0][0].size], "n_steps": [len(b[0]) for b in bodies]})
    store = TrajectoryStore.from_datafiles(spark, str(tmp_path / "c"), str(tmp_path / "t"), 3, offsets, [0, 0])
    assert np.array_equal(store[1][0], bodies[1][0])
    with pytest.raises(StoreError):
        TrajectoryStore.from_datafiles(spark, str(tmp_path / "c"), str(tmp_path / "t"), 3, offsets.assign(offset=[1, 2]), [0, 0])


def test_raw_files_by_ranges(spark, tmp_path):
    """Ranges of a few steps, empty objects, offsets as a table, and each rule of it."""
    from skyframe.sources import raw

    bodies = [line(1, -1, 0, 3.0), (np.zeros((0, 4, 7)), np.zeros(0)), line(2, 1, 0.25, 0.75, 0.25), line(0, 1, 0, 0.7)]
    np.concatenate([b[0].ravel() for b in bodies]).tofile(tmp_path / "c")
    np.concatenate([b[1] for b in bodies]).tofile(tmp_path / "t")
    sizes = [b[0].size for b in bodies]
    rows = [(i, sum(sizes[:i]), len(b[0]), 13 * (i == 1)) for i, b in enumerate(bodies)]
    files = f"file://{tmp_path}/c", str(tmp_path / "t")
    table = lambda r: spark.createDataFrame(r, "obj_idx long, offset long, n_steps long, status int")
    store = TrajectoryStore.from_datafiles(spark, *files, 3, table(rows[::-1]))
    for i, (c, t) in enumerate(bodies):
        got = store[i]
        assert np.array_equal(got[0], c) and np.array_equal(got[1], t) and got[2] == rows[i][3]
    short = raw.segments(spark, table(rows), *files, 3, range_steps=4)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, store.segments.collect()))
    null = [*rows[:3], (3, None, None, 0)]
    for odd in ([], rows[:3], rows[1:], [*rows, rows[0]], null, [(*rows[0][:2], -1, 0), *rows[1:]], [rows[0], (1, 1, 0, 0), *rows[2:]], [(None, *rows[0][1:]), *rows[1:]]):
        with pytest.raises(StoreError):
            TrajectoryStore.from_datafiles(spark, *files, 3, table(odd))
    with pytest.raises(FileNotFoundError):
        TrajectoryStore.from_datafiles(spark, str(tmp_path / "no"), files[1], 3, table(rows))


def test_evaluation(spark, tmp_path):
    store = store_of(spark, line(1, -1, 0, 1), line(-1, 1, 0, 1.5))
    rows = {(r.obj_idx, r.t): r for r in evaluate.state_eval(store.segments, evaluate.at_times(store.objects, [0.11, 1.0, 1.2]), 3).collect()}
    assert rows[0, 0.11].x == pytest.approx(0.89, rel=1e-14) and rows[0, 0.11].vx == -1
    assert math.isnan(rows[0, 1.0].x) and math.isnan(rows[0, 1.2].r) and rows[1, 1.2].x == pytest.approx(0.2)
    with pytest.raises(IndexError):
        evaluate.select_objects(spark, [2], 0.0, 2)
    with pytest.raises(Exception, match="finite"):
        evaluate.state_eval(store.segments, evaluate.at_time(store.objects, math.nan), 3).collect()
    evaluate.at_time(store.objects, 0.5).write.parquet(str(tmp_path / "in"))
    points = spark.readStream.schema("obj_idx long, t double").parquet(str(tmp_path / "in"))
    stream = streaming.stream_states(points, store.segments, 3).writeStream.format("memory").queryName("states").start()
    stream.processAllAvailable()
    stream.stop()
    assert spark.table("states").count() == 2


#: Windows of the two bodies that meet at t = 1, and whether they are found meeting.
MEETINGS = [((0, 0.9), (0, 0.9), False), ((0, 2), (0, 2), True), ((0, 0.9), (1.1, 2), False), ((0, 1.5), (0.5, 2), True), ((0, 0.9), (0.9, 2), False), ((0.5, 1.5), (0.2, 1.9), True)]


@pytest.mark.parametrize("a,b,meet", MEETINGS)
def test_meeting_bodies(spark, a, b, meet):
    store = store_of(spark, line(1, -1, *a), line(-1, 1, *b))
    rows = found(store, 1e-6, 2 / 3)
    assert bool(rows) == meet
    assert all(r[:2] == (0, 1) and r[2] == pytest.approx(1, abs=1e-9) and r[3] == pytest.approx(0, abs=1e-9) for r in rows)


@pytest.mark.parametrize("shift", [0.0, 1.1])
def test_boundaries(spark, shift):
    a, b = line(1 + shift, -1, shift, 0.9 + shift), line(-1 - shift, 1, shift, 2 + shift)
    rows = found(store_of(spark, a, b), 0.25, 0.03)
    assert len(rows) == 1 and rows[0][2] == pytest.approx(0.9 + shift, abs=1e-9) and rows[0][3] == pytest.approx(0.2, abs=1e-9)
    a, b = line(0.1 - shift, 1, shift, 1 + shift), line(-0.1 + shift, -1, shift, 1 + shift)
    rows = found(store_of(spark, a, b), 0.25, 0.03)
    assert len(rows) == 1 and rows[0][2] == pytest.approx(shift, abs=1e-9) and rows[0][3] == pytest.approx(0.2, abs=1e-9)


def test_interval_does_not_matter(spark):
    store = store_of(spark, line(1, -1, 0, 2), line(-1, 1, 0, 2, y=0.01), line(0.5, -0.5, 0, 2, y=0.03), line(0.5, -0.5, 0, 2, y=0.03))
    rows = [found(store, 0.05, step) for step in (0.13, 0.37, 2.0)]
    assert len(rows[0]) == 5  # the two that are equal never come nearer
    for other in rows[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in rows[0]]
        assert np.allclose([r[2:] for r in other], [r[2:] for r in rows[0]], rtol=1e-9)


def test_masks_and_parameters(spark):
    store = store_of(spark, line(1, -1, 0, 2), line(-1, 1, 0, 2))
    for types, n in (((1, 1), 1), ((1, 2), 1), ((2, 2), 0), ((1, 4), 0)):
        objects = store.objects.withColumn("otype", F.when(F.col("obj_idx") == 0, types[0]).otherwise(types[1]))
        assert cj.detect(objects, store.segments, 2.0, 0.1, 0.5).count() == n
    with pytest.raises(ValueError):
        cj.check_parameters(0.0, 1.0)
    with pytest.raises(ValueError):
        cj.check_parameters(1e200, 1.0)
    with pytest.raises(ValueError):
        cj.check_types(store.objects.withColumn("otype", F.lit(3)))


def plain_tree(codes):
    """Begin, end, left and right of a radix tree's nodes in level order."""
    codes, nodes = sorted(c % 2**64 for c in codes.tolist()), []
    level = [(0, len(codes))]
    while level:
        below, after = [], len(nodes) + len(level)
        for begin, end in level:
            bit = (codes[begin] ^ codes[end - 1]).bit_length() - 1
            if bit < 0:
                nodes.append([begin, end, -1, -1])
                continue
            split = next(k for k in range(begin, end) if codes[k] >> bit & 1)
            nodes.append([begin, end, after + len(below), after + len(below) + 1])
            below += [(begin, split), (split, end)]
        level = below
    return nodes


def test_boxes_hold_positions_and_tree_is_whole(spark):
    draw = np.random.default_rng(3)
    bodies = []
    for _ in range(40):
        c = draw.normal(size=(5, 6, 7)) * 0.3 ** np.arange(6)[None, :, None]
        bodies.append((c, np.linspace(0, 2.5, 6)))
    store = store_of(spark, *bodies)
    coded = cj.morton(cj.aabbs(store.segments, 2.5, 0.4, 0.1)).cache()
    boxes = {(r.cd_idx, r.obj_idx): r for r in coded.collect()}
    for (k, i), r in boxes.items():
        for t in draw.uniform(k * 0.4, min(2.5, (k + 1) * 0.4), 5):
            s = min(int(t / 0.5), 4)
            for d, a in ((0, "x"), (1, "y"), (2, "z"), (6, "r")):
                assert r["l" + a] <= np.polyval(bodies[i][0][s, ::-1, d], t - s * 0.5) <= r["u" + a]
    pairs = sorted(map(tuple, cj.collisions(coded, store.objects).collect()))
    assert pairs == sorted(map(tuple, cj.collisions_naive(coded, store.objects).collect())) and pairs
    odd = coded.unionByName(coded.filter("obj_idx < 4").withColumn("obj_idx", F.col("obj_idx") + 100))  # equal codes
    odd = odd.unionByName(coded.filter("cd_idx = 0 AND obj_idx = 3").withColumn("cd_idx", F.lit(90).cast("long")))  # a step of one object
    rows = cj.bvh_tree(odd).toPandas()
    assert set(rows.cd_idx) == {*range(7), 90}
    for step, frame in odd.toPandas().groupby("cd_idx"):
        mine = rows[rows.cd_idx == step].sort_values("node_idx")
        assert mine.node_idx.tolist() == list(range(len(mine)))
        assert mine[["begin", "end", "left", "right"]].to_numpy().tolist() == plain_tree(frame.mcode.to_numpy())
    order = cj.morton_order(coded, store.objects.limit(30), cj.cd_steps(spark, 2.5, 0.4)).toPandas()
    for step, frame in order.groupby("cd_idx"):
        frame = frame.sort_values("pos")
        assert frame.pos.tolist() == list(range(len(frame))) and frame.obj_idx.is_unique
        assert frame.mcode.to_numpy().view(np.uint64).tolist() == sorted(frame.mcode.to_numpy().view(np.uint64).tolist())
    for step, nodes in cj.bvh_tree(coded).toPandas().groupby("cd_idx"):
        inner = nodes[nodes.left >= 0].set_index("node_idx")
        by = nodes.set_index("node_idx")
        assert len(nodes) == 2 * (len(nodes) - len(inner)) - 1
        for _, n in inner.iterrows():
            a, b = by.loc[n.left], by.loc[n.right]
            assert (n.begin, n.end, a.end) == (a.begin, b.end, b.begin)
            assert np.array_equal(n.lb, np.minimum(a.lb, b.lb)) and np.array_equal(n.ub, np.maximum(a.ub, b.ub))


@given(st.lists(st.floats(0.05, 0.95), min_size=1, max_size=5, unique=True))
@settings(max_examples=60, deadline=None)
def test_roots(roots):
    roots = sorted(roots)
    if any(b - a < 1e-2 for a, b in zip(roots, roots[1:])):
        return
    slope = np.poly(roots)[::-1]
    c = np.concatenate([[0.3], slope / np.arange(1, len(slope) + 1)])[None]
    _, t = poly.minima(c, np.array([1.0]))
    want = [r for k, r in enumerate(roots) if (len(roots) - k) % 2 == 1]
    assert np.allclose(sorted(t), want, atol=1e-7)


def test_kernels():
    draw = np.random.default_rng(4)
    c = draw.normal(size=(7, 6))
    t = draw.uniform(0, 1, 7)
    assert np.allclose(poly.np_horner(poly.np_translate(c, t), t), poly.np_horner(c, 2 * t))
    values = poly.np_horner(c[:, None, :], np.linspace(0, 0.7, 50))
    b = poly.np_bernstein(c, np.full(7, 0.7))
    assert (b.min(1) <= values.min(1) + 1e-12).all() and (b.max(1) >= values.max(1) - 1e-12).all()
    nodes = poly.chebyshev(5)
    assert np.allclose(poly.interpolate(poly.np_horner(c[:, None, :], nodes), nodes), c)


def test_sgp4_verification_vectors():
    d = math.pi / 180
    el = propagate.Elements([16.05824518 * 2 * math.pi / 1440], [0.0086731], [72.8435 * d], [115.9689 * d], [52.6988 * d], [110.5714 * d], [0.66816e-4])
    #: The published test case of Spacetrack Report 3 at 0 and 360 minutes, km.
    for t, want in ((0.0, (2328.96975, -5995.22051, 1719.97297)), (360.0, (2456.10706, -6071.93855, 1222.89769))):
        pos, _, status = el.at(np.array([t]))
        assert status[0] == 0 and np.allclose(pos[0], want, atol=2e-5)


def test_fit_follows_sgp4():
    row = {"n0": 15.2 * 2 * math.pi / 1440, "e0": 0.001, "i0": 0.9, "node0": 1.0, "omega0": 2.0, "m0": 3.0, "bstar": 1e-5}
    found, status = propagate.fit_rows(row, 0.0, 0.0, 300.0)
    assert status == 0 and found[0][0] == 0 and found[-1][1] == pytest.approx(300 / 1440)
    el = propagate.Elements(*([row[k]] for k in ("n0", "e0", "i0", "node0", "omega0", "m0", "bstar")))
    for a, b, c in found:
        for t in np.linspace(a, b, 7)[:-1]:
            pos, vel, _ = el.at(np.array([t * 1440]))
            assert np.allclose(poly.np_horner(c[:3], t - a), pos[0], atol=1e-6) and np.allclose(poly.np_horner(c[3:6], t - a), vel[0], atol=1e-8)
    assert propagate.fit_rows(row, 0.0, 0.0, 10.0, leave=100.0) == ([], 12)
    assert propagate.fit_rows(row, 0.0, 0.0, 10.0, reentry=1e5) == ([], 11)
    assert propagate.fit_rows(row | {"n0": 0.0044}, 0.0, 0.0, 10.0) == ([], propagate.DEEP_SPACE)


def test_catalog_merge(spark, tmp_path):
    raw = '{"NORAD_CAT_ID": %d, "OBJECT_ID": "UNKNOWN", "OBJECT_NAME": "A", "EPOCH": "2024-11-01T06:00:00.500000", "MEAN_MOTION": 15.0, "ECCENTRICITY": 0.001, "INCLINATION": 90.0, "RA_OF_ASC_NODE": 1, "ARG_OF_PERICENTER": 2, "MEAN_ANOMALY": 3, "BSTAR": 0.1%s}'
    (tmp_path / "base.json").write_text("[" + ", ".join(raw % (k, ', "TLE_LINE1": "1", "TLE_LINE2": "2"') for k in (5, 6)) + "]")
    (tmp_path / "starlink.json").write_text("[" + ", ".join(raw % (k, ', "RMS": "%s"' % r) for k, r in ((6, ""), (6, "0.5"), (7, "0.1"))) + "]")
    base = catalog.reformat(catalog.read_json(spark, str(tmp_path / "base.json")), clean_placeholders=True)
    extra = catalog.read_groups(spark, str(tmp_path))
    extra = catalog.lowest_rms(catalog.reformat(extra, clean_placeholders=False))
    satcat = spark.createDataFrame([(6, 1.5, None), (5, 2.5, "D")], "norad_id long, rcs double, status string")
    rows = {r.norad_id: r for r in catalog.merge(base, extra, satcat).collect()}
    assert set(rows) == {5, 6, 7} and list(rows[5].asDict()) == schema.CATALOG.fieldNames()
    assert (rows[5].cospar_id, rows[5].ops_code, rows[5].tle_line1, rows[5].rms) == (None, "D", "1", None)
    assert (rows[6].cospar_id, rows[6].ops_code, rows[6].tle_line1, rows[6].rms) == ("UNKNOWN", None, None, 0.5)
    assert rows[7].ops_code == "+" and rows[7].i0 == pytest.approx(math.pi / 2) and rows[7].n0 == pytest.approx(15 * 2 * math.pi / 1440)
    assert rows[5].epoch_jd1 + rows[5].epoch_jd2 == pytest.approx(2460615.75 + 0.5 / 86400, abs=1e-9)
    assert catalog.read_groups(spark, str(tmp_path), ("none",)) is None
    with pytest.raises(catalog.CatalogError, match="recurs"):
        catalog.validate(extra.union(extra), unique="norad_id", required=["n0"])


RAW = '{"NORAD_CAT_ID": %d, "OBJECT_ID": "UNKNOWN", "OBJECT_NAME": "A", "EPOCH": "2024-11-01T06:00:00.500000", "MEAN_MOTION": %s, "ECCENTRICITY": 0.001, "INCLINATION": 90.0, "RA_OF_ASC_NODE": 1, "ARG_OF_PERICENTER": 2, "MEAN_ANOMALY": 3, "BSTAR": 0.1%s}'
BASE = ', "TIME_SYSTEM": "UTC", "REF_FRAME": "TEME", "CENTER_NAME": "EARTH", "TLE_LINE1": "1", "TLE_LINE2": "2"'


def test_load_catalog(spark, tmp_path, caplog):
    base, satcat, groups = tmp_path / "base.json", tmp_path / "satcat.csv", tmp_path / "groups"
    groups.mkdir()
    base.write_text("[" + ", ".join(RAW % (k, m, BASE) for k, m in ((9, 15.0), (5, 15.0), (6, 14.0))) + "]")
    satcat.write_text("NORAD_CAT_ID,RCS,OPS_STATUS_CODE\n6,1.5,\n5,,D\n")
    (groups / "starlink.json").write_text("[" + ", ".join(RAW % (k, m, f', "RMS": "{r}"') for k, m, r in ((6, 14.5, ""), (6, 14.25, "0.5"), (7, 13.0, "0.1"))) + "]")
    (groups / "iss.json").write_text("Invalid query")
    with caplog.at_level("WARNING", "skyframe"):
        rows = catalog.load_catalog(spark, str(base), str(satcat), str(groups)).collect()
    assert "iss isn't a list" in caplog.text.replace("supplemental group ", "") and "css" in caplog.text and "starlink" not in caplog.text
    assert [r.norad_id for r in rows] == [5, 6, 7]  # 9 has the elements of 5
    assert (rows[0].ops_code, rows[0].rcs, rows[0].tle_line1) == ("D", None, "1")
    assert (rows[1].ops_code, rows[1].rcs, rows[1].rms, rows[1].tle_line1) == (None, 1.5, 0.5, None)
    assert rows[2].ops_code == "+" and rows[2].n0 == pytest.approx(13 * 2 * math.pi / 1440)
    plain = catalog.load_catalog(spark, str(base), str(satcat)).collect()
    assert [r.norad_id for r in plain] == [5, 6] and all(r.rms is None for r in plain)
    base.write_text("[" + (RAW % (5, 15.0, BASE.replace("UTC", "TAI"))) + "]")
    with pytest.raises(catalog.CatalogError, match="TIME_SYSTEM"):
        catalog.load_base(spark, str(base))
    base.write_text("[" + (RAW % (5, 15.0, "")) + "]")
    with pytest.raises(catalog.CatalogError, match="REF_FRAME"):
        catalog.load_base(spark, str(base))
    satcat.write_text("NORAD_CAT_ID,RCS,OPS_STATUS_CODE\n6,1.5,\n6,,D\n")
    with pytest.raises(catalog.CatalogError, match="recurs"):
        catalog.load_satcat(spark, str(satcat))


def test_rules_of_elements(spark):
    row = (5, 2460000.5, 0.25, 0.06, 0.001, 1.0, 1.0, 1.0, 1.0, 0.0)
    frame = lambda *rows: spark.createDataFrame(list(rows), schema.GPE)
    assert catalog.check_elements(frame(row, (6, *row[1:]))).count() == 2
    for rows, said in (((), "no elements"), ((row, row), "recurs"), ((row, (5, 2460000.0, 0.75, *row[3:])), "recurs"), (((5, *row[1:3], float("nan"), *row[4:]),), "n0"), (((None, *row[1:]),), "norad_id")):
        with pytest.raises(catalog.CatalogError, match=said):
            catalog.check_elements(frame(*rows))
    for span in ((1.0, 1.0), (2.0, 1.0), (float("nan"), 1.0), (0.0, 1.0, 5.0, 5.0), (0.0, 1.0, float("nan"))):
        with pytest.raises(ValueError):
            catalog.check_span(*span)


def test_results_are_tables(spark, tmp_path):
    store = store_of(spark, line(1, -1, 0, 2), line(-1, 1, 0, 2), line(5, 0, 0, 1))
    made = results.Conjunctions.detect(store, 0.1, 0.75, str(tmp_path / "found"))
    again = results.Conjunctions.mount(spark, str(tmp_path / "found"))
    assert again.n_steps == 3 and [r.cd_end for r in again.steps.orderBy("cd_idx").collect()] == [0.75, 1.5, 2.0]
    assert [(r.cd_idx, r.i, r.j, round(r.tca, 9)) for r in made.conjunctions.collect()] == [(1, 0, 1, 1.0)]
    assert [tuple(r) for r in again.aabb_collisions(1).collect()] == [(0, 1)] and again.aabb_collisions(2).count() == 0
    assert again.aabbs.count() == again.srt_aabbs.count() == 9 and again.mcodes.count() == 8 and again.global_aabbs.count() == 3
    last = {r.obj_idx: (r.pos, r.lx) for r in again.srt_aabbs.filter("cd_idx = 2").collect()}
    assert last[2] == (2, float("inf"))
    assert again.leaves(0).count() == 3 and again.otypes.count() == 3
    for k in (-1, 3):
        with pytest.raises(IndexError):
            again.aabb_collisions(k)
    with pytest.raises(ValueError):
        results.Conjunctions.detect(TrajectoryStore.from_frames(store.objects.withColumn("otype", F.lit(3)), store.segments), 0.1, 0.75, str(tmp_path / "other"))


def test_results_by_step(spark, tmp_path):
    """A step's accessors read its folder only, counters are those of the pass that found, and stages without rows read as empty."""
    store = store_of(spark, line(1, -1, 0, 2), line(-1, 1, 0, 2), line(5, 0, 0, 1))
    made = results.Conjunctions.detect(store, 0.1, 0.75, str(tmp_path / "found"))
    for rows in (made.leaves(1), made.aabb_collisions(1), made.conjunctions_in(1)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(cd_idx" in plan
    assert len(os.listdir(tmp_path / "found" / "aabbs")) > 3 and not (tmp_path / "found" / "found").exists()
    assert [tuple(r)[:3] for r in made.conjunctions_in(1).collect()] == [(1, 0, 1)] and made.conjunctions_in(0).count() == 0
    wanted = cj.narrow_report(made._table("collisions"), store.segments, store.max_t, 0.75, 0.1)
    assert sorted(map(tuple, made.report.collect())) == sorted(map(tuple, wanted.select(made.report.columns).collect()))
    assert made.report.agg(F.sum("hits")).first()[0] >= 1
    none = results.Conjunctions.detect(store_of(spark, line(1, 0, 0, 1), line(50, 0, 0, 1)), 0.1, 0.75, str(tmp_path / "none"))
    assert none.conjunctions.count() == none.report.count() == none.aabb_collisions(0).count() == 0


def test_without_primaries_nothing_is_searched(spark, tmp_path):
    store = store_of(spark, line(1, -1, 0, 2), line(-1, 1, 0, 2))
    others = TrajectoryStore.from_frames(store.objects.withColumn("otype", F.when(F.col("obj_idx") == 0, 2).otherwise(4)), store.segments)
    assert cj.detect(others.objects, others.segments, others.max_t, 0.1, 0.75).columns == cj.detect(store.objects, store.segments, store.max_t, 0.1, 0.75).columns
    made = results.Conjunctions.detect(others, 0.1, 0.75, str(tmp_path / "found"))
    assert made.conjunctions.count() == made.report.count() == made.aabb_collisions(1).count() == 0
    assert made.mcodes.count() == 6 and made.leaves(1).count() == 2
    for odd in (3, None):
        with pytest.raises(ValueError):
            cj.check_types(store.objects.withColumn("otype", F.lit(odd).cast("int")))


def test_boxes_of_odd_numbers_raise(spark):
    """NaN and infinity don't get lost in minima and maxima: a box that isn't finite ends the job."""
    store = store_of(spark, line(1, -1, 0, 0.5), line(-1, 1, 0, 0.5))
    for bad in (math.nan, math.inf):
        x = F.when(F.col("obj_idx") == 1, F.array(F.lit(bad), *(F.col("x")[k] for k in range(1, 4)))).otherwise(F.col("x"))
        with pytest.raises(Exception, match="isn't finite"):
            cj.aabbs(store.segments.withColumn("x", x), store.max_t, 0.25, 0.1).collect()


def test_elements_from_arrays_and_records(spark):
    import pandas as pd

    names = schema.GPE.fieldNames()
    rows = [(k, 2460000.5, 0.1 * k, 0.06, 0.001, 1.0, 2.0, 3.0, 0.5, 1e-5) for k in (5, 6)]
    array = np.array(rows, dtype=[(n, "i8" if n == "norad_id" else "f8") for n in names])
    frame = pd.DataFrame(rows, columns=names).assign(extra="x")
    records = [type("Record", (), dict(zip(catalog.RECORD, r, strict=True)))() for r in rows]
    text = spark.createDataFrame(frame.astype({"norad_id": str}))
    for data in (array, array[::-1], frame, records, text):
        got = catalog.check_elements(catalog.elements(spark, data))
        assert got.schema == schema.GPE and sorted(map(tuple, got.collect())) == rows
    assert catalog.elements(spark, array[:0]).count() == catalog.elements(spark, []).count() == 0
    for odd in (array.astype([(n, "f8") for n in names]), [*records, 1], tuple(rows), array[None]):
        with pytest.raises(TypeError):
            catalog.elements(spark, odd)
    with pytest.raises(catalog.CatalogError, match="bstar"):
        catalog.elements(spark, frame.drop(columns="bstar"))


def test_stores_in_buckets(spark, tmp_path):
    """Steps' lists of a store in buckets move nothing, one object is read from one bucket, and a mounted store knows its buckets."""
    store = store_of(spark, line(1, -1, 0, 2), line(-1, 1, 0, 2), (np.zeros((0, 4, 7)), []), line(5, 0, 0, 1))
    plain = store.save(str(tmp_path / "plain"))
    kept = store.save(str(tmp_path / "it's in buckets"), buckets=3)
    again = TrajectoryStore.mount(spark, str(tmp_path / "it's in buckets"))
    for s in (kept, again):
        listed = cj.listed_segments(s.segments, s.max_t, 0.75)
        plan = lambda df: df._jdf.queryExecution().executedPlan()
        ends = s.segments.groupBy("obj_idx").agg(F.max("t_end"))
        assert "Exchange hashpartitioning" not in plan(listed).toString() and "Exchange" not in plan(ends).toString()
        assert plan(s.segments.filter("obj_idx = 1")).collectLeaves().head().optionalBucketSet().get().cardinality() == 1
        assert sorted(map(tuple, s.segments.collect())) == sorted(map(tuple, plain.segments.collect()))
    assert found(again, 0.1, 0.75) == found(plain, 0.1, 0.75) and len(found(again, 0.1, 0.75)) == 1
    gone = store.save_temporary(buckets=2)
    gone.detach()
    assert not os.path.exists(gone.path)


def test_temporary_stores_go(spark):
    store = store_of(spark, line(1, -1, 0, 2)).save_temporary()
    assert os.path.isdir(store.path) and store.segments.count() == 20
    with pytest.raises(StoreError, match="persistent"):
        TrajectoryStore.mount(spark, store.path)
    store.detach()
    assert not os.path.exists(store.path)


def test_roots_closer_than_numbers_resolve():
    third = np.poly1d([1, -0.3]) ** 3
    row, low, high = poly.sign_intervals(third.coeffs[::-1][None].copy(), np.array([1.0]))
    assert len(row) == 1 and low[0] <= 0.3 + 1e-6 and high[0] >= 0.3 - 1e-6
    row, t = poly.real_roots(np.poly(np.array([0.25, 0.5, 0.75]))[::-1][None].copy(), np.array([1.0]))
    assert np.allclose(np.sort(t), [0.25, 0.5, 0.75])


def test_boxes_of_many_sizes(spark):
    """Crowds of small boxes, some large ones, and one that holds everything."""
    draw = np.random.default_rng(11)
    rows = []
    for step in range(2):
        for i in range(300):
            size = 10.0 ** draw.integers(-3, 3) if i else 1e4
            middle = draw.normal(size=4) * (1 if i % 5 else 200)
            low, high = (middle + s * size * draw.uniform(0.2, 1, 4) for s in (-1, 1))
            rows.append((step, i, *low.tolist(), *high.tolist()))
    boxes = spark.createDataFrame(rows, cj.BOX_DDL)
    objects = spark.createDataFrame([(i, (1, 2, 4)[i % 3]) for i in range(300)], "obj_idx long, otype int")
    coded = cj.morton(boxes)
    found = sorted(map(tuple, cj.collisions(coded, objects).collect()))
    assert found == sorted(map(tuple, cj.collisions_naive(coded, objects).collect())) and len(found) > 500


def test_cells_are_no_larger_than_boxes_need(spark):
    """A crowd in a small part of a wide space: joined rows stay within twice those of cells of the size of boxes."""
    draw = np.random.default_rng(12)
    middle = np.concatenate([draw.uniform(0, 20, (4000, 4)), draw.uniform(-1e4, 1e4, (200, 4))])
    rows = [(0, i, *(m - 0.5).tolist(), *(m + 0.5).tolist()) for i, m in enumerate(middle)]
    coded = cj.morton(spark.createDataFrame(rows, cj.BOX_DDL))
    objects = spark.createDataFrame([(i, 1) for i in range(len(rows))], "obj_idx long, otype int")
    o = cj._at_home(coded.select("cd_idx", "obj_idx", *(F.col(f"{s}{a}").alias(f"o{s}{a}") for s in "lu" for a in cj.AXES)), "o")
    levels = o.groupBy("cd_idx").agg(F.collect_set("ohome").alias("levels"))
    per = cj._cells(o, levels, "o").groupBy("cd_idx", "level", "cx", "cy", "cz").count()
    met = per.agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    cells = {}
    for m in middle:  # cells with edges of 1.5 boxes
        for x, y, z in {tuple(np.floor((m[:3] + s) / 1.5).astype(int)) for s in np.array(np.meshgrid(*[[-0.5, 0.5]] * 3)).T.reshape(-1, 3)}:
            cells[x, y, z] = cells.get((x, y, z), 0) + 1
    assert met < 2 * sum(n * n for n in cells.values())
    assert cj.collisions(coded, objects).count() == cj.collisions_naive(coded, objects).count()


def plain_windows(i, j):
    return sorted((max(a[0], b[0]), min(a[1], b[1]), a[2], b[2]) for a in i for b in j if max(a[0], b[0]) < min(a[1], b[1]))


def test_windows_are_swept(spark):
    draw = np.random.default_rng(13)

    def segments(n, gaps):
        times = np.sort(draw.integers(0, 60, 2 * n)).tolist() if gaps else np.sort(draw.choice(60, n + 1, replace=False)).tolist()
        pairs = list(zip(times[::2], times[1::2], strict=True)) if gaps else list(zip(times, times[1:], strict=False))
        return [(float(a), float(b), float(a)) for a, b in pairs if a < b]

    sides = [(segments(draw.integers(1, 12), k % 2), segments(draw.integers(1, 12), k % 3 == 0)) for k in range(60)]
    coefficients = [[0.0, 0.0]] * 6
    part = lambda s: (*s, *coefficients)
    ddl = "array<struct<b: double, e: double, t_begin: double, " + ", ".join(f"{c}: array<double>" for c in schema.COORDS[:6]) + ">>"
    rows = [(k, 0, 1, 0.0, 60.0, [part(s) for s in i], 0.0, 60.0, [part(s) for s in j]) for k, (i, j) in enumerate(sides)]
    listed = spark.createDataFrame(rows, f"cd_idx long, i long, j long, i_born double, i_dead double, i_parts {ddl}, j_born double, j_dead double, j_parts {ddl}")
    got = {k: [] for k in range(60)}
    for b in listed.toArrow().to_batches():
        for r in cj.swept(b).to_pylist():
            got[r["cd_idx"]].append((r["begin"], r["end"], r["i_t_begin"], r["j_t_begin"]))
    for k, (i, j) in enumerate(sides):
        assert sorted(got[k]) == plain_windows(i, j)
    long = [[part((float(t), t + 1.0, float(t))) for t in range(n)] for n in (20_000, 10_000)]
    one = cj.swept(spark.createDataFrame([(0, 0, 1, 0.0, 2e4, long[0], 0.0, 1e4, long[1])], listed.schema).toArrow().combine_chunks().to_batches()[0])
    assert one.num_rows == 10_000


def test_points_meet_segments_by_merge(spark):
    """Ten thousand segments and points of one object: no row for each two of them."""
    n = 10_000
    one = F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))
    rows = spark.range(n).select(F.lit(7).cast("long").alias("obj_idx"), F.col("id").cast("int").alias("step_idx"), (F.col("id") / 8).alias("t_begin"), ((F.col("id") + 1) / 8).alias("t_end"), *(one.alias(c) for c in schema.COORDS))
    rows = rows.filter("step_idx % 1000 <> 5")
    points = spark.range(n).select(F.lit(7).cast("long").alias("obj_idx"), (F.col("id") / 7 - 50).alias("t"), F.col("id").alias("_t"), F.lit("x").alias("_begin"))
    points = points.unionByName(points.limit(3)).unionByName(points.limit(1).withColumn("obj_idx", F.lit(None).cast("long")))
    for state in (evaluate.state_eval, evaluate.state_join):
        found = state(rows, points, 3)
        assert found.columns == [*points.columns, *schema.COORDS]
        seen = 0
        for r in found.collect():
            k = math.floor(r.t * 8)
            if r.obj_idx is not None and 0 <= k < n and k % 1000 != 5:
                assert r.x == pytest.approx(1 + r.t - k / 8)
                seen += 1
            else:
                assert math.isnan(r.x)
        assert found.count() == n + 4 and seen > 8000
    assert evaluate.state_eval(rows.limit(0), points, 3).filter(F.isnan("x")).count() == n + 4


def test_dates_know_no_session_zone(spark):
    rows = spark.createDataFrame([("2024-07-05T12:00:00.123456789",), ("2024-07-05T12:00:00Z",), ("2017-01-01",), ("2016-12-31T23:59:59.9996",), (None,)], "iso string")
    for zone in ("Asia/Tokyo", "America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            dated = timescale.with_pair(rows, timescale.iso_to_jd(F.col("iso")), "a", "b")
            out = dated.select("a", "b", *(timescale.jd_to_iso((F.col("a"), F.col("b")), k).alias(f"d{k}") for k in (0, 3, 9))).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        day = 2460496.5
        assert ((out[0].a - day) + out[0].b) * 86400 == pytest.approx(43200.123456789, abs=1e-10)
        assert (out[1].a, out[1].b, out[2].a) == (2460497.0, 0.0, 2457754.5)
        assert [tuple(r)[2:] for r in out] == [
            ("2024-07-05T12:00:00", "2024-07-05T12:00:00.123", "2024-07-05T12:00:00.123456789"),
            ("2024-07-05T12:00:00", "2024-07-05T12:00:00.000", "2024-07-05T12:00:00.000000000"),
            ("2017-01-01T00:00:00", "2017-01-01T00:00:00.000", "2017-01-01T00:00:00.000000000"),
            ("2017-01-01T00:00:00", "2017-01-01T00:00:00.000", "2016-12-31T23:59:59.999600000"),
            (None, None, None),
        ]


def test_intervals_of_elements(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "norad_id long, epoch_jd1 double, epoch_jd2 double, bstar double")
    gpes = frame((1, 2457754.5, -1e-9, 0.0), (1, 2457754.0, 0.5, 0.0), (1, 2457753.0, 0.0, 0.0), (2, 2457755.0, 0.0, 0.0), (3, 2457760.0, 0.0, 0.0), (3, 2457761.0, 0.0, 0.0))
    rows = {(r.norad_id, r.epoch_jd1): r for r in catalog.gpe_intervals(gpes, 2457754.0, 2457756.0).collect()}
    assert set(rows) == {(1, 2457753.0), (1, 2457754.5), (1, 2457754.0), (2, 2457755.0), (3, 2457760.0)}
    # the last epoch before the leap second, and the one a nanoday later behind it
    a, b = rows[1, 2457754.5], rows[1, 2457754.0]
    assert (a.end - a.begin) * 86400 == pytest.approx(86400e-9 + 1, abs=1e-9) and (b.begin_jd1, b.begin_jd2) == (2457754.5, 0.0)
    assert (a.begin_jd1 - 2457754.5) + a.begin_jd2 == pytest.approx(-1e-9, abs=1e-18)
    assert rows[2, 2457755.0].begin == 0.0 and rows[2, 2457755.0].end * 86400 == pytest.approx(2 * 86400 + 1, abs=1e-9)
    for broken, said in ((frame((1, 2457754.0, 0.5, 0.0), (1, 2457754.5, 0.0, 0.0)), "recurs"), (frame((1, 2457754.0, 0.0, float("nan"))), "bstar"), (frame(), "no elements"), (gpes.drop("epoch_jd2"), "epoch_jd2")):
        with pytest.raises(catalog.CatalogError, match=said):
            catalog.gpe_intervals(broken, 2457754.0, 2457756.0)
    assert catalog.gpe_intervals(frame((1, 2457754.0, 0.0, float("nan"))), 2457754.0, 2457756.0, check=False).count() == 1


def test_nearest_rows_of_a_hot_key(spark):
    """A key with most rows, many of one time, shared among ranges of time."""
    draw = np.random.default_rng(14)
    keys = lambda n: [None if k == 3 else int(k) for k in np.where(draw.random(n) < 0.9, 1, draw.integers(0, 5, n))]
    left = [(k, int(x), n) for n, (k, x) in enumerate(zip(keys(600), draw.integers(-20, 120, 600), strict=True))]
    right = [(k, int(x), n % 7, n) for n, (k, x) in enumerate(zip(keys(300), np.where(draw.random(300) < 0.3, 50, draw.integers(0, 100, 300)), strict=True))]
    a, b = spark.createDataFrame(left, "k int, t int, n int"), spark.createDataFrame(right, "k int, t int, tie int, v int")
    want = {}
    for k, t, n in left:
        near = min(((abs(r[1] - t), r[1], r[2]) for r in right if r[0] == k), default=None)
        want[n] = near
    for parts in (None, 1, 7, 40):
        rows = catalog.asof_nearest(a, b.withColumn("u", F.col("t")), ["k"], "t", ["u", "tie"], "tie", parts).collect()
        assert len(rows) == len(left)
        for r in rows:
            assert (None if r.u is None else (abs(r.u - r.t), r.u, r.tie)) == want[r.n]
    ranged = catalog._parted(a.select("k", F.col("t").alias("_t"), F.lit(0).alias("_side"), F.col("n").alias("_tie")), ["k"], 8)
    assert max(r["count"] for r in ranged.groupBy("_part").count().collect()) < 0.3 * len(left)


def test_temporary_stores_go_with_what_refers_to_them(spark, tmp_path):
    import gc
    import subprocess
    import sys
    from pathlib import Path

    store = store_of(spark, line(1, -1, 0, 2)).save_temporary()
    path = store.path
    del store
    gc.collect()
    assert not os.path.exists(path)
    say = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "%s").getOrCreate()
from skyframe.sources.store import TrajectoryStore
import numpy as np
store = TrajectoryStore.from_arrays(spark, [np.ones((1, 3, 7))], [np.array([0.0, 1.0])], [0]).save_temporary()
import os
print(os.path.isdir(store.path))
""" % tmp_path
    out = subprocess.run([sys.executable, "-c", say], env=os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}, capture_output=True, text=True, check=True, timeout=300)
    assert "True" in out.stdout and not list((tmp_path / "skyframe").glob("store-*"))
