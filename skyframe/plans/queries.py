"""The registered queries, each with the SQL that DuckDB answers it with, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import poly, timescale
from ..operators import conjunctions as cj
from ..operators import evaluate, propagate
from ..sources import catalog, store
from . import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _r(c, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# trajectories and their evaluation

_P = {a: f"(CAST({b.START[a]} AS DOUBLE) + CAST({b.SPEED[a]} AS DOUBLE) * (t - {b.SHIFT}))" for a in "xyz"}
_ALIVE = f"({b.MOVES} AND t >= {b.BEGIN} AND t < {b.BEGIN} + 2)"
_STATE = ", ".join(f"CASE WHEN {_ALIVE} THEN {_P[a]} ELSE 0.0 END AS {a}" for a in "xyz") + ", " + ", ".join(f"CASE WHEN {_ALIVE} THEN CAST({b.SPEED[a]} AS DOUBLE) ELSE 0.0 END AS v{a}" for a in "xyz") + f", CASE WHEN {_ALIVE} THEN CAST({b.START['r']} AS DOUBLE) ELSE 0.0 END AS r, NOT {_ALIVE} AS no_data"


def _states(spark, d, wanted: DataFrame) -> DataFrame:
    out = evaluate.state_eval(b.segments(spark, d), wanted, b.ORDER)
    values = [F.nanvl(c, F.lit(0.0)).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz", "r")]
    return out.select(*wanted.columns, *values, F.isnan("x").alias("no_data"))


@query("state_eval_scalar", f"SELECT k AS obj_idx, t, {_STATE} FROM (SELECT c_custkey AS k, CAST(1.125 AS DOUBLE) AS t FROM customer)")
def _(spark, d):
    return _states(spark, d, evaluate.at_time(b.objects(spark, d), 1.125))


@query("state_eval_array", f"SELECT k AS obj_idx, t, {_STATE} FROM (SELECT c_custkey AS k, CAST((c_custkey%13)*0.25 AS DOUBLE) AS t FROM customer)")
def _(spark, d):
    return _states(spark, d, b.objects(spark, d).select("obj_idx", F.expr("CAST((obj_idx%13)*0.25 AS DOUBLE)").alias("t")))


@query("state_eval_selector", f"SELECT pos, k AS obj_idx, k0 AS k, t, {_STATE} FROM (SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(5 AS BIGINT), CAST(0 AS BIGINT), CAST(1.5 AS DOUBLE)), (1, 3, 0, 0.75), (2, 5, 0, 2.0), (3, 7, 0, 1.0), (4, 4, 0, 9.0)) v(pos, k, k0, t))")
def _(spark, d):
    return _states(spark, d, evaluate.select_objects(spark, [5, 3, 5, 7, 4], [1.5, 0.75, 2.0, 1.0, 9.0], 100))


@query("state_meval_1d", f"SELECT k AS obj_idx, CAST(n AS INTEGER) AS k, t, {_STATE} FROM (SELECT c_custkey AS k, n, t FROM customer, (VALUES (0, CAST(0.25 AS DOUBLE)), (1, 1.0), (2, 2.25)) v(n, t))")
def _(spark, d):
    return _states(spark, d, evaluate.at_times(b.objects(spark, d), [0.25, 1.0, 2.25]))


@query("state_meval_2d", f"SELECT k AS obj_idx, CAST(n AS INTEGER) AS n, t, {_STATE} FROM (SELECT c_custkey AS k, n, CAST((c_custkey%5)*0.25+n*0.5 AS DOUBLE) AS t FROM customer, (VALUES (0), (1), (2)) v(n))")
def _(spark, d):
    rows = b.objects(spark, d).select("obj_idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    return _states(spark, d, rows.withColumn("t", F.expr("CAST((obj_idx%5)*0.25+n*0.5 AS DOUBLE)")))


_SEG = f"SELECT c_custkey AS k, s, CAST((c_custkey%4)*0.25 + s AS DOUBLE) AS tb, CAST((c_custkey%4)*0.25 + s + 1 AS DOUBLE) AS te FROM customer, (VALUES (0), (1)) v(s) WHERE c_custkey%7<>0"


@query("traj_meta", f"SELECT COUNT(DISTINCT k) AS n_moving, COUNT(*) AS n_steps, CAST(MAX(te) AS DOUBLE) AS maxT, CAST(3 AS INTEGER) AS poly_order FROM ({_SEG})")
def _(spark, d):
    return b.segments(spark, d).agg(F.countDistinct("obj_idx").alias("n_moving"), F.count(F.lit(1)).alias("n_steps"), F.max("t_end").alias("maxT"), (F.max(F.size("x")) - 1).alias("poly_order"))


@query("traj_offsets", f"SELECT k AS obj_idx, CAST(n AS BIGINT) AS n_steps, CAST(COALESCE(SUM(n*4*7) OVER w, 0) AS BIGINT) AS traj_offset, CAST(COALESCE(SUM(n+1) OVER w, 0) AS BIGINT) AS time_offset FROM (SELECT k, COUNT(*) AS n FROM ({_SEG}) GROUP BY k) WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return store.offsets(b.segments(spark, d)).select("obj_idx", "n_steps", F.col("traj_offset").cast("long").alias("traj_offset"), F.col("time_offset").cast("long").alias("time_offset"))


@query("traj_validate", "SELECT rule, CAST(broken AS BIGINT) AS broken FROM (SELECT 'increasing times' AS rule, COUNT(*) FILTER (c_custkey%7<>0 AND c_custkey%50=1) AS broken FROM customer UNION ALL SELECT 'steps without gaps', COUNT(*) FILTER (c_custkey%7<>0 AND c_custkey%50=1) FROM customer UNION ALL SELECT 'finite coefficients', 2*COUNT(*) FILTER (c_custkey%7<>0 AND c_custkey%60=2) FROM customer) WHERE broken > 0")
def _(spark, d):
    rows = b.segments(spark, d)
    rows = rows.withColumn("t_end", F.when((F.col("obj_idx") % 50 == 1) & (F.col("step_idx") == 0), F.col("t_begin")).otherwise(F.col("t_end")))
    rows = rows.withColumn("y", F.when(F.col("obj_idx") % 60 == 2, F.transform("y", lambda x: x * float("nan"))).otherwise(F.col("y")))
    return store.check_segments(rows).filter("broken > 0")


# polynomials

_LINE = "SELECT c_custkey AS k, CAST((c_custkey%17-8)/4.0 AS DOUBLE) AS c0, CAST((c_custkey%5-2)/2.0 AS DOUBLE) AS c1, CAST((c_custkey%3-1)/4.0 AS DOUBLE) AS c2, CAST((c_custkey%7-3)/8.0 AS DOUBLE) AS c3, CAST((c_custkey%11)/8.0 AS DOUBLE) AS a FROM customer"


def _cubics(spark, d) -> DataFrame:
    k = "c_custkey"
    rows = b.table(spark, d, "customer")
    return rows.select(F.col(k).alias("obj_idx"), F.expr(f"array(({k}%17-8)/4.0D, ({k}%5-2)/2.0D, ({k}%3-1)/4.0D, ({k}%7-3)/8.0D)").alias("c"), F.expr(f"({k}%11)/8.0D").alias("a"))


def _spread(df: DataFrame, c: Column) -> DataFrame:
    return df.select("obj_idx", *(_r(c[k], 9).alias(f"c{k}") for k in range(4)))


@query("poly_translate", f"SELECT k AS obj_idx, ROUND(c0+c1*a+c2*a*a+c3*a*a*a,9)+0.0 AS c0, ROUND(c1+2*c2*a+3*c3*a*a,9)+0.0 AS c1, ROUND(c2+3*c3*a,9)+0.0 AS c2, ROUND(c3,9)+0.0 AS c3 FROM ({_LINE})")
def _(spark, d):
    return _spread(_cubics(spark, d), poly.translate(F.col("c"), F.col("a"), 3))


@query("poly_rescale", f"SELECT k AS obj_idx, ROUND(c0,9)+0.0 AS c0, ROUND(c1*a,9)+0.0 AS c1, ROUND(c2*a*a,9)+0.0 AS c2, ROUND(c3*a*a*a,9)+0.0 AS c3 FROM ({_LINE})")
def _(spark, d):
    return _spread(_cubics(spark, d), poly.rescale(F.col("c"), F.col("a")))


@query("poly_derivative", f"SELECT k AS obj_idx, ROUND(c1,9)+0.0 AS c0, ROUND(2*c2,9)+0.0 AS c1, ROUND(3*c3,9)+0.0 AS c2, CAST(0.0 AS DOUBLE) AS c3 FROM ({_LINE})")
def _(spark, d):
    return _spread(_cubics(spark, d), poly.derivative(F.col("c")))


@query("poly_enclosure", f"SELECT k AS obj_idx, ROUND(LEAST(c0, c0+c1/3, c0+2*c1/3+c2/3, c0+c1+c2+c3),9)+0.0 AS low, ROUND(GREATEST(c0, c0+c1/3, c0+2*c1/3+c2/3, c0+c1+c2+c3),9)+0.0 AS high FROM ({_LINE})")
def _(spark, d):
    e = poly.bernstein(F.col("c"), 3)
    return _cubics(spark, d).select("obj_idx", _r(F.array_min(e), 9).alias("low"), _r(F.array_max(e), 9).alias("high"))


_QUADRATIC = "SELECT c_custkey AS k, CAST((c_custkey%17-8)/4.0+0.03125 AS DOUBLE) AS c0, CAST((c_custkey%5-2)/2.0 AS DOUBLE) AS c1 FROM customer"


@query("poly_roots", f"SELECT k AS obj_idx, ROUND(t,9)+0.0 AS root FROM (SELECT k, (-c1 + s*sqrt(c1*c1-4*c0))/2 AS t FROM ({_QUADRATIC}) q, (VALUES (-1), (1)) v(s) WHERE c1*c1-4*c0 > 0) r WHERE t >= 0 AND t < 2")
def _(spark, d):
    k = "c_custkey"
    rows = b.table(spark, d, "customer").select(F.col(k).alias("obj_idx"), F.expr(f"array(({k}%17-8)/4.0D+0.03125D, ({k}%5-2)/2.0D, 1.0D, 0.0D)").alias("c"), F.lit(2.0).alias("width"))
    return evaluate.roots(rows).select("obj_idx", _r("root", 9).alias("root"))


_GAP = {a: f"(CAST({b.START[a].replace('k*', '(k+1)*')} AS DOUBLE) - CAST({b.START[a]} AS DOUBLE))" for a in "xyz"}
_PACE = {a: f"(CAST({b.SPEED[a].replace('k*', '(k+1)*')} AS DOUBLE) - CAST({b.SPEED[a]} AS DOUBLE))" for a in "xyz"}
_TIE = 1.23e-7  # keeps decimal ties away from rounding


@query(
    "dist2_poly",
    "SELECT k AS obj_idx, "
    + ", ".join(f"ROUND({' + '.join(t.format(g=_GAP[a], v=_PACE[a]) for a in 'xyz')} + {_TIE}, 6)+0.0 AS c{n}" for n, t in enumerate(("{g}*{g}", "2*{g}*{v}", "{v}*{v}")))
    + ", CAST(0.0 AS DOUBLE) AS c3 FROM (SELECT c_custkey AS k FROM customer) c",
)
def _(spark, d):
    rows = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    line = lambda fragment, speed: F.expr(f"array(CAST({fragment} AS DOUBLE), CAST({speed} AS DOUBLE), 0.0D, 0.0D)")
    of = lambda a, text: text.replace("k*", "(k+1)*")
    sides = {f"i_{a}": line(b.START[a], b.SPEED[a]) for a in "xyz"} | {f"j_{a}": line(of(a, b.START[a]), of(a, b.SPEED[a])) for a in "xyz"}
    rows = rows.select(F.col("k").alias("obj_idx"), *(v.alias(c) for c, v in sides.items()), F.lit(1.5).alias("width"))
    return _spread_near(evaluate.distances2(rows))


def _spread_near(df: DataFrame) -> DataFrame:
    return df.select("obj_idx", *(_r(F.col("d2")[k] + _TIE, 6).alias(f"c{k}") for k in range(3)), _r(F.col("d2")[3], 6).alias("c3"))


# detection

_STEPS = "SELECT i AS cd_idx, CAST(i*0.375 AS DOUBLE) AS cb, CAST(CASE WHEN i=7 THEN 2.75 ELSE (i+1)*0.375 END AS DOUBLE) AS ce FROM range(8) t(i)"
_NEXT = "nextafter(CAST({v} AS FLOAT), CAST('{s}infinity' AS FLOAT))"


def _at(a: str, t: str, begins: dict[str, str]) -> str:
    return f"(CAST({begins[a]} AS DOUBLE) + CAST({b.SPEED[a]} AS DOUBLE) * ({t} - {b.SHIFT}))" if a != "r" else f"CAST({begins['r']} AS DOUBLE)"


_HALF = "0.55"
def _boxes_of(begins: dict[str, str]) -> str:
    return (
        f"SELECT cd_idx, k AS obj_idx, "
        + ", ".join(f"MIN({_NEXT.format(v=f'LEAST({_at(a, 'lo', begins)}, {_at(a, 'hi', begins)}) - CAST({_HALF} AS DOUBLE)', s='-')}) AS l{a}" for a in "xyzr")
        + ", "
        + ", ".join(f"MAX({_NEXT.format(v=f'GREATEST({_at(a, 'lo', begins)}, {_at(a, 'hi', begins)}) + CAST({_HALF} AS DOUBLE)', s='')}) AS u{a}" for a in "xyzr")
        + f" FROM (SELECT cd_idx, k, GREATEST(cb, tb) AS lo, LEAST(ce, te) AS hi FROM ({_SEG}) s JOIN ({_STEPS}) c ON tb < ce AND te > cb) GROUP BY cd_idx, k"
    )


_BOX = _boxes_of(b.START)
_SIDES = [s + a for s in "lu" for a in "xyzr"]
_GLOBAL = "SELECT cd_idx, " + ", ".join(f"MIN(l{a}) AS gl{a}" for a in "xyzr") + ", " + ", ".join(f"MAX(u{a}) AS gu{a}" for a in "xyzr") + " FROM box GROUP BY cd_idx"


def _cell(a: str) -> str:
    centre = f"CAST(CAST(l{a}/2 AS FLOAT) + CAST(u{a}/2 AS FLOAT) AS FLOAT)"
    place = f"CAST(CAST({centre} - gl{a} AS FLOAT) / CAST(gu{a} - gl{a} AS FLOAT) AS FLOAT)"
    return f"LEAST(CAST(TRUNC(CAST(GREATEST({place}, CAST(0 AS FLOAT)) * CAST(65536 AS FLOAT) AS DOUBLE)) AS BIGINT), 65535)"


def _bits(v: str) -> str:
    return " + ".join(f"(CAST(({v} >> {i}) & 1 AS HUGEINT) * {2 ** (4 * i)})" for i in range(16))


def _codes_of(begins: dict[str, str]) -> str:
    return (
        f"WITH box AS ({_boxes_of(begins)}), span AS ({_GLOBAL}), cells AS (SELECT box.*, " + ", ".join(f"{_cell(a)} AS c{a}" for a in "xyzr") + " FROM box JOIN span USING (cd_idx)), "
        "sums AS (SELECT *, " + " + ".join(f"({_bits('c' + a)}) * {2**k}" for k, a in enumerate("xyzr")) + " AS code FROM cells), "
        "coded AS (SELECT cd_idx, obj_idx, " + ", ".join(_SIDES) + ", CAST(CASE WHEN code >= 9223372036854775808 THEN code - 18446744073709551616 ELSE code END AS BIGINT) AS mcode FROM sums), "
        "leaf AS (SELECT cd_idx, mcode, COUNT(*) AS n, " + ", ".join(f"MIN(l{a}) AS l{a}" for a in "xyzr") + ", " + ", ".join(f"MAX(u{a}) AS u{a}" for a in "xyzr") + " FROM coded GROUP BY cd_idx, mcode), "
        f"typed AS (SELECT k AS obj_idx, {b.OTYPE} AS otype FROM (SELECT c_custkey AS k FROM customer))"
    )


_CODED = _codes_of(b.START)


def _boxes(spark, d) -> DataFrame:
    return cj.aabbs(b.segments(spark, d), b.MAX_T, b.INTERVAL, b.THRESHOLD)


def _coded(spark, d) -> DataFrame:
    return cj.morton(_boxes(spark, d))


def _pairs(spark, d) -> DataFrame:
    return cj.collisions(_coded(spark, d), b.objects(spark, d))


@query("cd_steps", f"SELECT cd_idx, cb AS cd_begin, ce AS cd_end FROM ({_STEPS})")
def _(spark, d):
    return cj.cd_steps(spark, b.segments(spark, d).agg(F.max("t_end")).first()[0], b.INTERVAL)


@query("aabbs", f"SELECT cd_idx, obj_idx, {', '.join(_SIDES)} FROM ({_BOX})")
def _(spark, d):
    return _boxes(spark, d)


@query("global_aabb", f"WITH box AS ({_BOX}) {_GLOBAL}")
def _(spark, d):
    return cj.global_aabbs(_boxes(spark, d)).withColumnsRenamed({s: "g" + s for s in _SIDES})


@query("aabbs_missing", f"WITH box AS ({_BOX}) SELECT s.cd_idx, c_custkey AS obj_idx, COALESCE(lx, CAST(0 AS FLOAT)) AS lx, COALESCE(ur, CAST(0 AS FLOAT)) AS ur, lx IS NULL AS infinite FROM customer CROSS JOIN ({_STEPS}) s LEFT JOIN box ON box.cd_idx = s.cd_idx AND box.obj_idx = c_custkey")
def _(spark, d):
    rows = cj.all_boxes(_boxes(spark, d), b.objects(spark, d), cj.cd_steps(spark, b.MAX_T, b.INTERVAL))
    gone, zero = F.col("lx") == float("inf"), F.lit(0.0).cast("float")
    return rows.select("cd_idx", "obj_idx", F.when(gone, zero).otherwise(F.col("lx")).alias("lx"), F.when(gone, zero).otherwise(F.col("ur")).alias("ur"), gone.alias("infinite"))


@query("morton", f"{_CODED} SELECT cd_idx, obj_idx, mcode FROM coded")
def _(spark, d):
    return _coded(spark, d).select("cd_idx", "obj_idx", "mcode")


@query("srt_idx", f"{_CODED}, every AS (SELECT s.cd_idx, c_custkey AS obj_idx, COALESCE(mcode, -1) AS mcode, mcode IS NULL AS empty FROM customer CROSS JOIN ({_STEPS}) s LEFT JOIN coded ON coded.cd_idx = s.cd_idx AND coded.obj_idx = c_custkey) SELECT cd_idx, CAST(ROW_NUMBER() OVER (PARTITION BY cd_idx ORDER BY empty, mcode < 0, mcode, obj_idx) - 1 AS BIGINT) AS pos, obj_idx, mcode FROM every")
def _(spark, d):
    return cj.morton_order(_coded(spark, d), b.objects(spark, d), cj.cd_steps(spark, b.MAX_T, b.INTERVAL))


@query("bvh_leaves", f"{_CODED} SELECT cd_idx, mcode, CAST(n AS BIGINT) AS n, {', '.join(_SIDES)} FROM leaf")
def _(spark, d):
    return cj.leaves(_coded(spark, d))


@query("bvh_tree")
def _(spark, d):
    return cj.bvh_tree(_coded(spark, d))


@query("bvh_nodes", f"{_CODED} SELECT cd_idx, CAST(2*COUNT(*)-1 AS BIGINT) AS n_nodes, CAST(COUNT(*) AS BIGINT) AS n_leaves, CAST(SUM(n) AS BIGINT) AS n_members FROM leaf GROUP BY cd_idx")
def _(spark, d):
    leaf = F.col("left") < 0
    return cj.bvh_tree(_coded(spark, d)).groupBy("cd_idx").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(leaf).alias("n_leaves"), F.sum(F.when(leaf, F.col("end") - F.col("begin"))).alias("n_members"))


_HIT = " AND ".join(f"o.u{a} >= l.l{a} AND o.l{a} <= l.u{a}" for a in "xyzr")
_HITS = f", hits AS (SELECT o.cd_idx, o.obj_idx AS i, m.obj_idx AS j FROM coded o JOIN leaf l ON o.cd_idx = l.cd_idx AND {_HIT} JOIN coded m ON m.cd_idx = l.cd_idx AND m.mcode = l.mcode AND o.obj_idx < m.obj_idx JOIN typed ti ON ti.obj_idx = o.obj_idx JOIN typed tj ON tj.obj_idx = m.obj_idx WHERE ti.otype + tj.otype <= 3)"
_COLLIDE = _CODED + _HITS


@query("aabb_collisions", f"{_COLLIDE} SELECT cd_idx, i, j FROM hits")
def _(spark, d):
    return _pairs(spark, d)


@query("aabb_collisions_naive", f"{_COLLIDE} SELECT cd_idx, i, j FROM hits")
def _(spark, d):
    return cj.collisions_naive(_coded(spark, d), b.objects(spark, d))


@query("collisions_clustered", f"{_codes_of(b.CLUSTERED)}{_HITS} SELECT cd_idx, i, j FROM hits")
def _(spark, d):
    boxes = cj.aabbs(b.segments(spark, d, b.CLUSTERED), b.MAX_T, b.INTERVAL, b.THRESHOLD)
    return cj.collisions(cj.morton(boxes), b.objects(spark, d))


@query("collisions_otypes", f"{_COLLIDE} SELECT cd_idx, ti.otype AS type_i, tj.otype AS type_j, CAST(COUNT(*) AS BIGINT) AS n FROM hits JOIN typed ti ON ti.obj_idx = i JOIN typed tj ON tj.obj_idx = j GROUP BY cd_idx, ti.otype, tj.otype")
def _(spark, d):
    return cj.collisions_by_type(_coded(spark, d), b.objects(spark, d))


_MOVING = "SELECT c_custkey AS k, " + ", ".join(f"CAST({b.START[a].replace('k*', 'c_custkey*')} AS DOUBLE) - CAST({b.SPEED[a].replace('k*', 'c_custkey*')} AS DOUBLE)*{b.SHIFT} AS {a}0, CAST({b.SPEED[a].replace('k*', 'c_custkey*')} AS DOUBLE) AS v{a}" for a in "xyz") + f", CAST((c_custkey%4)*0.25 AS DOUBLE) AS ta, CAST((c_custkey%4)*0.25+2 AS DOUBLE) AS tz, {b.OTYPE.replace('k%', 'c_custkey%')} AS otype FROM customer WHERE c_custkey%7<>0"
_PAIRED = (
    f"m AS ({_MOVING}), p AS (SELECT i.k AS i, j.k AS j, " + ", ".join(f"i.{a}0-j.{a}0 AS d{a}, i.v{a}-j.v{a} AS w{a}" for a in "xyz") + ", GREATEST(i.ta, j.ta) AS a, LEAST(i.tz, j.tz) AS z FROM m i JOIN m j ON i.k < j.k AND i.otype + j.otype <= 3 AND i.tz > j.ta AND j.tz > i.ta), "
    "q AS (SELECT *, wx*wx+wy*wy+wz*wz AS qa, dx*wx+dy*wy+dz*wz AS qb FROM p)"
)
_CONJ = (
    f"WITH {_PAIRED}, "
    "c AS (SELECT i, j, -qb/qa AS tca, dx, dy, dz, wx, wy, wz, 0 AS kind FROM q WHERE qa > 0 AND -qb/qa > a AND -qb/qa < z "
    "UNION ALL SELECT i, j, a, dx, dy, dz, wx, wy, wz, 1 FROM q WHERE qa*a+qb > 0 UNION ALL SELECT i, j, z, dx, dy, dz, wx, wy, wz, 2 FROM q WHERE qa*z+qb < 0), "
    "e AS (SELECT i, j, tca, kind, wx, wy, wz, sqrt((dx+wx*tca)*(dx+wx*tca)+(dy+wy*tca)*(dy+wy*tca)+(dz+wz*tca)*(dz+wz*tca)) AS dca FROM c), "
    "conj AS (SELECT CAST(CASE WHEN kind=2 THEN CEIL(tca/0.375)-1 ELSE LEAST(FLOOR(tca/0.375), 7) END AS BIGINT) AS cd_idx, i, j, tca, dca, kind, sqrt(wx*wx+wy*wy+wz*wz) AS speed FROM e WHERE dca < 1.1)"
)


def _report(spark, d) -> DataFrame:
    """What the narrow phase counts, without what it finds."""
    return cj.report_of(cj.search_found(_coded(spark, d), b.objects(spark, d), b.segments(spark, d), b.MAX_T, b.INTERVAL, b.THRESHOLD, cj.REPORT))


def _found(spark, d, *columns: str, objects: DataFrame | None = None) -> DataFrame:
    """The wanted columns of what is found: in no order, as SQL asks for none."""
    return cj.detected(b.objects(spark, d) if objects is None else objects, b.segments(spark, d), b.MAX_T, b.THRESHOLD, b.INTERVAL, columns)


@query("conjunctions", f"{_CONJ} SELECT cd_idx, i, j, ROUND(tca,6)+0.0 AS tca, ROUND(dca,6)+0.0 AS dca FROM conj")
def _(spark, d):
    return _found(spark, d, "cd_idx", "i", "j", "tca", "dca").select("cd_idx", "i", "j", _r("tca").alias("tca"), _r("dca").alias("dca"))


@query("rel_speed", f"{_CONJ} SELECT i, j, ROUND(tca,6)+0.0 AS tca, ROUND(speed,6)+0.0 AS rel_speed FROM conj")
def _(spark, d):
    square = lambda k: (F.col("vi")[k] - F.col("vj")[k]) * (F.col("vi")[k] - F.col("vj")[k])
    speed = F.sqrt(square(0) + square(1) + square(2))
    return _found(spark, d, "i", "j", "tca", "vi", "vj").select("i", "j", _r("tca").alias("tca"), _r(speed).alias("rel_speed"))


@query("conj_ids", f"{_CONJ} SELECT i+40000 AS norad_i, j+40000 AS norad_j, ROUND(dca,6)+0.0 AS dca FROM conj")
def _(spark, d):
    kind = b.objects(spark, d).schema["norad_id"].dataType
    return _found(spark, d, "norad_id_i", "norad_id_j", "tca", "dca").select(*(F.col(f"norad_id_{s}").cast(kind).alias(f"norad_{s}") for s in "ij"), _r("dca").alias("dca"))


@query("tca_utc", f"{_CONJ} SELECT i, j, strftime(TIMESTAMP '2023-02-25 00:00:00' + to_milliseconds(CAST(ROUND(ROUND(tca,6)*86400000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS tca_utc FROM conj")
def _(spark, d):
    rows = _found(spark, d, "i", "j", "tca").select("i", "j", F.round("tca", 6).alias("tca"))
    rows = timescale.with_pair(rows, timescale.utc_to_tai((F.lit(2460000.5), F.lit(0.0))), "a", "b")
    rows = timescale.with_pair(rows, timescale.dl_add((F.col("a"), F.col("b")), (F.col("tca"), F.lit(0.0))), "hi", "lo")
    rows = timescale.with_pair(rows, timescale.tai_to_utc((F.col("hi"), F.col("lo"))), "hi", "lo")
    return rows.select("i", "j", F.substr(timescale.jd_to_iso((F.col("hi"), F.col("lo"))), F.lit(1), F.lit(19)).alias("tca_utc"))


@query("conjunctions_boundary", f"{_CONJ} SELECT i, j, ROUND(tca,6)+0.0 AS tca, ROUND(dca,6)+0.0 AS dca, kind = 1 AS at_begin FROM conj WHERE kind > 0")
def _(spark, d):
    rows = _found(spark, d, "i", "j", "tca", "dca", *(f"{c}_{s}" for c in ("born", "dead") for s in "ij"))
    begin, end = (F.abs(F.col("tca") - edge) < 1e-9 for edge in (F.greatest("born_i", "born_j"), F.least("dead_i", "dead_j")))
    return rows.filter(begin | end).select("i", "j", _r("tca").alias("tca"), _r("dca").alias("dca"), begin.alias("at_begin"))


_TYPES = "CASE WHEN {k}%3=0 THEN 1 WHEN {k}%3=1 THEN 2 ELSE 4 END"


@query("conjunctions_otypes", f"{_CONJ.replace(b.OTYPE.replace('k%', 'c_custkey%'), _TYPES.format(k='c_custkey'))} SELECT cd_idx, i, j, ROUND(tca,6)+0.0 AS tca, ROUND(dca,6)+0.0 AS dca FROM conj")
def _(spark, d):
    objects = b.objects(spark, d).withColumn("otype", F.expr(_TYPES.format(k="obj_idx")))
    return _found(spark, d, "cd_idx", "i", "j", "tca", "dca", objects=objects).select("cd_idx", "i", "j", _r("tca").alias("tca"), _r("dca").alias("dca"))


@query(
    "conjunctions_curved",
    "SELECT CAST(FLOOR(t/0.8) AS BIGINT) AS cd_idx, 2*k AS i, 2*k+1 AS j, ROUND(t,6)+0.0 AS tca, h AS dca, ROUND(2*(t-1),6)+0.0 AS vx FROM "
    "(SELECT s_suppkey AS k, 1 + s*sqrt((s_suppkey%5+1)/8.0) AS t, CAST((s_suppkey%3)/16.0 AS DOUBLE) AS h FROM supplier, (VALUES (-1), (1)) v(s)) c",
)
def _(spark, d):
    objects, segments = b.curved(spark, d)
    found = cj.detect(objects, segments, 2.0, 0.25, 0.8)
    return found.select("cd_idx", "i", "j", _r("tca").alias("tca"), _r("dca").alias("dca"), _r(F.col("vj")[0]).alias("vx"))


@query("np_report")
def _(spark, d):
    return _report(spark, d)


_D2 = " + ".join("(d{0}+w{0}*({{t}}))*(d{0}+w{0}*({{t}}))".format(a) for a in "xyz")
_NEAR = "{} < 1.1*1.1"
_WINDOWS = (
    f"{_COLLIDE}, {_PAIRED}, "
    "piece AS (SELECT c_custkey AS k, (c_custkey%4)*0.25 + s AS tb FROM customer, (VALUES (0), (1)) v(s) WHERE c_custkey%7<>0), "
    f"win AS (SELECT h.cd_idx, q.*, CAST(GREATEST(e.tb, f.tb, cb) AS DOUBLE) AS w0, CAST(LEAST(e.tb+1, f.tb+1, ce) AS DOUBLE) AS w1 FROM hits h JOIN ({_STEPS}) s ON s.cd_idx = h.cd_idx JOIN piece e ON e.k = h.i JOIN piece f ON f.k = h.j JOIN q ON q.i = h.i AND q.j = h.j)"
)


@query(
    "np_counts",
    f"{_WINDOWS} SELECT cd_idx, COUNT(*) AS windows, COUNT(*) FILTER (qa > 0 AND -qb/qa > w0 AND -qb/qa < w1 AND {_NEAR.format(_D2.format(t='-qb/qa'))}) AS hits, "
    f"COUNT(*) FILTER (w1 = z AND qa*w1+qb < 0 AND {_NEAR.format(_D2.format(t='w1'))}) AS end_hits, COUNT(*) FILTER (w0 = a AND qa*w0+qb > 0 AND {_NEAR.format(_D2.format(t='w0'))}) AS begin_hits FROM win WHERE w0 < w1 GROUP BY cd_idx",
)
def _(spark, d):
    return _report(spark, d).select("cd_idx", "windows", "hits", "end_hits", "begin_hits")


# catalogs


@query("gpe_unit_convert", "SELECT event_id, ROUND(value*2*pi()/1440,9) AS n0, ROUND(value*2*pi()/360,9) AS i0 FROM events")
def _(spark, d):
    rows = b.table(spark, d, "events")
    return rows.select("event_id", F.round(F.col("value") * catalog.REV_PER_DAY, 9).alias("n0"), F.round(F.col("value") * catalog.DEGREE, 9).alias("i0"))


@query("gpe_placeholder_nulls", "SELECT event_id, NULLIF(event_type, 'click') AS name, CAST(NULLIF(CASE WHEN event_id%3=0 THEN '' ELSE CAST(event_id AS VARCHAR) END, '') AS DOUBLE) AS rms FROM events")
def _(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_id").cast("string"))
    return b.table(spark, d, "events").select("event_id", catalog.placeholder_to_null(F.col("event_type"), "click").alias("name"), catalog.empty_to_null(text).cast("double").alias("rms"))


@query("gpe_validate", "SELECT 'value is null' AS rule, CAST(COUNT(*) FILTER (event_id%97=0) AS BIGINT) AS broken FROM events UNION ALL SELECT 'event_type isn''t click', CAST(COUNT(*) FILTER (event_type <> 'click') AS BIGINT) FROM events UNION ALL SELECT 'user_id recurs', CAST(COUNT(*) AS BIGINT) FROM (SELECT user_id FROM events GROUP BY user_id HAVING COUNT(*) > 1)")
def _(spark, d):
    rows = b.table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 97 != 0, F.col("value")))
    return catalog.broken_rules(rows, unique="user_id", required=["value"], constant={"event_type": "click"})


@query("gpe_dedup", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_quantity, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def _(spark, d):
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    return catalog.first_of_same(rows, ("l_quantity", "l_returnflag", "l_linestatus"), "id").drop("id")


@query("supgp_concat", "SELECT event_id, value FROM events WHERE event_id%2=0 UNION ALL SELECT event_id, value FROM events WHERE event_id%3=0")
def _(spark, d):
    rows = b.table(spark, d, "events").select("event_id", "value")
    return catalog.concat([rows.filter("event_id%2=0"), None, rows.select("value", "event_id").filter("event_id%3=0")])


@query("supgp_lowest_rms", "SELECT user_id, event_type, rms, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY rms ASC NULLS LAST, event_id) AS n FROM (SELECT user_id, event_type, CASE WHEN event_id%5=0 THEN NULL ELSE value END AS rms, event_id FROM events)) WHERE n = 1")
def _(spark, d):
    rows = b.table(spark, d, "events").select("user_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("rms"), "event_id")
    return catalog.lowest_rms(rows, ("user_id", "event_type"))


@query("catalog_full_join", "SELECT COALESCE(c.norad_id, o.norad_id) AS norad_id, COALESCE(o.n0, c.n0) AS n0, c.name AS name, o.rms AS rms, CASE WHEN o.norad_id IS NOT NULL THEN '+' END AS ops_code, CASE WHEN o.norad_id IS NULL THEN c.tle END AS tle FROM (SELECT c_custkey AS norad_id, c_acctbal AS n0, c_name AS name, c_mktsegment AS tle FROM customer) c FULL JOIN (SELECT o_custkey+40 AS norad_id, o_totalprice AS n0, CAST(o_orderkey AS DOUBLE) AS rms FROM orders) o ON c.norad_id = o.norad_id")
def _(spark, d):
    base = b.table(spark, d, "customer").select(F.col("c_custkey").alias("norad_id"), F.col("c_acctbal").alias("n0"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tle"))
    extra = b.table(spark, d, "orders").select((F.col("o_custkey") + 40).alias("norad_id"), F.col("o_totalprice").alias("n0"), F.col("o_orderkey").cast("double").alias("rms"))
    df = catalog.mark_members(catalog.prefer_supplemental(base, extra), extra)
    return df.select("norad_id", "n0", "name", "rms", F.when(F.col("_member"), "+").alias("ops_code"), F.when(~F.col("_member"), F.col("tle")).alias("tle"))


@query("catalog_no_supgp", "SELECT c_custkey AS norad_id, c_name AS name, c_acctbal AS n0, CAST(NULL AS DOUBLE) AS rms, CASE WHEN s_suppkey%3<>0 THEN 'D' END AS ops_code, s_acctbal AS rcs FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def _(spark, d):
    rows = b.table(spark, d, "customer").select(F.col("c_custkey").alias("norad_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("n0"))
    base = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.CATALOG.fields if f.name not in (*rows.columns, "rms", "ops_code", "rcs")})
    known = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("norad_id"), F.col("s_acctbal").alias("rcs"), F.when(F.col("s_suppkey") % 3 != 0, "D").alias("status"))
    return catalog.merge(base, None, known).select("norad_id", "name", "n0", "rms", "ops_code", "rcs")


@query("satcat_override", "SELECT c_custkey AS norad_id, s.rcs AS rcs, CASE WHEN s.norad_id IS NOT NULL THEN s.status ELSE CASE WHEN c_custkey%2=0 THEN '+' END END AS ops_code FROM customer LEFT JOIN (SELECT s_suppkey AS norad_id, s_acctbal AS rcs, CASE WHEN s_suppkey%3<>0 THEN 'D' END AS status FROM supplier) s ON s.norad_id = c_custkey")
def _(spark, d):
    df = b.table(spark, d, "customer").select(F.col("c_custkey").alias("norad_id"), F.when(F.col("c_custkey") % 2 == 0, "+").alias("ops_code"))
    known = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("norad_id"), F.col("s_acctbal").alias("rcs"), F.when(F.col("s_suppkey") % 3 != 0, "D").alias("status"))
    return catalog.override_status(df, known).select("norad_id", "rcs", "ops_code")


@query("unique_ids", "SELECT CAST(ROW_NUMBER() OVER (ORDER BY user_id) - 1 AS BIGINT) AS obj_idx, user_id AS norad_id FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    return catalog.norad_index(b.table(spark, d, "events").select(F.col("user_id").alias("norad_id")))


_EPOCHS = "SELECT DISTINCT user_id AS norad_id, 2460000.5 + CAST(event_id%512 AS DOUBLE)/64 AS epoch FROM events"


@query("gpe_intervals", f"WITH e AS ({_EPOCHS}), n AS (SELECT norad_id, epoch, LEAD(epoch) OVER w AS nx, ROW_NUMBER() OVER w AS k FROM e WINDOW w AS (PARTITION BY norad_id ORDER BY epoch)), v AS (SELECT norad_id, epoch, CASE WHEN k=1 THEN CAST(2460001.5 AS DOUBLE) ELSE GREATEST(epoch, CAST(2460001.5 AS DOUBLE)) END AS b0, LEAST(COALESCE(nx, CAST(2460005.5 AS DOUBLE)), CAST(2460005.5 AS DOUBLE)) AS e0 FROM n) SELECT norad_id, epoch, b0 AS begin_jd, e0 AS end_jd FROM v WHERE b0 < e0")
def _(spark, d):
    rows = b.table(spark, d, "events").select(F.col("user_id").alias("norad_id"), F.lit(2460000.5).alias("epoch_jd1"), ((F.col("event_id") % 512).cast("double") / 64).alias("epoch_jd2")).distinct()
    return catalog.gpe_intervals(rows, 2460001.5, 2460005.5).select("norad_id", (F.col("epoch_jd1") + F.col("epoch_jd2")).alias("epoch"), (F.col("begin_jd1") + F.col("begin_jd2")).alias("begin_jd"), (F.col("end_jd1") + F.col("end_jd2")).alias("end_jd"))


# epochs from the last day of 2016 on, which ends with a leap second, in steps of 1e-9 days: as whole steps in SQL
_STEPS_OF = "SELECT DISTINCT user_id AS norad_id, (event_id%3)*CAST(1000000000 AS BIGINT) + event_id*7%1000 AS u FROM events"
_TAI_NS = "(({u} - 500000000)*86400 + CASE WHEN {u} >= 1000000000 THEN 1000000000 ELSE 0 END)"


@query(
    "gpe_intervals_exact",
    f"WITH e AS ({_STEPS_OF}), n AS (SELECT norad_id, u, LEAD(u) OVER w AS nx, ROW_NUMBER() OVER w AS k FROM e WINDOW w AS (PARTITION BY norad_id ORDER BY u)), "
    "v AS (SELECT norad_id, u, CASE WHEN k=1 THEN 500000000 ELSE GREATEST(u, 500000000) END AS b, LEAST(COALESCE(nx, 2250000000), 2250000000) AS e FROM n) "
    f"SELECT norad_id, u AS epoch, CAST(b AS BIGINT) AS begin_step, CAST(e AS BIGINT) AS end_step, CAST({_TAI_NS.format(u='b')} AS BIGINT) AS begin_ns, CAST({_TAI_NS.format(u='e')} AS BIGINT) AS end_ns FROM v WHERE b < e",
)
def _(spark, d):
    step = F.lit(1e-9)
    rows = b.table(spark, d, "events").select(F.col("user_id").alias("norad_id"), (F.lit(2457753.5) + F.col("event_id") % 3).alias("epoch_jd1"), ((F.col("event_id") * 7 % 1000) * step).alias("epoch_jd2")).distinct()
    found = catalog.gpe_intervals(rows, 2457754.0, 2457755.75)
    steps = lambda c: F.round(((F.col(f"{c}_jd1") - 2457753.5) + F.col(f"{c}_jd2")) / step).cast("long")
    found = found.withColumn("epoch", F.round(((F.col("epoch_jd1") - 2457753.5) + F.col("epoch_jd2")) / step).cast("long"))
    return found.select("norad_id", "epoch", *(steps(c).alias(f"{c}_step") for c in ("begin", "end")), *(F.round(F.col(c) * 86400e9).cast("long").alias(f"{c}_ns") for c in ("begin", "end")))


@query("pair_canonical", "SELECT l_orderkey, l_linenumber, LEAST(l_partkey, l_suppkey) AS a, GREATEST(l_partkey, l_suppkey) AS b FROM lineitem")
def _(spark, d):
    rows = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return catalog.canonical_pairs(rows, "a", "b")


_NEAREST = "SELECT o_orderkey, event_id FROM (SELECT o_orderkey, event_id, ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY ABS(rt - t), rt, event_id) AS n FROM (SELECT o_orderkey, o_custkey, CAST(o_orderkey%1000 AS DOUBLE) AS t FROM orders) o LEFT JOIN (SELECT event_id, user_id, CAST(event_id*7%1000 AS DOUBLE) AS rt FROM events) e ON user_id = o_custkey) WHERE n = 1"


def _dated(spark, d) -> tuple[DataFrame, DataFrame]:
    left = b.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 1000).cast("double").alias("t"))
    return left, b.table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") * 7 % 1000).cast("double").alias("t"))


@query("asof_nearest", _NEAREST)
def _(spark, d):
    return catalog.asof_nearest(*_dated(spark, d), ["user_id"], "t", ["event_id"], "event_id").select("o_orderkey", "event_id")


@query("asof_nearest_ranges", _NEAREST)
def _(spark, d):
    return catalog.asof_nearest(*_dated(spark, d), ["user_id"], "t", ["event_id"], "event_id", parts=16).select("o_orderkey", "event_id")


@query("dl_add", "SELECT l_orderkey, l_linenumber, l_extendedprice + l_tax AS hi, (l_extendedprice - ((l_extendedprice + l_tax) - ((l_extendedprice + l_tax) - l_extendedprice))) + (l_tax - ((l_extendedprice + l_tax) - l_extendedprice)) AS lo FROM lineitem")
def _(spark, d):
    hi, lo = timescale.two_sum(F.col("l_extendedprice"), F.col("l_tax"))
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hi.alias("hi"), lo.alias("lo"))


_LEAPS = ", ".join(f"(CAST({day} AS DOUBLE), CAST({s} AS DOUBLE))" for day, s in timescale.LEAP_SECONDS)


@query("utc_to_tai", f"SELECT o_orderkey, ROUND((SELECT MAX(s) FROM (VALUES {_LEAPS}) l(day, s) WHERE day <= jd),6) AS offset_s FROM (SELECT o_orderkey, 2441317.5 + CAST(o_orderkey%19000 AS DOUBLE) AS jd FROM orders)")
def _(spark, d):
    jd = F.lit(2441317.5) + (F.col("o_orderkey") % 19000).cast("double")
    hi, lo = timescale.utc_to_tai((jd, F.lit(0.0)))
    return b.table(spark, d, "orders").select("o_orderkey", F.round(((hi - jd) + lo) * 86400, 6).alias("offset_s"))


@query("iso_to_jd", "SELECT event_id, CAST(epoch_us(date_trunc('day', ts))/86400000000 AS DOUBLE) + 2440587.5 AS jd1, ROUND(CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS DOUBLE)/86400000000.0, 12) AS jd2 FROM events")
def _(spark, d):
    hi, lo = timescale.iso_to_jd(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    day = F.floor(hi - 0.5) + 0.5
    return b.table(spark, d, "events").select("event_id", day.cast("double").alias("jd1"), F.round((hi - day) + lo, 12).alias("jd2"))


# propagation


@query("sgp4_state")
def _(spark, d):
    return propagate.states(b.gpes(spark, d), [0.0, 60.0, 720.0])


@query("sgp4_fit")
def _(spark, d):
    rows = b.gpes(spark, d).withColumns({"epoch": F.col("epoch_jd1") + F.col("epoch_jd2"), "obj_idx": F.col("norad_id") - 1, "begin": F.lit(2460000.5), "end": F.lit(2460000.75)})
    return propagate.objects_of(propagate.fitted(rows, 2460000.5)).select("obj_idx", "norad_id", "status", "n_steps", "t_end")
