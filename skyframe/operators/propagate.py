"""Near-earth SGP4 (Spacetrack Report 3 and AIAA 2006-6753, WGS72, mode 'a') over arrays of element rows, and the fit of
trajectories to it.

Elements with a period of 225 minutes or more need the deep-space theory, which isn't implemented: their status is DEEP_SPACE and
they have no segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime, schema
from ..functions import poly

#: WGS72 constants, km and minutes.
RADIUS, MU, J2, J3, J4 = 6378.135, 398600.8, 0.001082616, -0.00000253881, -0.00000165597
KE = 60.0 / math.sqrt(RADIUS**3 / MU)
J3_J2 = J3 / J2
DEEP_SPACE = 20


class Elements:
    """Element rows, initialised. Arrays have one value a row."""

    def __init__(self, n0, e0, i0, node0, omega0, m0, bstar):
        self.e, self.i, self.node, self.omega, self.m, self.bstar = (np.asarray(x, float) for x in (e0, i0, node0, omega0, m0, bstar))
        n0 = np.asarray(n0, float)
        c, s = np.cos(self.i), np.sin(self.i)
        beta2 = 1 - self.e**2
        beta = np.sqrt(beta2)
        x3 = 3 * c**2 - 1
        # mean motion without the J2 part
        a1 = (KE / n0) ** (2 / 3)
        d = 0.75 * J2 * x3 / (beta * beta2)
        d1 = d / a1**2
        a0 = a1 * (1 - d1 * d1 - d1 * (1 / 3 + 134 / 81 * d1 * d1))
        d0 = d / a0**2
        self.n = n0 / (1 + d0)
        self.a = (KE / self.n) ** (2 / 3)
        self.deep = 2 * math.pi / self.n >= 225
        perigee = (self.a * (1 - self.e) - 1) * RADIUS
        # density function's height s and (q0 - s) ** 4
        height = np.where(perigee < 98, 20.0, np.where(perigee < 156, perigee - 78, 78.0))
        q4 = ((120 - height) / RADIUS) ** 4
        s4 = height / RADIUS + 1
        xi = 1 / (self.a - s4)
        self.eta = self.a * self.e * xi
        eta2, ee = self.eta**2, self.e * self.eta
        psi = np.abs(1 - eta2)
        k = q4 * xi**4
        k1 = k / psi**3.5
        c2 = k1 * self.n * (self.a * (1 + 1.5 * eta2 + ee * (4 + eta2)) + 0.375 * J2 * xi / psi * x3 * (8 + 3 * eta2 * (8 + eta2)))
        self.c1 = self.bstar * c2
        c3 = np.where(self.e > 1e-4, -2 * k * xi * J3_J2 * self.n * s / np.maximum(self.e, 1e-12), 0.0)
        x1 = 1 - c**2
        self.c4 = 2 * self.n * k1 * self.a * beta2 * (self.eta * (2 + 0.5 * eta2) + self.e * (0.5 + 2 * eta2) - J2 * xi / (self.a * psi) * (-3 * x3 * (1 - 2 * ee + eta2 * (1.5 - 0.5 * ee)) + 0.75 * x1 * (2 * eta2 - ee * (1 + eta2)) * np.cos(2 * self.omega)))
        self.c5 = 2 * k1 * self.a * beta2 * (1 + 2.75 * (eta2 + ee) + ee * eta2)
        p2 = 1 / (self.a * beta2) ** 2
        t1, c4 = 1.5 * J2 * p2 * self.n, c**4
        t2, t3 = 0.5 * t1 * J2 * p2, -0.46875 * J4 * p2 * p2 * self.n
        self.m_dot = self.n + 0.5 * t1 * beta * x3 + 0.0625 * t2 * beta * (13 - 78 * c**2 + 137 * c4)
        self.omega_dot = -0.5 * t1 * (1 - 5 * c**2) + 0.0625 * t2 * (7 - 114 * c**2 + 395 * c4) + t3 * (3 - 36 * c**2 + 49 * c4)
        h1 = -t1 * c
        self.node_dot = h1 + (0.5 * t2 * (4 - 19 * c**2) + 2 * t3 * (3 - 7 * c**2)) * c
        self.omega_drag = self.bstar * c3 * np.cos(self.omega)
        self.m_drag = np.where(self.e > 1e-4, -2 / 3 * k * self.bstar / np.where(ee == 0, 1.0, ee), 0.0)
        self.node_drag = 3.5 * beta2 * h1 * self.c1
        self.t2 = 1.5 * self.c1
        self.lc = np.where(np.abs(c + 1) > 1.5e-12, -0.25 * J3_J2 * s * (3 + 5 * c) / np.where(np.abs(c + 1) > 1.5e-12, 1 + c, 1.5e-12), -0.25 * J3_J2 * s * (3 + 5 * c) / 1.5e-12)
        self.ay = -0.5 * J3_J2 * s
        self.dm0 = (1 + self.eta * np.cos(self.m)) ** 3
        self.sin_m = np.sin(self.m)
        self.x7 = 7 * c**2 - 1
        self.x3, self.x1, self.cos_i, self.sin_i = x3, x1, c, s
        self.simple = perigee < 220
        c1s = self.c1**2
        self.d2 = 4 * self.a * xi * c1s
        t = self.d2 * xi * self.c1 / 3
        self.d3 = (17 * self.a + s4) * t
        self.d4 = 0.5 * t * self.a * xi * (221 * self.a + 31 * s4) * self.c1
        self.t3 = self.d2 + 2 * c1s
        self.t4 = 0.25 * (3 * self.d3 + self.c1 * (12 * self.d2 + 10 * c1s))
        self.t5 = 0.2 * (3 * self.d4 + 12 * self.c1 * self.d3 + 6 * self.d2**2 + 15 * c1s * (2 * self.d2 + c1s))

    def at(self, t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions [..., 3] in km, velocities in km/s, status) t minutes from the epoch; t: one value a row, or [times, rows]."""
        t = np.asarray(t, float)
        full = ~self.simple
        m_df, omega_df, node_df = self.m + self.m_dot * t, self.omega + self.omega_dot * t, self.node + self.node_dot * t
        t2 = t * t
        node = node_df + self.node_drag * t2
        turn = np.where(full, self.omega_drag * t + self.m_drag * ((1 + self.eta * np.cos(m_df)) ** 3 - self.dm0), 0.0)
        m, omega = m_df + turn, omega_df - turn
        shrink = 1 - self.c1 * t - np.where(full, self.d2 * t2 + self.d3 * t2 * t + self.d4 * t2 * t2, 0.0)
        less_e = self.bstar * self.c4 * t + np.where(full, self.bstar * self.c5 * (np.sin(m) - self.sin_m), 0.0)
        longer = self.t2 * t2 + np.where(full, self.t3 * t2 * t + t2 * t2 * (self.t4 + t * self.t5), 0.0)
        a = self.a * shrink**2
        n = KE / np.abs(a) ** 1.5
        e = self.e - less_e
        status = np.where(self.n <= 0, 2, np.where((e >= 1) | (e < -0.001), 1, 0))
        e = np.clip(e, 1e-6, 0.999999)
        m = m + self.n * longer
        length = m + omega + node
        node, omega = np.fmod(node, 2 * np.pi), np.fmod(omega, 2 * np.pi)
        m = np.fmod(np.fmod(length, 2 * np.pi) - omega - node, 2 * np.pi)
        axn = e * np.cos(omega)
        over = 1 / (a * (1 - e * e))
        ayn = e * np.sin(omega) + over * self.ay
        u = np.fmod(m + omega + node + over * self.lc * axn - node, 2 * np.pi)
        big = u
        for _ in range(10):
            sin_e, cos_e = np.sin(big), np.cos(big)
            step = (u - ayn * cos_e + axn * sin_e - big) / (1 - cos_e * axn - sin_e * ayn)
            big = big + np.clip(step, -0.95, 0.95)
        sin_e, cos_e = np.sin(big), np.cos(big)
        ec, es = axn * cos_e + ayn * sin_e, axn * sin_e - ayn * cos_e
        el2 = axn * axn + ayn * ayn
        pl = a * (1 - el2)
        status = np.where((status == 0) & (pl < 0), 4, status)
        pl = np.where(pl <= 0, np.nan, pl)
        r = a * (1 - ec)
        rdot, rv = np.sqrt(np.abs(a)) * es / r, np.sqrt(pl) / r
        beta = np.sqrt(1 - el2)
        t1 = es / (1 + beta)
        sin_u, cos_u = a / r * (sin_e - ayn - axn * t1), a / r * (cos_e - axn + ayn * t1)
        su = np.arctan2(sin_u, cos_u)
        sin2, cos2 = 2 * cos_u * sin_u, 1 - 2 * sin_u**2
        k = 0.5 * J2 / pl
        k2 = k / pl
        r2 = r * (1 - 1.5 * k2 * beta * self.x3) + 0.5 * k * self.x1 * cos2
        su = su - 0.25 * k2 * self.x7 * sin2
        node2 = node + 1.5 * k2 * self.cos_i * sin2
        inc = self.i + 1.5 * k2 * self.cos_i * self.sin_i * cos2
        rdot = rdot - n * k * self.x1 * sin2 / KE
        rv = rv + n * k * (self.x1 * cos2 + 1.5 * self.x3) / KE
        ss, cs, sn, cn, si, ci = np.sin(su), np.cos(su), np.sin(node2), np.cos(node2), np.sin(inc), np.cos(inc)
        up = np.stack([-sn * ci * ss + cn * cs, cn * ci * ss + sn * cs, si * ss], -1)
        along = np.stack([-sn * ci * cs - cn * ss, cn * ci * cs - sn * ss, si * cs], -1)
        pos = r2[..., None] * up * RADIUS
        vel = (rdot[..., None] * up + rv[..., None] * along) * (RADIUS * KE / 60)
        status = np.where((status == 0) & (r2 < 1), 6, status)
        return pos, vel, np.where((status == 0) & ~np.isfinite(pos).all(-1), 10, status)


ORDER = 15


def _fit(el: Elements, begin: float, end: float, order: int) -> tuple[np.ndarray, float, int]:
    """Coefficients [7, order + 1] in days from begin, the largest midpoint error in km, and a status; times in minutes from the epoch."""
    nodes = poly.chebyshev(order)
    middle = (nodes[1:] + nodes[:-1]) / 2
    t = begin + (end - begin) * np.concatenate([nodes, middle])
    pos, vel, status = el.at(t[:, None])
    if status.any():
        return np.zeros((7, order + 1)), math.inf, int(status[status != 0][0])
    pos, vel = pos[:, 0], vel[:, 0]
    y = np.concatenate([pos, vel, np.sqrt((pos**2).sum(1, keepdims=True))], 1).T
    c = poly.interpolate(y[:, : order + 1], nodes)
    err = np.sqrt(((poly.np_horner(c[:3, None, :], middle) - y[:3, order + 1 :]) ** 2).sum(0)).max()
    return c / ((end - begin) / 1440) ** np.arange(order + 1), float(err), 0


def fit_rows(row: dict, t0: float, begin: float, end: float, *, order: int = ORDER, tolerance: float = 1e-7, step: float | None = None, shortest: float = 5 / 60, most: int = 20, reentry: float = 0.0, leave: float = math.inf) -> tuple[list[tuple], int]:
    """Segments (t_begin, t_end, coefficients) of one row of elements from begin to end (minutes from its epoch), and its status.

    Steps are a tenth of the period, halved until the midpoint error is within the tolerance or they are `shortest`. t0: days of
    the store's time at the epoch. The first error ends the row, and earlier steps stay.
    """
    el = Elements(*([row[k]] for k in ("n0", "e0", "i0", "node0", "omega0", "m0", "bstar")))
    if el.deep[0]:
        return [], DEEP_SPACE
    out, at = [], begin
    step = step or 2 * math.pi / float(el.n[0]) / 10
    while at < end:
        pos, _, status = el.at(np.array([at]))
        r2 = float((pos[0] ** 2).sum())
        if status[0]:
            return out, int(status[0])
        if r2 < reentry * reentry:
            return out, 11
        if r2 >= leave * leave:
            return out, 12
        stop = min(at + step, end)
        todo, done = [(at, stop)], []
        while todo:
            a, b = todo.pop()
            c, err, status = _fit(el, a, b, order)
            if status:
                return out, status
            if err < tolerance or b - a < shortest:
                done.append((a, b, c))
                if len(done) > most and todo:
                    return out, 14
            else:
                mid = (a + b) / 2
                todo += [(mid, b), (a, mid)]
        out += [(t0 + a / 1440, t0 + b / 1440, c) for a, b, c in sorted(done, key=lambda d: d[0])]
        at = stop
    return out, 0


def propagate(gpes: DataFrame, jd_begin: float, *, order: int = ORDER, reentry: float = 0.0, leave: float = math.inf) -> tuple[DataFrame, DataFrame]:
    """(objects, segments) from rows of elements with obj_idx, norad_id, the elements, `epoch` and an interval [begin, end) as dates.

    Dates are plain Julian dates of one uniform scale. Both are read from fitted(); write that first where both are wanted.
    """
    rows = fitted(gpes, jd_begin, order=order, reentry=reentry, leave=leave)
    return objects_of(rows).drop("n_steps", "t_end"), rows.filter("step_idx >= 0").select(*(f.name for f in schema.SEGMENTS.fields))


def objects_of(fitted: DataFrame) -> DataFrame:
    """One row an object of fitted(), with its number of steps and its end (null: no steps)."""
    steps = F.count_if(F.col("step_idx") >= 0)
    return fitted.groupBy("obj_idx").agg(F.max("status").alias("status"), F.max("norad_id").alias("norad_id"), F.lit(schema.PRIMARY).alias("otype"), F.when(steps > 0, steps).alias("n_steps"), F.max("t_end").alias("t_end"))


def fitted(gpes: DataFrame, jd_begin: float, *, order: int = ORDER, reentry: float = 0.0, leave: float = math.inf) -> DataFrame:
    """Segments with norad_id and status; step_idx is -1 in the one row of an object without segments.

    Each satellite is one group of its few rows of elements. These are dealt by object to as many tasks as shuffles have: their bytes
    are few, but not the work that follows from them.
    """
    runtime.ready(gpes.sparkSession)
    columns = [f.name for f in schema.SEGMENTS.fields]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, status = [], 0
        for r in frame.sort_values("begin").to_dict("records"):
            if status:
                break
            found, status = fit_rows(r, r["epoch"] - jd_begin, (r["begin"] - r["epoch"]) * 1440, (r["end"] - r["epoch"]) * 1440, order=order, reentry=reentry, leave=leave)
            rows += found
        key = int(frame["obj_idx"].iloc[0]), int(frame["norad_id"].iloc[0])
        out, last = [], None
        for k, (a, b, c) in enumerate(rows):
            a = a if last is None else last
            out.append((key[0], k, a, b, *(x.tolist() for x in c), key[1], status))
            last = b
        if not out:
            out.append((key[0], -1, None, None, *[None] * 7, key[1], status))
        return pd.DataFrame(out, columns=[*columns, "norad_id", "status"])

    ddl = "obj_idx long, step_idx int, t_begin double, t_end double, " + ", ".join(f"{c} array<double>" for c in schema.COORDS) + ", norad_id long, status int"
    tasks = int(gpes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return gpes.repartition(tasks, "obj_idx").groupBy("obj_idx").applyInPandas(run, ddl)


def states(gpes: DataFrame, minutes: list[float]) -> DataFrame:
    """(norad_id, minutes, x..vz, status): direct SGP4 states of every row of elements, in Arrow batches of all rows at once."""
    runtime.ready(gpes.sparkSession)
    names = ("n0", "e0", "i0", "node0", "omega0", "m0", "bstar")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            el = Elements(*(f[k].to_numpy() for k in names))
            for t in minutes:
                pos, vel, status = el.at(np.full(len(f), t))
                status = np.where(el.deep, DEEP_SPACE, status)
                yield pd.DataFrame({"norad_id": f["norad_id"], "minutes": t, **{k: np.where(status == 0, pos[:, d], np.nan) for d, k in enumerate("xyz")}, **{f"v{k}": np.where(status == 0, vel[:, d], np.nan) for d, k in enumerate("xyz")}, "status": status.astype(np.int32)})

    return gpes.select("norad_id", *names).mapInPandas(run, "norad_id long, minutes double, x double, y double, z double, vx double, vy double, vz double, status int")
