"""Polynomials held as arrays of ascending coefficients: Column builders, and NumPy kernels over rows of one order."""

from __future__ import annotations

from functools import cache
from math import comb, pi

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def horner(c: Column, t: Column, order: int | None = None) -> Column:
    """The value at t. With a known order the sum is unrolled, which stays in generated code."""
    if order is None:
        return F.aggregate(F.reverse(c), F.lit(0.0), lambda s, x: s * t + x)
    out = c[order]
    for k in range(order - 1, -1, -1):
        out = out * t + c[k]
    return out


def derivative(c: Column) -> Column:
    """Coefficients of the derivative, as many as before with 0 on top."""
    return F.transform(c, lambda x, k: F.coalesce(F.get(c, k + 1), F.lit(0.0)) * (k + 1))


def rescale(c: Column, s: Column) -> Column:
    """Coefficients after x -> s x."""
    return F.transform(c, lambda x, k: x * F.pow(s, k))


def translate(c: Column, a: Column, order: int) -> Column:
    """Coefficients after x -> x + a."""
    return F.array(*(sum((c[k] * float(comb(k, i)) * F.pow(a, F.lit(float(k - i))) for k in range(i + 1, order + 1)), c[i]) for i in range(order + 1)))


def bernstein(c: Column, order: int) -> Column:
    """Bernstein coefficients on [0, 1], whose least and greatest enclose the values there."""
    return F.array(*(sum((c[k] * (comb(i, k) / comb(order, k)) for k in range(1, i + 1)), c[0]) for i in range(order + 1)))


# NumPy kernels: the last axis holds coefficients


def np_translate(c: np.ndarray, a: np.ndarray) -> np.ndarray:
    """x -> x + a by repeated synthetic division; a has one value a row."""
    out = np.array(c, float)
    n = out.shape[-1] - 1
    for i in range(n):
        for k in range(n - 1, i - 1, -1):
            out[..., k] += a * out[..., k + 1]
    return out


@cache
def bernstein_matrix(n: int) -> np.ndarray:
    return np.array([[comb(i, k) / comb(n, k) if k <= i else 0.0 for i in range(n + 1)] for k in range(n + 1)])


def np_bernstein(c: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bernstein coefficients on [0, width]."""
    n = c.shape[-1] - 1
    return (c * np.asarray(width)[..., None] ** np.arange(n + 1)) @ bernstein_matrix(n)


def np_horner(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = c[..., -1]
    for k in range(c.shape[-1] - 2, -1, -1):
        out = out * t + c[..., k]
    return out


@cache
def chebyshev(n: int) -> np.ndarray:
    """n + 1 Chebyshev nodes of [0, 1], ascending."""
    return np.sort((np.cos((2 * np.arange(n + 1) + 1) / (2 * (n + 1)) * pi) + 1) / 2)


def interpolate(y: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Coefficients through (nodes, y) by Newton's divided differences; y: values along the last axis."""
    c = np.array(y, float)
    n = len(nodes) - 1
    for k in range(n):
        c[..., k + 1 :] = (c[..., k + 1 :] - c[..., k:-1]) / (nodes[k + 1 :] - nodes[: n - k])
    for k in range(n - 1, -1, -1):
        c[..., k:-1] -= nodes[k] * c[..., k + 1 :]
    return c


def distance2(a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The squared distance of a and b [rows, 3, n + 1] as a polynomial of order n, through the Chebyshev nodes of [0, width]."""
    n = a.shape[-1] - 1
    t = chebyshev(n)
    scale = width[:, None] ** np.arange(n + 1)
    d = (a - b) * scale[:, None, :]
    values = (d @ (t[None, :] ** np.arange(n + 1)[:, None])) ** 2
    return interpolate(values.sum(axis=1), t) / scale


def sign_intervals(c: np.ndarray, width: np.ndarray, deepest: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high) of intervals of [0, width] that hold one sign change of the row's polynomial each.

    Intervals are halved while their Bernstein coefficients change sign more than once; none is left where they don't. One that
    still does after `deepest` halvings, which is as fine as numbers get, holds a root if its ends differ in sign.
    """
    n = c.shape[-1] - 1
    row, low, size = np.arange(len(c)), np.zeros(len(c)), np.array(width, float)
    found = []
    for depth in range(deepest):
        b = np_bernstein(np_translate(c[row], low), size)
        # neighbours have to see the same sign where they meet
        b[:, 0], b[:, -1] = np_horner(c[row], low), np_horner(c[row], low + size)
        s = np.sign(b)
        filled = s.copy()
        for k in range(1, n + 1):
            filled[:, k] = np.where(s[:, k] == 0, filled[:, k - 1], s[:, k])
        changes = ((filled[:, 1:] != filled[:, :-1]) & (filled[:, :-1] != 0)).sum(axis=1)
        # a zero at the left end is a root there
        root0 = (s[:, 0] == 0) & (s != 0).any(axis=1)
        one = (changes == 1) & ~root0
        found.append((row[one], low[one], low[one] + size[one]))
        if root0.any():
            found.append((row[root0], low[root0], low[root0]))
        more = (changes > 1) | (root0 & (changes > 0))
        if not more.any():
            break
        row, low, size = row[more], low[more], size[more] / 2
        row, low, size = np.concatenate([row, row]), np.concatenate([low, low + size]), np.concatenate([size, size])
    else:
        found.append(_unresolved(c, row, low, size))
    row, low, high = (np.concatenate([x[k] for x in found]) for k in range(3))
    once = np.unique(np.stack([row.astype(float), low, high]), axis=1, return_index=True)[1]  # a root at a left end is met at each depth
    return row[once], low[once], high[once]


def _unresolved(c: np.ndarray, row: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring intervals joined, as (row, low, high); those whose ends differ in sign."""
    order = np.lexsort([low, row])
    row, low, high = row[order], low[order], (low + size)[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (low[1:] > high[:-1] + 2 * size[order][1:])
    start = np.flatnonzero(new)
    row, low, high = row[start], low[start], np.maximum.reduceat(high, start)
    turns = np.sign(np_horner(c[row], low)) * np.sign(np_horner(c[row], high)) < 0
    return row[turns], low[turns], high[turns]


def refine(c: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 80) -> np.ndarray:
    """The root between low and high of each row, by bisection in floating point and Newton steps that stay inside."""
    low, high = low.copy(), high.copy()
    slope = c[:, 1:] * np.arange(1, c.shape[1])
    f_low = np_horner(c, low)
    t = (low + high) / 2
    for _ in range(rounds):
        f = np_horner(c, t)
        left = np.sign(f) == np.sign(f_low)
        left &= f != 0
        low, high = np.where(left, t, low), np.where(left, high, t)
        with np.errstate(divide="ignore", invalid="ignore"):
            newton = t - f / np_horner(slope, t)
        inside = (newton > low) & (newton < high)
        new = np.where(inside, newton, (low + high) / 2)
        if (np.abs(new - t) <= 1e-16 * np.maximum(1.0, np.abs(t))).all():
            t = new
            break
        t = new
    else:
        late = np.flatnonzero(high - low > 1e-12 * np.maximum(1.0, np.abs(t)))
        for _ in range(64):  # halving alone, for rows whose steps crept
            mid = (low[late] + high[late]) / 2
            left = np.sign(np_horner(c[late], mid)) == np.sign(f_low[late])
            low[late], high[late] = np.where(left, mid, low[late]), np.where(left, high[late], mid)
        t[late] = (low[late] + high[late]) / 2
    return t


def real_roots(c: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, t): where in [0, width) the row's polynomial changes sign, or is 0 at the left end."""
    row, low, high = sign_intervals(c, width)
    return _apart(row, refine(c[row], low, high), width) if len(row) else (row, low)


def _apart(row: np.ndarray, t: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots by row and place, each once: rounding may show one in two intervals that meet there."""
    order = np.lexsort([t, row])
    row, t = row[order], t[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (t[1:] - t[:-1] > 1e-11 * width[row[1:]])
    return row[new], t[new]


#: Minima this share of the width beyond an end count as at that end: rounding may put one at a seam of two windows outside both.
SEAM = 1e-10


def minima(c: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, t): where in [0, width] the row's polynomial turns from falling to rising. A minimum at an end may show up in both windows that meet there."""
    beyond = SEAM * width
    if c.shape[-1] == 3:
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            t = c[:, 1] / (-2 * c[:, 2])
        row = np.flatnonzero((c[:, 2] > 0) & (t >= -beyond) & (t < width + beyond))
        return row, np.clip(t[row], 0.0, width[row])
    moved = np_translate(c, -beyond)
    slope = np.concatenate([moved[:, 1:] * np.arange(1, c.shape[1]), np.zeros((len(c), 1))], axis=1)
    row, low, high = sign_intervals(slope, width + 2 * beyond)
    if not len(row):
        return row, low
    row, t = _apart(row, refine(slope[row], low, high), width)
    bend = np_horner(slope[row][:, 1:] * np.arange(1, slope.shape[1]), t)
    ok = np.isfinite(t) & (bend > 0)
    row, t = row[ok], t[ok] - beyond[row[ok]]
    return row, np.clip(t, 0.0, width[row])
