"""Scalar curves, calibration and small expressions as columns, and fits of them to traces."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.maps import map_traces

L = F.lit


def gaussian(x: Column, a: float, m: float, c: float) -> Column:
    return a * F.exp(-((x - m) * (x - m)) / (2 * c * c))


def fwhm(c: Column | float) -> Column:
    """Full width at half maximum of a Gaussian of deviation c."""
    return L(2 * math.sqrt(2 * math.log(2))) * c


def decaying_exp(x: Column, a: float, b: float, tau: float) -> Column:
    """a + b e^(-x / tau)."""
    return a + b * F.exp(-x / tau)


def rising_exp(x: Column, a: float, b: float, tau: float) -> Column:
    """a - b e^(-x / tau)."""
    return a - b * F.exp(-x / tau)


def double_rising_exp(x: Column, a: float, b1: float, b2: float, t1: float, t2: float) -> Column:
    """a - b1 e^(-x / t1) - b2 e^(-x / t2)."""
    return rising_exp(x, a, b1, t1) - b2 * F.exp(-x / t2)


def logistic(x: Column, a: float, b: float, tau: float) -> Column:
    """a / (1 + b e^(-x / tau))."""
    return a / (1 + b * F.exp(-x / tau))


def rising_pow(x: Column, a: float, b: float, p: float) -> Column:
    """a - b x^-p; null at 0."""
    return a - F.when(x != 0, b * F.pow(x, L(-p)))


def michaelis_menten(x: Column, top: float, half: float, p: float = 1.0) -> Column:
    """top x / (half + x^p)."""
    return top * x / (half + F.pow(x, L(float(p))))


def half_rise_michaelis_menten(half: float, p: float = 1.0) -> float:
    return half ** (1 / p)


def half_rise_exp(a: float, b: float, tau: float) -> float:
    """Where a - b e^(-x / tau) is a / 2."""
    return tau * math.log(2 * b / a)


def half_rise_pow(a: float, b: float, p: float) -> float:
    """Where a - b x^-p is a / 2."""
    return (2 * b / a) ** (1 / p)


def tanh_spike(x: Column, at: float, a: float = 1.0, rise: float = 10.0, tau: float = 10.0) -> Column:
    """A quick rise and exponential fall about `at`."""
    return 0.5 * a * (1 + F.tanh(rise * (x - at) / tau)) * F.exp(-F.abs(x - at) / tau)


def alias_freq(f: Column, fs: float) -> Column:
    """The frequency that f shows as when sampled at fs."""
    r = F.pmod(f, L(fs))
    return F.least(r, fs - r)


def excel_time(days: Column) -> Column:
    """The timestamp of an Excel serial day."""
    return F.timestamp_micros((F.round(days * 86400_000_000) + L(-2209161600_000_000)).cast("long"))


def ticks_to_ms(high: Column, low: Column) -> Column:
    """Milliseconds of a 64-bit count of 100 ns in two 32-bit words."""
    return (high.cast("double") * 4294967296 + low.cast("double")) / 10_000


def natural_key(name: Column) -> Column:
    """A key under which f2 comes before f10: digits padded with zeros."""
    parts = F.regexp_extract_all(name, L(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def decimal_comma(x: Column) -> Column:
    return F.replace(x, L(","), L(".")).cast("double")


def roi_tag(n: Column) -> Column:
    return F.concat(L("r"), F.lpad(n.cast("string"), 2, "0"))


def fit_gaussian(v: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """(a, m, c) of the least-squares Gaussian by damped Gauss-Newton from the moments."""
    x = np.arange(len(v), dtype=float)
    w = np.maximum(v - v.min(), 0)
    total = w.sum() or 1.0
    m = (x * w).sum() / total
    p = np.array([v.max(), m, max(np.sqrt(((x - m) ** 2 * w).sum() / total), 0.5)])
    damp = 1e-2
    f = lambda q: q[0] * np.exp(-((x - q[1]) ** 2) / (2 * q[2] ** 2))
    err = ((v - f(p)) ** 2).sum()
    for _ in range(rounds):
        e = np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2))
        j = np.stack([e, p[0] * e * (x - p[1]) / p[2] ** 2, p[0] * e * (x - p[1]) ** 2 / p[2] ** 3], 1)
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ (v - p[0] * e))
        new = ((v - f(p + step)) ** 2).sum()
        if new < err:
            p, damp, done = p + step, damp / 3, err - new < 1e-12 * err
            err = new
            if done:
                break
        else:
            damp *= 4
    return float(p[0]), float(p[1]), float(abs(p[2]))


#: Curves for fits: functions of x and the parameters.
SHAPES = {
    "gaussian": lambda x, a, m, c, f: a * np.exp(-((x - m) ** 2) / (2 * c * c)) + f,
    "decaying_exp": lambda x, a, b, tau: a + b * np.exp(-x / tau),
    "rising_exp": lambda x, a, b, tau: a - b * np.exp(-x / tau),
    "logistic": lambda x, a, b, tau: a / (1 + b * np.exp(-x / tau)),
    "michaelis_menten": lambda x, a, half, p: a * x / (half + np.abs(x) ** p),
}


def fit_shape(v: np.ndarray, kind: str, start: list[float], rounds: int = 100) -> list[float]:
    """Least squares from `start` by damped Gauss-Newton with numeric slopes."""
    x, p, damp = np.arange(len(v), dtype=float), np.array(start, float), 1e-2
    f = lambda q: SHAPES[kind](x, *q)
    with np.errstate(all="ignore"):
        err = ((v - f(p)) ** 2).sum()
        for _ in range(rounds):
            h = 1e-6 * np.maximum(np.abs(p), 1e-3)
            j = np.stack([(f(p + d) - f(p - d)) / (2 * e) for e, d in zip(h, np.diag(h), strict=True)], 1)
            a = j.T @ j
            if not np.isfinite(a).all():
                break
            new = p + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ (v - f(p)), rcond=None)[0]
            e = ((v - f(new)) ** 2).sum()
            if e < err:
                done, p, err, damp = err - e < 1e-14 * err, new, e, damp / 3
                if done:
                    break
            else:
                damp *= 4
    return p.tolist()


def fits(traces, kind: str, start: list[float]):
    """(row, col, p): the parameters of a curve of SHAPES that fits each trace best, from the same start."""
    return map_traces(traces, lambda v: [(fit_shape(v, kind, start),)], "p array<double>")


def gauss_fits(traces):
    """(row, col, a, m, c): the Gaussian that fits each trace best."""
    return map_traces(traces, lambda v: [fit_gaussian(v)], "a double, m double, c double")
