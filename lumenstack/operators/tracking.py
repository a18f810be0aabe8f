"""Ordered state machines along t: recursive filters, trackers and baselines; one state per key, groups in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .maps import map_traces
from .ordered import in_order


def kalman_stack(frames: DataFrame, key: str = "seq_id", seed: str = "mean", gain: float = 0.5, var: float = 0.05) -> DataFrame:
    """Frames (key, t, h, w, data) filtered recursively over t; a frame's own maximum scales its error, which couples its pixels.

    The first prediction is the mean of the key's frames, or its first frame.  A task holds two images, however long the stack is.
    """
    x = frames.select(key, "t", "h", "w", "data")
    if seed == "mean":
        sums = x.select(key, "h", "w", F.posexplode("data").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("v"), F.max("h").alias("h"), F.max("w").alias("w"))
        mean = sums.groupBy(key).agg(F.max("h").alias("h"), F.max("w").alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("data"))
        x = x.unionByName(mean.select(key, F.lit(None).cast("long").alias("t"), "h", "w", "data"))  # a null t comes first

    def make(k):
        p, e = None, None

        def step(row) -> list[tuple]:
            nonlocal p, e
            if row is None:
                return []
            m = np.asarray(row.data, float)
            if p is None:
                p, e = m.copy(), np.full_like(m, var)
                if seed == "mean":
                    return []
            kk = 1 + gain * (e / (e + var) - 1)
            c = p + kk * (m - p)
            top = float(p.max()) ** 2
            e = e * (1 - kk) + ((c - p) ** 2 / top if top else 0.0)
            p = c
            return [(k, row.t, row.h, row.w, c)]

        return step

    return in_order(x, key, ["t"], make, f"{key} {dict(frames.dtypes)[key]}, t long, h int, w int, data array<double>")


def track_nearest(candidates: DataFrame, key: str, seed: float, memory: int = 5) -> DataFrame:
    """(key, t, value): at each t the candidate nearest the mean of the last accepted ones; candidates are (key, t, value)."""

    def make(k):
        last, t, held = [seed], None, []

        def close() -> list[tuple]:
            mean = np.mean(last[-memory:])
            best = float(min(held, key=lambda v: (abs(v - mean), v)))
            last[:] = [*last[-memory:], best]
            return [(k, t, best)]

        def step(row) -> list[tuple]:
            nonlocal t
            out = close() if held and (row is None or row.t != t) else []
            if row is not None:
                if row.t != t:
                    t = row.t
                    held.clear()
                held.append(float(row.value))
            return out

        return step

    return in_order(candidates.select(key, "t", "value"), key, ["t", "value"], make, f"{key} {dict(candidates.dtypes)[key]}, t long, value double")


def track_kalman(lines: DataFrame, key: str, seed: float, seed_var: float = 4.0, gain: float = 0.25) -> DataFrame:
    """(key, t, value): a wall followed through gradient rows (key, t, v), each weighed by a Gaussian about the last place.

    The new place is g * (last place) + (1 - g) * (best place), where g = (1 + snr) / (1 + snr / gain) falls from 1 for a row
    of noise to `gain` for a clean one, and snr is the ratio of the row's maximum to its deviation.
    """

    def one(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        mu, delta, rows = float(seed), 0.0, []
        for t, v in zip(*[g.sort_values("t")[c] for c in ("t", "v")], strict=True):
            v = np.asarray(v, float)
            snr = max(v.max() / max(v.std(), 1e-9), 1e-9)
            spread = seed_var + delta**2 + 1 / snr**2
            z = float((np.exp(-((np.arange(len(v)) - mu) ** 2) / (2 * spread)) * v).argmax())
            w = (1 + snr) / (1 + snr / gain)
            new = w * mu + (1 - w) * z
            delta, mu = new - mu, new
            rows.append((k[0], t, mu))
        return pd.DataFrame(rows, columns=[key, "t", "value"])

    return lines.groupBy(key).applyInPandas(one, f"{key} {dict(lines.dtypes)[key]}, t long, value double")


def solve_bands(a: np.ndarray, b: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x of A x = y for symmetric positive A with the diagonal a, and b and c one and two beside it, by its LDL factors.

    All are (n, ...) arrays: systems side by side are solved together, in n steps and memory of n.
    """
    n = len(a)
    d, l1, l2, x = np.zeros_like(a), np.zeros_like(a), np.zeros_like(a), y.astype(float).copy()
    for i in range(n):
        d[i] = a[i] - (l1[i - 1] ** 2 * d[i - 1] if i > 0 else 0) - (l2[i - 2] ** 2 * d[i - 2] if i > 1 else 0)
        if i + 1 < n:
            l1[i] = (b[i] - (l2[i - 1] * d[i - 1] * l1[i - 1] if i > 0 else 0)) / d[i]
        if i + 2 < n:
            l2[i] = c[i] / d[i]
        x[i] = x[i] - (l1[i - 1] * x[i - 1] if i > 0 else 0) - (l2[i - 2] * x[i - 2] if i > 1 else 0)
    x /= d
    for i in range(n - 2, -1, -1):
        x[i] = x[i] - l1[i] * x[i + 1] - (l2[i] * x[i + 2] if i + 2 < n else 0)
    return x


def als(y: np.ndarray, lam: float, p: float = 0.1, rounds: int = 10) -> np.ndarray:
    """Asymmetric least-squares baseline of (n, ...) traces: second differences penalised, points above weighing p and those below 1 - p."""
    n = len(y)
    if n < 3:
        return y.astype(float)
    bands = [np.zeros(n) for _ in range(3)]
    for i in range(n - 2):  # each second difference adds (1, -2, 1) squared
        for k, v in enumerate(((1, 4, 1), (-2, -2), (1,))):
            bands[k][i : i + len(v)] += lam * np.array(v)
    a, b, c = (x.reshape(-1, *[1] * (y.ndim - 1)) + np.zeros(y.shape) for x in bands)
    w, z = np.ones(y.shape), y
    for _ in range(rounds):
        z = solve_bands(a + w, b, c, w * y)
        w = np.where(y > z, p, np.where(y < z, 1 - p, 0.0))
    return z


def baseline_als(traces: DataFrame, lam: float | None = None, p: float = 0.1, rounds: int = 10) -> DataFrame:
    """(row, col, v): each trace's baseline; the penalty is the squared length unless given.  Traces of one length in a batch are solved side by side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            size = g["v"].map(len)
            for n in sorted(set(size)):
                mine = g[size == n]
                z = als(np.stack(mine["v"].to_numpy()).astype(float).T, lam if lam is not None else float(n) ** 2, p, rounds)
                yield mine.assign(v=list(z.T))

    return traces.select("row", "col", "v").mapInPandas(run, "row int, col int, v array<double>")


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y); a line through two points."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h, m = np.diff(x), np.zeros(n)
    slope = np.diff(y) / h
    m[1:-1] = solve_bands(2 * (h[:-1] + h[1:]), np.append(h[1:-1], 0.0), np.zeros(n - 2), 6 * np.diff(slope))
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u, w = at - x[k], x[k + 1] - at
    return (m[k] * w**3 + m[k + 1] * u**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * w + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * u


def extrema(v: np.ndarray, fine: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(places of maxima, of minima) of the spline through v, on a grid `fine` times finer."""
    g = np.linspace(0, len(v) - 1, (len(v) - 1) * fine + 1)
    s = spline(np.arange(len(v), dtype=float), v, g)
    d = np.sign(np.diff(s))
    return g[1:-1][(d[:-1] > 0) & (d[1:] <= 0)], g[1:-1][(d[:-1] < 0) & (d[1:] >= 0)]


def refined_extrema(traces: DataFrame) -> DataFrame:
    """(row, col, kind, t, value), kind max or min."""

    def one(v: np.ndarray):
        up, down = extrema(v)
        for kind, at in (("max", up), ("min", down)):
            for t, y in zip(at, spline(np.arange(len(v), dtype=float), v, at), strict=True):
                yield kind, float(t), float(y)

    return map_traces(traces, one, "kind string, t double, value double")


def interpolate(traces: DataFrame, times: int) -> DataFrame:
    """(row, col, v): traces on a grid `times` finer, by the spline."""
    one = lambda v: [(spline(np.arange(len(v), dtype=float), v, np.linspace(0, len(v) - 1, (len(v) - 1) * times + 1)).tolist(),)]
    return map_traces(traces, one, "v array<double>")


def refined_lag(traces: DataFrame, signal: np.ndarray, dt: float = 1.0) -> DataFrame:
    """(row, col, lag, value): the place between samples, and height, of the highest peak of each trace's correlation with a signal.

    Both are taken as deviations from their means over their standard deviations; the correlation at every lag is smoothed by
    two scales of the starlet, and peaks are those of the spline through it.  A positive lag is a trace that comes first.  A
    trace without deviation, or without a peak, has nulls.
    """
    from .wavelet import starlet

    s = np.asarray(signal, float)
    s = (s - s.mean()) / s.std() / len(s)

    def one(v: np.ndarray) -> Iterator[tuple]:
        if len(v) != len(s) or v.std() == 0:
            yield None, None
            return
        x = starlet(np.correlate(s, (v - v.mean()) / v.std(), "full"), 2)[-1]
        up, _ = extrema(x)
        if not len(up):
            yield None, None
            return
        height = spline(np.arange(len(x), dtype=float), x, up)
        k = int(height.argmax())
        yield float((up[k] - (len(s) - 1)) * dt), float(height[k])

    return map_traces(traces, one, "lag double, value double")


def _sift(v: np.ndarray, most: int = 200) -> np.ndarray:
    """One mode: the mean of the envelopes is taken off until the mode is symmetric enough."""
    x, h = np.arange(len(v), dtype=float), v
    for _ in range(most):
        d = np.sign(np.diff(h))
        up, down = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1, np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
        if len(up) < 2 or len(down) < 2:
            break
        ends = lambda k: np.unique(np.concatenate([[0], k, [len(v) - 1]]))
        mean = (spline(ends(up).astype(float), h[ends(up)], x) + spline(ends(down).astype(float), h[ends(down)], x)) / 2
        new = h - mean
        crossings = int(((new[:-1] < 0) & (new[1:] >= 0)).sum())
        change = (mean**2).sum() / max((h**2).sum(), 1e-12)
        h = new
        if change < 0.2 and abs(len(up) - len(down)) < 2 and abs(crossings - len(up)) < 2:
            break
    return h


def emd(traces: DataFrame, most: int = 100) -> DataFrame:
    """(row, col, mode, v): empirical modes from fast to slow, the last being what is left; they add up to the trace."""

    def one(v: np.ndarray):
        rest = v.copy()
        for k in range(most):
            d = np.sign(np.diff(rest))
            if ((d[:-1] * d[1:]) < 0).sum() < 4:
                break
            m = _sift(rest)
            yield k, m.tolist()
            rest = rest - m
        else:
            k = most - 1
        yield -1, rest.tolist()

    return map_traces(traces, one, "mode long, v array<double>")


def guess_walls(v: np.ndarray) -> tuple[int, int]:
    """The steepest rise before and the steepest fall after the brightest place of a profile."""
    g, top = np.gradient(v), int(v.argmax())
    return int(g[: top + 1].argmax()), top + int(g[top:].argmin())


def vessel_walls(lines: DataFrame, key: str, memory: int = 5) -> DataFrame:
    """(key, t, lower, upper, diameter): both walls of a bright vessel, each followed along the extrema of the gradient.

    Lines are (key, t, v).  The first walls come from the mean profile; a wall goes to the local extremum nearest the
    mean of its last places.
    """

    def one(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        x = np.stack(g["v"].to_numpy()).astype(float)
        lo, hi = ([float(s)] for s in guess_walls(x.mean(0)))
        rows = []
        for t, v in zip(g["t"], x, strict=True):
            d = np.gradient(v)
            for last, s in ((lo, d), (hi, -d)):
                peaks = np.flatnonzero((s[1:-1] > s[:-2]) & (s[1:-1] >= s[2:]) & (s[1:-1] > 0.25 * s.max())) + 1
                if len(peaks):
                    last.append(float(peaks[np.abs(peaks - np.mean(last[-memory:])).argmin()]))
                else:
                    last.append(last[-1])
            rows.append((k[0], t, lo[-1], hi[-1], hi[-1] - lo[-1]))
        return pd.DataFrame(rows, columns=[key, "t", "lower", "upper", "diameter"])

    return lines.groupBy(key).applyInPandas(one, f"{key} {dict(lines.dtypes)[key]}, t long, lower double, upper double, diameter double")


def contours(u: np.ndarray, rounds: int = 500, spring: float = 0.3, pull: float = 1.0, damping: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) walls of a bright band in an image (place, t): two elastic contours moved to where the brightness
    lies between the means inside and outside, integrated until they rest."""
    n, m = u.shape
    a, b = guess_walls(u.mean(1))
    walls = np.array([np.full(m, float(a)), np.full(m, float(b))])
    speed = np.zeros_like(walls)
    place, col = np.arange(n)[:, None], np.arange(m)
    for _ in range(rounds):
        inside = (place >= walls[0]) & (place <= walls[1])
        c1, c2 = u[inside].mean() if inside.any() else 1.0, u[~inside].mean() if (~inside).any() else 0.0
        force = np.zeros_like(walls)
        for i, sign in ((0, -1.0), (1, 1.0)):
            at = np.clip(walls[i], 0, n - 1)
            lo = np.minimum(at.astype(int), n - 2)
            value = u[lo, col] * (1 - (at - lo)) + u[lo + 1, col] * (at - lo)
            region = (np.abs(value - c2) - np.abs(value - c1)) / max(abs(c1 - c2), 1e-9)
            p = np.pad(walls[i], 1, "edge")
            force[i] = sign * pull * region + spring * (p[:-2] + p[2:] - 2 * walls[i])
        speed = (1 - damping) * (speed + 0.5 * np.clip(force, -2, 2))
        walls = np.clip(walls + 0.5 * speed, 0, n - 1)
        if np.abs(speed).max() < 5e-3:
            break
    return walls[0], walls[1]


def local_contours(u: np.ndarray, window: int = 2, rounds: int = 500, spring: float = 0.25, pull: float = 1.0, damping: float = 0.25, flat: float = 0.005, steady: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) walls as elastic contours, each column judged by the means inside and outside of its own surroundings.

    The means of a column are over the `window` columns on both sides of it, from running sums along both axes, so a step
    costs as much as the image has pixels whatever the window.  A wall moves to where the brightness is as far from one mean
    as from the other; where a column has no contrast it is drawn to the mean wall.  Positions are integrated with damping
    until the line through the last `steady` mean movements has been flat for as many steps.
    """
    n, m = u.shape
    walls = np.array([np.full(m, float(x)) for x in guess_walls(u.mean(1))])
    last, col = walls.copy(), np.arange(m)
    above = np.concatenate([np.zeros((1, m)), np.cumsum(u, 0)])
    first, end = np.maximum(col - window, 0), np.minimum(col + window + 1, m)

    def around(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(x)])
        return run[end] - run[first]

    moved: list[float] = []
    rested, steps = 0, np.arange(steady) - (steady - 1) / 2
    for _ in range(rounds):
        lo, hi = np.minimum(np.floor(walls[0]).astype(int) + 1, n), np.ceil(walls[1]).astype(int)
        hi = np.maximum(hi, lo)
        held, size = above[hi, col] - above[lo, col], (hi - lo).astype(float)
        c1 = around(held) / np.maximum(around(size), 1e-12)
        c2 = around(above[-1] - held) / np.maximum(around(n - size), 1e-12)
        region = np.abs(u - c1) - np.abs(u - c2)
        most = np.abs(region).max(0)
        some = most > 1e-12
        force = np.zeros_like(walls)
        for i, sign in ((0, 1.0), (1, -1.0)):
            at = np.clip(walls[i], 0, n - 1)
            k = np.minimum(at.astype(int), n - 2)
            value = region[k, col] * (1 - (at - k)) + region[k + 1, col] * (at - k)
            p = np.pad(walls[i], 1, "edge")
            force[i] = sign * pull * np.where(some, value / np.where(some, most, 1), 0) + spring * (p[:-2] + p[2:] - 2 * walls[i]) + spring * np.where(some, 0, walls[i].mean() - walls[i])
        new = np.clip((2 - damping) * walls - (1 - damping) * last + 0.25 * np.clip(force, -2, 2), 0, n - 1)
        walls, last = np.sort(new, 0), walls
        moved.append(float(np.abs(walls - last).mean()))
        if len(moved) > steady:
            slope = float(steps @ np.array(moved[-steady:])) / float(steps @ steps)
            rested = rested + 1 if abs(slope) < flat and moved[-1] < 10 * flat else 0
            if rested > steady:
                break
    return walls[0], walls[1]


def contour_walls(lines: DataFrame, key: str, window: int | None = None) -> DataFrame:
    """(key, t, lower, upper, diameter) by elastic contours over each key's whole line scan; with a `window`, by the means around each line."""

    def one(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        u = np.stack(g["v"].to_numpy()).astype(float).T
        lo, hi = contours(u) if window is None else local_contours(u, window)
        return pd.DataFrame({key: k[0], "t": g["t"], "lower": lo, "upper": hi, "diameter": hi - lo})

    return lines.groupBy(key).applyInPandas(one, f"{key} {dict(lines.dtypes)[key]}, t long, lower double, upper double, diameter double")


def asymmetric_smooth(traces: DataFrame, level: int, r: float = 1.0, tol: float = 1e-5, most: int = 1000) -> DataFrame:
    """(row, col, v): the starlet approximation after samples above it by r deviations are cut down to it, until it rests."""
    from .wavelet import B3, _mirror, check_level

    def approx(v: np.ndarray) -> np.ndarray:
        for j in range(level):
            v = sum(w * v[_mirror(len(v), 2**j, d)] for d, w in zip(range(-2, 3), B3, strict=True))
        return v

    def one(v: np.ndarray):
        check_level(level, len(v))
        s, x = approx(v), v.copy()
        for _ in range(most):
            x = np.where(x > s + r * (v - s).std(), s, x)
            new = approx(x)
            done = (new - s).std() < tol
            s = new
            if done:
                break
        yield (s.tolist(),)

    return map_traces(traces, one, "v array<double>")


def front_velocity(points: DataFrame, key: str, least: float = 5.0) -> DataFrame:
    """(key, side, r, velocity) of a wave front picked as (key, x, t): distance from its first place, by central differences."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    apex = points.groupBy(key).agg(F.min_by("x", "t").alias("_x0"))
    p = points.join(apex, key).withColumns({"r": F.abs(F.col("x") - F.col("_x0")), "side": F.signum(F.col("x") - F.col("_x0")).cast("int")}).filter("side <> 0")
    w = Window.partitionBy(key, "side").orderBy("r")
    v = F.abs((F.lead("r").over(w) - F.lag("r").over(w)) / F.nullif(F.lead("t").over(w) - F.lag("t").over(w), F.lit(0.0)))
    return p.withColumn("velocity", v).filter((F.col("r") >= least) & F.col("velocity").isNotNull()).select(key, "side", "r", "velocity")


def _window_sums(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums of every h x w window, from a table of the sums above and left of each pixel."""
    table = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return table[h:, w:] - table[:-h, w:] - table[h:, :-w] + table[:-h, :-w]


def template_scores(x: np.ndarray, template: np.ndarray, how: str = "correlation") -> np.ndarray:
    """How well the template fits at every place of its upper left corner: Pearson's correlation, or less the summed squared difference.

    Sums of windows come from summed-area tables, products from one pass for each of the template's pixels.  Windows without
    contrast have correlation 0.
    """
    h, w = template.shape
    base = x - x.mean()  # keeps the tables' differences exact enough
    t = template - (template.mean() if how == "correlation" else x.mean())
    shape = (x.shape[0] - h + 1, x.shape[1] - w + 1)
    cross = sum((t[i, j] * base[i : i + shape[0], j : j + shape[1]] for i in range(h) for j in range(w)), np.zeros(shape))
    squares, sums = _window_sums(base**2, h, w), _window_sums(base, h, w)
    if how == "squares":
        return -(squares - 2 * cross + (t**2).sum())
    spread = np.maximum(squares - sums**2 / (h * w), 0) * (t**2).sum()
    flat = spread <= 1e-12 * max(1.0, float(squares.max()) ** 2)
    return np.where(flat, 0.0, cross / np.sqrt(np.where(flat, 1.0, spread)))


def follow_template(frames: DataFrame, template: np.ndarray, around: tuple[int, int] | None = None, reach: int | None = None, how: str = "correlation") -> DataFrame:
    """(t, row, col, score) of the place in each frame where the template fits best, ties to the first in raster order.

    With `around` and `reach`, corners at most so many rows and columns from a place are searched, else all; frames that the
    template does not fit into give no row.  The template travels with the code: it is one region of a frame.
    """
    from .wavelet import map_frames

    template = np.asarray(template, float)

    def one(t: int, x: np.ndarray) -> Iterator[tuple]:
        if any(a < b for a, b in zip(x.shape, template.shape, strict=True)):
            return
        score = template_scores(x, template, how)
        r0, c0 = (max(0, a - reach) for a in around) if around else (0, 0)
        part = score[r0 : around[0] + reach + 1, c0 : around[1] + reach + 1] if around else score
        if part.size:
            # Scores that differ by rounding alone are ties.
            r, c = np.unravel_index(int((part >= part.max() - 1e-9 * max(1.0, abs(part.max()))).argmax()), part.shape)
            yield t, int(r + r0), int(c + c0), float(part[r, c])

    return map_frames(frames, one, "t long, row long, col long, score double")
