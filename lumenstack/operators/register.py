"""Registration: shifts by phase correlation, optical flow, warps as data, and their application to frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import frames_to_cells
from .wavelet import map_frames


def template(cells: DataFrame, first: int, last: int) -> np.ndarray:
    """The largest value of each pixel over frames first ... last - 1: one image, small enough to send."""
    got = cells.filter((F.col("t") >= first) & (F.col("t") < last)).groupBy("row", "col").agg(F.max("value").alias("value")).toPandas()
    out = np.zeros((got["row"].max() + 1, got["col"].max() + 1))
    out[got["row"], got["col"]] = got["value"]
    return out


def phase_shift(a: np.ndarray, b: np.ndarray, up: int = 16) -> tuple[float, float]:
    """(dy, dx) that moves b onto a: the peak of the phase correlation, refined on a grid `up` times finer."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    f /= np.maximum(np.abs(f), 1e-3 * np.abs(f).max() + 1e-300)  # frequencies of no power have no phase to tell
    c = np.fft.ifft2(f).real
    peak = np.array(np.unravel_index(c.argmax(), c.shape), float)
    size = np.array(c.shape)
    peak = np.where(peak > size // 2, peak - size, peak)
    fine = np.arange(-up, up + 1) / up
    fy, fx = np.fft.fftfreq(size[0]), np.fft.fftfreq(size[1])
    ey = np.exp(2j * np.pi * (peak[0] + fine)[:, None] * fy[None])
    ex = np.exp(2j * np.pi * fx[:, None] * (peak[1] + fine)[None])
    i, j = np.unravel_index((ey @ f @ ex).real.argmax(), (len(fine), len(fine)))
    return float(peak[0] + fine[i]), float(peak[1] + fine[j])


def register_shifts(frames: DataFrame, target: np.ndarray) -> DataFrame:
    """warps (t, model, params): the shift of each frame onto the template; no shuffle."""
    return map_frames(frames, lambda t, x: [(t, "shift", list(phase_shift(target, x)))], "t long, model string, params array<double>")


def affine_fit(a: np.ndarray, b: np.ndarray, rounds: int = 30) -> list[float]:
    """Six parameters (y then x: offset, by row, by column) of the affine map under which b looks like a, by Gauss-Newton."""
    h, w = a.shape
    y, x = np.mgrid[:h, :w].astype(float)
    y0, x0 = y - (h - 1) / 2, x - (w - 1) / 2
    p = np.zeros(6)
    for _ in range(rounds):
        ys, xs = y + p[0] + p[1] * y0 + p[2] * x0, x + p[3] + p[4] * y0 + p[5] * x0
        moved = bilinear(b, ys, xs)
        gy, gx = np.gradient(moved)
        j = np.stack([gy, gy * y0, gy * x0, gx, gx * y0, gx * x0], -1).reshape(-1, 6)
        step = np.linalg.lstsq(j, (a - moved).ravel(), rcond=None)[0]
        p += step
        if np.abs(step).max() < 1e-4:
            break
    return p.tolist()


def register_affine(frames: DataFrame, target: np.ndarray) -> DataFrame:
    return map_frames(frames, lambda t, x: [(t, "affine", affine_fit(target, x))], "t long, model string, params array<double>")


def bilinear(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Values between the pixels; the nearest ones outside."""
    h, w = x.shape
    ys, xs = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = np.minimum(ys.astype(int), max(h - 2, 0)), np.minimum(xs.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = ys - y0, xs - x0
    return (x[y0, x0] * (1 - fx) + x[y0, x1] * fx) * (1 - fy) + (x[y1, x0] * (1 - fx) + x[y1, x1] * fx) * fy


def spline_coefficients(x: np.ndarray) -> np.ndarray:
    """Coefficients whose cubic B-spline passes through the image, mirrored at the edges: two recursions along each axis."""
    pole = math.sqrt(3) - 2
    for axis in (0, 1):
        n = x.shape[axis]
        if n < 2:
            continue
        c = np.moveaxis(x, axis, 0).astype(float)
        # The mirrored signal has period 2n - 2; the first value of the recursion is its sum over all of the past.
        k = np.arange(1, n - 1)
        past = c[0] + np.tensordot(pole**k + pole ** (2 * n - 2 - k), c[1:-1], 1) + pole ** (n - 1) * c[-1]
        out = np.empty_like(c)
        out[0] = past / (1 - pole ** (2 * n - 2))
        for i in range(1, n):
            out[i] = c[i] + pole * out[i - 1]
        out[-1] = pole / (pole * pole - 1) * (out[-1] + pole * out[-2])
        for i in range(n - 2, -1, -1):
            out[i] = pole * (out[i + 1] - out[i])
        x = np.moveaxis(6 * out, 0, axis)
    return x


def bicubic(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Values between the pixels by the cubic spline through them; those of the nearest place inside beyond the edges."""
    h, w = x.shape
    c, out = spline_coefficients(x), 0.0

    def parts(at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = np.clip(at, 0, n - 1)
        low = np.floor(at).astype(int)
        f = at - low
        weights = ((1 - f) ** 3 / 6, (4 - 6 * f**2 + 3 * f**3) / 6, (1 + 3 * f + 3 * f**2 - 3 * f**3) / 6, f**3 / 6)
        for d, v in zip((-1, 0, 1, 2), weights, strict=True):
            k = np.abs(low + d) % max(2 * n - 2, 1)
            yield np.where(k < n, k, 2 * n - 2 - k), v

    across = list(parts(xs, w))
    for r, v in parts(ys, h):
        for k, u in across:
            out = out + v * u * c[r, k]
    return out


SAMPLERS = {1: bilinear, 3: bicubic}


def warp(x: np.ndarray, model: str, p: list[float], order: int = 1) -> np.ndarray:
    """The image resampled where the model says, between pixels by splines of the order (1 or 3)."""
    h, w = x.shape
    between = SAMPLERS[order]
    r, c = np.mgrid[:h, :w].astype(float)
    if model == "shift":
        return between(x, r - p[0], c - p[1])
    if model == "affine":
        y0, x0 = r - (h - 1) / 2, c - (w - 1) / 2
        return between(x, r + p[0] + p[1] * y0 + p[2] * x0, c + p[3] + p[4] * y0 + p[5] * x0)
    if model == "homography":
        s = max(h, w) / 2
        ys, xs, _ = _project(np.asarray(p), (r - (h - 1) / 2) / s, (c - (w - 1) / 2) / s)
        return between(x, ys * s + (h - 1) / 2, xs * s + (w - 1) / 2)
    if model == "mesh":
        n, m, size = map(int, p[:3])
        step = max(size // 3, 1)
        ry, cx = np.arange(min(size // 2, h // 2), h, step), np.arange(min(size // 2, w // 2), w, step)
        dy, dx = (_spread_mesh(d, ry, cx, h, w) for d in np.reshape(p[3:], (2, n, m)))
        return between(x, r + dy, c + dx)
    if model == "line_scan":
        base = _hats(h, w, int(p[0]))
        dy, dx = (base @ np.asarray(d) for d in np.reshape(p[1:], (2, -1)))
        return between(x, r + dy.reshape(h, w), c + dx.reshape(h, w))
    raise ValueError(f"no warp model {model}")


def apply_warps(frames: DataFrame, warps: DataFrame, order: int = 1) -> DataFrame:
    """Frames resampled by the warp of their t, by splines of the order (1 or 3); frames without one stay."""

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["data"] = [np.asarray(d) if m is None else warp(np.asarray(d, float).reshape(h, w), m, p, order).ravel() for h, w, d, m, p in zip(b["h"], b["w"], b["data"], b["model"], b["params"], strict=True)]
            yield b[["t", "h", "w", "data"]]

    return frames.join(warps, "t", "left").mapInPandas(run, "t long, h int, w int, data array<double>")


def register_recursive(frames: DataFrame) -> DataFrame:
    """warps of every frame onto the common mean: at each of log2(T) rounds the means of neighbouring halves are aligned.

    A round works on one mean image per block of frames, so its rows halve; warps are summed up by block.
    """
    means = frames.select(F.col("t").alias("k"), "h", "w", "data", F.lit(1.0).alias("n"))
    n = frames.agg(F.max("t")).first()[0] or 0
    total = frames.select("t", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))
    level = 0
    from .graph import written

    while 2**level <= n:

        def one(key, g):
            g = g.sort_values("k0")
            a = np.asarray(g["data"].iloc[0], float).reshape(g["h"].iloc[0], g["w"].iloc[0])
            import pandas as pd

            if len(g) < 2:
                return pd.DataFrame({"k": [key[0]], "h": a.shape[0], "w": a.shape[1], "data": [a.ravel()], "n": g["n"], "dy": 0.0, "dx": 0.0})
            b = np.asarray(g["data"].iloc[1], float).reshape(a.shape)
            dy, dx = phase_shift(b, a)
            mean = (warp(a, "shift", [dy, dx]) + b) / 2
            return pd.DataFrame({"k": [key[0]], "h": a.shape[0], "w": a.shape[1], "data": [mean.ravel()], "n": [g["n"].sum()], "dy": dy, "dx": dx})

        pair = means.withColumn("k0", F.col("k")).withColumn("k", F.floor(F.col("k") / 2).cast("long")).groupBy("k")
        done = written(pair.applyInPandas(one, "k long, h int, w int, data array<double>, n double, dy double, dx double"), "halves")
        block = F.floor(F.col("t") / 2 ** (level + 1)).cast("long")
        left = F.pmod(F.floor(F.col("t") / 2**level), F.lit(2)) == 0
        moved = done.select(F.col("k").alias("_k"), F.col("dy").alias("_dy"), F.col("dx").alias("_dx"))
        total = written(total.join(moved, block == F.col("_k"), "left").select("t", (F.col("dy") + F.when(left, F.col("_dy")).otherwise(0.0)).alias("dy"), (F.col("dx") + F.when(left, F.col("_dx")).otherwise(0.0)).alias("dx")), "warps")
        means = done.select("k", "h", "w", "data", "n")
        level += 1
    return total.select("t", F.lit("shift").alias("model"), F.array("dy", "dx").alias("params"))


def lk_flow(cells: DataFrame, size: int) -> DataFrame:
    """(t, tr, tc, vy, vx): Lucas-Kanade flow from each frame to the next in tiles of `size`, by sums of gradient products.

    Gradients are central differences by windows along rows and columns; borders and singular tiles have none.
    """
    byrow, bycol, bytime = (Window.partitionBy(*k).orderBy(o) for k, o in ((("t", "col"), "row"), (("t", "row"), "col"), (("row", "col"), "t")))
    g = cells.withColumns(
        {"iy": (F.lead("value").over(byrow) - F.lag("value").over(byrow)) / 2, "ix": (F.lead("value").over(bycol) - F.lag("value").over(bycol)) / 2, "it": F.col("value") - F.lead("value").over(bytime)}
    ).dropna(subset=["iy", "ix", "it"])
    s = {n: F.sum(F.col(a) * F.col(b)) for n, a, b in (("yy", "iy", "iy"), ("xy", "iy", "ix"), ("xx", "ix", "ix"), ("yt", "iy", "it"), ("xt", "ix", "it"))}
    m = g.groupBy("t", F.floor(F.col("row") / size).cast("long").alias("tr"), F.floor(F.col("col") / size).cast("long").alias("tc")).agg(*[v.alias(k) for k, v in s.items()])
    det = F.expr("yy * xx - xy * xy")
    return m.filter(det > 1e-9).select("t", "tr", "tc", (F.expr("yt * xx - xt * xy") / det).alias("vy"), (F.expr("xt * yy - yt * xy") / det).alias("vx"))


def stabilise(frames: DataFrame, models: tuple[str, ...] = ("shift",), most: int = 50) -> tuple[DataFrame, list[DataFrame]]:
    """(frames, warps of each model) after a chain of models, each on what the one before left.

    The template is the largest value over up to `most` frames from the middle.
    """
    out, all_ = frames, []
    n = frames.count()
    for m in models:
        first = max(0, n // 2 - most // 2)
        target = template(frames_to_cells(out), first, first + most)
        warps = register_model(out, target, m)
        all_.append(warps)
        out = apply_warps(out, warps)
    return out, all_


def homography_fit(a: np.ndarray, b: np.ndarray, rounds: int = 40) -> list[float]:
    """Eight parameters of the projective map (of centred, scaled coordinates) under which b looks like a."""
    h, w = a.shape
    y, x = np.mgrid[:h, :w].astype(float)
    s = max(h, w) / 2
    v, u = (y - (h - 1) / 2) / s, (x - (w - 1) / 2) / s
    p = np.zeros(8)
    for _ in range(rounds):
        ys, xs, d = _project(p, v, u)
        moved = bilinear(b, ys * s + (h - 1) / 2, xs * s + (w - 1) / 2)
        gy, gx = (g * s for g in np.gradient(moved))
        z = -(gy * ys + gx * xs) / d
        j = np.stack([gy / d, gy * v / d, gy * u / d, gx / d, gx * v / d, gx * u / d, z * v, z * u], -1).reshape(-1, 8)
        step = np.linalg.lstsq(j, (a - moved).ravel(), rcond=None)[0]
        p += step
        if np.abs(step).max() < 1e-6:
            break
    return p.tolist()


def _project(p: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = 1 + p[6] * v + p[7] * u
    return (v + p[0] + p[1] * v + p[2] * u) / d, (u + p[3] + p[4] * v + p[5] * u) / d, d


def mesh_fit(a: np.ndarray, b: np.ndarray, size: int = 25, rounds: int = 10) -> list[float]:
    """[rows, cols, dy..., dx...]: displacements on a mesh of step size // 3, from flow in windows, smoothed each round."""
    h, w = a.shape
    step = max(size // 3, 1)
    ry, cx = np.arange(min(size // 2, h // 2), h, step), np.arange(min(size // 2, w // 2), w, step)
    d = np.zeros((2, len(ry), len(cx)))
    y, x = np.mgrid[:h, :w].astype(float)
    for _ in range(rounds):
        dy, dx = (_spread_mesh(m, ry, cx, h, w) for m in d)
        moved = bilinear(b, y + dy, x + dx)
        gy, gx = np.gradient(moved)
        e = a - moved
        add = np.zeros_like(d)
        for i, r in enumerate(ry):
            for k, c in enumerate(cx):
                win = np.s_[max(r - size // 2, 0) : r + size // 2 + 1, max(c - size // 2, 0) : c + size // 2 + 1]
                m = np.array([[(gy[win] ** 2).sum(), (gy[win] * gx[win]).sum()], [(gy[win] * gx[win]).sum(), (gx[win] ** 2).sum()]])
                rhs = np.array([(gy[win] * e[win]).sum(), (gx[win] * e[win]).sum()])
                add[:, i, k] = np.clip(np.linalg.solve(m + 1e-6 * (np.trace(m) + 1e-9) * np.eye(2), rhs), -10, 10)
        p = np.pad(add, ((0, 0), (1, 1), (1, 1)), "edge")
        add = sum(wr * wc * p[:, 1 + i : 1 + i + len(ry), 1 + k : 1 + k + len(cx)] for i, wr in ((-1, 0.25), (0, 0.5), (1, 0.25)) for k, wc in ((-1, 0.25), (0, 0.5), (1, 0.25)))
        d += add
        if np.abs(add).max() < 1e-2:
            break
    return [float(len(ry)), float(len(cx)), float(size), *d.ravel().tolist()]


def _spread_mesh(m: np.ndarray, ry: np.ndarray, cx: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mesh values at every pixel, linear between the knots."""
    rows = np.array([np.interp(np.arange(w), cx, line) for line in m])
    return np.array([np.interp(np.arange(h), ry, col) for col in rows.T]).T


def line_scan_fit(a: np.ndarray, b: np.ndarray, knots: int = 11, rounds: int = 50) -> list[float]:
    """[knots, dy..., dx...]: displacement piecewise linear in the time of a raster scan, by Gauss-Newton, within 10 pixels."""
    h, w = a.shape
    y, x = np.mgrid[:h, :w].astype(float)
    base = _hats(h, w, knots)
    p = np.zeros((2, knots))
    for _ in range(rounds):
        dy, dx = (base @ p[0]).reshape(h, w), (base @ p[1]).reshape(h, w)
        moved = bilinear(b, y + dy, x + dx)
        if np.corrcoef(moved.ravel(), a.ravel())[0, 1] > 0.9999:
            break
        gy, gx = np.gradient(moved)
        j = np.hstack([base * gy.reshape(-1, 1), base * gx.reshape(-1, 1)])
        n = j.T @ j
        step = np.linalg.solve(n + 1e-6 * (np.trace(n) / len(n) + 1e-9) * np.eye(len(n)), j.T @ (a - moved).ravel()).reshape(2, -1)
        p = np.clip(p + step, -10, 10)
        if np.abs(step).max() < 1e-3:
            break
    return [float(knots), *p.ravel().tolist()]


def _hats(h: int, w: int, knots: int) -> np.ndarray:
    """(h * w, knots): linear interpolation weights along the scan."""
    at = np.linspace(0, knots - 1, h * w)
    return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(knots)[None]))


FITS = {"affine": affine_fit, "homography": homography_fit, "mesh": mesh_fit, "line_scan": line_scan_fit}


def register_model(frames: DataFrame, target: np.ndarray, model: str, **more) -> DataFrame:
    """(t, model, params) of each frame by a model of FITS or `shift`; `more` goes to the model's fit."""
    if model == "shift":
        return register_shifts(frames, target)
    fit = FITS[model]
    return map_frames(frames, lambda t, x: [(t, model, fit(target, x, **more))], "t long, model string, params array<double>")
