"""Undecimated (starlet) wavelets: along time on trace arrays, in space per frame; thresholds, noise and reconstruction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The B3 spline, and the deviation of each level's coefficients for unit white noise.
B3 = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
SIGMA_1D = (0.7235, 0.2854, 0.1779, 0.1222, 0.08581, 0.06057, 0.0428)
SIGMA_2D = (0.890, 0.201, 0.086, 0.042, 0.021, 0.010, 0.005)
SIGMA_3D = (0.956, 0.120, 0.035, 0.012, 0.004, 0.001, 0.0005)
SIGMA_MEDIAN_2 = (0.8908, 0.2111, 0.0808, 0.0343, 0.0200, 0.0107)
SIGMA_MEDIAN_1 = (1.012, 0.229, 0.072, 0.044, 0.028, 0.015)


def _let(x: Column, f) -> Column:
    return F.transform(F.array(x), f)[0]


def smooth_once(v: Column, hole: int) -> Column:
    """One pass of the spline with holes on an array; indices are mirrored at both ends without repeating the edge."""

    def at(i: Column, d: int, n: Column) -> Column:
        k = i + d * hole
        return F.when(k < 0, F.pmod(-k, n)).when(k >= n, n - 2 - F.pmod(k, n)).otherwise(k)

    return _let(v, lambda a: F.transform(a, lambda _, i: sum((F.get(a, at(i, d, F.size(a)).cast("int")) * w for d, w in zip((-2, -1, 1, 2), (B3[0], B3[1], B3[3], B3[4]), strict=True)), F.get(a, i) * B3[2])))


def check_level(level: int, length: int | None) -> None:
    if level < 1 or length is not None and 2**level > length - 1:
        raise ValueError(f"level {level} is too deep for {length} samples")


def decompose1d(traces: DataFrame, level: int, length: int | None = None) -> DataFrame:
    """`traces` with w0 ... w(level - 1), the details from fine to coarse, and `approx`; all expressions."""
    check_level(level, length)
    out = traces.withColumn("_c0", F.col("v"))
    for j in range(level):
        out = out.withColumn(f"_c{j + 1}", smooth_once(F.col(f"_c{j}"), 2**j))
    details = {f"w{j}": F.zip_with(f"_c{j}", f"_c{j + 1}", lambda a, b: a - b) for j in range(level)}
    return out.withColumns({**details, "approx": F.col(f"_c{level}")}).drop(*[f"_c{j}" for j in range(level + 1)])


def coefficients(decomposed: DataFrame, level: int, keys: list[str]) -> DataFrame:
    """(keys, level, t, value): details as levels 0 ... level - 1, the approximation as `level`."""
    all_ = F.array(*[F.col(f"w{j}") for j in range(level)], F.col("approx"))
    x = decomposed.select(*keys, F.posexplode(all_).alias("level", "_v"))
    return x.select(*keys, F.col("level").cast("long").alias("level"), F.posexplode("_v").alias("t", "value")).withColumn("t", F.col("t").cast("long"))


def smooth1d(traces: DataFrame, level: int) -> DataFrame:
    """The approximation alone."""
    v = F.col("v")
    for j in range(level):
        traces = traces.withColumn("v", smooth_once(v, 2**j))
    return traces


def detrend1d(traces: DataFrame, level: int) -> DataFrame:
    s = smooth1d(traces.withColumn("_o", F.col("v")), level)
    return s.withColumn("v", F.zip_with("_o", "v", lambda a, b: a - b)).drop("_o")


def dfof1d(traces: DataFrame, level: int) -> DataFrame:
    """v over its approximation, minus 1; 0 where that is nearly 0."""
    s = smooth1d(traces.withColumn("_o", F.col("v")), level)
    return s.withColumn("v", F.zip_with("_o", "v", lambda a, b: F.when(F.abs(b) >= 1e-6, a / b - 1).otherwise(0.0))).drop("_o")


def dfosd1d(traces: DataFrame, level: int, smooth: int = 0) -> DataFrame:
    """What the approximation leaves, over the noise of the finest details; without the `smooth` finest levels; 0 where there is no noise."""
    d = sigma_mad(decompose1d(traces, level))
    rest = F.zip_with("v", "approx", lambda a, b: a - b)
    for j in range(smooth):
        rest = F.zip_with(rest, f"w{j}", lambda a, b: a - b)
    return d.withColumn("v", F.transform(F.arrays_zip(rest.alias("r"), F.array_repeat("sigma", F.size("v")).alias("s")), lambda z: F.coalesce(F.try_divide(z["r"], z["s"]), F.lit(0.0)))).select(*traces.columns)


def local_std1d(traces: DataFrame, level: int) -> DataFrame:
    """The root of the smoothed square of what the approximation leaves."""
    d = detrend1d(traces, level)
    sq = smooth1d(d.withColumn("v", F.transform("v", lambda x: x * x)), level)
    return sq.withColumn("v", F.transform("v", lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))))


def sigma_mad(traces: DataFrame) -> DataFrame:
    """`traces` with sigma: the noise of each trace from the median deviation of its finest details."""
    w = F.zip_with("v", smooth_once(F.col("v"), 1), lambda a, b: a - b)
    med = lambda a: _let(F.array_sort(a), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)
    return traces.withColumn("sigma", _let(w, lambda a: _let(med(a), lambda m: med(F.transform(a, lambda x: F.abs(x - m))))) / (0.6745 * SIGMA_1D[0]))


def denoise1d(traces: DataFrame, level: int, k: float = 3.0, soft: bool = False) -> DataFrame:
    """Details within k noise deviations of their level (by modulus) go; the approximation stays."""
    d = decompose1d(sigma_mad(traces), level)
    out = F.col("approx")
    for j in range(level):
        th = k * SIGMA_1D[j] * F.col("sigma")
        cut = F.transform(F.arrays_zip(F.col(f"w{j}").alias("w"), F.array_repeat(th, F.size(f"w{j}")).alias("th")), _shrink(soft))
        out = F.zip_with(out, cut, lambda a, b: a + b)
    return d.withColumn("v", out).select(*traces.columns)


def _shrink(soft: bool):
    return lambda z: F.when(F.abs(z["w"]) > z["th"], z["w"] - F.signum(z["w"]) * z["th"] if soft else z["w"]).otherwise(0.0)


def support(coefs: DataFrame, sigma: float | Column, k: float | list, table: tuple[float, ...] = SIGMA_1D, modulus: bool = True, neg: bool = False, level_of_rest: int | None = None) -> DataFrame:
    """`coefs` with supp: 1 where significant; the approximation, which is `level_of_rest` where that is given, always is.

    `k` is in deviations of a level's noise: one number, or for each level a number or a band (low, high], in which a coefficient
    is significant.  `neg` asks for less than the threshold instead of more, and then leaves the approximation out; bands are
    as they are.  Without `modulus` the sign counts.
    """
    scale = F.element_at(F.array(*map(F.lit, table)), F.least(F.col("level") + 1, F.lit(len(table))).cast("int")) * sigma
    v = F.abs("value") if modulus else F.col("value")

    def beyond(t) -> Column:
        if isinstance(t, (tuple, list)):
            return (v > t[0] * scale) & (v <= t[1] * scale)
        return v < t * scale if neg else v > t * scale

    if isinstance(k, list):
        # Levels beyond the list are as its last.
        hit = beyond(k[-1])
        for j in range(len(k) - 2, -1, -1):
            hit = F.when(F.col("level") == j, beyond(k[j])).otherwise(hit)
    else:
        hit = beyond(k)
    if level_of_rest is not None:
        hit = F.when(F.col("level") == level_of_rest, F.lit(not neg)).otherwise(hit)
    return coefs.withColumn("supp", hit.cast("int"))


def represent_support(coefs: DataFrame, keys: list[str]) -> DataFrame:
    """One number per place: the sum of 2 ** (level + 1) over its significant levels."""
    return coefs.groupBy(*keys).agg(F.sum(F.col("supp") * F.pow(F.lit(2.0), F.col("level") + 1)).cast("long").alias("value"))


def reconstruct(coefs: DataFrame, keys: list[str], above: int = -1) -> DataFrame:
    """Sum of the levels above, times the support where there is one."""
    v = F.col("value") * F.col("supp") if "supp" in coefs.columns else F.col("value")
    return coefs.filter(F.col("level") > above).groupBy(*keys).agg(F.sum(v).alias("value"))


# Per-frame kernels.


def _mirror(n: int, hole: int, d: int) -> np.ndarray:
    k = np.arange(n) + d * hole
    return np.where(k < 0, (-k) % n, np.where(k >= n, n - 2 - k % n, k))


def smooth2d(x: np.ndarray, hole: int) -> np.ndarray:
    for axis in (0, 1):
        x = sum(w * np.take(x, _mirror(x.shape[axis], hole, d), axis) for d, w in zip(range(-2, 3), B3, strict=True))
    return x


def starlet2d(x: np.ndarray, level: int) -> np.ndarray:
    """(level + 1, h, w): details, then the approximation."""
    check_level(level, min(x.shape))
    out = []
    for j in range(level):
        c = smooth2d(x, 2**j)
        out.append(x - c)
        x = c
    return np.array([*out, x])


def starlet(x: np.ndarray, level: int) -> np.ndarray:
    """Details, then the approximation, of an array of any number of dimensions."""
    check_level(level, min(x.shape))
    out = []
    for j in range(level):
        c = x
        for axis in range(x.ndim):
            c = sum(w * np.take(c, _mirror(c.shape[axis], 2**j, d), axis) for d, w in zip(range(-2, 3), B3, strict=True))
        out.append(x - c)
        x = c
    return np.array([*out, x])


def median2d(x: np.ndarray, s: int) -> np.ndarray:
    """Median of the (2s + 1)-square, mirrored at the edges."""
    p = np.pad(x, s, "reflect" if s < min(x.shape) else "symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (2 * s + 1, 2 * s + 1)), axis=(2, 3))


def median_pyramid(x: np.ndarray, level: int, s: int = 2) -> np.ndarray:
    out = []
    for _ in range(level):
        c = median2d(x, s)
        out.append(x - c)
        x, s = c, 2 * s
    return np.array([*out, x])


#: Values or result rows that a frame kernel holds, besides those of one frame, before it hands them on.
HELD = 1 << 16


def map_frames(frames: DataFrame, fn, schema: str) -> DataFrame:
    """`fn(t, image)` yields result tuples; frames are independent, so no shuffle, and results go on some at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for t, h, w, d in zip(b["t"], b["h"], b["w"], b["data"], strict=True):
                for r in fn(t, np.asarray(d, float).reshape(h, w)):
                    rows.append(r)
                    if len(rows) >= HELD:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return frames.mapInPandas(run, schema)


def decompose2d(frames: DataFrame, level: int, kind: str = "starlet") -> DataFrame:
    """(t, level, row, col, value) of each frame; kind is starlet, median or hybrid."""
    kernel = {"starlet": starlet2d, "median": median_pyramid, "hybrid": hybrid_pyramid}[kind]

    def batch(done: list[tuple]) -> pa.RecordBatch:
        at = [np.indices(w.shape).reshape(3, -1) for _, w in done]
        level, row, col = (np.concatenate([a[k] for a in at]) for k in range(3))
        t = pa.array([t for t, _ in done], pa.int64()).take(pa.array(np.repeat(np.arange(len(done)), [w.size for _, w in done])))
        columns = [t, pa.array(level, pa.int64()), pa.array(row.astype("int32")), pa.array(col.astype("int32")), pa.array(np.concatenate([w.ravel() for _, w in done]))]
        return pa.RecordBatch.from_arrays(columns, names=["t", "level", "row", "col", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, held = [], 0
            for k in range(len(b)):
                h, w, data = b["h"][k].as_py(), b["w"][k].as_py(), b["data"][k].values.to_numpy(zero_copy_only=False)
                done.append((b["t"][k].as_py(), kernel(data.astype(float).reshape(h, w), level)))
                held += done[-1][1].size
                if held >= HELD:
                    yield batch(done)
                    done, held = [], 0
            if done:
                yield batch(done)

    return frames.select(F.col("t").cast("long").alias("t"), "h", "w", "data").mapInArrow(run, "t long, level long, row int, col int, value double")


def decompose3d(cells: DataFrame, level: int, frames: int, temporal_only: bool = False) -> DataFrame:
    """(level, t, row, col, value) of a cube: at each level a pass along time per pixel, then one in space per frame.

    Two exchanges a level, by pixel and by frame; each level's smooth cube is a written table.
    """
    from .graph import written
    from .layout import frames_to_cells, to_frames, to_traces, traces_to_cells

    check_level(level, frames)
    now, out = cells.select("t", "row", "col", "value"), None
    for j in range(level):
        nxt = traces_to_cells(to_traces(now).withColumn("v", smooth_once(F.col("v"), 2**j)))
        if not temporal_only:
            f = to_frames(nxt)

            def run(batches: Iterator[pd.DataFrame], hole: int = 2**j) -> Iterator[pd.DataFrame]:
                for b in batches:
                    b["data"] = [smooth2d(np.asarray(d, float).reshape(h, w), hole).ravel() for h, w, d in zip(b["h"], b["w"], b["data"], strict=True)]
                    yield b

            nxt = frames_to_cells(f.mapInPandas(run, "t long, h int, w int, data array<double>"))
        nxt = written(nxt, "smooth")
        both = now.unionByName(nxt.withColumn("value", -F.col("value")))
        detail = both.groupBy("t", "row", "col").agg(F.sum("value").alias("value")).select(F.lit(j).cast("long").alias("level"), "t", "row", "col", "value")
        out = detail if out is None else out.unionByName(detail)
        now = nxt
    return out.unionByName(now.select(F.lit(level).cast("long").alias("level"), "t", "row", "col", "value"))


def bspline_smooth(traces: DataFrame) -> DataFrame:
    """One pass of the spline, mirrored with the edge repeated."""

    def one(a: Column) -> Column:
        n = F.size(a)
        at = lambda k: F.when(k < 0, -k - 1).when(k >= n, 2 * n - 1 - k).otherwise(k)
        return F.transform(a, lambda _, i: sum((F.get(a, at(i + d).cast("int")) * w for d, w in zip((-2, -1, 1, 2), (B3[0], B3[1], B3[3], B3[4]), strict=True)), F.get(a, i) * B3[2]))

    return traces.withColumn("v", _let(F.col("v"), one))


def sigma_kclip(df: DataFrame, k: float = 3.0, rounds: int = 3) -> float:
    """Deviation of `value` after rounds of leaving out what is k deviations or more from 0; one row a round."""
    sd = df.agg(F.stddev_pop("value")).first()[0] or 0.0
    for _ in range(rounds):
        sd = df.agg(F.stddev_pop(F.when(F.abs("value") < k * sd, F.col("value")))).first()[0] or 0.0
    return sd / SIGMA_1D[0]


def estimate_sigma(traces: DataFrame, level: int, k: float = 3.0, eps: float = 0.01, rounds: int = 20) -> DataFrame:
    """`traces` with sigma: from the median deviation, then the deviation of what the approximation leaves, over the
    samples that are significant at no level, until it moves by less than eps; per trace, in expressions."""
    d = sigma_mad(decompose1d(traces, level))
    rest = F.zip_with("v", "approx", lambda a, b: a - b)
    zipped = F.arrays_zip(rest.alias("r"), *[F.col(f"w{j}") for j in range(level)])

    def again(s: Column) -> Column:
        quiet = F.filter(zipped, lambda z: ~_any([F.abs(z[f"w{j}"]) > k * SIGMA_1D[j] * s for j in range(level)]))

        def sd(a: Column) -> Column:
            n = F.size(a)
            total = lambda f: F.aggregate(a, F.lit(0.0), lambda x, z: x + f(z["r"]))
            return F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(total(lambda r: r * r), n) - F.pow(F.try_divide(total(lambda r: r), n), F.lit(2.0)))))

        return F.coalesce(_let(quiet, sd), s)

    step = lambda acc, _: F.when(acc["done"], acc).otherwise(_let(again(acc["s"]), lambda new: F.struct(new.alias("s"), (F.abs(new - acc["s"]) <= eps * new).alias("done"))))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.col("sigma").alias("s"), F.lit(False).alias("done")), step, lambda a: a["s"])
    return d.withColumn("sigma", out).select(*traces.columns, "sigma")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def hybrid_pyramid(x: np.ndarray, level: int, s: int = 2, tau: float = 5.0, upto: int = 2) -> np.ndarray:
    """Median pyramid on the first `upto` levels, whose strong coefficients are kept out of the starlet smoothing; starlet beyond."""
    out = []
    for j in range(level):
        if j < upto:
            c = median2d(x, s)
            w = x - c
            held = w[w != 0]
            th = tau * np.median(np.abs(held - np.median(held))) / 0.6745 if len(held) else 0.0
            c = np.where(np.abs(w) > th, c, x)
            for i in range(j + 1):
                c = smooth2d(c, 2**i)
            s *= 2
        else:
            c = smooth2d(x, 2**j)
        out.append(x - c)
        x = c
    return np.array([*out, x])


def rebuild(coefs: np.ndarray, supp: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A non-negative image whose starlet coefficients agree with the significant ones, by damped gradient steps."""
    level = len(coefs) - 1
    x = (coefs * supp).sum(0)
    step = 1.0
    for _ in range(rounds):
        u = ((coefs - starlet2d(x, level)) * supp).sum(0)
        wu = (starlet2d(u, level) * supp).sum(0)
        a = (u**2).sum() / max((wu**2).sum(), 1e-12)
        x = np.maximum(0, x + a * step * u)
        step *= 0.9
    return x


def rebuild_cg(coefs: np.ndarray, supp: np.ndarray, rounds: int = 30, tol: float = 1e-9) -> np.ndarray:
    """A non-negative image whose starlet coefficients agree best, in squares, with the significant ones, by conjugate gradients."""
    level = len(coefs) - 1

    def back(w: np.ndarray) -> np.ndarray:
        """The transpose of the masked transform, whose filters are symmetric but for the edges."""
        out = np.zeros(w.shape[1:])
        for j in range(level + 1):
            y = w[j] * supp[j]
            for i in range(j):
                y = smooth2d(y, 2**i)
            out += y - smooth2d(y, 2**j) if j < level else y
        return out

    x = (coefs * supp).sum(0)
    r = back(coefs - starlet2d(x, level))
    d, size = r.copy(), (r**2).sum()
    first = size
    for _ in range(rounds):
        if size <= tol * first:
            break
        q = back(starlet2d(d, level))
        a = size / max((d * q).sum(), 1e-300)
        x, r = x + a * d, r - a * q
        size, before = (r**2).sum(), size
        d = r + size / before * d
    return np.maximum(x, 0)
