"""Functional maps: a number per pixel from its trace, another signal, or its neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import AXIS, spread
from .window import dfosd

PIXEL = ["row", "col"]


def pearson(a: str, b: str) -> Column:
    """Pearson's r; null where a side does not vary."""
    a_, b_ = F.col(a).cast("double"), F.col(b).cast("double")
    return F.try_divide(F.covar_pop(a_, b_), F.stddev_pop(a_) * F.stddev_pop(b_))


def _rank(value: str, keys: list[str]) -> Column:
    """Average rank of a value in its trace."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(w) + (ties - 1) / 2


def xcorrmap(cells: DataFrame, signal: DataFrame, how: str | Callable[[Column, Column], Column] = "pearson", norm: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per pixel, the correlation with `signal` (t, s): pearson, spearman, the raw dot product, or a function of the two columns
    that gives an aggregate.  `norm` is a function of the cells that is applied first."""
    both = (norm(cells) if norm else cells).join(signal, "t")
    if how == "spearman":
        both = both.withColumns({"value": _rank("value", PIXEL), "s": _rank("s", PIXEL)})
    if callable(how):
        score = how(F.col("value"), F.col("s"))
    else:
        score = F.sum(F.col("value") * F.col("s")) if how == "dot" else pearson("value", "s")
    return both.groupBy(*PIXEL).agg(score.alias("value"))


def tanh_step(n: int, start: int, stop: int, slope: float = 1.0) -> list[float]:
    """A smooth pulse from start to stop, without its mean."""
    t = np.arange(n)
    s = 0.5 * (1 + np.tanh((t - start) / slope) * np.tanh((stop - t) / slope))
    return (s - s.mean()).tolist()


def actcorrmap(cells: DataFrame, n: int, start: int, stop: int) -> DataFrame:
    """Correlation with activity between two frames."""
    signal = cells.sparkSession.createDataFrame(list(enumerate(tanh_step(n, start, stop))), "t long, s double")
    return xcorrmap(cells, signal)


def meanactmap(cells: DataFrame, start: int, stop: int, n: int) -> DataFrame:
    """Mean of the baseline-normalised value strictly between two frames."""
    d = dfosd(cells, PIXEL, n)
    return d.filter((F.col("t") > start) & (F.col("t") < stop)).groupBy(*PIXEL).agg(F.avg("value").alias("value"))


def _neighbours(cells: DataFrame) -> DataFrame:
    """(t, row, col, value, row0, col0): a cell's value sent to each axis neighbour."""
    far = spread(cells.select("t", "row", "col", F.col("row").alias("row0"), F.col("col").alias("col0"), F.col("value").alias("other")), AXIS)
    return cells.join(far, ["t", "row", "col"])


def local_corr_map(cells: DataFrame, how: str = "dot") -> DataFrame:
    """Mean over the axis neighbours of the dot product, or of Pearson's r, of the traces."""
    one = F.sum(F.col("value") * F.col("other")) if how == "dot" else pearson("value", "other")
    return _neighbours(cells).groupBy(*PIXEL, "row0", "col0").agg(one.alias("c")).groupBy(*PIXEL).agg(F.avg("c").alias("value"))


def local_coherence(cells: DataFrame) -> DataFrame:
    """Mean over the axis neighbours of the share of frames where both are on one side of their means."""
    c = cells.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*PIXEL)))
    same = F.avg(F.when(F.col("value") * F.col("other") > 0, 1.0).otherwise(0.0))
    return _neighbours(c).groupBy(*PIXEL, "row0", "col0").agg(same.alias("c")).groupBy(*PIXEL).agg(F.avg("c").alias("value"))


def corr_lag(cells: DataFrame, signal: DataFrame, most: int) -> DataFrame:
    """Per pixel, the lag up to `most` of the greatest cross-correlation with `signal`; the first of equal ones."""
    lagged = signal.select(F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "t", "s").select("lag", (F.col("t") + F.col("lag")).alias("t"), "s")
    c = cells.join(lagged, "t").groupBy(*PIXEL, "lag").agg(F.sum(F.col("value") * F.col("s")).alias("c"))
    return c.groupBy(*PIXEL).agg(F.max(F.struct("c", (-F.col("lag")).alias("m"))).alias("b")).select(*PIXEL, (-F.col("b.m")).cast("long").alias("lag"))


def band_power(cells: DataFrame, n: int, low: float, high: float) -> DataFrame:
    """Per pixel, the mean over frequencies k / n in [low, high) of |DFT of the centred trace|^2.

    The few frequencies of the band are counted out beside each value, and their sums are partial aggregates.
    """
    ks = [k for k in range(n // 2 + 1) if low <= k / n < high]
    c = cells.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*PIXEL)))
    x = c.select(*PIXEL, "t", "value", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    arg = F.col("k") * F.col("t") * F.lit(2 * np.pi / n)
    p = x.groupBy(*PIXEL, "k").agg(F.sum(F.col("value") * F.cos(arg)).alias("re"), F.sum(F.col("value") * F.sin(arg)).alias("im"))
    return p.groupBy(*PIXEL).agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("value"))


def roi_matrix(traces: DataFrame) -> DataFrame:
    """(a, b, r): Pearson's r of each pair of tagged traces (tag, t, value), lower triangle.

    Regions of interest are drawn by hand, so pairs are few; both sides meet on t.
    """
    o = traces.select("t", F.col("tag").alias("b"), F.col("value").alias("v"))
    return traces.join(o, "t").filter(F.col("tag") > F.col("b")).groupBy(F.col("tag").alias("a"), "b").agg(pearson("value", "v").alias("r"))


def morlet(v: np.ndarray, freqs: np.ndarray, dt: float = 1.0, omega: float = 6.0) -> np.ndarray:
    """Energy of the continuous Morlet transform, (frequency, t), by FFT; L2-normalised wavelets."""
    n = len(v)
    w = 2 * np.pi * np.fft.fftfreq(n, dt)
    spec = np.fft.fft(v - v.mean())
    scale = (omega / (2 * np.pi * freqs))[:, None]
    psi = np.pi**-0.25 * np.sqrt(2 * np.pi * scale / dt) * np.exp(-0.5 * (scale * w[None] - omega) ** 2) * (w[None] > 0)
    return np.abs(np.fft.ifft(spec[None] * psi, axis=1)) ** 2


def map_traces(traces: DataFrame, fn, schema: str) -> DataFrame:
    """`fn(v)` yields result tuples for each (row, col); traces are independent, so no shuffle."""
    names = ["row", "col", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r, c, *x) for r, c, v in zip(b["row"], b["col"], b["v"], strict=True) for x in fn(np.asarray(v, float))], columns=names)

    return traces.select("row", "col", "v").mapInPandas(run, f"row int, col int, {schema}")


def cwt_map(traces: DataFrame, freqs: list[float], start: int, stop: int) -> DataFrame:
    """Per pixel, mean wavelet energy over the frequencies in a time window."""
    f = np.array(freqs)
    return map_traces(traces, lambda v: [(float(morlet(v, f)[:, start:stop].mean()),)], "value double")


def cwt_freqmap(traces: DataFrame, freqs: list[float], start: int, stop: int) -> DataFrame:
    """Per pixel, the frequency of greatest mean energy, linearly detrended over frequencies; null where it is under 1e-7."""
    f = np.array(freqs)

    def one(v: np.ndarray):
        e = morlet(v, f)[:, start:stop].mean(1)
        d = e - np.polyval(np.polyfit(f, e, 1), f)
        yield (float(f[d.argmax()]) if d.max() >= 1e-7 else None,)

    return map_traces(traces, one, "value double")


def avg_energy(traces: DataFrame, freqs: list[float]) -> DataFrame:
    """(freq, t, value): the energy surface averaged over pixels; partial sums per batch, so little is shuffled."""
    f = np.array(freqs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                e = sum(morlet(np.asarray(v, float), f) for v in b["v"])
                k, t = np.indices(e.shape)
                yield pd.DataFrame({"freq": f[k.ravel()], "t": t.ravel(), "s": e.ravel(), "n": len(b)})

    return traces.select("v").mapInPandas(run, "freq double, t long, s double, n long").groupBy("freq", "t").agg((F.sum("s") / F.sum("n")).alias("value"))


def spectra(traces: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, k, power): power of the discrete Fourier transform of traces of n samples less their mean, for k from 1 to n / 2.

    A sample is met with each frequency, so this is for the traces of regions, not for all pixels.
    """
    mean = F.avg("value").over(Window.partitionBy(*keys))
    x = traces.withColumn("_v", F.col("value") - mean).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n // 2))))
    turn = F.lit(2 * np.pi / n) * F.col("k") * F.col("t")
    parts = x.groupBy(*keys, "k").agg(F.sum(F.col("_v") * F.cos(turn)).alias("_c"), F.sum(F.col("_v") * F.sin(turn)).alias("_s"))
    return parts.select(*keys, "k", (F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")).alias("power"))


def spectrograms(traces: DataFrame, keys: list[str], size: int, step: int) -> DataFrame:
    """(keys, part, k, power): spectra of whole windows of `size` samples that begin at multiples of `step`."""
    reach = -(-size // step)
    x = traces.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach - 1)), lambda j: F.floor(F.col("t") / step) - j)))
    x = x.withColumn("t", F.col("t") - F.col("part") * step).filter((F.col("part") >= 0) & (F.col("t") < size))
    whole = x.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "part"))).filter(F.col("_n") == size).drop("_n")
    return spectra(whole, [*keys, "part"], size)
