"""Synthetic signals and movies with known truth; seeded, generated in parallel from `spark.range`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

from ..functions.curves import tanh_spike


def ar1(n: int, alpha: float = 0.74, seed: int = 0) -> np.ndarray:
    e, out = np.random.default_rng(seed).normal(size=n), np.zeros(n)
    for i in range(1, n):
        out[i] = alpha * out[i - 1] + e[i]
    return out


def ar1_traces(spark: SparkSession, count: int, n: int, alpha: float = 0.74, seed: int = 0) -> DataFrame:
    """(row, col, v): independent AR(1) traces, one per row."""
    one = lambda it: (pd.DataFrame({"row": b["id"].astype("int32"), "col": 0, "v": [ar1(n, alpha, seed + int(i)) for i in b["id"]]}) for b in it)
    return spark.range(count).mapInPandas(one, "row int, col int, v array<double>")


def spikes(spark: SparkSession, n: int, at: list[float], tau: float = 10.0) -> DataFrame:
    """(t, value): the sum of spikes at given times."""
    t = F.col("id").cast("double")
    return spark.range(n).select(F.col("id").alias("t"), sum((tanh_spike(t, a, tau=tau) for a in at), F.lit(0.0)).alias("value"))


def regular_spikes(spark: SparkSession, n: int, period: int) -> DataFrame:
    return spikes(spark, n, [float(x) for x in range(period // 2, n, period)])


def gauss_blobs(spark: SparkSession, frames: int, h: int, w: int, centres: list[tuple[float, float, float, float]], velocity: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """cells of Gaussian blobs (row, col, sigma, height) that move by `velocity` a frame."""
    i = F.col("id")
    x = spark.range(frames * h * w).select(F.floor(i / (h * w)).alias("t"), F.floor(F.pmod(i, F.lit(h * w)) / w).cast("int").alias("row"), F.pmod(i, F.lit(w)).cast("int").alias("col"))
    blob = lambda r, c, s, a: a * F.exp(-(F.pow(F.col("row") - r - velocity[0] * F.col("t"), F.lit(2.0)) + F.pow(F.col("col") - c - velocity[1] * F.col("t"), F.lit(2.0))) / (2 * s * s))
    return x.withColumn("value", sum((blob(*c) for c in centres), F.lit(0.0)))


def with_noise(cells: DataFrame, sigma: float, seed: int = 0) -> DataFrame:
    return cells.withColumn("value", F.col("value") + sigma * F.randn(seed))


def movie(spark: SparkSession, frames: int, h: int, w: int, segments: list[tuple[int, int, int, int]], signal: list[float], background: float = 10.0, seed: int = 0) -> DataFrame:
    """frames (t, h, w, data): Poisson counts about a background, raised inside boxes (r0, r1, c0, c1) by the signal of t."""

    def one(it):
        for b in it:
            rows = []
            for t in b["id"]:
                m = np.full((h, w), background)
                for r0, r1, c0, c1 in segments:
                    m[r0:r1, c0:c1] += background * signal[t]
                rows.append((t, h, w, np.random.default_rng([seed, int(t)]).poisson(m).astype(float).ravel()))
            yield pd.DataFrame(rows, columns=["t", "h", "w", "data"])

    return spark.range(frames).mapInPandas(one, "t long, h int, w int, data array<double>")


def vessel(spark: SparkSession, n: int, width: int, lower: float, upper: float, seed: int = 0) -> DataFrame:
    """(seq, t, v): a bright vessel between two wandering walls, one row of pixels for each t."""
    a, b = lower + 0.3 * ar1(n, 0.9, seed), upper + 0.3 * ar1(n, 0.9, seed + 1)
    x = np.arange(width)
    rows = [(0, t, (1 / (1 + np.exp(-(x - a[t]))) - 1 / (1 + np.exp(-(x - b[t])))).tolist()) for t in range(n)]
    return spark.createDataFrame(rows, "seq int, t long, v array<double>")


def noise_levels(spark: SparkSession, level: int, n: int = 1024, repeats: int = 64, seed: int = 0) -> DataFrame:
    """(level, sigma): the mean deviation of each level's coefficients for unit white noise, one dimension."""
    from ..operators.wavelet import coefficients, decompose1d

    one = lambda it: (pd.DataFrame({"row": b["id"].astype("int32"), "col": 0, "v": [np.random.default_rng([seed, int(i)]).normal(size=n) for i in b["id"]]}) for b in it)
    x = spark.range(repeats).mapInPandas(one, "row int, col int, v array<double>")
    c = coefficients(decompose1d(x, level, n), level, ["row"]).filter(F.col("level") < level)
    return c.groupBy("level", "row").agg(F.stddev_pop("value").alias("s")).groupBy("level").agg(F.avg("s").alias("sigma"))


def noise_table(spark: SparkSession, level: int, size: tuple[int, ...] = (256, 256), repeats: int = 64, seed: int = 0, transform: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """(level, sigma): the same for arrays of any number of dimensions, and any transform to details and an approximation (the starlet).

    A task draws and transforms one array after another; only a deviation for each level leaves it.
    """
    from ..operators.wavelet import starlet

    make = transform or starlet

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(j, float(w.std())) for i in b["id"] for j, w in enumerate(make(np.random.default_rng([seed, int(i)]).normal(size=size), level)[:-1])]
            yield pd.DataFrame(rows, columns=["level", "s"])

    ship(spark)
    return spark.range(repeats).mapInPandas(run, "level long, s double").groupBy("level").agg(F.avg("s").alias("sigma"))
