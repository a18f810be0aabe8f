"""Decompositions of points (id, x array<double>): the Gram matrix is one aggregate, small algebra stays on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, population covariance): one d x d partial sum per batch of rows, added up by position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()).astype(float)
                flat = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                yield pd.DataFrame({"i": range(len(flat)), "s": flat})

    got = points.select("x").mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()["s"].to_numpy()
    if not len(got):
        raise ValueError("no points")
    n = int(got[0])
    d = int((-1 + np.sqrt(1 + 4 * (len(got) - 1))) / 2)
    mean = got[1 : d + 1] / n
    return n, mean, got[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)


def pca(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes as rows, variances), largest first; an axis's largest component is positive."""
    _, mean, cov = moments(points)
    s, v = np.linalg.eigh(cov)
    axes = v[:, ::-1][:, :k].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return mean, axes, s[::-1][:k]


def project(points: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """`points` with p, the coordinates along the axes; expressions only."""
    ax = F.array(*[F.array(*map(F.lit, a.tolist())) for a in axes])
    centred = F.zip_with("x", F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b)
    return points.withColumn("_c", centred).withColumn("p", F.transform(ax, lambda a: F.aggregate(F.zip_with(a, "_c", lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x))).drop("_c")


def whitening(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    mean, axes, var = pca(points, k)
    return mean, axes / np.sqrt(np.maximum(var, 1e-12))[:, None]


def _decorrelate(b: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(b @ b.T)
    return u @ np.diag(1 / np.sqrt(np.maximum(s, 1e-18))) @ u.T @ b


def fastica(points: DataFrame, k: int, rounds: int = 100, tol: float = 1e-6, g: str = "cube", seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, unmixing rows) by symmetric FastICA; each iteration is one k x k aggregate over the whitened points."""
    mean, white = whitening(points, k)
    b = _decorrelate(np.random.default_rng(seed).normal(size=(k, k)))

    def sums(b: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    z = (np.stack(x["x"].to_numpy()).astype(float) - mean) @ white.T
                    y = z @ b.T
                    f, df = (y**3, 3 * y**2) if g == "cube" else (np.tanh(y), 1 - np.tanh(y) ** 2)
                    flat = np.concatenate([[len(z)], df.sum(0), (f.T @ z).ravel()])
                    yield pd.DataFrame({"i": range(len(flat)), "s": flat})

        return points.select("x").mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()["s"].to_numpy()

    for _ in range(rounds):
        s = sums(b)
        new = _decorrelate(s[k + 1 :].reshape(k, k) / s[0] - (s[1 : k + 1] / s[0])[:, None] * b)
        done = np.abs(np.abs((new * b).sum(1)) - 1).max() < tol
        b = new
        if done:
            break
    return mean, b @ white


def pca_points(points: DataFrame) -> DataFrame:
    """(angle, major, minor) of points (x, y): the axes of their covariance in closed form; angle in degrees."""
    m = points.agg(F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    half = F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2.0)) + F.col("xy") * F.col("xy"))
    mid = (F.col("xx") + F.col("yy")) / 2
    return m.select(F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2).alias("angle"), (mid + half).alias("major"), (mid - half).alias("minor"))


def jpca(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(skew matrix, its rotation frequencies) of dU = U M for points ordered by id, least squares over M = -M'."""
    mean, axes, _ = pca(points, k)
    u = project(points, mean, axes).select("id", F.col("p"))
    later = u.select((F.col("id") - 1).alias("id"), F.col("p").alias("q"))
    pair = u.join(later, "id").select(F.concat("p", F.zip_with("q", "p", lambda a, b: a - b)).alias("x"))
    n, m, cov = moments(pair)
    second = cov + np.outer(m, m)
    a, c = second[:k, :k], second[:k, k:]
    idx = [(i, j) for i in range(k) for j in range(i)]
    basis = []
    for i, j in idx:
        e = np.zeros((k, k))
        e[i, j], e[j, i] = 1, -1
        basis.append(e)
    lhs = np.array([[np.trace(p.T @ a @ q) for q in basis] for p in basis])
    coef = np.linalg.solve(lhs, np.array([np.trace(p.T @ c) for p in basis]))
    skew = sum(w * e for w, e in zip(coef, basis, strict=True))
    return skew, np.sort(np.abs(np.linalg.eigvals(skew).imag))[::-1]


def spatiotemporal_ica(traces: DataFrame, k: int, mu: float = 0.5, rounds: int = 100) -> tuple[DataFrame, np.ndarray]:
    """(traces with p, time courses): components independent over pixels (1 - mu) and over time (mu) together.

    Traces (row, col, v) are reduced to k axes; space stays distributed, the time courses are k rows.  Components are
    ordered by the size of their skewness, which is made positive.
    """
    pts = traces.select(F.struct("row", "col").alias("id"), "row", "col", F.col("v").alias("x"))
    mean, axes, var = pca(pts, k)
    space = project(pts, mean, axes).withColumn("x", F.transform("p", lambda v: v)).drop("p")
    scale = np.sqrt(np.maximum(var, 1e-12))
    time = axes / axes.std(1, keepdims=True)
    weight = np.sqrt(1 - 2 * mu + 2 * mu * mu)
    b = _decorrelate(np.random.default_rng(0).normal(size=(k, k)))

    def sums(b: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                if len(x):
                    z = (1 - mu) / weight * np.stack(x["x"].to_numpy()).astype(float) / scale
                    y = z @ b.T
                    flat = np.concatenate([[len(z)], (3 * y**2).sum(0), (y**3).T.dot(z).ravel()])
                    yield pd.DataFrame({"i": range(len(flat)), "s": flat})

        return space.select("x").mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()["s"].to_numpy()

    t = mu / weight * time.T
    for _ in range(rounds):
        s, y = sums(b), t @ b.T
        n = s[0] + len(t)
        new = _decorrelate((s[k + 1 :].reshape(k, k) + (y**3).T @ t) / n - ((s[1 : k + 1] + (3 * y**2).sum(0)) / n)[:, None] * b)
        done = np.abs(np.abs((new * b).sum(1)) - 1).max() < 1e-6
        b = new
        if done:
            break
    out = project(space, np.zeros(k), b / scale).select("row", "col", "p")
    skew = np.array(out.select(*[F.skewness(F.element_at("p", i + 1)) for i in range(k)]).first())
    order = np.argsort(-np.abs(skew), kind="stable")
    turn = F.array(*[F.element_at("p", int(i) + 1) * float(np.sign(skew[i]) or 1) for i in order])
    return out.withColumn("p", turn), (b @ time)[order] * np.sign(skew[order])[:, None]
