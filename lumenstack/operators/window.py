"""Operators along time: windows partitioned by the trace's key, ordered by t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def _all(keys: list[str]) -> Window:
    return Window.partitionBy(*keys)


def dfof(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """value / baseline - 1, the baseline being the mean of t < n; 0 where the baseline is nearly 0."""
    base = F.avg(F.when(F.col("t") < n, F.col("value"))).over(_all(keys))
    return df.withColumn("value", F.when(F.abs(base) >= EPS, F.col("value") / base - 1).otherwise(F.lit(0.0)))


def dfosd(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(value - baseline) / population deviation of the baseline; 0 where that is nearly 0."""
    first = F.when(F.col("t") < n, F.col("value"))
    base, sd = F.avg(first).over(_all(keys)), F.stddev_pop(first).over(_all(keys))
    return df.withColumn("value", F.when(F.abs(sd) > EPS, (F.col("value") - base) / sd).otherwise(F.lit(0.0)))


def over_mean_frame(cells: DataFrame) -> DataFrame:
    """value / (mean of its pixel) - 1; null where that mean is 0."""
    return cells.withColumn("value", F.try_divide(F.col("value"), F.avg("value").over(_all(["row", "col"]))) - 1)


def limit_bounds(df: DataFrame, low: float | None = None, high: float | None = None, value: str = "value") -> DataFrame:
    """Rows within the bounds, both included; a bound of 0 is one too."""
    for bound, inside in ((low, F.col(value) >= low), (high, F.col(value) <= high)):
        df = df if bound is None else df.filter(inside)
    return df


def moving_average(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean of this and the next n - 1 rows; only whole windows."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, n - 1)
    return df.withColumn("_n", F.count("value").over(w)).withColumn("value", F.avg("value").over(w)).filter(F.col("_n") == n).drop("_n")


def first_difference(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t")
    return df.withColumn("value", F.col("value") - F.lag("value").over(w)).filter(F.col("value").isNotNull())


def chunks(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, chunk, value): means of whole chunks of n frames."""
    out = df.groupBy(*keys, F.floor(F.col("t") / n).cast("long").alias("chunk")).agg(F.count("value").alias("_n"), F.avg("value").alias("value"))
    return out.filter(F.col("_n") == n).drop("_n")


def _fit(df: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Sums for the least-squares polynomial of order 1 or 2 in centred t, by keys."""
    w = _all(keys)
    x, y = F.col("t") - F.avg("t").over(w), F.col("value")
    df = df.withColumn("_x", x)
    sums = {"_n": F.count("value"), **{f"_x{k}": F.sum(F.pow("_x", F.lit(float(k)))) for k in range(2, 2 * order + 1)}, **{f"_y{k}": F.sum(F.pow("_x", F.lit(float(k))) * y) for k in range(order + 1)}}
    return df.withColumns({k: v.over(w) for k, v in sums.items()})


def detrend(df: DataFrame, keys: list[str], order: int = 2) -> DataFrame:
    """value minus its least-squares polynomial in t; closed form from centred moments."""
    f = _fit(df, keys, order)
    c = F.col
    if order == 1:
        trend = c("_y0") / c("_n") + c("_y1") / c("_x2") * c("_x")
    else:
        # Normal equations in centred x: [n 0 s2; 0 s2 s3; s2 s3 s4].
        n, s2, s3, s4, y0, y1, y2 = (c(k).cast("double") for k in ("_n", "_x2", "_x3", "_x4", "_y0", "_y1", "_y2"))
        det = n * (s2 * s4 - s3 * s3) - s2 * s2 * s2
        a = (y0 * (s2 * s4 - s3 * s3) + s2 * (y1 * s3 - s2 * y2)) / det
        b = (n * (y1 * s4 - s3 * y2) - s2 * (s2 * y1 - s3 * y0)) / det
        q = (n * (s2 * y2 - s3 * y1) - s2 * s2 * y0) / det
        trend = a + b * c("_x") + q * c("_x") * c("_x")
    return f.withColumn("value", c("value") - trend).select(*df.columns)


def local_maxima(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows above both neighbours in time."""
    w = Window.partitionBy(*keys).orderBy("t")
    d = df.withColumns({"_a": F.lag("value").over(w), "_b": F.lead("value").over(w)})
    return d.filter((F.col("value") > F.col("_a")) & (F.col("value") > F.col("_b"))).drop("_a", "_b")


def gaussian_baseline(df: DataFrame, keys: list[str], sigma: float, radius: int | None = None) -> DataFrame:
    """`df` with `base`: the mean of the neighbours in t, weighted by exp(-d^2 / 2 sigma^2) and cut at `radius` (4 sigma).

    Neighbours come by lag and lead in one sorted window, with no self-join; weights outside the trace are left out.
    """
    radius = radius or int(4 * sigma + 0.5)
    w = Window.partitionBy(*keys).orderBy("t")
    near = [(F.lit(2.718281828459045 ** (-d * d / (2 * sigma * sigma))), F.lead("value", d).over(w) if d >= 0 else F.lag("value", -d).over(w)) for d in range(-radius, radius + 1)]
    zero = F.lit(0.0)
    top = sum((g * F.coalesce(v, zero) for g, v in near), zero)
    bottom = sum((F.when(v.isNotNull(), g).otherwise(zero) for g, v in near), zero)
    return df.withColumn("base", top / bottom)


def mavg_dfof(df: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """value over its Gaussian-smoothed baseline, minus 1; 0 where the baseline is nearly 0."""
    b = gaussian_baseline(df, keys, sigma)
    return b.withColumn("value", F.when(F.abs("base") >= EPS, F.col("value") / F.col("base") - 1).otherwise(F.lit(0.0))).drop("base")


def mavg_dfosd(df: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """(value - baseline) over the deviation of that; all 0 where the deviation is nearly 0."""
    b = gaussian_baseline(df, keys, sigma).withColumn("_d", F.col("value") - F.col("base"))
    sd = F.stddev_pop("_d").over(_all(keys))
    return b.withColumn("value", F.when(sd >= EPS, F.col("_d") / sd).otherwise(F.lit(0.0))).drop("base", "_d")


def rank_by(df: DataFrame, keys: list[str], by: Column, tie: str) -> DataFrame:
    """1 for the largest; ties to the smaller `tie`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(by.desc(), tie)).cast("long"))
