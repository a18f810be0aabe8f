"""Aggregates of cells: over all values, per frame, per pixel, inside masks and regions of interest."""

from __future__ import annotations

import bisect
import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

PIXEL = ["row", "col"]
#: Reductions by name; all are partial aggregates, but for the exact percentiles.
REDUCE = {
    "mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop,
    "median": lambda c: F.percentile(c, F.lit(0.5)), "count": F.count,
}


Reduction = str | Callable[[Column], Column]


def reduction(how: Reduction) -> Callable[[Column], Column]:
    """A reduction by its name, or as a function from a column to an aggregate."""
    return how if callable(how) else REDUCE[how]


def mean_frame(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*PIXEL).agg(F.avg("value").alias("value"))


def max_project(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*PIXEL).agg(F.max("value").alias("value"))


def time_project(cells: DataFrame, how: Reduction) -> DataFrame:
    """Any reduction of each pixel's trace, by name or as a function of the column."""
    return cells.groupBy(*PIXEL).agg(reduction(how)(F.col("value")).alias("value"))


def shape(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_distinct("t").alias("n_frames"), (F.max("row") + 1).cast("long").alias("h"), (F.max("col") + 1).cast("long").alias("w"))


def data_range(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("value").alias("low"), F.max("value").alias("high"))


def global_std(cells: DataFrame) -> DataFrame:
    return cells.agg(F.stddev_pop("value").alias("std"))


#: Values that a last round of exact quantiles may fetch.
FETCHED = 65_536


def quantiles(df: DataFrame, qs: list[float], value: str = "value", bins: int = 4096, fetched: int = FETCHED) -> list[float | None]:
    """Exact quantiles of a column, with linear interpolation; nulls and NaN are left out, None where nothing is left.

    Each round counts the values by equal bins of the ranges in which ranks lie, and goes on in their bins, from the least to
    the greatest value there, until these are equal or all that is left in open bins is at most `fetched` values, which are
    fetched.  A round sends `bins` rows for each range that is still open, so no task holds the distinct values; ranges shrink
    by the number of bins, and a few rounds do.  After the first, rounds read a table of the values in open bins alone.
    """
    v = F.col(value).cast("double")
    df = df.filter(v.isNotNull() & ~F.isnan(v)).select(v.alias("_v"))
    n, low, high = df.agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).first()
    if not n:
        return [None] * len(qs)
    ranks = {r for q in qs for r in (int(q * (n - 1)), min(n - 1, int(q * (n - 1)) + 1))}
    open_, found, held = {r: (low, high, 0, n) for r in ranks}, {}, []  # rank: the range it lies in, and how many values are below that and in it
    for round_ in itertools.count():
        for r in [r for r, (a, b, _, _) in open_.items() if a == b]:
            found[r] = open_.pop(r)[0]
        if not open_:
            break
        spans = sorted({(a, b, m) for a, b, _, m in open_.values()})
        inside = functools.reduce(lambda x, y: x | y, [(F.col("_v") >= a) & (F.col("_v") <= b) for a, b, _ in spans])
        x = df.filter(inside)
        if sum(m for _, _, m in spans) <= fetched:
            left = sorted(r[0] for r in x.collect())
            for r, (a, _, below, _) in open_.items():
                found[r] = left[bisect.bisect_left(left, a) + r - below]
            break
        if round_ == 1:
            df = x = written(x, "open-bins", held)
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b, _) in enumerate(spans)])
        # Ranges do not overlap, so a value has one.
        x = x.select("_v", F.filter(each, lambda s: (F.col("_v") >= s["a"]) & (F.col("_v") <= s["b"]))[0].alias("s"))
        # Halves, as the range itself may be beyond a double; two bins where it is too small to be halved.
        part = F.try_divide(F.col("_v") / 2 - F.col("s.a") / 2, F.col("s.b") / 2 - F.col("s.a") / 2) * bins
        k = F.least(F.coalesce(F.floor(part), (F.col("_v") > F.col("s.a")).cast("long") * bins), F.lit(bins - 1))
        rows = sorted(map(tuple, x.groupBy(F.col("s.i").alias("i"), k.alias("k")).agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).collect()))
        for r, (a, b, below, size) in open_.items():
            for i, _, m, first, last in rows:
                if spans[i] == (a, b, size):
                    if r < below + m:
                        open_[r] = (first, last, below, m)
                        break
                    below += m
    out = []
    for q in qs:
        at = int(q * (n - 1))
        a, b = found[at], found[min(n - 1, at + 1)]
        out.append(a + (b - a) * (q * (n - 1) - at))
    return out


def percentiles(cells: DataFrame, ps: list[float]) -> DataFrame:
    """(p, value): exact, with linear interpolation; p in percent."""
    got = quantiles(cells, [p / 100 for p in ps])
    return cells.sparkSession.createDataFrame([(float(p), v) for p, v in zip(ps, got, strict=True)], "p double, value double")


def in_circle(row: Column, col: Column, cx: Column, cy: Column, r: Column) -> Column:
    return (col - cx) * (col - cx) + (row - cy) * (row - cy) <= r * r


def roi_trace(cells: DataFrame, rois: DataFrame) -> DataFrame:
    """(tag, t, value): the mean inside each circle.

    Circles are counted out into the pixels they hold, so that cells meet them in an equi-join on (row, col).
    """
    span = lambda c: F.sequence(F.ceil(F.col(c) - F.col("r")).cast("int"), F.floor(F.col(c) + F.col("r")).cast("int"))
    held = rois.withColumn("row", F.explode(span("cy"))).withColumn("col", F.explode(span("cx"))).filter(in_circle(*map(F.col, ("row", "col", "cx", "cy", "r"))))
    return cells.join(held.select("tag", "row", "col"), PIXEL).groupBy("tag", "t").agg(F.avg("value").alias("value"))


def mask_reduce(cells: DataFrame, mask: DataFrame, how: Reduction = "mean") -> DataFrame:
    """One value per frame, of the pixels in `mask` (row, col)."""
    return cells.join(mask.select(*PIXEL), PIXEL, "left_semi").groupBy("t").agg(reduction(how)(F.col("value")).alias("value"))


def softmask_reduce(cells: DataFrame, weights: DataFrame, how: Reduction = "mean") -> DataFrame:
    """One value per frame, of value * weight where the weight is positive."""
    held = weights.filter("weight > 0").select(*PIXEL, "weight")
    return cells.join(held, PIXEL).groupBy("t").agg(reduction(how)(F.col("value") * F.col("weight")).alias("value"))


def simple_snr(cells: DataFrame) -> DataFrame:
    """Per pixel, the mean above the third quartile over 1 plus the deviation up to the median."""
    cuts = cells.groupBy(*PIXEL).agg(F.percentile("value", F.lit(0.75)).alias("q3"), F.percentile("value", F.lit(0.5)).alias("q2"))
    both = cells.join(cuts, PIXEL)
    up, down = F.when(F.col("value") > F.col("q3"), F.col("value")), F.when(F.col("value") <= F.col("q2"), F.col("value"))
    return both.groupBy(*PIXEL).agg((F.avg(up) / (F.stddev_pop(down) + 1)).alias("value"))


def simple_snr2(cells: DataFrame) -> DataFrame:
    """Per pixel, the larger size of simple_snr of the trace and of its negative, over the mean of that over all pixels."""
    both = simple_snr(cells).join(simple_snr(cells.withColumn("value", -F.col("value"))).withColumnRenamed("value", "_down"), PIXEL)
    both = both.select(*PIXEL, F.greatest(F.abs("value"), F.abs("_down")).alias("value"))
    return both.crossJoin(F.broadcast(both.agg(F.avg("value").alias("_m")))).withColumn("value", F.try_divide("value", "_m")).drop("_m")  # one row


def auto_threshold(cells: DataFrame, rounds: int = 64) -> float:
    """Inter-means threshold: from the median, the mean of the means on both sides, until it stops growing.

    Each round is one aggregate that sends one row.
    """
    t = quantiles(cells, [0.5])[0]
    for _ in range(rounds if t is not None else 0):
        v = F.col("value")
        low, high = cells.agg(F.avg(F.when(v <= t, v)), F.avg(F.when(v > t, v))).first()
        new = t if low is None or high is None else (low + high) / 2
        if new <= t:
            break
        t = new
    return t


def mad(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median absolute deviation from the median, by keys."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    both = df.join(med, keys) if keys else df.crossJoin(F.broadcast(med))  # one row
    return both.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("mad"))
