"""Thresholds and masks.  The scalar a threshold needs is one aggregated row, joined as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import quantiles


def _with_scalars(img: DataFrame, **aggs: Column) -> DataFrame:
    return img.crossJoin(F.broadcast(img.agg(*[a.alias(k) for k, a in aggs.items()])))  # one row


def threshold(img: DataFrame, th: float) -> DataFrame:
    return img.withColumn("mask", F.col("value") > th)


def percent_threshold(img: DataFrame, p: float) -> DataFrame:
    """Above p percent of the range."""
    return _with_scalars(img, _r=F.max("value") - F.min("value")).withColumn("mask", F.col("value") > F.col("_r") * p / 100).drop("_r")


def num_std(img: DataFrame, n: float) -> DataFrame:
    return _with_scalars(img, _s=F.stddev_pop("value")).withColumn("mask", F.col("value") > n * F.col("_s")).drop("_s")


def median_sd(img: DataFrame, n: float) -> DataFrame:
    middle = F.lit(quantiles(img, [0.5])[0])
    return _with_scalars(img, _s=F.stddev_pop("value")).withColumn("mask", F.col("value") > middle + n * F.col("_s")).drop("_s")


def low_percentile(img: DataFrame, p: float) -> DataFrame:
    return img.withColumn("mask", F.col("value") < F.lit(quantiles(img, [p / 100])[0]))


def invert(mask: DataFrame) -> DataFrame:
    return mask.withColumn("mask", ~F.col("mask"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in either of two masks given as (row, col) sets."""
    return a.select("row", "col").unionByName(b.select("row", "col")).distinct()


def clip_rescale(img: DataFrame, nout: int) -> DataFrame:
    """Values cut at the percentile that leaves `nout` above, over that percentile."""
    total = img.count()
    cut = F.lit(quantiles(img, [max(0.0, 1 - nout / max(total, 1))])[0])
    return img.withColumn("value", F.try_divide(F.least("value", cut), cut))


def rescale(img: DataFrame) -> DataFrame:
    """To 0 ... 1."""
    return _with_scalars(img, _a=F.min("value"), _b=F.max("value")).withColumn("value", F.try_divide(F.col("value") - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def zero_where(img: DataFrame, mask: DataFrame) -> DataFrame:
    """0 at the pixels of `mask` (row, col)."""
    m = mask.select("row", "col").distinct().withColumn("_m", F.lit(True))
    return img.join(m, ["row", "col"], "left").withColumn("value", F.when(F.col("_m"), 0.0).otherwise(F.col("value"))).drop("_m")
