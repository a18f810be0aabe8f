"""The multiscale vision model as tables: significant structures of wavelet scales, the forest that they make, and its objects.

A node is a connected region of significant coefficients of one scale of a frame.  Its parent is the node one scale up
that covers its maximum.  Nodes and edges are small tables that Spark groups and joins; only the wavelet transform, which
needs a whole frame, is a kernel on frames, and it puts out significant coefficients alone.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .spatial import regions
from .wavelet import SIGMA_2D, map_frames, starlet2d


def noise(x: np.ndarray) -> float:
    """The deviation of an image's noise, from the median deviation of its finest details."""
    w = x - starlet2d(x, 1)[-1]
    return float(np.median(np.abs(w - np.median(w))) / (0.6745 * SIGMA_2D[0]))


def significant(frames: DataFrame, level: int, k: float = 3.0) -> DataFrame:
    """(t, level, row, col, value, up): coefficients above k deviations of the noise of their scale; `up` is that of the next scale there."""

    def one(t: int, x: np.ndarray):
        coefs, sigma = starlet2d(x, level), noise(x)
        for j in range(level):
            for r, c in zip(*np.nonzero(coefs[j] > k * sigma * SIGMA_2D[j]), strict=True):
                yield t, j, r, c, coefs[j][r, c], coefs[j + 1][r, c]

    return map_frames(frames, one, "t long, level long, row int, col int, value double, up double")


def structures(found: DataFrame, h: int, w: int) -> DataFrame:
    """`found` with region: the connected regions of each scale of each frame, named by their least pixel number."""
    levels = 32
    both = found.withColumn("_u", F.col("t") * levels + F.col("level"))
    named = regions(both.select(F.col("_u").alias("t"), "row", "col"), h, w).withColumnRenamed("t", "_u")
    return both.join(named, ["_u", "row", "col"]).select(*found.columns, "region")


def nodes(labelled: DataFrame) -> DataFrame:
    """(t, level, region, mass, peak, peak_row, peak_col, coarser, parent): a row for each structure.

    The first of equal maxima in raster order is the peak; coarser is the greatest coefficient of the next scale under the
    structure; parent is a region of the next level, null for roots.
    """
    first = F.max(F.struct("value", (-F.col("row")).alias("r"), (-F.col("col")).alias("c")))
    n = labelled.groupBy("t", "level", "region").agg(F.count(F.lit(1)).alias("mass"), first.alias("p"), F.max("up").alias("coarser"))
    n = n.select("t", "level", "region", "mass", F.col("p.value").alias("peak"), (-F.col("p.r")).alias("peak_row"), (-F.col("p.c")).alias("peak_col"), "coarser")
    over = labelled.select("t", (F.col("level") - 1).alias("level"), F.col("row").alias("peak_row"), F.col("col").alias("peak_col"), F.col("region").alias("parent"))
    return n.join(over, ["t", "level", "peak_row", "peak_col"], "left").select("t", "level", "region", "mass", "peak", "peak_row", "peak_col", "coarser", "parent")


def rooted(forest: DataFrame, levels: int) -> DataFrame:
    """`forest` (t, level, region, parent, ...) with root_level and root: each node jumps to its parent's parent until all are at roots."""
    now = forest.withColumns({"root_level": F.when(F.col("parent").isNotNull(), F.col("level") + 1).otherwise(F.col("level")), "root": F.coalesce("parent", "region")})
    for _ in range(max(0, math.ceil(math.log2(max(1, levels - 1))))):  # a tree has at most one node more on its way up than scales
        up = now.select("t", F.col("level").alias("root_level"), F.col("region").alias("root"), F.col("root_level").alias("_l"), F.col("root").alias("_r"))
        now = now.join(up, ["t", "root_level", "root"]).withColumns({"root_level": F.col("_l"), "root": F.col("_r")}).drop("_l", "_r")
    return now.select(*forest.columns, "root_level", "root")


ROOT = ["t", "root_level", "root"]


def trees(held: DataFrame, labelled: DataFrame) -> DataFrame:
    """(t, root_level, root, tree_mass, n_nodes, n_scales, n_locations) of a rooted forest: pixels with and without those that scales share."""
    sums = held.groupBy(*ROOT).agg(F.sum("mass").alias("tree_mass"), F.count(F.lit(1)).alias("n_nodes"), (F.max("level") - F.min("level") + 1).alias("n_scales"))
    places = members(held, labelled).select(*ROOT, "row", "col").distinct().groupBy(*ROOT).agg(F.count(F.lit(1)).alias("n_locations"))
    return sums.join(places, ROOT)


def members(held: DataFrame, labelled: DataFrame) -> DataFrame:
    """The labelled pixels with the root of their structure."""
    return labelled.join(held.select("t", "level", "region", "root_level", "root"), ["t", "level", "region"])


def connected(held: DataFrame, min_scales: int) -> DataFrame:
    """The trees of a rooted forest that have more than a root, and structures at `min_scales` scales at least."""
    good = held.groupBy(*ROOT).agg(F.count(F.lit(1)).alias("_n"), (F.max("level") - F.min("level") + 1).alias("_s")).filter((F.col("_n") > 1) & (F.col("_s") >= min_scales))
    return held.join(good.select(*ROOT), ROOT, "left_semi")


def deblend(held: DataFrame, levels: int, min_scales: int = 2) -> DataFrame:
    """The rooted forest with branches cut that are objects of their own, and `cut` for those, without trees of fewer scales.

    A branch is cut where it has siblings and its maximum is above that of its nearest branch (0 without one) and above all
    coefficients of the next scale under it.  What a branch has is judged before any cut, so cuts do not depend on one
    another, and one join decides all of them.
    """
    forest = held.drop("root_level", "root")
    kids = forest.filter(F.col("parent").isNotNull()).select("t", (F.col("level") + 1).alias("level"), F.col("parent").alias("region"), F.col("region").alias("_kid"), F.col("peak").alias("_peak"), F.col("peak_row").alias("_row"), F.col("peak_col").alias("_col"))
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    near = forest.select("t", "level", "region", "peak_row", "peak_col").join(kids, ["t", "level", "region"])
    finer = near.groupBy("t", "level", "region").agg(F.min_by("_peak", F.struct(square("peak_row", "_row") + square("peak_col", "_col"), "_kid")).alias("_finer"))
    siblings = F.count("parent").over(Window.partitionBy("t", "level", "parent"))
    judged = forest.join(finer, ["t", "level", "region"], "left").withColumn("_n", siblings)
    cut = F.col("parent").isNotNull() & (F.col("_n") > 1) & (F.col("peak") > F.coalesce("_finer", F.lit(0.0))) & (F.col("peak") > F.col("coarser"))
    free = judged.withColumn("cut", cut).withColumn("parent", F.when(~F.col("cut"), F.col("parent"))).drop("_finer", "_n")
    out = rooted(free, levels)
    many = out.groupBy(*ROOT).agg((F.max("level") - F.min("level") + 1).alias("_s")).filter(F.col("_s") >= min_scales)
    return out.join(many.select(*ROOT), ROOT, "left_semi")


def objects_of(held: DataFrame, labelled: DataFrame, min_pixels: int) -> DataFrame:
    """(t, obj, row, col, value): each tree rebuilt from the coefficients of its structures but for those of the finest scale.

    Trees of more than `min_pixels` places count, and objects of more than `min_pixels` pixels above 0 are left; obj numbers
    a frame's trees by mass, the heaviest first.
    """
    big = trees(held, labelled).filter(F.col("n_locations") > min_pixels)
    image = members(held, labelled).filter("level > 0").groupBy(*ROOT, "row", "col").agg(F.sum("value").alias("value")).filter("value > 0")
    whole = image.groupBy(*ROOT).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_pixels)
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("tree_mass"), F.desc("root_level"), "root")) - 1
    named = big.join(whole, ROOT).withColumn("obj", rank.cast("long")).select(*ROOT, "obj")
    return image.join(named, ROOT).select("t", "obj", "row", "col", "value")


def find_objects(frames: DataFrame, level: int = 4, k: float = 3.0, min_scales: int = 2, min_pixels: int = 4, deblended: bool = True) -> DataFrame:
    """(t, obj, row, col, value): the non-zero pixels of each frame's objects; frames are independent."""
    size = frames.agg(F.max("h"), F.max("w")).first()
    labelled = written(structures(significant(frames, level, k), size[0] or 1, size[1] or 1), "structures")
    held = connected(rooted(nodes(labelled), level), min_scales)
    held = written(deblend(held, level, min_scales) if deblended else held, "forest")
    return objects_of(held, labelled, min_pixels)
