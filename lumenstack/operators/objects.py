"""Objects of the multiscale vision model, which `forest` finds frame by frame, linked over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forest import find_objects
from .graph import connected_components, written

__all__ = ["find_objects", "link_frames", "linked_objects", "object_stats"]


def link_frames(objects: DataFrame, ahead: int = 3) -> DataFrame:
    """(t, obj, t2, obj2): each object to the objects it overlaps in the first of the next frames that has any.

    An object reached from several keeps the one whose maximum is nearest, then the earlier and smaller-numbered one.
    """
    o = objects.select("t", "obj", "row", "col")
    steps = o.select(F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("lag"), "t", "obj", "row", "col").withColumn("t2", F.col("t") + F.col("lag"))
    there = o.select(F.col("t").alias("t2"), F.col("obj").alias("obj2"), "row", "col")
    hits = steps.join(there, ["t2", "row", "col"]).select("t", "obj", "lag", "t2", "obj2").distinct()
    first = hits.withColumn("_r", F.rank().over(Window.partitionBy("t", "obj").orderBy("lag"))).filter("_r = 1").drop("_r")
    peak = objects.groupBy("t", "obj").agg(F.max(F.struct("value", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("p")).select("t", "obj", (-F.col("p.r")).alias("pr"), (-F.col("p.c")).alias("pc"))
    other = peak.select(F.col("t").alias("t2"), F.col("obj").alias("obj2"), F.col("pr").alias("pr2"), F.col("pc").alias("pc2"))
    near = first.join(peak, ["t", "obj"]).join(other, ["t2", "obj2"])
    d = (F.col("pr") - F.col("pr2")) * (F.col("pr") - F.col("pr2")) + (F.col("pc") - F.col("pc2")) * (F.col("pc") - F.col("pc2"))
    best = Window.partitionBy("t2", "obj2").orderBy(d, "t", "obj")
    return near.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("t", "obj", "t2", "obj2")


def linked_objects(objects: DataFrame, min_frames: int = 5, ahead: int = 3) -> DataFrame:
    """(track, t, obj, first, last) of objects linked over at least `min_frames` frames; tracks are components of the links,
    named by their least object, numbered by frame and then as in it."""
    objects = written(objects, "objects")
    most = (objects.agg(F.max("obj")).first()[0] or 0) + 1
    name = lambda t, o: (F.col(t) * most + F.col(o)).cast("long")
    found = connected_components(link_frames(objects, ahead).select(name("t", "obj").alias("a"), name("t2", "obj2").alias("b")), "tracks")
    x = objects.select("t", "obj").distinct().withColumn("_n", name("t", "obj"))
    x = x.join(found, x["_n"] == found["node"], "left").select("t", "obj", F.coalesce("root", "_n").alias("track"))
    w = Window.partitionBy("track")
    x = x.withColumns({"first": F.min("t").over(w), "last": F.max("t").over(w)})
    return x.filter(F.col("last") - F.col("first") + 1 >= min_frames).select("track", "t", "obj", "first", "last")


def object_stats(objects: DataFrame) -> DataFrame:
    """(t, obj, npixels, energy, density): density is the share of the bounding box that is not 0."""
    box = (F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)
    return objects.groupBy("t", "obj").agg(F.count(F.lit(1)).alias("npixels"), F.sum("value").alias("energy"), (F.count(F.lit(1)) / box).alias("density"))
