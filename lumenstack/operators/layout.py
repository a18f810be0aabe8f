"""The three layouts of a frame sequence, and the conversions between them.

cells   (t, row, col, value), or with further key columns: one row per value; every relational operator works on it
traces  (row, col, v array<double>): one row per pixel, values in order of t
frames  (t, h, w, data array<double>): one row per frame, row-major
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def densify(cells: DataFrame, frames: int, h: int, w: int, fill: float = 0.0) -> DataFrame:
    """Every (t, row, col) of the grid, `fill` where `cells` has none; the grid is counted out, not joined."""
    i, size = F.col("id"), h * w
    grid = cells.sparkSession.range(frames * size).select(F.floor(i / size).alias("t"), F.floor(F.pmod(i, F.lit(size)) / w).cast("int").alias("row"), F.pmod(i, F.lit(w)).cast("int").alias("col"))
    return grid.join(cells, ["t", "row", "col"], "left").select("t", "row", "col", F.coalesce("value", F.lit(fill)).alias("value"))


def to_traces(cells: DataFrame) -> DataFrame:
    return cells.groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("v"))


def to_frames(cells: DataFrame, fill: float | None = None) -> DataFrame:
    """Frames as high and wide as their cells reach.  A frame that misses cells gets `fill` there, or is an error without one."""
    one = F.collect_list(F.struct("row", "col", "value"))
    g = cells.groupBy("t").agg((F.max("row") + 1).cast("int").alias("h"), (F.max("col") + 1).cast("int").alias("w"), one.alias("_c"))
    size = (F.col("h") * F.col("w")).cast("long")
    place = lambda x: (x["row"] * F.col("w") + x["col"]).cast("long")
    if fill is None:
        held = F.when(F.size("_c") == size, F.col("_c")).otherwise(F.raise_error(F.concat(F.lit("frame misses cells, or has some twice: "), F.col("t").cast("string"))))
        return g.select("t", "h", "w", F.transform(F.array_sort(held), lambda x: x["value"]).alias("data"))
    there = F.transform("_c", lambda x: F.struct(place(x).alias("i"), x["value"].cast("double").alias("value")))
    gone = F.array_except(F.sequence(F.lit(0).cast("long"), size - 1), F.transform("_c", place))
    filled = F.concat(there, F.transform(gone, lambda i: F.struct(i.alias("i"), F.lit(float(fill)).alias("value"))))
    return g.select("t", "h", "w", F.transform(F.array_sort(filled), lambda x: x["value"]).alias("data"))


def shuffled(traces: DataFrame, seed: int = 0) -> DataFrame:
    """Traces in a random order of pixels, the same for one seed: a sort by hash, over all tasks."""
    return traces.orderBy(F.xxhash64(F.lit(seed), "row", "col"), "row", "col")


def traces_to_cells(traces: DataFrame) -> DataFrame:
    return traces.select(F.posexplode("v").alias("_t", "value"), "row", "col").select(F.col("_t").cast("long").alias("t"), "row", "col", "value")


def frames_to_cells(frames: DataFrame) -> DataFrame:
    x = frames.select("t", "w", F.posexplode("data").alias("i", "value"))
    return x.select("t", F.floor(F.col("i") / F.col("w")).cast("int").alias("row"), F.pmod("i", "w").cast("int").alias("col"), "value")


def crop(cells: DataFrame, t=None, rows=None, cols=None, step: int = 1) -> DataFrame:
    """Half-open ranges (start, stop) of frames, rows and columns; every `step`-th frame.  All reach the scan as filters."""
    for name, r in (("t", t), ("row", rows), ("col", cols)):
        if r is not None:
            cells = cells.filter((F.col(name) >= r[0]) & (F.col(name) < r[1]))
    return cells if step == 1 else cells.filter((F.col("t") - (t[0] if t else 0)) % step == 0)


def take(cells: DataFrame, n: int, step: int = 1) -> DataFrame:
    """Every `step`-th of the first n frames."""
    return crop(cells, (0, n), step=step)


def flip(cells: DataFrame, h: int | None = None, w: int | None = None) -> DataFrame:
    """Upside down if the height is given, left to right if the width is."""
    row = (F.lit(h - 1) - F.col("row")).cast("int") if h else F.col("row")
    col = (F.lit(w - 1) - F.col("col")).cast("int") if w else F.col("col")
    return cells.withColumns({"row": row, "col": col})


def concat(sequences: list[DataFrame]) -> DataFrame:
    """Sequences one after the other in time; t goes on from the largest of those before."""
    out, start = None, 0
    for s in sequences:
        moved = s.withColumn("t", F.col("t") + start)
        out = moved if out is None else out.unionByName(moved)
        last = s.agg(F.max("t")).first()[0]
        start += 0 if last is None else last + 1
    return out


def times(cells: DataFrame, scale: float, units: str) -> DataFrame:
    """`ts` of each frame: t times the scale, or t itself where there is no unit."""
    return cells.withColumn("ts", F.col("t") * F.lit(1.0 if units == "" else scale))
