"""Neighbourhoods of pixels: filters and binary morphology as kernels on frames, regions as components of the pixel graph.

A filter gathers the cells of a frame once, as an image, and works on shifted copies of it; no cell is sent to its neighbours.
Cells that a frame lacks add nothing to a neighbourhood.  Joins between neighbours (`spread`) are for regions and distances,
whose frames may be larger than a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import ship
from .aggregate import Reduction, reduction
from .graph import connected_components, written

CROSS = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
AXIS = CROSS[1:]
SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def spread(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell at all its offsets: what a pixel of the result gathers by grouping."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    x = cells.withColumn("_o", o)
    return x.withColumns({"row": F.col("row") + F.col("_o.i"), "col": F.col("col") + F.col("_o.j")}).drop("_o")


def disc(radius: float) -> list[tuple[int, int]]:
    n = int(radius)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= radius * radius]


def shifts(x: np.ndarray, offsets: list[tuple[int, int]], fill=np.nan) -> np.ndarray:
    """The image at each offset, stacked: what stands at p + offset, `fill` outside."""
    n = max(max(abs(i), abs(j)) for i, j in offsets)
    p = np.pad(x, n, constant_values=fill)
    return np.stack([p[n + i : n + i + x.shape[0], n + j : n + j + x.shape[1]] for i, j in offsets])


def median_of(stack: np.ndarray) -> np.ndarray:
    """Median along the first axis of what is not NaN."""
    s, n = np.sort(stack, 0), (~np.isnan(stack)).sum(0)
    at = lambda k: np.take_along_axis(s, np.maximum(k, 0)[None], 0)[0]
    return (at((n - 1) // 2) + at(n // 2)) / 2


def on_frames(cells: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`cells` with the values of `fn`, which maps the image of a frame (NaN where it has no cell) to one of its shape."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        r, c = (g[k].to_numpy() - g[k].min() for k in ("row", "col"))
        x = np.full((r.max() + 1, c.max() + 1), np.nan)
        x[r, c] = g["value"]
        return g.assign(value=fn(x)[r, c])

    ship(cells.sparkSession)
    return cells.groupBy("t").applyInPandas(one, cells.schema)


def on_masks(mask: DataFrame, reach: int, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(t, row, col) of the pixels that `fn` sets, from the image of the set ones with a margin of `reach`, and its rows and columns."""
    pixels = mask.select("t", "row", "col")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        (r0, c0), (r1, c1) = g[["row", "col"]].min() - reach, g[["row", "col"]].max() + reach
        x = np.zeros((r1 - r0 + 1, c1 - c0 + 1), bool)
        x[g["row"] - r0, g["col"] - c0] = True
        rows, cols = np.arange(r0, r1 + 1)[:, None], np.arange(c0, c1 + 1)[None]
        r, c = np.nonzero(fn(x, rows, cols))
        return pd.DataFrame({"t": g["t"].iloc[0], "row": r + r0, "col": c + c0})

    ship(mask.sparkSession)
    return pixels.groupBy("t").applyInPandas(one, StructType(pixels.schema.fields))


def adaptive_median3(cells: DataFrame, k: float) -> DataFrame:
    """3 x 3 median where the value is further than k deviations from the local mean; the border stays."""

    def one(x: np.ndarray) -> np.ndarray:
        s = shifts(x, SQUARE)
        whole = ~np.isnan(s).any(0)
        far = np.abs(x - s.mean(0)) > k * s.std(0)
        return np.where(whole & far, median_of(s), x)

    return on_frames(cells, one)


def median3(cells: DataFrame) -> DataFrame:
    return on_frames(cells, lambda x: median_of(shifts(x, SQUARE)))


def convolve(cells: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """Weighted sum over offsets, divided by the weights inside the frame."""

    def one(x: np.ndarray) -> np.ndarray:
        there, v = (~np.isnan(x)).astype(float), np.nan_to_num(x)
        n = max(max(abs(i), abs(j)) for i, j in kernel)
        top, bottom = np.zeros_like(v), np.zeros_like(v)
        v, there = np.pad(v, n), np.pad(there, n)
        for (i, j), k in kernel.items():
            part = slice(n + i, n + i + x.shape[0]), slice(n + j, n + j + x.shape[1])
            top += k * v[part]
            bottom += k * there[part]
        return np.divide(top, bottom, out=np.full_like(top, np.nan), where=bottom != 0)

    return on_frames(cells, one)


def gauss_kernel(sigma: float, radius: int | None = None) -> dict[tuple[int, int], float]:
    n = radius if radius is not None else int(3 * sigma + 0.5)
    return {(i, j): 2.718281828459045 ** (-(i * i + j * j) / (2 * sigma * sigma)) for i in range(-n, n + 1) for j in range(-n, n + 1)}


def gauss_blur(cells: DataFrame, sigma: float, radius: int | None = None) -> DataFrame:
    return convolve(cells, gauss_kernel(sigma, radius))


def adaptive_threshold(cells: DataFrame, n: int, k: float) -> DataFrame:
    """(t, row, col, mask): above the mean of the window of radius n, less k; windows end at the frame."""
    means = convolve(cells.select("t", "row", "col", "value", F.col("value").alias("_v")), {(i, j): 1.0 for i in range(-n, n + 1) for j in range(-n, n + 1)})
    return means.select("t", "row", "col", (F.col("_v") > F.col("value") - k).alias("mask"))


def _count(x: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return shifts(x, offsets, False).sum(0)


def majority(mask: DataFrame, least: int = 5) -> DataFrame:
    """Pixels of which `least` of the 3 x 3 are set; mask rows are (t, row, col)."""
    return on_masks(mask, 1, lambda x, r, c: _count(x, SQUARE) >= least)


def density(mask: DataFrame, radius: float, size: int) -> DataFrame:
    """Set pixels with more than `size` set ones within the radius, themselves included."""
    return on_masks(mask, 0, lambda x, r, c: x & (_count(x, disc(radius)) > size))


def _inside(r: np.ndarray, c: np.ndarray, h: int, w: int) -> np.ndarray:
    return (r >= 0) & (r < h) & (c >= 0) & (c < w)


def dilate(mask: DataFrame, h: int, w: int) -> DataFrame:
    return on_masks(mask, 1, lambda x, r, c: (_count(x, CROSS) > 0) & _inside(r, c, h, w))


def erode(mask: DataFrame) -> DataFrame:
    """Pixels whose whole cross is set; outside the frame nothing is."""
    return on_masks(mask, 0, lambda x, r, c: _count(x, CROSS) == len(CROSS))


def opening_of_closing(mask: DataFrame, h: int, w: int) -> DataFrame:
    """Dilation, two erosions and a dilation, in one pass over a frame."""

    def one(x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        inside = _inside(r, c, h, w)
        x = (_count(x, CROSS) > 0) & inside
        for _ in range(2):
            x = _count(x, CROSS) == len(CROSS)
        return (_count(x, CROSS) > 0) & inside

    return on_masks(mask, 2, one)


#: Side of the tiles that are labelled by themselves.
TILE = 256


def label_image(x: np.ndarray, offsets: list[tuple[int, int]] = AXIS) -> np.ndarray:
    """For each set pixel the least raster number of its region, for the others the image's size."""
    size = x.size
    idx = np.where(x, np.arange(size).reshape(x.shape), size)
    while x.any():
        new = np.where(x, np.minimum(idx, shifts(idx, offsets, size).min(0)), size)
        new = np.where(x, np.append(new.ravel(), size)[new], size)  # a pixel's name has a name itself
        if (new == idx).all():
            break
        idx = new
    return idx


def regions(mask: DataFrame, h: int, w: int, offsets: list[tuple[int, int]] = AXIS, tile: int = TILE) -> DataFrame:
    """(t, row, col, region): connected regions of each frame, named by their least pixel number (row * w + col).

    A task labels one tile.  Where frames have several, pixels near a tile's rim meet those of the next one, and only the
    names that meet become nodes of a graph whose components are found over all tiles; so a region may be larger than a
    task, and its inside is never an edge.  `offsets` hold each neighbour with its opposite.
    """
    kinds = dict(mask.dtypes)
    schema = f"t {kinds['t']}, row {kinds['row']}, col {kinds['col']}, region long"
    at = [F.floor(F.col(c) / tile) for c in ("row", "col")]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = g["row"].min(), g["col"].min()
        x = np.zeros((g["row"].max() - r0 + 1, g["col"].max() - c0 + 1), bool)
        x[g["row"] - r0, g["col"] - c0] = True
        name = label_image(x, offsets)
        r, c = np.nonzero(x)
        first = name[r, c]
        return pd.DataFrame({"t": g["t"].iloc[0], "row": r + r0, "col": c + c0, "region": (first // x.shape[1] + r0) * w + first % x.shape[1] + c0})

    ship(mask.sparkSession)
    local = mask.select("t", "row", "col").groupBy("t", *at).applyInPandas(lambda _, g: one(g), schema)
    if h <= tile and w <= tile:
        return local
    local = written(local, "tiles")
    reach = max(max(abs(i), abs(j)) for i, j in offsets)
    near = [(F.pmod(c, F.lit(tile)) < reach) | (F.pmod(c, F.lit(tile)) >= tile - reach) for c in (F.col("row"), F.col("col"))]
    rim = local.filter(near[0] | near[1])
    half = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets if (i, j) > (0, 0)]))
    there = rim.select("t", "row", "col", F.col("region").alias("other"))
    met = rim.withColumn("_o", half).select("t", (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), "region").join(there, ["t", "row", "col"]).filter("region <> other")
    name = lambda c: F.col("t") * (h * w) + F.col(c)
    found = connected_components(met.select(name("region").alias("a"), name("other").alias("b")).distinct(), "regions").select("node", F.pmod("root", F.lit(h * w)).alias("_least"))
    out = local.withColumn("_n", name("region"))
    return out.join(found, out["_n"] == found["node"], "left").select("t", "row", "col", F.coalesce("_least", "region").alias("region"))


def region_stats(labelled: DataFrame, keys: tuple[str, ...] = ("t", "region")) -> DataFrame:
    return labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.avg("row").alias("row_center"), F.avg("col").alias("col_center"),
        (F.max("row") - F.min("row")).cast("long").alias("row_extent"), (F.max("col") - F.min("col")).cast("long").alias("col_extent"),
    )


def borders(labelled: DataFrame) -> DataFrame:
    """Pixels of a region with an axis neighbour outside it."""
    inner = spread(labelled.select("t", "region", "row", "col"), AXIS).groupBy("t", "region", "row", "col").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(AXIS))
    return labelled.join(inner, ["t", "region", "row", "col"], "left_anti")


def filter_size(labelled: DataFrame, more_than: int) -> DataFrame:
    return labelled.join(region_stats(labelled).filter(F.col("size") > more_than), ["t", "region"], "left_semi")


def filter_shape(labelled: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Regions whose linear size is more than `ratio` roots of their area: the long ones."""
    both = region_stats(labelled).join(region_linsize(labelled), ["t", "region"])
    return labelled.join(both.filter(F.col("linsize") > ratio * F.sqrt("size")), ["t", "region"], "left_semi")


def filter_mask(mask: DataFrame, h: int, w: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(t, row, col) of the regions of a mask that `keep` leaves; one region that is left is kept too."""
    return keep(regions(mask, h, w)).select("t", "row", "col")


def region_centre_distances(labelled: DataFrame) -> DataFrame:
    """(t, a, b, distance) of the centres of each two regions of a frame, a < b."""
    s = region_stats(labelled).select("t", F.col("region").alias("a"), "row_center", "col_center")
    o = s.select("t", F.col("a").alias("b"), F.col("row_center").alias("r"), F.col("col_center").alias("c"))
    d = F.sqrt(F.pow(F.col("row_center") - F.col("r"), F.lit(2.0)) + F.pow(F.col("col_center") - F.col("c"), F.lit(2.0)))
    return s.join(o, "t").filter(F.col("a") < F.col("b")).select("t", "a", "b", d.alias("distance"))


def boxes(labelled: DataFrame) -> DataFrame:
    """(t, region, r0, r1, c0, c1): the bounding box of each region, half open."""
    return labelled.groupBy("t", "region").agg(F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))


def boxes_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """(t, a, b): boxes of one frame that have a pixel in common."""
    o = b.select("t", F.col("region").alias("b"), *[F.col(c).alias(f"_{c}") for c in ("r0", "r1", "c0", "c1")])
    meet = [F.greatest(f"{k}0", f"_{k}0") < F.least(f"{k}1", f"_{k}1") for k in "rc"]
    return a.join(o, "t").filter(meet[0] & meet[1]).select("t", F.col("region").alias("a"), "b")


def embed(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells of each frame within the bounding box of what is not 0, moved to its corner; the boxes t, r0, c0, h, w)."""
    hit = cells.filter("value <> 0").groupBy("t").agg(F.min("row").alias("r0"), F.min("col").alias("c0"), (F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w"))
    moved = cells.join(hit, "t").withColumns({"row": F.col("row") - F.col("r0"), "col": F.col("col") - F.col("c0")})
    return moved.filter("row >= 0 and col >= 0 and row < h and col < w").select(*cells.columns), hit


def unembed(part: DataFrame, box: DataFrame, h: int, w: int) -> DataFrame:
    """Whole frames of h x w again, 0 outside the boxes; frames without a box are not in it."""
    back = part.join(box.select("t", "r0", "c0"), "t").select("t", (F.col("row") + F.col("r0")).alias("row"), (F.col("col") + F.col("c0")).alias("col"), "value")
    grid = box.select("t", F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("i")).select("t", F.floor(F.col("i") / w).cast("int").alias("row"), F.pmod("i", F.lit(w)).cast("int").alias("col"))
    return grid.join(back, ["t", "row", "col"], "left").select("t", "row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def surface_points(img: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(x, y, z) of the pixels that are not in `mask`: places over the longer side, and the value scaled to 0 ... 1 over the image."""
    s = F.broadcast(img.agg(F.greatest(F.max("row"), F.max("col")).alias("_n"), F.min("value").alias("_a"), F.max("value").alias("_b")))  # one row
    out = img.crossJoin(s).select("row", "col", (F.col("col") / (F.col("_n") + 1)).alias("x"), (F.col("row") / (F.col("_n") + 1)).alias("y"), F.try_divide(F.col("value") - F.col("_a"), F.col("_b") - F.col("_a")).alias("z"))
    return out if mask is None else out.join(mask.select("row", "col"), ["row", "col"], "left_anti")


def in_frame(row: Column, col: Column, h: int, w: int) -> Column:
    return (row >= 0) & (row < h) & (col >= 0) & (col < w)


def random_places(spark, n: int, h: int, w: int, seed: int = 0) -> DataFrame:
    """(id, row, col) of n places, drawn evenly."""
    return spark.range(n).select("id", F.floor(F.rand(seed) * h).cast("int").alias("row"), F.floor(F.rand(seed + 1) * w).cast("int").alias("col"))


def resize(cells: DataFrame, h: int, w: int) -> DataFrame:
    """Frames of h x w whose pixel (i, j) is read, between its four neighbours, at i (h0 - 1) / h and j (w0 - 1) / w of the old."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = np.full((g["row"].max() + 1, g["col"].max() + 1), np.nan)
        x[g["row"], g["col"]] = g["value"]
        r, c = np.arange(h) * (x.shape[0] - 1) / h, np.arange(w) * (x.shape[1] - 1) / w
        i, j = r.astype(int), c.astype(int)
        u, v = (r - i)[:, None], (c - j)[None]
        at = lambda a, b: x[np.minimum(a, x.shape[0] - 1)][:, np.minimum(b, x.shape[1] - 1)]
        y = (1 - u) * (1 - v) * at(i, j) + u * (1 - v) * at(i + 1, j) + (1 - u) * v * at(i, j + 1) + u * v * at(i + 1, j + 1)
        return pd.DataFrame({"t": g["t"].iloc[0], "row": np.repeat(np.arange(h), w), "col": np.tile(np.arange(w), h), "value": y.ravel()})

    ship(cells.sparkSession)
    return cells.select("t", "row", "col", "value").groupBy("t").applyInPandas(one, "t long, row int, col int, value double")


def line_of(x0: float, y0: float, x1: float, y1: float) -> tuple[float, float] | None:
    """(slope, intercept) of the line through two points; None for a vertical one."""
    return None if x0 == x1 else ((y0 - y1) / (x0 - x1), y0 - x0 * (y0 - y1) / (x0 - x1))


def normal_of(x0: float, y0: float, x1: float, y1: float) -> tuple[float, float]:
    """The unit vector that moves a segment sideways."""
    n = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    return (y1 - y0) / n, (x0 - x1) / n


def line_projection(cells: DataFrame, segment: tuple[float, float, float, float], how: Reduction = "mean") -> DataFrame:
    """(t, i, value): positive cells of each frame reduced over lines at right angles to a segment, i pixels along it."""
    x0, y0, x1, y1 = segment
    n = max(((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5, 1e-9)
    along = (F.col("col") - x0) * ((x1 - x0) / n) + (F.col("row") - y0) * ((y1 - y0) / n)
    return cells.filter("value > 0").groupBy("t", F.floor(along + 0.5).alias("i")).agg(reduction(how)(F.col("value")).alias("value"))


def region_linsize(labelled: DataFrame) -> DataFrame:
    """(t, region, linsize): the greatest distance within a region's border.

    A region's farthest pair lies on the ends of its rows, so each row sends its two ends only.
    """
    ends = labelled.groupBy("t", "region", "row").agg(F.min("col").alias("a"), F.max("col").alias("b")).select("t", "region", "row", F.explode(F.array_distinct(F.array("a", "b"))).alias("col"))
    o = ends.select("t", "region", F.col("row").alias("r2"), F.col("col").alias("c2"))
    far = F.max((F.col("row") - F.col("r2")) * (F.col("row") - F.col("r2")) + (F.col("col") - F.col("c2")) * (F.col("col") - F.col("c2")))
    return ends.join(o, ["t", "region"]).groupBy("t", "region").agg(F.sqrt(far).alias("linsize"))


def region_distances(labelled: DataFrame, at_most: int) -> DataFrame:
    """(t, a, b, distance): regions of a frame whose borders come within `at_most`.

    Border pixels meet by counting out the disc, so only near ones do; farther pairs of regions have no row.
    """
    b = borders(labelled).select("t", "region", "row", "col")
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit((i * i + j * j) ** 0.5).alias("d")) for i, j in disc(at_most)]))
    near = b.select("t", F.col("region").alias("a"), "row", "col", o.alias("o")).select("t", "a", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.col("o.d").alias("d"))
    return near.join(b.withColumnRenamed("region", "b"), ["t", "row", "col"]).filter(F.col("a") < F.col("b")).groupBy("t", "a", "b").agg(F.min("d").alias("distance"))


def glue_regions(labelled: DataFrame, closer_than: int) -> DataFrame:
    """Regions of a frame that come closer than the distance, directly or over others, become one."""
    near = region_distances(labelled, closer_than).filter(F.col("distance") < closer_than)
    big = 1 << 32
    found = connected_components(near.select((F.col("t") * big + F.col("a")).alias("a"), (F.col("t") * big + F.col("b")).alias("b")), "glue")
    x = labelled.withColumn("_n", F.col("t") * big + F.col("region"))
    return x.join(found, x["_n"] == found["node"], "left").withColumn("region", F.coalesce(F.pmod("root", F.lit(big)), "region")).select(*labelled.columns)


def line_samples(x0: float, y0: float, x1: float, y1: float) -> list[tuple[int, int, int]]:
    """(i, row, col) of the nearest pixels along a segment."""
    n = int(((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5)
    return [(i, int(y0 + i * (y1 - y0) / n), int(x0 + i * (x1 - x0) / n)) for i in range(n)]


def line_reslice(cells: DataFrame, segment: tuple[float, float, float, float]) -> DataFrame:
    """(t, i, value): the space-time image along a segment."""
    points = cells.sparkSession.createDataFrame(line_samples(*segment), "i long, row int, col int")
    return cells.join(F.broadcast(points), ["row", "col"]).select("t", "i", "value")  # as many rows as the segment is long


def plane_fit(cells: DataFrame) -> DataFrame:
    """(t, a, b, c): the least-squares plane a * col + b * row + c of each frame, from centred moments."""
    r, c, v = (F.col(x).cast("double") for x in ("row", "col", "value"))
    m = cells.groupBy("t").agg(
        F.covar_pop(c, c).alias("cc"), F.covar_pop(r, r).alias("rr"), F.covar_pop(r, c).alias("rc"), F.covar_pop(c, v).alias("cv"), F.covar_pop(r, v).alias("rv"),
        F.avg(c).alias("mc"), F.avg(r).alias("mr"), F.avg(v).alias("mv"),
    )
    det = F.expr("cc * rr - rc * rc")
    m = m.withColumns({"a": F.expr("cv * rr - rv * rc") / det, "b": F.expr("rv * cc - cv * rc") / det})
    return m.select("t", "a", "b", F.expr("mv - a * mc - b * mr").alias("c"))


def remove_plane(cells: DataFrame) -> DataFrame:
    return cells.join(plane_fit(cells), "t").withColumn("value", F.expr("value - a * col - b * row - c")).select(*cells.columns)


def in_polygon(row: Column, col: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a pixel lies inside a polygon of (row, col) corners: an odd number of edges cross the ray to the right."""
    odd = F.lit(0)
    for (r0, c0), (r1, c1) in zip(corners, corners[1:] + corners[:1], strict=True):
        if r0 != r1:
            crosses = ((F.lit(float(r0)) > row) != (F.lit(float(r1)) > row)) & (col < F.lit(float(c1 - c0)) * (row - r0) / float(r1 - r0) + c0)
            odd = odd + F.when(crosses, 1).otherwise(0)
    return odd % 2 == 1


def zview(cells: DataFrame, segment: tuple[float, float, float, float], half_width: int = 0) -> DataFrame:
    """(t, i, value): the space-time image along a segment, averaged over copies up to `half_width` pixels to both sides."""
    x0, y0, x1, y1 = segment
    n = max(((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5, 1e-9)
    oy, ox = (x1 - x0) / n, -(y1 - y0) / n
    points = [p for k in range(-half_width, half_width + 1) for p in line_samples(x0 + k * ox, y0 + k * oy, x1 + k * ox, y1 + k * oy)]
    held = cells.sparkSession.createDataFrame(points, "i long, row int, col int")
    # As many rows as the segment is long times its width.
    return cells.join(F.broadcast(held), ["row", "col"]).groupBy("t", "i").agg(F.avg("value").alias("value"))


def tiles(cells: DataFrame, size: int, stride: int) -> DataFrame:
    """Cells with (tr, tc) of every tile of side `size` at multiples of `stride` that holds them."""
    reach = -(-size // stride)
    o = F.sequence(F.lit(0), F.lit(reach - 1))
    x = cells.withColumn("tr", F.explode(F.transform(o, lambda k: F.floor(F.col("row") / stride) - k))).withColumn("tc", F.explode(F.transform(o, lambda k: F.floor(F.col("col") / stride) - k)))
    inside = (F.col("tr") >= 0) & (F.col("tc") >= 0) & (F.col("row") < F.col("tr") * stride + size) & (F.col("col") < F.col("tc") * stride + size)
    return x.filter(inside)


def adaptive_median_mad(cells: DataFrame, k: float) -> DataFrame:
    """The 3 x 3 median, but the value itself where it differs by at most k noise deviations (from the median deviation)."""

    def one(x: np.ndarray) -> np.ndarray:
        q = median_of(shifts(x, SQUARE))
        d = x - q
        noise = np.nanmedian(np.abs(d - np.nanmedian(d))) / 0.6745
        return np.where(np.abs(d) <= k * noise, x, q)

    return on_frames(cells, one)
