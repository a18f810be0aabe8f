"""Distances and clusterings of points (id, x array<double>)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ship
from .graph import connected_components, written


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def minkowski(a: Column, b: Column, k: float = 2) -> Column:
    d = _sum(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(k)))))
    return F.sqrt(d) if k == 2 else d if k == 1 else F.pow(d, F.lit(1 / k))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def pearson(a: Column, b: Column) -> Column:
    n = F.size(a)
    ma, mb = _sum(a) / n, _sum(b) / n
    return F.try_divide(dot(a, b) - n * ma * mb, F.sqrt((dot(a, a) - n * ma * ma) * (dot(b, b) - n * mb * mb)))


def ranks(a: Column) -> Column:
    """Average ranks of the values of an array."""
    return F.transform(a, lambda x: (F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) + 1) / 2).cast("double"))


def _let(x: Column, f) -> Column:
    return F.transform(F.array(x), f)[0]


def spearman(a: Column, b: Column) -> Column:
    return _let(ranks(a), lambda p: _let(ranks(b), lambda q: pearson(p, q)))


DISTANCES = {
    "euclidean": minkowski, "cityblock": lambda a, b: minkowski(a, b, 1), "pearson": lambda a, b: 1 - pearson(a, b),
    "spearman": lambda a, b: 1 - spearman(a, b), "apearson": lambda a, b: 1 - F.abs(pearson(a, b)), "xcorr": lambda a, b: 1 / dot(a, b),
}


Distance = str | Callable[[Column, Column], Column]


def distance(how: Distance) -> Callable[[Column, Column], Column]:
    """A distance by its name, or as a function of two array columns."""
    return how if callable(how) else DISTANCES[how]


def pairwise(points: DataFrame, queries: DataFrame, how: Distance = "euclidean") -> DataFrame:
    """(a, b, distance) of each point to each of a stated set of queries, which is small enough to send."""
    q = queries.select(F.col("id").alias("b"), F.col("x").alias("_y"))
    if q.count() > 10_000:
        raise ValueError("too many queries for one pass; search in blocks")
    return points.crossJoin(F.broadcast(q)).filter(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b", distance(how)(F.col("x"), F.col("_y")).alias("distance"))


def assign(points: DataFrame, centres: DataFrame, how: Distance = "euclidean") -> DataFrame:
    """`points` with label and distance of the nearest centre (label, c); ties to the smaller label.

    Centres are a few, so they travel as one array and nothing is shuffled.
    """
    all_ = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("_cs")))
    best = F.array_min(F.transform("_cs", lambda s: F.struct(distance(how)(F.col("x"), s["c"]).alias("d"), s["label"].alias("label"))))
    return points.crossJoin(all_).withColumn("_b", best).withColumns({"label": F.col("_b.label"), "distance": F.col("_b.d")}).drop("_cs", "_b")


def centroids(assigned: DataFrame) -> DataFrame:
    """(label, c): the mean of each dimension."""
    x = assigned.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    return x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c"))


def kmeans_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """One Lloyd step; a centre without points stays."""
    new = centroids(assign(points, centres))
    return centres.withColumnRenamed("c", "_old").join(new, "label", "left").select("label", F.coalesce("c", "_old").alias("c"))


def kmeans(points: DataFrame, centres: DataFrame, rounds: int = 50, tol: float = 1e-6) -> DataFrame:
    """(label, c) after Lloyd's iterations from explicit seeds, until none moves by `tol`; the centres are small."""
    spark, now = points.sparkSession, centres.collect()
    for _ in range(rounds):
        new = kmeans_step(points, spark.createDataFrame(now, centres.schema)).collect()
        old = {r["label"]: r["c"] for r in now}
        moved = max((math.dist(r["c"], old[r["label"]]) for r in new), default=0.0)
        now = new
        if moved < tol:
            break
    return spark.createDataFrame(now, centres.schema)


def _euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def _cityblock(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out, one = (np.zeros((len(x), len(y)), x.dtype) for _ in range(2))
    for k in range(x.shape[1]):
        np.subtract(x[:, k : k + 1], y[:, k], out=one)
        np.abs(one, out=one)
        out += one
    return out


def _close_euclidean(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of x and y that may be within eps, no pair of nearer ones left out: products of matrices and one comparison each.

    In single precision where its rounding, for which there is room in either, is small beside eps.
    """
    half = lambda v: (v**2).sum(1, keepdims=True) / 2
    one = lambda v: np.ones((len(v), 1))
    hx, hy = half(x), half(y)
    top = hx.max(initial=0) + hy.max(initial=0)
    error = lambda kind: 2 * (x.shape[1] + 8) * np.finfo(kind).eps * top
    kind = np.float32 if top < 1e30 and eps < 1e15 and error(np.float32) <= 0.005 * eps**2 else float
    a, b = np.hstack([x, -hx, one(x)]).astype(kind, copy=False), np.hstack([y, one(y), -hy]).astype(kind, copy=False)
    least = kind(-((eps + 1e-6 * (1 + eps + np.abs(x).max(initial=0) + np.abs(y).max(initial=0))) ** 2) / 2 - error(kind))
    for k in range(0, len(a), 256):
        for m in range(0, len(b), 2048):
            near = ~(a[k : k + 256] @ b[m : m + 2048].T < least)  # what overflows may be near
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            yield i + k, j + m


def _close_cityblock(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, in single precision or steps of two bytes with as much room as their rounding asks for, by pieces that stay in a processor's cache."""
    size = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    kind, n = np.float32 if size < 1e30 else float, x.shape[1]
    most = eps + 1e-6 * (1 + eps + (n + 1) * size)
    step = n * size / 16_000
    if 0 < n * step <= 0.05 * eps and n <= 500:  # steps so small that two bytes will do, whose sums cannot overflow
        x, y, kind, most = np.round(x / step), np.round(y / step), np.int16, min(most / step + n + 1, 32_767)
    a, b = x.astype(kind), np.asfortranarray(y.astype(kind))
    for k in range(0, len(a), 64):
        for m in range(0, len(b), 1024):
            i, j = np.nonzero(_cityblock(a[k : k + 64], b[m : m + 1024]) <= most)
            yield i + k, j + m


#: Metrics of near pairs: all distances of two blocks, quickly; those of given pairs, exactly; and the pairs of two blocks that may be near.
METRICS = {
    "euclidean": (_euclidean, lambda x, y: np.sqrt(((x - y) ** 2).sum(1)), _close_euclidean),
    "cityblock": (_cityblock, lambda x, y: np.abs(x - y).sum(1), _close_cityblock),
}
#: Pivots of a split, points of a cell that are not split further, rows of a cell that one task leads to their pivots, splits at most,
#: and rows (about) that tell what a split is worth.
PIVOTS, LEAF, SLICE, DEPTH, TRIAL = 16, 1024, 20_000, 10, 2048
#: Rows of a block that are compared with as many at a time, numbers that exact distances are taken of at a time, and pairs that leave a task at a time.
PIECE, EXACT, HITS = 10_000, 1 << 19, 1 << 16
#: Blocks that the rows of a cell are dealt into at most, unless one would have more than so many rows: a row goes to as many tasks.
SHARE, MOST = 16, 32_768


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    column = column.combine_chunks()
    if len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("points must have one number of dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _blocks(n: Column, block: int) -> Column:
    """Blocks for n rows: of `block` rows each, or larger ones where those would be more than SHARE."""
    return F.ceil(n / F.greatest(F.lit(block), F.least(F.ceil(n / SHARE), F.lit(MOST))))


def near_rows(batches: Iterator[pa.RecordBatch], eps: float, metric: str) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) of a pair of blocks (i, j), whose rows (i, j, at, id, x) come in any order.

    The blocks' rows are held once, in the pieces they come in; a piece is compared with a piece, so that nothing else grows
    with the blocks or with the hits.
    """
    _, exact, close = METRICS[metric]
    one, two, found, n, dims = [], [], [], 0, set()

    def told() -> pa.RecordBatch:
        a, b, d = (np.concatenate(v) for v in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(f(a, b), id_type) for f in (np.minimum, np.maximum)), pa.array(d)], names=["a", "b", "distance"])

    for whole in batches:
        id_type = whole.schema.field("id").type
        for k in range(0, len(whole), PIECE):
            g = whole.slice(k, PIECE)
            at, ids, x, (i, j) = g["at"].to_numpy(), g["id"].to_numpy(zero_copy_only=False), _matrix(pa.chunked_array([g["x"]])), (g[c][0].as_py() for c in "ij")
            dims.add(x.shape[1])
            finite = np.isfinite(x).all(1)
            for side, block in ((one, i), (two, j)) if i != j else ((one, i),):
                if (rows := finite & (at == block)).any():
                    side.append((ids[rows], x[rows]))
    if len(dims) > 1:
        raise ValueError("points must have one number of dimensions")
    two = one if i == j else two
    for p, (ids, x) in enumerate(one):
        centre, step = x.mean(0), max(1, EXACT // max(1, x.shape[1]))
        for q, (ids2, y) in enumerate(two):
            if two is one and q < p:
                continue
            for r, c in close(x - centre, y - centre, eps):
                r, c = (r[r < c], c[r < c]) if two is one and p == q else (r, c)
                for m in range(0, len(r), step):
                    a, b = r[m : m + step], c[m : m + step]
                    d = exact(x[a], y[b])
                    hit = d <= eps
                    if hit.any():
                        found.append((ids[a[hit]], ids2[b[hit]], d[hit]))
                        n += len(found[-1][2])
                    if n >= HITS:
                        yield told()
                        found, n = [], 0
    if n:
        yield told()


def near_cells(points: DataFrame, eps: float, metric: str = "euclidean", pivots: int = PIVOTS, leaf: int = LEAF, whole: bool = False) -> DataFrame:
    """(cell, guest, id, x): the leaves of a tree of pivots, so that each two points within eps meet in just one of them.

    A split takes some members of a cell for pivots.  A member goes to the nearest of them; where its distance to another
    exceeds that by at most 2 eps, which the triangle inequality asks of points within eps of each other, it is a guest there
    too, if that pivot has the greater number.  Guests of a cell are guests of all pivots within that bound.  A pair meets
    where one of it is a member and the other is a member or guest.  Guests farther from a pivot than its farthest member and
    eps, or nearer than its nearest less eps, go.  `whole` asks for guests at smaller numbers too: then all points within eps
    of a member are in its cell.  Cells are split until they have at most `leaf` members, or until a split would leave more than
    four fifths of the pairs to compare, as it must for copies and in many dimensions; some rows of the cell are led to its
    pivots to see that, so a cell that is not worth a split is not copied.

    Pivots travel with slices of their cell's rows, so nothing is broadcast and no cell is one task's.  A split is a
    written table; the depth grows with the logarithm of the points.
    """
    kind = dict(points.dtypes)["id"]
    spread = METRICS[metric][0]
    ship(points.sparkSession)

    def homes(x: np.ndarray, c: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances to the pivots, the nearest, and where a row goes."""
        d = spread(x, c)
        home, near, at = d.argmin(1), d - d.min(1)[:, None] <= 2 * eps + 1e-6 * (1 + d), np.arange(len(c))
        return d, home, np.where(guest[:, None], near, (at == home[:, None]) | near & (whole | (at > home[:, None])))

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pa.Table.from_batches(batches)
        c = _matrix(g.filter(pc.greater_equal(g["pivot"], 0)).sort_by("pivot")["x"])
        rows = g.filter(pc.less(g["pivot"], 0)).select(["cell", "guest", "id", "x"])
        for k in range(0, len(rows), 4096):
            part = rows.slice(k, 4096).combine_chunks()
            guest, cell = part["guest"].to_numpy(), part["cell"].to_numpy()
            d, home, to = homes(_matrix(part["x"]), c, guest)
            i, j = np.nonzero(to)
            for m in range(0, len(i), 16_384):
                a, b = i[m : m + 16_384], j[m : m + 16_384]
                out = part.take(pa.array(a))
                columns = [pa.array(cell[a] * 64 + b + 1), pa.array(guest[a] | (home[a] != b)), out["id"].combine_chunks(), out["x"].combine_chunks(), pa.array(d[a, b])]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "guest", "id", "x", "d"])

    def tried(g: pd.DataFrame) -> pd.DataFrame:
        """The share of a cell's pairs that its split would leave, by some of its rows."""
        p, r = g[g["pivot"] >= 0].sort_values("pivot"), g[g["pivot"] < 0]
        share = 0.0
        if len(r) and not r["guest"].all():
            x, c = (np.stack(v["x"].to_numpy()).astype(float) for v in (r, p))
            guest = r["guest"].to_numpy()
            d, home, to = homes(x, c, guest)
            work = lambda mine, all_: mine * (all_ - (0 if whole else mine / 2))
            left = 0.0
            for j in range(len(c)):
                mine = ~guest & (home == j)
                if mine.any():
                    left += work(mine.sum(), (to[:, j] & (mine | (d[:, j] <= d[mine, j].max() + eps) & (d[:, j] >= d[mine, j].min() - eps))).sum())
            share = left / work((~guest).sum(), len(r))
        return pd.DataFrame({"cell": g["cell"].iloc[:1], "share": [share]})

    schema = f"cell long, guest boolean, id {kind}, x array<double>"
    now = written(points.filter(F.col("x").isNotNull()).select(F.lit(0).cast("long").alias("cell"), F.lit(False).alias("guest"), "id", F.col("x").cast("array<double>").alias("x"), F.lit(0.0).alias("d")), "cells")
    leaves = None
    for depth in range(DEPTH + 1):
        own = lambda c: F.when(~F.col("guest"), c)
        info = now.groupBy("cell").agg(F.count(own(F.lit(1))).alias("members"), F.count(F.lit(1)).alias("rows"), F.max(own(F.col("d"))).alias("far"), F.min(own(F.col("d"))).alias("near"))
        info = written(info.filter("members > 0").withColumn("large", (F.col("members") > leaf) & F.lit(depth < DEPTH)), "cell-sizes")
        near = ~F.col("guest") | ((F.col("d") <= F.col("far") + eps + 1e-6 * (1 + F.col("d"))) & (F.col("d") >= F.col("near") - eps - 1e-6 * (1 + F.col("d"))))
        large = now.join(info.filter("large"), "cell").filter(near)
        # About four times as many members as are needed are drawn by hash, and the first of them are the pivots.
        draw = F.pmod(F.xxhash64(F.lit(depth), "id"), F.greatest(F.lit(1), F.floor(F.col("members") / (4 * pivots)))) == 0
        order = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
        centre = large.filter(~F.col("guest") & draw).withColumn("pivot", F.row_number().over(order) - 1).filter(F.col("pivot") < pivots)
        centre = written(centre.select("cell", "guest", "id", "x", "d", "pivot", F.ceil(F.col("rows") / SLICE).alias("slices")), "pivots")
        some = large.filter(F.pmod(F.xxhash64(F.lit(-1 - depth), "id"), F.greatest(F.lit(1), F.floor(F.col("rows") / TRIAL))) == 0).select("cell", "guest", "x", F.lit(-1).alias("pivot"))
        share = some.unionByName(centre.select("cell", "guest", "x", "pivot")).groupBy("cell").applyInPandas(tried, "cell long, share double")
        info = written(info.join(share, "cell", "left").withColumn("split", F.coalesce(F.col("share") <= 0.8, F.lit(False))), "cell-splits")
        kept = now.join(info, "cell").filter(near)
        done = kept.filter("not split").select("cell", "guest", "id", "x")
        leaves = done if leaves is None else leaves.unionByName(done)
        if info.filter("split").isEmpty():
            return written(leaves.select(*[f.split()[0] for f in schema.split(", ")]), "leaves")
        pick = ["cell", "guest", "id", "x", "pivot", "slice"]
        centre = centre.join(info.filter("split").select("cell"), "cell", "left_semi").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        rest = kept.filter("split").withColumns({"pivot": F.lit(-1), "slice": F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / SLICE))})
        now = written(rest.select(*pick).unionByName(centre.select(*pick)).repartition("cell", "slice").groupBy("cell", "slice").applyInArrow(led, schema + ", d double"), "cells")


def near_pairs(points: DataFrame, eps: float, pivots: int = PIVOTS, block: int = 4096, metric: str = "euclidean", leaf: int = LEAF) -> DataFrame:
    """(a, b, distance) of points within eps, a < b, in any number of dimensions; metrics are euclidean, cityblock and pearson.

    Points meet in the leaves of a tree of pivots; the members and guests of a leaf are dealt into blocks by hash, whose pairs
    are compared at once, and only hits leave them, some at a time.  A block has `block` points, or more where a leaf would have
    more than SHARE blocks, so that what is sent grows with the points and not with their square; from SHARE times MOST points
    in one leaf on, blocks stay as large as they are.  `pivots` (63 at most), `leaf` and `block` decide the work, not the
    result.  The correlation distance 1 - r is half the squared distance of the points' unit vectors about their means;
    points without any have no neighbours in it.  Ids are expected to be unique, points without coordinates, or with
    coordinates that are not finite, have no neighbours.
    """
    if metric == "pearson":
        from_mean = lambda x: _let(_sum(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))
        unit = _let(from_mean(F.col("x")), lambda c: _let(F.sqrt(dot(c, c)), lambda n: F.when(n > 0, F.transform(c, lambda v: v / n))))
        found = near_pairs(points.select("id", unit.alias("x")), math.sqrt(2 * eps) + 1e-9, pivots, block, "euclidean", leaf)
        return found.withColumn("distance", F.col("distance") * F.col("distance") / 2).filter(F.col("distance") <= eps)
    kind = dict(points.dtypes)["id"]
    cells = near_cells(points, eps, metric, min(pivots, 63), leaf)
    n = lambda guest: _blocks(F.count(F.when(F.col("guest") == guest, 1)), block)
    mine = cells.join(cells.groupBy("cell").agg(n(False).alias("homes"), n(True).alias("guests")), "cell").withColumn("k", F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))))
    # Block pairs (i, j): of members, i <= j; of members and guests, j counted on from the members' blocks.
    up = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k")), lambda i: F.struct(i.alias("i"), F.col("k").alias("j")))
    on = F.transform(F.filter(F.sequence(F.col("k"), F.col("homes") + F.col("guests")), lambda j: (j > F.col("k")) & (j < F.col("homes") + F.col("guests"))), lambda j: F.struct(F.col("k").alias("i"), j.alias("j")))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("homes") - 1), lambda i: F.struct(i.alias("i"), (F.col("homes") + F.col("k")).alias("j")))
    tasks = mine.select("cell", F.explode(F.when(F.col("guest"), met).otherwise(F.concat(up, on))).alias("o"), F.when(F.col("guest"), F.col("homes") + F.col("k")).otherwise(F.col("k")).alias("at"), "id", "x")
    tasks = tasks.select("cell", F.col("o.i").alias("i"), F.col("o.j").alias("j"), "at", "id", "x")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return near_rows(batches, eps, metric)

    # Dealt out by block pair: a join by cell has put a whole cell in one place, which Spark would take for grouped already.
    return tasks.repartition("cell", "i", "j").groupBy("cell", "i", "j").applyInArrow(pairs, f"a {kind}, b {kind}, distance double")


def dbscan(points: DataFrame, eps: float, min_points: int, strict: bool = False, with_self: bool = True, metric: str = "euclidean") -> DataFrame:
    """(id, label): -1 is noise; a cluster is named by its least core id, and a border point joins the least near it.

    A core point has `min_points` points within eps, itself among them.  `strict` asks for less than eps and for more than
    `min_points`; without `with_self` a point does not count itself.
    """
    pairs = near_pairs(points, eps, metric=metric)
    pairs = written(pairs.filter(F.col("distance") < eps) if strict else pairs, "pairs")
    least = min_points + strict
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = points.select(F.col("id").alias("a"))
    near = own.unionByName(both.select("a")).groupBy("a").agg((F.count(F.lit(1)) - (0 if with_self else 1)).alias("n"))
    core = written(near.filter(F.col("n") >= least).select("a"), "core")
    inner = pairs.join(core, "a", "left_semi").join(core.withColumnRenamed("a", "b"), "b", "left_semi")
    found = connected_components(inner.select("a", "b"), "dbscan")
    named = core.join(found, core["a"] == found["node"], "left").select("a", F.coalesce("root", "a").alias("label"))
    edge = both.join(core, "a", "left_anti").join(named.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("label"))
    out = named.unionByName(edge)
    return points.select("id").join(out, points["id"] == out["a"], "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def som(points: DataFrame, grid: tuple[int, int], seeds: DataFrame, epochs: int = 10, radius: float = 2.0) -> DataFrame:
    """(label, c) of a batch self-organising map on a grid, label = i * width + j, from explicit seeds (label, c).

    An epoch assigns every point and sums by winner, which is one aggregate; the neighbourhood is applied to those sums.
    """
    spark = points.sparkSession
    now = np.array([r["c"] for r in sorted(seeds.collect())], float)
    at = np.array([(k // grid[1], k % grid[1]) for k in range(grid[0] * grid[1])], float)
    square = ((at[:, None] - at[None]) ** 2).sum(-1)
    for e in range(epochs):
        won = assign(points, spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(now)], "label long, c array<double>"))
        n = won.groupBy("label").count()
        got = centroids(won).join(n, "label").collect()
        h = np.exp(-square / (radius * 0.9**e) ** 2)
        top, bottom = np.zeros_like(now), np.zeros(len(now))
        for r in got:
            top += h[:, [r["label"]]] * np.array(r["c"]) * r["count"]
            bottom += h[:, r["label"]] * r["count"]
        now = np.where(bottom[:, None] > 1e-12, top / np.maximum(bottom, 1e-12)[:, None], now)
    return spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(now)], "label long, c array<double>")


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """(label, mass, distortion): points and mean distance to the centre."""
    return assigned.groupBy("label").agg(F.count(F.lit(1)).alias("mass"), F.avg("distance").alias("distortion"))


def select_points(assigned: DataFrame, label: int) -> DataFrame:
    return assigned.filter(F.col("label") == label)


def farthest(assigned: DataFrame, queries: DataFrame, how: Distance = "euclidean") -> DataFrame:
    """(label, b, distance): from each of a stated set of queries (id, x), which is small enough to send, the farthest point of each cluster."""
    q = queries.select(F.col("id").alias("b"), F.col("x").alias("_y"))
    return assigned.crossJoin(F.broadcast(q)).groupBy("label", "b").agg(F.max(distance(how)(F.col("x"), F.col("_y"))).alias("distance"))


def diameters(assigned: DataFrame, block: int = 2048) -> DataFrame:
    """(label, diameter): the greatest distance of two points of each cluster, exactly; 0 for one point.

    From the centre to the farthest point, from that to the farthest, and once more, gives a distance that the diameter has at
    least.  Two points farther apart have radii about the centre that exceed it in sum, so those whose radius and the greatest
    one do not are left out.  The others are dealt into blocks by radius, and only pairs of blocks whose greatest radii exceed
    it are compared, each pair of blocks by a task.  A block has `block` points, or more where a label would have more than
    SHARE blocks and one for each band.  Points are (id, x) with a label; those without coordinates count for nothing.
    """
    p = assigned.filter(F.col("x").isNotNull()).select("label", "id", F.col("x").cast("array<double>").alias("x"))
    centre = p.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    centre = centre.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c"))
    p = written(p.join(centre, "label").withColumn("r", minkowski(F.col("x"), F.col("c"))).drop("c"), "radii")
    ends = p.groupBy("label").agg(F.max_by("x", F.struct("r", "id")).alias("end"), F.max("r").alias("most"), F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("least"))
    for _ in range(2):
        far = p.join(ends.select("label", "end"), "label").withColumn("d", minkowski(F.col("x"), F.col("end")))
        far = far.groupBy("label").agg(F.max_by("x", F.struct("d", "id")).alias("next"), F.max("d").alias("d"))
        ends = written(ends.join(far, "label").select("label", F.col("next").alias("end"), "most", "n", F.greatest("least", "d").alias("least")), "ends")
    slack = 1e-9 * (1 + F.col("most"))
    outer = p.join(ends.select("label", "most", "least"), "label").filter(F.col("r") + F.col("most") >= F.col("least") - slack)
    # Bands of equal width in radius; a band has as many blocks as its points ask for.
    band = outer.withColumn("band", F.least(F.lit(15), F.floor(16 * F.coalesce(F.try_divide(F.col("most") - F.col("r"), 2 * F.col("most") - F.col("least")), F.lit(0.0)))).cast("int"))
    sizes = band.groupBy("label", "band").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("top"), F.first("least").alias("least"), F.first("most").alias("most"))
    room = F.greatest(F.lit(block), F.least(F.ceil(F.sum("n").over(Window.partitionBy("label")) / SHARE), F.lit(MOST)))
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("n") / room)).drop("n"), "bands")
    each = sizes.select("label", "band", "top", "least", "most", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    other = each.select("label", F.col("band").alias("band2"), F.col("top").alias("top2"), F.col("k").alias("k2"))
    # Pairs of blocks, not of points; as many as the work asks for.
    due = each.join(other, "label").filter(((F.col("band") < F.col("band2")) | ((F.col("band") == F.col("band2")) & (F.col("k") <= F.col("k2")))) & (F.col("top") + F.col("top2") >= F.col("least") - slack))
    due = due.select("label", "band", "k", "band2", "k2").withColumn("pair", F.struct("band", "k", "band2", "k2"))
    sides = due.select("label", "pair", "band", "k", F.lit(False).alias("second")).unionByName(due.filter("band <> band2 or k <> k2").select("label", "pair", F.col("band2").alias("band"), F.col("k2").alias("k"), F.lit(True).alias("second")))
    dealt = band.join(sizes.select("label", "band", "blocks"), ["label", "band"]).select("label", "band", F.pmod(F.xxhash64("id"), "blocks").alias("k"), "x")
    both = dealt.join(sides, ["label", "band", "k"]).select("label", "pair", "second", "x")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g["x"].to_numpy()).astype(float)
        a, b = x[~g["second"].to_numpy()], x[g["second"].to_numpy()]
        b = b if len(b) else a
        top = 0.0
        for k in range(0, len(a), 256):
            d = _euclidean(a[k : k + 256], b)
            i, j = np.nonzero(d >= d.max() - 1e-6 * (1 + d.max()))  # few are as far; those are measured exactly
            top = max([top, *(float(np.sqrt(((a[k + i[m : m + 4096]] - b[j[m : m + 4096]]) ** 2).sum(1)).max()) for m in range(0, len(i), 4096))])
        return pd.DataFrame({"label": g["label"].iloc[:1], "diameter": [top]})

    ship(assigned.sparkSession)
    found = both.repartition("label", "pair").groupBy("label", "pair").applyInPandas(one, f"label {dict(assigned.dtypes)['label']}, diameter double")
    return found.unionByName(ends.select("label", F.col("least").alias("diameter"))).groupBy("label").agg(F.max("diameter").alias("diameter"))


def top_by_mass(stats: DataFrame) -> DataFrame:
    return stats.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mass"), "label")).cast("long"))


def quality_threshold(points: DataFrame, most_diameter: float, key: str) -> DataFrame:
    """(key, id, label): greedy clusters of bounded diameter within each group of `key`; groups must be small (cubic work)."""

    def one(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        x = np.stack(g["x"].to_numpy()).astype(float)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        label, left, k_ = np.full(len(g), -1), set(range(len(g))), 0
        while left:
            best: list[int] = []
            for s in sorted(left):
                mine, far, rest = [s], d[s].copy(), left - {s}
                while rest:
                    nearest = min(rest, key=lambda i: (far[i], i))
                    if far[nearest] >= most_diameter:
                        break
                    mine.append(nearest)
                    far = np.maximum(far, d[nearest])
                    rest -= {nearest}
                if len(mine) > len(best):
                    best = mine
            label[best] = k_
            left -= set(best)
            k_ += 1
        return pd.DataFrame({key: k[0], "id": g["id"], "label": label})

    return points.groupBy(key).applyInPandas(one, f"{key} {dict(points.dtypes)[key]}, id long, label long")


#: Seeds that a task of QT grows at least, tasks that the rows of a cell go to at most, partitions that those are dealt into at least (few
#: rows are much work, so they are not to be put together by their size), and points of a part that one task clusters to the end.
SEEDS, SEED_TASKS, DEALT, REST = 64, 32, 128, 1024
#: Seeds grown together while half the points are open to them, scores of those held at most, and points whose distances are taken ahead at a time.
TOGETHER, HELD, AHEAD = 64, 1 << 23, 24


class _Growth:
    """Growth of QT's candidates over rows of x, which are in order of id; `about` has them less their mean, for scores alone.

    Scores order the distances (squares for euclidean ones), and are right but for `slack`; choices that this leaves open are
    made by exact distances.  They are products of matrices, in single precision where its rounding has room; where there are
    none (other metrics, squares that overflow) they are the exact distances.
    """

    def __init__(self, x: np.ndarray, about: np.ndarray, most: float, metric: str):
        self.x, self.about, self.most, self.exact = x, about, most, METRICS[metric][1]
        with np.errstate(over="ignore"):
            self.norm = (about**2).sum(1)
            top, size = self.norm.max(initial=0), (x**2).max(initial=0)
        self.products = metric == "euclidean" and 0 < most < 1e150 and max(top, size) < 1e300
        self.limit, self.slack = most**2 if self.products else most, 0.0
        if self.products:
            slack = lambda kind: 2.5 * (x.shape[1] + 8) * np.finfo(kind).eps * top + 1e-15 * (x.shape[1] + 8) * (top + size) + 1e-300
            kind = np.float32 if 1e-30 < self.limit < 1e30 and top < 1e30 and slack(np.float32) <= 1e-4 * self.limit else float
            self.slack, self.fine = slack(kind), slack(float)
            n, one = self.norm[:, None], np.ones((len(x), 1))
            self.left, self.right = np.hstack([-2 * about, one, n]).astype(kind), np.hstack([about, n, one]).astype(kind)
        else:
            self.left = self.right = x

    def scores(self, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of the points `at` to rows of `right`, a row for each of `at`."""
        if self.products:
            out, left = np.empty((len(at), len(rows)), rows.dtype), self.left[at].T
            for p in range(0, len(rows), 2048):
                out[:, p : p + 2048] = (rows[p : p + 2048] @ left).T
            return out
        return np.stack([self.exact(rows, self.left[[k]]) for k in at])

    def nearest(self, open_: np.ndarray, mine: list[int], held: np.ndarray | None = None) -> int:
        """The first of the points `open_` whose farthest member is nearest, or -1 if none is near enough; `held` has the members' `double` rows."""
        held = self.double(mine) if held is None else held[: len(mine)]
        far = (held[:, -1:] - 2 * (held[:, :-1] @ self.about[open_].T)).max(0) + self.norm[open_]
        open_ = open_[far <= far.min() + 2 * self.fine]
        if len(open_) == 1 and far.min() < self.limit - self.fine:
            return int(open_[0])
        true = np.array([self.exact(self.x[mine], self.x[[k]]).max() for k in open_])
        return int(open_[true.argmin()]) if true.min() < self.most else -1

    def double(self, at: list[int]) -> np.ndarray:
        """Rows of points and their squares, for scores in double precision."""
        return np.hstack([self.about[at], self.norm[at][:, None]])

    def together(self, seeds: np.ndarray, skip: bool) -> Iterator[tuple[int, list[int] | None]]:
        """(seed, rows of its candidate).  With `skip`, there are none for a seed whose nearest point is a smaller one with that seed for its nearest: both have one candidate."""
        n = len(self.x)
        few = int(max(1, min(TOGETHER, HELD // max(1, n))))
        for m in range(0, len(seeds), few):
            mine = [[int(s)] for s in seeds[m : m + few]]
            far, step = np.full((len(mine), n), -np.inf, self.right.dtype), 1
            while True:
                at = np.array([v[-1] for v in mine])
                for p in range(0, n, 4096):
                    np.maximum(far[:, p : p + 4096], self.scores(at, self.right[p : p + 4096]), out=far[:, p : p + 4096])
                far[np.arange(len(mine)), at] = np.inf
                near = far.argmin(1)
                if step & (step - 1) == 0 or step % 16 == 0:
                    if np.count_nonzero(far < self.limit + self.slack) < far.size / 2:
                        break
                picks = [self.pick(f, k, None, v) for f, k, v in zip(far, near.tolist(), mine, strict=True)]
                if skip and step == 1:
                    twin = [k for k, (v, t) in enumerate(zip(mine, picks, strict=True)) if 0 <= t < v[0]]
                    back = self.scores(np.array([picks[k] for k in twin], int), self.right) if twin else []
                    gone = set()
                    for k, b in zip(twin, back, strict=True):
                        b[picks[k]] = np.inf
                        if np.count_nonzero(b <= b[mine[k][0]] + 2 * self.slack) == 1:
                            gone.add(k)
                            yield mine[k][0], None
                    stay = [k for k in range(len(mine)) if k not in gone]
                    far, mine, picks = far[stay], [mine[k] for k in stay], [picks[k] for k in stay]
                    if not mine:
                        break
                for v, k in zip(mine, picks, strict=True):
                    if k >= 0:
                        v.append(k)
                if min(picks) < 0:
                    # Of those that took a point the scores lack it still.
                    for f, v, k in zip(far, mine, picks, strict=True):
                        if k >= 0:
                            np.maximum(f, self.scores(np.array([k]), self.right)[0], out=f)
                            f[k] = np.inf
                    break
                step += 1
            for v, f in zip(mine, far, strict=True):
                yield v[0], self.alone(v, f)

    def pick(self, far: np.ndarray, k: int, live: np.ndarray | None, mine: list[int], held: np.ndarray | None = None) -> int:
        """The place of the point to take, given that of the least score, or -1."""
        while (least := far[k]) < self.limit + self.slack:
            if not self.slack:
                return k
            far[k] = np.inf
            second = far.min()
            far[k] = least
            if second > least + 2 * self.slack and least < self.limit - self.slack:
                return k
            open_ = np.flatnonzero(far <= least + 2 * self.slack)
            if (best := self.nearest(open_ if live is None else live[open_], mine, held)) >= 0:
                return best if live is None else int(np.searchsorted(live, best))
            far[open_] = np.inf  # no nearer than the limit after all
            k = int(far.argmin())
        return -1

    def alone(self, mine: list[int], far: np.ndarray) -> list[int]:
        """A candidate grown to its end, from its first members and the scores that they leave.

        Points too far from a member are never taken, so they are dropped as the candidate grows; distances are taken of
        those points that are likely to be next, some at a time.
        """
        live, rows, ahead, held = np.arange(len(far)), self.right, {}, self.double(mine)
        while (k := self.pick(far, int(far.argmin()), live, mine, held)) >= 0:
            if k not in ahead:
                within = far < self.limit + self.slack
                if (n := np.count_nonzero(within)) < 0.7 * len(far):
                    keep = np.flatnonzero(within)
                    k, live, rows, far = int(np.searchsorted(keep, k)), live[keep], rows[keep], far[keep]
                some = np.argpartition(far, AHEAD)[:AHEAD] if AHEAD < n else np.flatnonzero(far < np.inf)
                some = some if (some == k).any() else np.append(some, k)
                some = some if self.products else np.array([k])
                ahead, scores = {int(v): i for i, v in enumerate(some)}, self.scores(live[some], rows)
            if len(mine) == len(held):
                held = np.concatenate([held, np.empty_like(held)])
            mine.append(int(live[k]))
            held[len(mine) - 1, :-1], held[len(mine) - 1, -1] = self.about[mine[-1]], self.norm[mine[-1]]
            np.maximum(far, scores[ahead[k]], out=far)
            far[k] = np.inf
        return mine


def _grow(x: np.ndarray, about: np.ndarray, seed: int, most: float, metric: str) -> list[int]:
    """Rows of one seed's candidate, in the order taken."""
    return next(_Growth(x, about, most, metric).together(np.array([seed]), False))[1]


def _qt_rows(g: pa.Table, most: float, metric: str) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray, bool], Iterator[tuple[int, list[int] | None]]]]:
    """Ids and numbers of points in order of id, and the growth of some of them among those that are left; points that are not finite stay alone."""
    ids, x, n = g["id"].to_numpy(), _matrix(g["x"]), g["n"].to_numpy()
    finite = np.isfinite(x).all(1)

    def grow(seeds: np.ndarray, left: np.ndarray, skip: bool) -> Iterator[tuple[int, list[int] | None]]:
        yield from ((int(s), [int(s)]) for s in seeds[~finite[seeds]])
        rows = np.flatnonzero(left & finite)
        y = x[rows]
        about = y - (y.mean(0) if len(y) else 0.0)
        for s, mine in _Growth(y, about, most, metric).together(np.searchsorted(rows, seeds[finite[seeds]]), skip):
            yield int(rows[s]), None if mine is None else rows[mine].tolist()

    return ids, n, grow


def qt_clusters(points: DataFrame, most_diameter: float, rounds: int | None = None, metric: str = "euclidean") -> DataFrame:
    """(id, label): quality-threshold clustering over all tasks; label 0 is the largest cluster, 1 the largest of the rest, and so on.

    A seed's candidate takes, again and again, the point whose farthest member is nearest (ties to the smaller id), while
    that is nearer than `most_diameter`.  So a candidate needs the seed's near points alone, which are all in the seed's leaf of a
    tree of pivots; the seeds of a leaf are dealt out, and a task holds the points of one leaf and no pairs.  Leaves that share
    points, by one or many steps, are a part, and parts do not touch each other: each has its largest candidate (ties to the
    smaller seed) taken away in a round, and those seeds near a point that went are grown anew; the others would grow as before.
    A part of at most REST points is clustered to its end by a task.  What is first over all parts is told by the clusters
    alone: one comes when all before it in its part have come, so it has the later of its own place and theirs.

    A round is a handful of Spark jobs, and there are as many as the largest part has clusters before it is small; `rounds`
    asks for the first clusters only, and points that are left have label -1.  The work of a round is seeds times their near
    points times the members that it takes to rule a point out.
    Copies count as one point with their number.  Ids are unique; points without coordinates have label -1, those with
    coordinates that are not finite are clusters of their own.
    """
    kind = dict(points.dtypes)["id"]
    ship(points.sparkSession)
    x = F.col("x").cast("array<double>")
    own = F.when(~F.coalesce(F.forall(x, lambda v: F.abs(v) < float("inf")), F.lit(False)) | F.lit(most_diameter <= 0), F.col("id"))
    keyed = points.filter(F.col("x").isNotNull()).select("id", x.alias("x"), own.alias("own"))
    same = written(keyed.groupBy("x", "own").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "points")
    cells = near_cells(same.select("id", "x"), most_diameter, metric, whole=True)
    cells = written(cells.join(same.select("id", "n"), "id").select("cell", "guest", "id", "x", "n"), "near")
    homes = cells.filter("not guest").select("id", F.col("cell").alias("a"))
    roots = connected_components(cells.filter("guest").join(homes, "id").select("a", F.col("cell").alias("b")), "qt-parts")
    cells = cells.join(roots, cells["cell"] == roots["node"], "left").select(F.coalesce("root", "cell").alias("part"), "cell", "guest", "id", "x", "n", F.lit(False).alias("gone"))
    near, dealt = METRICS[metric][0], max(DEALT, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, seed, mass, members) of the `due` of a leaf that are near one of the `gone`, or of all, if none are; members if `told`."""
        g = pa.Table.from_batches(batches).sort_by("id")
        part, told, id_type = g["part"][0].as_py(), g["told"][0].as_py(), g.schema.field("id").type
        seeds, gone = np.flatnonzero(g["due"].to_numpy()), g["gone"].to_numpy()
        if gone.any():
            v = _matrix(g["x"])
            v -= np.nan_to_num(v, posinf=0, neginf=0).mean(0)
            some, lost = max(1, HELD // (8 * int(gone.sum()))), v[gone]
            with np.errstate(over="ignore", invalid="ignore"):
                room = most_diameter + 1e-6 * (1 + most_diameter + np.abs(v).max())
                seeds = np.concatenate([seeds[k : k + some][(~(near(v[seeds[k : k + some]], lost) > room)).any(1)] for k in range(0, len(seeds), some)] or [seeds])
        ids, n, candidates = _qt_rows(g, most_diameter, metric)
        del g
        found = ((s, n[mine].sum() if mine else 0, ids[mine] if told else ids[:0]) for s, mine in candidates(seeds, ~gone, not told))
        for s, mass, mine in found:
            members = pa.array([pa.array(mine, id_type).to_pylist()], pa.list_(id_type))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array(ids[[s]], id_type), pa.array([int(mass)], pa.int64()), members], names=["part", "seed", "mass", "members"])

    def grown(rows: DataFrame, told: bool = False) -> DataFrame:
        """Candidates of the rows that are `due`; those of a twin that is greater have no mass unless `told`."""
        slices = F.least(F.lit(SEED_TASKS), F.ceil(F.count_if("due") / SEEDS)).cast("long")
        y = rows.join(rows.groupBy("cell").agg(slices.alias("slices")).filter("slices > 0"), "cell")
        y = y.withColumns({"at": F.when(F.col("due"), F.pmod(F.xxhash64("id"), "slices")), "slice": F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))})
        y = y.select("part", "cell", "slice", "id", "x", "n", "gone", F.lit(told).alias("told"), F.coalesce(F.col("at") == F.col("slice"), F.lit(False)).alias("due"))
        return y.repartition(dealt, "cell", "slice").groupBy("cell", "slice").applyInArrow(grow, f"part long, seed {kind}, mass long, members array<{kind}>")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, turn, mass, seed, id) of all clusters of a part."""
        g = pa.Table.from_batches(batches).sort_by("id")
        part, turn, id_type = g["part"][0].as_py(), g["turn"][0].as_py(), g.schema.field("id").type
        ids, n, candidates = _qt_rows(g, most_diameter, metric)
        left, now = np.ones(len(ids), bool), {}
        while left.any() and (rounds is None or turn < rounds):
            now |= candidates(np.array([s for s in np.flatnonzero(left) if now.get(s) is None], int), left, True)
            mass = {s: int(n[mine].sum()) for s, mine in now.items() if mine}
            best = min(mass, key=lambda s: (-mass[s], s))
            mine = now[best]
            left[mine] = False
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.full(len(mine), v), pa.int64()) for v in (part, turn, mass[best])), pa.array(ids[np.full(len(mine), best)], id_type), pa.array(ids[mine], id_type)], names=["part", "turn", "mass", "seed", "id"]
            )
            now = {s: v for s, v in now.items() if left[s] and v and left[v].all()}
            turn += 1

    kept: list[str] = []
    left, out, now, last, turn = written(cells, "left", kept), [], None, [], 0
    while True:
        sizes = left.filter("not guest and not gone").groupBy("part").agg((F.count(F.lit(1)) <= REST).alias("small"))
        small, large = sizes.agg(F.count_if("small"), F.count_if(~F.col("small"))).first()
        if small:
            ends = left.filter("not guest and not gone").join(sizes.filter("small"), "part").select("part", "id", "x", "n", F.lit(turn).cast("long").alias("turn"))
            out.append(written(ends.repartition(dealt, "part").groupBy("part").applyInArrow(end, f"part long, turn long, mass long, seed {kind}, id {kind}"), "ends"))
            left = written(left.join(sizes.filter("not small"), "part", "left_semi"), "left", kept)
        if not large or turn == rounds:
            break
        due = left if now is None else left.join(left.filter("gone").select("cell").distinct(), "cell", "left_semi")
        new = written(grown(due.withColumn("due", ~F.col("guest") & ~F.col("gone"))).drop("members"), "grown")
        stay = left.filter("not guest and not gone").select(F.col("id").alias("seed"))
        now = written(new if now is None else now.join(stay, "seed", "left_semi").join(new.select("seed"), "seed", "left_anti").unionByName(new), "candidates", last)
        best = now.groupBy("part").agg(F.min_by("seed", F.struct(-F.col("mass"), "seed")).alias("best"))
        at = left.filter("not guest").join(best, "part").filter(F.col("id") == F.col("best")).select("cell", "best")
        told = grown(left.filter("not gone").join(at, "cell").withColumn("due", ~F.col("guest") & (F.col("id") == F.col("best"))).drop("best"), True)
        out.append(written(told.select("part", F.lit(turn).cast("long").alias("turn"), "mass", "seed", F.explode("members").alias("id")), "won"))
        gone = out[-1].select("id", F.lit(True).alias("taken"))
        left = written(left.filter("not gone").join(gone, "id", "left").withColumn("gone", F.coalesce("taken", F.lit(False))).select(*cells.columns), "left", kept)
        turn += 1
    named = same.select("x", "own", F.lit(-1).cast("long").alias("label")).limit(0)
    if out:
        all_ = out[0]
        for o in out[1:]:
            all_ = all_.unionByName(o)
        first = all_.groupBy("part", "turn").agg(F.first(F.struct(-F.col("mass"), "seed")).alias("place"))
        first = first.withColumn("place", F.max("place").over(Window.partitionBy("part").orderBy("turn")))
        first = first.withColumn("label", F.row_number().over(Window.orderBy("place", "turn")).cast("long") - 1).drop("place")
        first = first if rounds is None else first.filter(F.col("label") < rounds)
        named = all_.join(first, ["part", "turn"]).select("id", "label").join(same, "id").select("x", "own", "label")
    named = written(named, "labels").select(F.col("x").alias("_x"), F.col("own").alias("_own"), "label")
    mine = points.select("id", x.alias("x"), own.alias("own"))
    return mine.join(named, (F.col("x") == F.col("_x")) & F.col("own").eqNullSafe(F.col("_own")), "left").select("id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def converging_squares(frames: DataFrame, start: int, least: int, how: str = "mean") -> DataFrame:
    """(t, row, col, size): squares of side `start` above the frame's deviation, shrunk step by step to the best of the four
    that drop one row and one column, down to `least`."""
    from .wavelet import map_frames

    score = {"mean": np.mean, "max": np.max, "sum": np.sum}[how]

    def one(t: int, x: np.ndarray) -> Iterator[tuple]:
        th, seen = x.std(), set()
        for r in range(0, x.shape[0] - start + 1, start):
            for c in range(0, x.shape[1] - start + 1, start):
                if score(x[r : r + start, c : c + start]) <= th:
                    continue
                a, b, n = r, c, start
                while n > least:
                    n -= 1
                    a, b = max(((a + i, b + j) for i in (0, 1) for j in (0, 1)), key=lambda p: score(x[p[0] : p[0] + n, p[1] : p[1] + n]))
                if (a, b) not in seen:
                    seen.add((a, b))
                    yield t, a, b, n

    return map_frames(frames, one, "t long, row int, col int, size int")


def gng(points: DataFrame, key: str, nodes: int = 20, rounds: int = 2000, every: int = 100, seed: int = 0) -> DataFrame:
    """(key, node, c, error) of a growing neural gas per group: sequential by nature, so groups are the parallelism."""

    def one(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        x = np.stack(g.sort_values("id")["x"].to_numpy()).astype(float)
        c, err, age = x[rng.integers(0, len(x), 2)].copy(), np.zeros(2), {}
        for i in range(1, rounds + 1):
            p = x[rng.integers(len(x))]
            d = ((c - p) ** 2).sum(1)
            s, t = np.argsort(d, kind="stable")[:2]
            err[s] += d[s]
            c[s] += 0.05 * (p - c[s])
            for e in [e for e in age if s in e]:
                age[e] += 1
                o = e[0] if e[1] == s else e[1]
                c[o] += 0.006 * (p - c[o])
            age[min(s, t), max(s, t)] = 0
            age = {e: a for e, a in age.items() if a < 50}
            if i % every == 0 and len(c) < nodes:
                q = int(err.argmax())
                f = max((e[0] if e[1] == q else e[1] for e in age if q in e), key=lambda o: err[o], default=(q + 1) % len(c))
                c, err = np.vstack([c, (c[q] + c[f]) / 2]), np.append(err, err[q] / 2)
                err[q] /= 2
                age.pop((min(q, f), max(q, f)), None)
                age[min(q, len(c) - 1), max(q, len(c) - 1)] = age[min(f, len(c) - 1), max(f, len(c) - 1)] = 0
            err *= 0.995
        return pd.DataFrame({key: k[0], "node": range(len(c)), "c": list(c), "error": err})

    return points.groupBy(key).applyInPandas(one, f"{key} {dict(points.dtypes)[key]}, node long, c array<double>, error double")
