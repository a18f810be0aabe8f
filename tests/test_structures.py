"""Frame ranges against whole reads, tiled regions and the object forest against plain searches."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest

from lumenstack.operators import cluster, forest, layout, register, spatial, tracking, wavelet
from lumenstack.sources import images, ranges, synthetic

F = forest.F


def frames_of(spark, x):
    return spark.createDataFrame([(t, *i.shape, i.ravel().tolist()) for t, i in enumerate(x)], "t long, h int, w int, data array<double>")


def images_of(df):
    return {r["t"]: np.array(r["data"]).reshape(r["h"], r["w"]) for r in df.collect()}


@pytest.mark.parametrize("kind,options", [("npy", {}), ("npy", {"dtype": "<f4"}), ("mlf", {}), ("raw", {"h": 5, "w": 7, "dtype": "<i4"})])
def test_ranges_round_trip(spark, tmp_path, kind, options):
    x = np.random.default_rng(0).integers(0, 60_000, (53, 5, 7)).astype(float)
    path = f"file://{tmp_path}/stack"
    ranges.write_ranges(frames_of(spark, x).repartition(5), path, kind, 3, **options)
    assert sorted(os.listdir(tmp_path / "stack")) == [f"part-0000{k}.{kind}" for k in range(3)]
    df = ranges.read_ranges(spark, path, kind, task_bytes=700, **options)
    got = images_of(df)
    assert sorted(got) == list(range(53)) and all((got[t] == x[t]).all() for t in got)
    # A filter on t takes ranges out of the plan; other filters are still Spark's.
    some = df.filter("t >= 10 and t < 30 and t <> 12 and h = 5")
    assert sorted(r["t"] for r in some.collect()) == [t for t in range(10, 30) if t != 12] and some.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    assert sorted(r["t"] for r in df.filter("t in (0, 17, 18, 52, 90)").collect()) == [0, 17, 18, 52]
    assert df.filter("t = 4 and t > 7").count() == 0 and df.filter("t > 52").count() == 0
    if kind != "raw":  # the reader of whole files sees the same
        whole = images_of(images.open_seq(spark, f"{path}/*.{kind}", suffix=kind))
        assert sorted(whole) == sorted(got) and all((whole[t] == got[t]).all() for t in got)


def test_ranges_of_odd_files(spark, tmp_path):
    one = tmp_path / "f10.npy"
    np.save(one, np.arange(6.0).reshape(2, 3))
    np.save(tmp_path / "f9.npy", np.arange(24).reshape(4, 2, 3))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = images_of(ranges.read_ranges(spark, str(tmp_path), "npy"))
    assert sorted(got) == [0, 1, 2, 3, 4] and (got[4] == np.arange(6.0).reshape(2, 3)).all()
    # A file that was cut short has its whole frames.
    data = (tmp_path / "f9.npy").read_bytes()
    (tmp_path / "f9.npy").write_bytes(data[:-1])
    assert images_of(ranges.read_ranges(spark, str(tmp_path / "f9.npy"), "npy")).keys() == {0, 1, 2}
    head = bytearray(0x10000)
    head[:18] = b"moorFLPI Live Image"[:18]
    with pytest.raises(ValueError):
        ranges.layout("mlf", bytes(head), 1 << 20, {})
    with pytest.raises(ValueError):
        ranges.layout("tiff", b"", 0, {})
    (tmp_path / "none").mkdir()
    assert ranges.read_ranges(spark, str(tmp_path / "none"), "npy").count() == 0
    twice = frames_of(spark, np.zeros((2, 2, 2))).withColumn("t", F.lit(1).cast("long"))
    with pytest.raises(Exception, match="unlike in t"):
        ranges.write_ranges(twice, f"file://{tmp_path}/twice", "npy", 1)
    assert not [f for f in os.listdir(tmp_path / "twice") if f.startswith("part")]


def flood(x, offsets):
    name = np.full(x.shape, -1)
    for r, c in zip(*np.nonzero(x), strict=True):
        if name[r, c] < 0:
            todo, name[r, c] = [(r, c)], r * x.shape[1] + c
            while todo:
                a, b = todo.pop()
                for i, j in offsets:
                    p = a + i, b + j
                    if 0 <= p[0] < x.shape[0] and 0 <= p[1] < x.shape[1] and x[p] and name[p] < 0:
                        name[p] = name[r, c]
                        todo.append(p)
    return name


@pytest.mark.parametrize("tile", [4, 7, 64])
@pytest.mark.parametrize("offsets", [spatial.AXIS, [o for o in spatial.SQUARE if o != (0, 0)]])
def test_tiled_regions(spark, tile, offsets):
    """Random pixels, one snake through all tiles, and a frame that is full."""
    rng = np.random.default_rng(1)
    snake = np.zeros((23, 31), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    frames = {0: rng.random((23, 31)) < 0.55, 3: snake, -2: np.ones((23, 31), bool)}
    rows = [(t, int(r), int(c)) for t, x in frames.items() for r, c in zip(*np.nonzero(x), strict=True)]
    df = spark.createDataFrame(rows + rows[:5], "t long, row int, col int")
    got = {(r["t"], r["row"], r["col"]): r["region"] for r in spatial.regions(df, 23, 31, offsets, tile).collect()}
    assert got == {(t, r, c): flood(frames[t], offsets)[r, c] for t, r, c in rows}
    assert spatial.regions(df.limit(0), 23, 31, offsets, tile).count() == 0


def brute_forest(x, level, k):
    """Nodes {(level, region): (pixels, peak, peak place, parent)} of one image."""
    coefs, sigma = forest.starlet2d(x, level), forest.noise(x)
    labels = [flood(coefs[j] > k * sigma * forest.SIGMA_2D[j], spatial.AXIS) for j in range(level)]
    out = {}
    for j in range(level):
        for n in set(labels[j][labels[j] >= 0].tolist()):
            at = np.argwhere(labels[j] == n)
            top = tuple(max(at.tolist(), key=lambda p: (coefs[j][tuple(p)], -p[0], -p[1])))
            up = int(labels[j + 1][top]) if j + 1 < level else -1
            out[j, n] = (set(map(tuple, at.tolist())), coefs[j][top], top, (j + 1, up) if up >= 0 else None)
    return coefs, out


def brute_objects(x, level, k, min_scales, min_pixels):
    coefs, nodes = brute_forest(x, level, k)
    kids = {n: sorted(c for c, v in nodes.items() if v[3] == n) for n in nodes}

    def tree(n):
        return [n, *(y for c in kids[n] for y in tree(c))]

    scales = lambda n: max(c[0] for c in tree(n)) - min(c[0] for c in tree(n)) + 1
    roots = [n for n, v in nodes.items() if v[3] is None and kids[n] and scales(n) >= min_scales]
    cut = []
    for n in [y for r in roots for y in tree(r)]:
        for b in kids[n]:
            near = min(kids[b], key=lambda c: (np.square(np.subtract(nodes[c][2], nodes[b][2])).sum(), c), default=None)
            if len(kids[n]) > 1 and nodes[b][1] > (nodes[near][1] if near else 0) and nodes[b][1] > max(coefs[b[0] + 1][p] for p in nodes[b][0]):
                cut.append((n, b))
    for n, b in cut:
        kids[n].remove(b)
    out = []
    for r in [*roots, *(b for _, b in cut)]:
        places = set().union(*(nodes[n][0] for n in tree(r)))
        if scales(r) < min_scales or len(places) <= min_pixels:
            continue
        image = sum((np.where([[(a, b) in nodes[n][0] for b in range(x.shape[1])] for a in range(x.shape[0])], coefs[n[0]], 0) for n in tree(r) if n[0] > 0), np.zeros(x.shape))
        if (image > 0).sum() > min_pixels:
            out.append((-sum(len(nodes[n][0]) for n in tree(r)), -r[0], r[1], image))
    return [o[-1] for o in sorted(out, key=lambda o: o[:3])], len(cut)


def test_forest_brute(spark):
    """Blended blobs and noise: nodes, trees and objects of each frame are those of a plain search, with branches cut."""
    rng = np.random.default_rng(4)
    yy, xx = np.mgrid[:40, :40]
    blob = lambda r, c, s, a: a * np.exp(-((yy - r) ** 2 + (xx - c) ** 2) / (2 * s * s))
    x = [np.round(64 * (blob(12, 12, 2, 20) + blob(18, 17, 1.5, 25) + blob(15, 15, 9, 6) + blob(30, 8 + 3 * t, 2, 12) + rng.normal(0, 0.7, (40, 40)))) / 64 for t in range(3)]
    frames = frames_of(spark, [*x, np.zeros((40, 40))])
    labelled = forest.structures(forest.significant(frames, 4, 3.0), 40, 40)
    held = forest.rooted(forest.nodes(labelled), 4)
    for r in held.collect():
        _, nodes = brute_forest(x[r["t"]], 4, 3.0)
        places, peak, top, parent = nodes[r["level"], r["region"]]
        assert (r["mass"], r["peak"], (r["peak_row"], r["peak_col"])) == (len(places), peak, top) and r["parent"] == (parent[1] if parent else None)
        root = (r["level"], r["region"])
        while nodes[root][3]:
            root = nodes[root][3]
        assert root == (r["root_level"], r["root"])
    found = forest.find_objects(frames, 4, 3.0, 2, 6).collect()
    cuts = 0
    for t in range(4):
        want, n = brute_objects([*x, np.zeros((40, 40))][t], 4, 3.0, 2, 6)
        cuts += n
        mine = [np.zeros((40, 40)) for _ in want]
        for r in found:
            if r["t"] == t:
                mine[r["obj"]][r["row"], r["col"]] = r["value"]
        assert all(np.allclose(a, np.maximum(b, 0)) for a, b in zip(mine, want, strict=True)) and (len(want) > 1 or t == 3)
    assert cuts > 1
    kept = forest.find_objects(frames, 4, 3.0, 2, 6, deblended=False)
    assert kept.select("t", "obj").distinct().count() < len({(r["t"], r["obj"]) for r in found})
    assert forest.find_objects(frames.limit(0), 4).count() == 0


def cloud(n, dims, rng):
    """Clusters of twenty points each, spread over a cube that grows with their number, and one tight heap of copies."""
    centres = rng.uniform(0, (n / 20) ** (1 / dims) * 4, (max(1, n // 20), dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.3, (n, dims))
    x[: n // 50] = x[0]
    return x


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "pearson"])
def test_near_pairs_by_pivot_tree(spark, metric):
    """Leaves of a few points, so that splits go deep; every pair once, in each metric."""
    rng = np.random.default_rng(8)
    x = cloud(900, 3, rng)
    x[5], eps = 0, {"euclidean": 0.5, "cityblock": 0.8, "pearson": 0.002}[metric]
    ids = rng.permutation(5000)[: len(x)]
    p = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(9999, None)], "id long, x array<double>")
    got = [(r["a"], r["b"], r["distance"]) for r in cluster.near_pairs(p, eps, 4, 16, metric, 12).collect()]
    if metric == "pearson":
        u = x - x.mean(1, keepdims=True)
        norm = np.sqrt((u**2).sum(1))
        d = np.where((norm[:, None] > 0) & (norm > 0), 1 - (u @ u.T) / np.maximum(norm[:, None] * norm, 1e-300), 9)
    else:
        d = sum(np.abs(x[:, None, k] - x[None, :, k]) ** (2 if metric == "euclidean" else 1) for k in range(3))
        d = np.sqrt(d) if metric == "euclidean" else d
    i, j = np.nonzero(np.tril(d <= eps + 1e-9, -1))
    want = {(min(ids[a], ids[b]), max(ids[a], ids[b])): d[a, b] for a, b in zip(i, j, strict=True)}
    edge = {k for k, v in want.items() if abs(v - eps) < 1e-8}
    assert len(got) == len({g[:2] for g in got}) and {g[:2] for g in got} - edge == set(want) - edge and len(want) > 900
    assert all(abs(g[2] - want[g[:2]]) < 1e-7 for g in got if g[:2] in want)
    assert cluster.near_pairs(p.filter("x is null"), eps, metric=metric).count() == 0


def test_pivot_tree_work_per_point(spark):
    """Pairs compared for each point stay about the same for ten times the points, copies aside."""
    work = []
    for n in (2000, 20_000):
        x = cloud(n, 3, np.random.default_rng(2))[n // 50 :]
        cells = cluster.near_cells(spark.createDataFrame(list(enumerate(x.tolist())), "id long, x array<double>"), 0.3, leaf=128)
        sums = cells.groupBy("cell").agg(F.count_if(~F.col("guest")).alias("m"), F.count(F.lit(1)).alias("n")).select(F.sum(F.col("m") * (F.col("n") - F.col("m") / 2))).first()[0]
        work.append(sums / n)
    assert work[1] < 2 * work[0] and work[1] < 1000


@pytest.mark.parametrize("scale,eps", [(0.1, 7.0), (100.0, 2.0), (1e32, 1e33), (0.1, 100.0)])
def test_cityblock_leaves_no_near_pair_out(scale, eps):
    rng = np.random.default_rng(7)
    x, y = rng.normal(0, scale, (150, 64)), rng.normal(0, scale, (1100, 64))
    y[:9] = x[:9] + rng.uniform(0, eps / 65, (9, 64))
    got = {(int(a), int(b)) for i, j in cluster._close_cityblock(x, y, eps) for a, b in zip(i, j, strict=True)}
    want = set(zip(*(k.tolist() for k in np.nonzero(np.abs(x[:, None] - y).sum(-1) <= eps)), strict=True))
    assert len(want) >= 9 and want <= got


@pytest.mark.parametrize("scale,eps", [(0.1, 1.1), (0.1, 0.01), (1e4, 9e4), (1e-9, 1e-8), (1e20, 1e21), (0.0, 0.0), (1e160, 1e161)])
def test_euclidean_leaves_no_near_pair_out(scale, eps):
    rng = np.random.default_rng(7)
    x, y = rng.normal(0, 1, (300, 64)) * scale, rng.normal(0, 1, (2100, 64)) * scale
    y[:9] = x[:9]
    y[9:18] = x[9:18] + eps / 8 * (1 - 1e-9)
    got = [(int(a), int(b)) for i, j in cluster._close_euclidean(x, y, eps) for a, b in zip(i, j, strict=True)]
    want = set(zip(*(k.tolist() for k in np.nonzero(np.stack([np.hypot.reduce(v - y, axis=1) for v in x]) <= eps)), strict=True))
    assert len(want) >= 18 and want <= set(got) and len(got) == len(set(got))


def _block_rows(x, i, j, step=5000):
    """Rows of blocks i and j, dealt out by turns, as the batches of a task."""
    for k in range(0, len(x), step):
        n = len(x[k : k + step])
        at = np.where(np.arange(k, k + n) % 2, i, j)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.full(n, j)), pa.array(at), pa.array(np.arange(k, k + n)), pa.array(list(x[k : k + n]))], names=["i", "j", "at", "id", "x"])


@pytest.mark.parametrize("i,j", [(0, 0), (0, 1)])
def test_near_rows_in_pieces(i, j):
    """Each pair of two blocks once, whatever pieces the rows come in; a block without finite rows has no pairs."""
    x = np.random.default_rng(3).normal(0, 1, (400, 3))
    x[7, 1] = np.nan
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    a, b = np.nonzero(np.triu(d <= 0.4, 1))
    want = sorted((int(p), int(q)) for p, q in zip(a, b, strict=True) if i == j or (p + q) % 2)
    for step in (400, 64, 1):
        got = pa.Table.from_batches(cluster.near_rows(_block_rows(x, i, j, step), 0.4, "euclidean"))
        assert sorted(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == want and len(want) > 100
    x[::2] = np.inf
    assert i == j or not list(cluster.near_rows(_block_rows(x, i, j), 0.4, "euclidean"))


@pytest.mark.parametrize("copies", [False, True])
def test_near_rows_hold_blocks_once(copies):
    """A task needs its blocks' rows once and a fixed room beside them, however many of their pairs are near."""
    x = np.random.default_rng(3).normal(0, 1, (5000 if copies else 30_000, 64))
    x[:2500] = x[0] if copies else x[:2500]
    tracemalloc.start()
    try:
        n = sum(len(g) for g in cluster.near_rows(_block_rows(x, 0, 1), 8.0, "euclidean"))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < x.nbytes + 40e6 and n > (1250**2 if copies else 10_000) - 1


def test_near_pairs_sent_rows(spark):
    """In many dimensions no split helps: the cell stays whole, its block pairs are many tasks', and small blocks do not multiply it."""
    x = np.random.default_rng(4).normal(0, 1, (1500, 48))
    p = spark.createDataFrame(list(enumerate(x.tolist())), "id long, x array<double>")
    assert cluster.near_cells(p, 7.0, leaf=40).count() == 1500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cluster.near_pairs(p, 7.0, 8, 4, leaf=40).select("a", "b", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert {(r["a"], r["b"]) for r in got} == set(zip(*(k.tolist() for k in np.nonzero(np.triu(d <= 7.0, 1))), strict=True)) and len(got) > 100
    assert len({r["task"] for r in got}) > 1
    sent = spark.range(1).select(*[cluster._blocks(F.lit(n), 4).alias(str(n)) for n in (0, 1, 9, 1500, 10_000_000)]).first()
    assert tuple(sent) == (0, 1, 3, 16, 306)


@pytest.mark.parametrize("block", [5, 2048])
def test_diameters_brute(spark, block):
    rng = np.random.default_rng(3)
    shapes = {0: rng.normal(0, 1, (200, 3)), 1: rng.normal(5, 0.1, (1, 3)), 2: np.ones((7, 3)), 3: (lambda a: np.c_[np.cos(a), np.sin(a), 0 * a])(rng.uniform(0, 7, 150)), 4: np.array([[0, 0, 0.0], [3, 4, 0], [3, 4, 0]])}
    rows = [(k, 1000 * k + i, v.tolist()) for k, x in shapes.items() for i, v in enumerate(x)] + [(0, 77, None)]
    got = {r["label"]: r["diameter"] for r in cluster.diameters(spark.createDataFrame(rows, "label long, id long, x array<double>"), block).collect()}
    assert got == pytest.approx({k: np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).max() for k, x in shapes.items()})
    assert cluster.diameters(spark.createDataFrame(rows[:0], "label long, id long, x array<double>")).count() == 0


def test_diameters_sent_rows(spark):
    """Small blocks do not multiply the points: a label has at most 16 blocks and one for each of its 16 bands."""
    x = np.random.default_rng(9).normal(0, 1, (1000, 32))
    tables, graph_written = {}, cluster.written

    def written(df, name, *a):
        tables[name] = graph_written(df, name, *a)
        return tables[name]

    cluster.written = written
    try:
        got = cluster.diameters(spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "label long, id long, x array<double>"), 2).first()[1]
    finally:
        cluster.written = graph_written
    assert got == pytest.approx(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).max())
    assert 4 < tables["bands"].agg(F.sum("blocks")).first()[0] <= 32


def test_quality_threshold_rounds_brute(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.5, (40, 2)) for c in ((0, 0), (3, 1), (8, 8))] + [np.ones((9, 2))])
    ids = rng.permutation(1000)[: len(x)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    order, left, want, k = np.argsort(ids), set(range(len(x))), {}, 0
    while left:
        best = []
        for s in (i for i in order if i in left):
            mine, rest = [s], left - {s}
            while rest:
                nearest = min(rest, key=lambda i: (d[i, mine].max(), ids[i]))
                if d[nearest, mine].max() >= 1.5:
                    break
                mine.append(nearest)
                rest.remove(nearest)
            if len(mine) > len(best):
                best = mine
        want |= {int(ids[i]): k for i in best}
        left -= set(best)
        k += 1
        if k == 4:
            break
    p = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(5000, None)], "id long, x array<double>")
    got = {r["id"]: r["label"] for r in cluster.qt_clusters(p, 1.5, 4).collect()}
    assert got == {int(i): want.get(int(i), -1) for i in ids} | {5000: -1}
    assert {r["label"] for r in cluster.qt_clusters(p.filter("id < 30"), 1.5).collect()} >= {0, 1}
    assert cluster.qt_clusters(p.limit(0), 1.5).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
def test_quality_threshold_growth_with_ties(metric):
    """Scores with their slack take the points that exact distances take, on grids of equal distances too."""
    exact, rng = cluster.METRICS[metric][1], np.random.default_rng(0)
    for x, most in ((rng.integers(0, 6, (200, 2)), 3.0), (rng.integers(0, 5, (200, 3)) * 0.1 + 1000, 0.2), (rng.normal(size=(300, 3)), 1.5), (np.zeros((1, 2)), 1.0)):
        x = np.unique(x, axis=0).astype(float)
        for k in range(0, len(x), 7):
            want, far, at = [], np.zeros(len(x)), k
            while not want or far[at] < most:
                want.append(at)
                far = np.maximum(far, exact(x, x[[at]]))
                far[want] = np.inf
                at = int(far.argmin())
            assert cluster._grow(x, x - x.mean(0), k, most, metric) == want


def test_quality_threshold_holds_no_pairs(spark):
    """Where all points are near one another, what is written grows with the points and not with their pairs."""
    x = np.random.default_rng(6).normal(0, 1, (600, 24))
    graph_written, rows = cluster.written, []

    def written(df, name, *a):
        out = graph_written(df, name, *a)
        rows.append(out.count())
        return out

    cluster.written = written
    try:
        got = cluster.qt_clusters(spark.createDataFrame(list(enumerate(x.tolist())), "id long, x array<double>"), 9.0, 2)
        assert {r["label"] for r in got.select("label").distinct().collect()} >= {0, 1}
    finally:
        cluster.written = graph_written
    assert max(rows) <= 600


def test_quality_threshold_query_leaves_no_point(spark):
    """The query goes on until every vector has a cluster."""
    from lumenstack.plans import registry

    sizes = {r["label"]: r["count"] for r in registry.queries()["qt_clusters"](spark, "/root/testdata/sf0.001").groupBy("label").count().collect()}
    assert sorted(sizes) == list(range(len(sizes))) and len(sizes) > 3 and sum(sizes.values()) == 500


def _quality_threshold(x, ids, most):
    """Labels by id, of a plain search over all distances."""
    x, ids = x[np.argsort(ids)], np.sort(ids)
    d, left, label = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), np.ones(len(x), bool), {}
    for turn in range(len(x)):
        best = []
        for s in np.flatnonzero(left):
            mine, far = [s], np.where(left, d[s], np.inf)
            far[s] = np.inf
            while far.min() < most:
                mine.append(far.argmin())
                far = np.maximum(far, d[mine[-1]])
                far[mine] = np.inf
            best = mine if len(mine) > len(best) else best
        label |= {int(ids[k]): turn for k in best}
        left[best] = False
        if not left.any():
            return label


def test_quality_threshold_parts(spark, monkeypatch):
    """Parts that do not touch have their rounds together, small ones are ended by a task, and labels are those of one search over all."""
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.8, 40), ((30, 0), 1.5, 30), ((0, 40), 0.3, 12), ((60, 60), 0.5, 9))] + [rng.integers(0, 4, (25, 2)) + 100.0, rng.uniform(200, 300, (12, 2))])
    ids = rng.permutation(1000)[: len(x)]
    want, whole = _quality_threshold(x, ids, 1.3), cluster.near_cells
    monkeypatch.setattr(cluster, "near_cells", lambda p, eps, metric, whole_=True, **k: whole(p, eps, metric, 6, 8, True))
    p = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, x array<double>")
    monkeypatch.setattr(cluster, "DEALT", 4)
    for rest, rounds in ((14, None), (1, 2)):
        monkeypatch.setattr(cluster, "REST", rest)
        got = {r["id"]: r["label"] for r in cluster.qt_clusters(p, 1.3, rounds).collect()}
        assert got == {i: k if rounds is None or k < rounds else -1 for i, k in want.items()}


def test_quality_threshold_of_odd_vectors_as_in_sql(spark, tmp_path):
    """Null vectors have no cluster, those that are not finite have their own, copies too."""
    import duckdb

    from lumenstack.plans import registry

    v = np.random.default_rng(12).normal(0, 1, (40, 3)).round(1).tolist()
    v += v[:6] + [None, None, [np.nan, 0, 0], [np.nan, 0, 0], [np.inf, 1, 1], [np.inf, 1, 1], [-np.inf, 0, 0], [1e18, 0, 0], [-1e18, 0, 0], [0.0, 0.0, 0.0], [-0.0, 0.0, 0.0]]
    pa.parquet.write_table(pa.table({"vec_id": pa.array(range(100, 100 + len(v)), pa.int64()), "embedding": pa.array(v, pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = dict(con.execute(f"SELECT id, label FROM ({registry.oracle_sql()['qt_clusters']})").fetchall())
    got = {r["id"]: r["label"] for r in registry.queries()["qt_clusters"](spark, str(tmp_path)).collect()}
    assert got == want and sorted(k for k, n in got.items() if n < 0) == [146, 147]


@pytest.mark.parametrize("size,most", [(1.0, 4.0), (1e8, 4e8), (1e160, 4e160)])
def test_quality_threshold_grows_seeds_together(size, most):
    """Seeds grown together have the candidates that they have alone; one is skipped only where a smaller seed has the same."""
    rng = np.random.default_rng(13)
    x = rng.normal(0, 1, (400, 5)) * size
    exact = cluster.METRICS["euclidean"][1]
    with np.errstate(over="ignore"):
        growth = cluster._Growth(x, x - x.mean(0), most, "euclidean")
        every, some = dict(growth.together(np.arange(400), False)), dict(growth.together(np.arange(400), True))
    skipped = [s for s in some if some[s] is None]
    assert len(every) == len(some) == 400 and (size > 1e100 or len(skipped) > 40)
    assert all(any(set(every[t]) == set(every[s]) for t in every[s] if t < s) for s in skipped) and all(v is None or v == every[s] for s, v in some.items())
    for s in range(0, 400, 40) if size < 1e100 else ():
        want, far = [], np.zeros(400)
        at = s
        while not want or far[at] < most:
            want.append(at)
            far = np.maximum(far, exact(x, x[[at]]))
            far[want] = np.inf
            at = int(far.argmin())
        assert every[s] == want


def test_cubic_warps():
    """The spline passes through the pixels, is exact for cubics inside, and holds the nearest value outside."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (9, 12))
    r, c = np.mgrid[:9, :12].astype(float)
    assert np.allclose(register.bicubic(x, r, c), x) and np.allclose(register.warp(x, "shift", [2, -3], 3)[2:, :-3], x[:-2, 3:])
    assert np.allclose(register.warp(x, "shift", [50, 0], 3), x[:1])
    # Coefficients solve the interpolation at every pixel, mirrored at the edges.
    k = register.spline_coefficients(x)
    p = np.pad(k, 1, "reflect")
    down = (p[:-2] + 4 * p[1:-1] + p[2:]) / 6
    assert np.allclose((down[:, :-2] + 4 * down[:, 1:-1] + down[:, 2:]) / 6, x)
    wide = np.mgrid[:60, :60][0] / 10.0
    smooth = np.sin(wide) + wide**2
    between = register.bicubic(smooth, np.full((1, 1), 30.5), np.full((1, 1), 20.25))[0, 0]
    assert abs(between - (np.sin(3.05) + 3.05**2)) < 1e-5 < abs(register.bilinear(smooth, np.full((1, 1), 30.5), np.full((1, 1), 20.25))[0, 0] - (np.sin(3.05) + 3.05**2))
    assert np.allclose(register.bicubic(np.ones((1, 1)), np.zeros((1, 1)), np.zeros((1, 1))), 1)


def test_follow_template(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(100, 5, (20, 26))
    t = rng.normal(0, 3, (4, 5))
    score = tracking.template_scores(x, t)
    squares = tracking.template_scores(x, t, "squares")
    for r in range(17):
        for c in range(22):
            w = x[r : r + 4, c : c + 5]
            assert abs(score[r, c] - np.corrcoef(w.ravel(), t.ravel())[0, 1]) < 1e-9 and abs(squares[r, c] + ((w - t) ** 2).sum()) < 1e-6
    moving = []
    for k in range(6):
        f = rng.normal(0, 0.3, (20, 26))
        f[2 + 2 * k : 6 + 2 * k, 3 * k : 3 * k + 5] += t
        moving.append(f)
    frames = frames_of(spark, [*moving, np.zeros((20, 26)), np.zeros((3, 3))])
    for how in ("correlation", "squares"):
        got = {r["t"]: (r["row"], r["col"]) for r in tracking.follow_template(frames, t, how=how).collect()}
        assert got == {k: (2 + 2 * k, 3 * k) for k in range(6)} | {6: (0, 0)}
    near = {r["t"]: (r["row"], r["col"]) for r in tracking.follow_template(frames, t, (6, 6), 1).collect()}
    assert near[2] == (6, 6) and all(5 <= a <= 7 and 5 <= b <= 7 for a, b in near.values()) and 7 not in near


def test_local_contours(spark):
    """Where a vessel fades along the scan, walls by the means around each line are within a pixel and those by global means are not."""
    lines = synthetic.vessel(spark, 120, 40, 10, 28)
    rows = [(r["seq"], r["t"], [v * (0.15 + 2.0 * r["t"] / 119) + 0.3 * r["t"] / 119 for v in r["v"]]) for r in lines.collect()]
    faded = spark.createDataFrame(rows, "seq int, t long, v array<double>")
    even = {r["t"]: r for r in tracking.contour_walls(lines, "seq", 2).collect()}
    local = {r["t"]: r for r in tracking.contour_walls(faded, "seq", 2).collect()}
    whole = {r["t"]: r for r in tracking.contour_walls(faded, "seq").collect()}
    truth = {0: synthetic.ar1(120, 0.9, 0) * 0.3 + 10, 1: synthetic.ar1(120, 0.9, 1) * 0.3 + 28}
    off = lambda got: np.array([[abs(got[t][c] - truth[i][t]) for t in range(120)] for i, c in enumerate(("lower", "upper"))])
    assert off(even).max() < 1 and off(local).max() < 1.0 < off(whole).max() and all(r["diameter"] == r["upper"] - r["lower"] for r in local.values())
    flat = np.ones((30, 9))
    flat[10:20, :4] = 5
    lo, hi = tracking.local_contours(flat, 0)  # columns without contrast keep near the others
    assert np.abs(lo[:3] - 9.5).max() < 1.5 and np.abs(lo - lo.mean()).max() < 6 and (lo <= hi).all()


def test_noise_tables(spark):
    """White noise gives the published deviations in two and three dimensions, and for the hybrid of medians and the starlet."""
    for size, want, n in (((96, 96), wavelet.SIGMA_2D, 3), ((24, 24, 24), wavelet.SIGMA_3D, 2)):
        got = {r["level"]: r["sigma"] for r in synthetic.noise_table(spark, n, size, 8).collect()}
        assert all(got[j] == pytest.approx(want[j], rel=0.1) for j in range(n))
    got = {r["level"]: r["sigma"] for r in synthetic.noise_table(spark, 2, (64, 64), 6, transform=wavelet.hybrid_pyramid).collect()}
    assert all(got[j] == pytest.approx(wavelet.SIGMA_MEDIAN_2[j], rel=0.1) for j in range(2))
    x = np.random.default_rng(0).normal(size=(20, 17))
    assert np.allclose(wavelet.starlet(x, 3), wavelet.starlet2d(x, 3))


def test_supports_of_every_kind(spark):
    values = [-3.0, -1.0, -0.2, 0.0, 0.2, 1.0, 3.0]
    df = spark.createDataFrame([(j, v) for j in range(3) for v in values], "level long, value double")
    of = lambda **k: {(r["level"], r["value"]): r["supp"] for r in wavelet.support(df, 1.0, table=(1.0, 0.5), **k).collect()}
    scale = {0: 1.0, 1: 0.5, 2: 0.5}
    for modulus in (True, False):
        m = abs if modulus else float
        assert of(k=1.0, modulus=modulus) == {(j, v): int(m(v) > scale[j]) for j in scale for v in values}
        assert of(k=1.0, modulus=modulus, neg=True, level_of_rest=2) == {(j, v): int(m(v) < scale[j]) if j < 2 else 0 for j in scale for v in values}
        assert of(k=[0.5, (1.0, 2.0)], modulus=modulus, level_of_rest=2) == {(j, v): 1 if j == 2 else int(m(v) > 0.5) if j == 0 else int(0.5 < m(v) <= 1.0) for j in scale for v in values}


def test_refined_lag_and_order(spark):
    t = np.arange(128.0)
    bump = lambda at: np.exp(-((t - at) ** 2) / 60)
    rows = [(0, k, bump(50 + d).tolist()) for k, d in enumerate((0.0, 7.4, -12.7))] + [(1, 0, [1.0] * 128)]
    df = spark.createDataFrame(rows, "row int, col int, v array<double>")
    got = {(r["row"], r["col"]): (r["lag"], r["value"]) for r in tracking.refined_lag(df, bump(50)).collect()}
    assert got[1, 0] == (None, None) and all(abs(got[0, k][0] + d) < 0.15 and got[0, k][1] > 0.8 for k, d in enumerate((0.0, 7.4, -12.7)))
    many = spark.range(300).selectExpr("cast(id div 20 as int) as row", "cast(id % 20 as int) as col", "array(1.0D) as v")
    one, two = ([(r["row"], r["col"]) for r in layout.shuffled(many, seed).collect()] for seed in (1, 2))
    assert one == [(r["row"], r["col"]) for r in layout.shuffled(many, 1).collect()] and one != two != sorted(two) and sorted(one) == sorted(two)


@pytest.mark.parametrize("kind", ["median", "hybrid", "starlet"])
def test_frame_kernels_hand_on_some_at_a_time(spark, kind):
    """A batch of many frames comes out in pieces of a bounded number of values."""
    import pyarrow as pa

    x = np.random.default_rng(2).normal(0, 1, (900, 8, 8))

    class Frames:
        def select(self, *_):
            return self

        def mapInArrow(self, fn, schema):
            b = pa.RecordBatch.from_pydict({"t": list(range(len(x))), "h": [8] * len(x), "w": [8] * len(x), "data": [v.ravel().tolist() for v in x]})
            return [b.to_pandas() for b in fn(iter([b]))]

        def mapInPandas(self, fn, schema):
            return self.mapInArrow(lambda bs: (pa.RecordBatch.from_pandas(o) for o in fn(b.to_pandas() for b in bs)), schema)

    out = wavelet.decompose2d(Frames(), 2, kind)
    assert sum(map(len, out)) == 900 * 192 and max(map(len, out)) <= (1 << 16) + 192
    kernel = {"median": wavelet.median_pyramid, "hybrid": wavelet.hybrid_pyramid, "starlet": wavelet.starlet2d}[kind]
    got = np.concatenate([o["value"].to_numpy() for o in out]).reshape(900, 3, 8, 8)
    assert np.allclose(got, [kernel(v, 2) for v in x])
    one = out[0].iloc[192:384]
    assert set(one["t"]) == {1} and one[["level", "row", "col"]].to_numpy().tolist() == np.argwhere(np.ones((3, 8, 8))).tolist()
    many = wavelet.map_frames(Frames(), lambda t, v: [(t, k) for k in range(100)], "t long, k long")
    assert sum(map(len, many)) == 90_000 and max(map(len, many)) <= 1 << 16


def test_lasaf_part_files(spark, tmp_path):
    """One export in part files: the gap lies between two of them; equal times, and the last of equal gaps."""
    for k, rows in enumerate(("0,0;1,5\n1,0;2,5\n", "9,0;3,5\n9,0;4,5\n", "17,0;5,5\n18,0;6,5\n")):
        (tmp_path / f"p{k}.txt").write_text("Axis; A\n" + rows)
    got = sorted(map(tuple, images.read_lasaf(spark, str(tmp_path), parts=True).collect()))
    assert got == [(0.0, 1.5, 0), (1.0, 2.5, 0), (9.0, 3.5, 0), (9.0, 4.5, 0), (17.0, 5.5, 1), (18.0, 6.5, 1)]
    each = sorted(map(tuple, images.read_lasaf(spark, str(tmp_path)).collect()))
    assert [r[2] for r in each] == [0, 1, 1, 1, 0, 1]
    plan = images.read_lasaf(spark, str(tmp_path), parts=True)._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[1].split("BroadcastExchange")[0]
