"""Operators that SQL cannot state: known truth, round trips, batch against stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenstack.functions import curves
from lumenstack.operators import aggregate, cluster, graph, layout, linalg, maps, objects, register, spatial, tracking, wavelet
from lumenstack.sources import images, sinks, synthetic, tiff
from lumenstack.streaming import stateful


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        if a is not None:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in pairs:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in root.items() if k != v} == got
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_noise_table(spark):
    got = {r["level"]: r["sigma"] for r in synthetic.noise_levels(spark, 4, 1024, 24).collect()}
    for j in range(4):
        assert got[j] == pytest.approx(wavelet.SIGMA_1D[j], rel=0.06)


def test_starlet_rebuilds_and_caps_level():
    x = np.random.default_rng(1).normal(size=(40, 33))
    w = wavelet.starlet2d(x, 4)
    assert np.allclose(w.sum(0), x) and w[0].std() == pytest.approx(wavelet.SIGMA_2D[0], rel=0.06)
    assert np.allclose(wavelet.median_pyramid(x, 2).sum(0), x)
    with pytest.raises(ValueError):
        wavelet.starlet2d(x, 6)


def test_shifts_recovered(spark):
    cells = synthetic.gauss_blobs(spark, 6, 48, 48, [(20, 20, 4, 10), (30, 28, 5, 7), (15, 33, 3, 9)], velocity=(0.5, -0.75))
    frames = layout.to_frames(cells)
    target = np.array(frames.filter("t = 0").first()["data"]).reshape(48, 48)
    for r in register.register_shifts(frames, target).collect():
        assert abs(r["params"][0] + 0.5 * r["t"]) < 0.15 and abs(r["params"][1] - 0.75 * r["t"]) < 0.15
    for r in register.register_affine(frames.filter("t < 3"), target).collect():
        assert abs(r["params"][0] - 0.5 * r["t"]) < 0.1 and abs(r["params"][3] + 0.75 * r["t"]) < 0.1
    out, _ = register.stabilise(frames, ("shift",))
    x = np.array([r["data"] for r in out.orderBy("t").collect()]).reshape(-1, 48, 48)[:, 8:40, 8:40]
    assert x.std(0).mean() < 0.3 * np.array([r["data"] for r in frames.collect()]).std(0).mean()
    warps = {r["t"]: r["params"] for r in register.register_recursive(frames.filter("t < 4")).collect()}
    assert warps[0][0] - warps[3][0] == pytest.approx(1.5, abs=0.5)


def test_objects_found_and_linked(spark):
    cells = synthetic.with_noise(synthetic.gauss_blobs(spark, 8, 40, 40, [(10, 10, 2.5, 20), (28, 26, 2.5, 25)], velocity=(0.3, 0.3)), 0.5, 3)
    found = objects.find_objects(layout.to_frames(cells), 3, 5.0, 2, 10)
    assert {r["n"] for r in found.groupBy("t").agg(F.count_distinct("obj").alias("n")).collect()} == {2}
    tracks = objects.linked_objects(found, 5).collect()
    assert len({r["track"] for r in tracks}) == 2 and len(tracks) == 16


def test_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (3, 3), (0, 4))])
    p = spark.createDataFrame([(i, v.tolist(), i // 40) for i, v in enumerate(x)] + [(500, [20.0, 20.0], 9)], "id long, x array<double>, g int")
    got = {r["id"]: r["label"] for r in cluster.dbscan(p, 0.6, 4).collect()}
    assert got[500] == -1 and [len({got[i] for i in range(40 * k, 40 * k + 40)}) for k in range(3)] == [1, 1, 1] and len(set(got.values())) == 4
    seeds = spark.createDataFrame([(k, x[40 * k].tolist()) for k in range(3)], "label long, c array<double>")
    centres = {r["label"]: r["c"] for r in cluster.kmeans(p.filter("id < 120"), seeds).collect()}
    assert all(math.dist(centres[k], x[40 * k : 40 * k + 40].mean(0)) < 1e-6 for k in range(3))
    assert cluster.quality_threshold(p.withColumn("one", F.lit(1)), 2.0, "one").select("label").distinct().count() == 4
    gas = np.stack([r["c"] for r in cluster.gng(p.filter("id < 120").withColumn("one", F.lit(1)), "one", 12, 1500).collect()])
    means = np.stack([x[40 * k : 40 * k + 40].mean(0) for k in range(3)])
    assert len(gas) == 12 and np.sqrt(((gas[:, None] - means) ** 2).sum(-1)).min(0).max() < 0.5
    m = cluster.som(p.filter("id < 120"), (1, 3), seeds, 5, 0.4)
    assert cluster.assign(p.filter("id < 120"), m).select("label").distinct().count() == 3


@pytest.mark.parametrize("block", [7, 4096])
def test_near_pairs_brute(spark, block):
    rng = np.random.default_rng(6)
    for dims, eps in ((1, 0.05), (2, 0.4), (24, 4.0)):
        x = np.vstack([rng.normal(c, 0.7, (60, dims)) for c in (0, 3)])
        x[30:40] = x[3]
        ids = rng.permutation(1000)[: len(x)]
        p = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + [(5000, None)], "id long, x array<double>")
        got = {(r["a"], r["b"]): r["distance"] for r in cluster.near_pairs(p, eps, 9, block).collect()}
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        assert got == pytest.approx({(min(ids[i], ids[j]), max(ids[i], ids[j])): d[i, j] for i in range(len(x)) for j in range(i) if d[i, j] <= eps}) and got
    assert cluster.near_pairs(p.limit(0), 1.0).count() == 0


def test_linalg(spark):
    rng = np.random.default_rng(3)
    s = np.stack([rng.uniform(-1, 1, 2000), np.sign(rng.normal(size=2000)) * rng.uniform(0.5, 1, 2000)], 1)
    x = s @ np.array([[1.0, 0.4], [0.3, 1.0]]).T
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    mean, axes, var = linalg.pca(p, 2)
    assert np.allclose(mean, x.mean(0)) and np.allclose(var, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])
    mean, un = linalg.fastica(p, 2)
    y = (x - mean) @ un.T
    c = np.abs(np.corrcoef(y.T, s.T)[:2, 2:])
    assert np.allclose(np.sort(c.max(1)), 1, atol=0.02)
    t = np.arange(200) * 0.1
    rot = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(t)], "id long, x array<double>")
    assert linalg.jpca(rot, 2)[1][0] == pytest.approx(math.sin(0.1), rel=0.02)


def test_tracking(spark):
    frames = synthetic.movie(spark, 40, 8, 8, [], [0] * 40).withColumn("seq_id", F.lit("a"))
    out = tracking.kalman_stack(frames)
    var = lambda f: np.array([r["data"] for r in f.collect()]).var(0).mean()
    assert out.count() == 40 and var(out) < var(frames)
    walls = synthetic.vessel(spark, 60, 40, 10, 28)
    edge = walls
    grad = spark.createDataFrame([(r["seq"], r["t"], np.gradient(np.array(r["v"])).tolist()) for r in edge.collect()], "seq int, t long, v array<double>")
    got = [r["value"] for r in tracking.track_kalman(grad, "seq", 10.0).orderBy("t").collect()]
    assert np.abs(np.array(got[20:]) - 10).mean() < 2
    y = np.sin(np.arange(60) / 3) ** 2 + np.arange(60) * 0.05
    traces = spark.createDataFrame([(0, 0, y.tolist())], "row int, col int, v array<double>")
    base = np.array(tracking.baseline_als(traces).first()["v"])
    assert (y > base).mean() > 0.6 and base.std() < y.std()
    modes = tracking.emd(traces).collect()
    assert np.allclose(np.sum([m["v"] for m in modes], 0), y)
    ext = {round(r["t"]) for r in tracking.refined_extrema(traces).filter("kind = 'max'").collect()}
    assert 5 in ext and len(tracking.interpolate(traces, 4).first()["v"]) == 59 * 4 + 1


def test_cwt_finds_frequency(spark):
    t = np.arange(200)
    traces = spark.createDataFrame([(0, 0, np.sin(2 * np.pi * 0.1 * t).tolist())], "row int, col int, v array<double>")
    freqs = [0.05, 0.08, 0.1, 0.13, 0.2]
    assert maps.cwt_freqmap(traces, freqs, 20, 180).first()["value"] == pytest.approx(0.1)
    e = {r["freq"]: r["v"] for r in maps.avg_energy(traces, freqs).groupBy("freq").agg(F.avg("value").alias("v")).collect()}
    assert max(e, key=e.get) == 0.1 and maps.cwt_map(traces, freqs, 20, 180).first()["value"] > 0


def test_curves(spark):
    c = F.col("x")
    row = spark.createDataFrame([(2.0,)], "x double").select(
        curves.gaussian(c, 3, 1, 2), curves.alias_freq(F.lit(7.0), 10.0), curves.alias_freq(F.lit(5.0), 10.0), curves.michaelis_menten(c, 4, 2), curves.fwhm(1.0), curves.roi_tag(F.lit(3)), curves.decimal_comma(F.lit("1,5")),
        curves.excel_time(F.lit(40237.029999999795)).cast("string"), curves.ticks_to_ms(F.lit(0), F.lit(20000)), curves.rising_exp(F.lit(curves.half_rise_exp(1.0, 0.8, 3.0)), 1, 0.8, 3.0), curves.rising_pow(F.lit(curves.half_rise_pow(1.0, 0.8, 2.0)), 1, 0.8, 2.0),
    ).first()
    assert row[0] == pytest.approx(3 * math.exp(-1 / 8)) and row[1:4] == (3.0, 5.0, 2.0) and row[4] == pytest.approx(2.3548, abs=1e-4)
    assert row[5] == "r03" and row[6] == 1.5 and row[7].startswith("2010-02-28 00:43:11.99998") and row[8] == 2.0 and row[9] == pytest.approx(0.5) and row[10] == pytest.approx(0.5)
    names = spark.createDataFrame([("f10",), ("f2",), ("f1",)], "n string").orderBy(curves.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in names] == ["f1", "f2", "f10"]
    x = np.arange(50)
    tr = spark.createDataFrame([(0, 0, (5 * np.exp(-((x - 20) ** 2) / 18)).tolist())], "row int, col int, v array<double>")
    a, m, s = curves.gauss_fits(tr).first()[2:]
    assert (a, m, s) == pytest.approx((5, 20, 3), abs=1e-3)
    for kind, true, start in (("gaussian", [5, 20, 3, 1], [4, 18, 4, 0]), ("decaying_exp", [1, 4, 9], [0.5, 3, 5]), ("rising_exp", [3, 2, 7], [2, 1, 5]), ("logistic", [4, 30, 5], [3, 20, 4]), ("michaelis_menten", [4, 6, 1], [3, 4, 1])):
        tr = spark.createDataFrame([(0, 0, curves.SHAPES[kind](x.astype(float), *true).tolist())], "row int, col int, v array<double>")
        assert curves.fits(tr, kind, start).first()["p"] == pytest.approx(true, rel=1e-3), kind


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32", "float64"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_round_trip(dtype, big):
    rng = np.random.default_rng(0)
    for shape in ((30, 21), (5, 7, 3)):
        stack = [(rng.random(shape) * 200).astype(dtype) for _ in range(3)]
        back = list(tiff.read_images(tiff.write_images(stack, big, "a=1\nb=2")))
        assert len(back) == 3 and all((a == b).all() for a, b in zip(stack, back))
        assert tiff.image_description(tiff.write_images(stack, big, "a=1\nb=2")) == {"a": "1", "b": "2"}


def test_codecs():
    data = bytes([0x21, 0x08, 0xFF, 0xFF])
    assert tiff.unpack_rgb(data, "<B", (5, 6, 5), False).tolist() == [1, 1, 1, 31, 63, 31]
    assert tiff.unpack_rgb(data, "<B", (5, 6, 5)).tolist() == [8, 4, 8, 255, 255, 255]
    assert tiff.unpack_rgb(data, "<B", (5, 5, 5)).tolist() == [16, 8, 8, 255, 255, 255]
    assert tiff.unpack_bits(b"\xfe\xaa\x02\x80\x00\x2a\xfd\xaa\x03\x80\x00\x2a\x22\xf7\xaa") == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    assert tiff.unpack_ints(b"\xa5\xf0", 4, 4).tolist() == [10, 5, 15, 0]
    assert tiff.unpack_lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"


def test_readers_and_sinks(spark, tmp_path):
    rng = np.random.default_rng(5)
    stack = rng.integers(0, 255, (12, 6, 5)).astype("uint8")
    for i, x in enumerate(stack):
        (tmp_path / f"p{i}.pgm").write_bytes(b"P5\n# c\n5 6\n255\n" + x.tobytes())
        np.save(tmp_path / f"n{i}.npy", x)
        np.savetxt(tmp_path / f"x{i}.txt", x)
    (tmp_path / "s.tif").write_bytes(tiff.write_images(list(stack)))
    head = bytes(16)
    (tmp_path / "m.mlf").write_bytes(head + b"".join(np.stack([x, 255 - x]).astype("<u2").tobytes() for x in stack))
    for path in ("p*.pgm", "n*.npy", "x*.txt", "s.tif"):
        rows = images.open_seq(spark, str(tmp_path / path), 0).orderBy("t").collect()
        assert [r["t"] for r in rows] == list(range(12)) and all((np.array(r["data"]).reshape(6, 5) == x).all() for r, x in zip(rows, stack)), path
    rows = images.read_mlf(spark, str(tmp_path / "m.mlf"), 6, 5, 16).orderBy("t").collect()
    assert all((np.array(r["data"]).reshape(6, 5) == x).all() for r, x in zip(rows, stack)) and len(rows) == 12
    with pytest.raises(ValueError):
        images.open_seq(spark, "a.xyz")
    frames = images.open_seq(spark, str(tmp_path / "s.tif"))
    sinks.save_stack(frames, str(tmp_path / "o.tif"), "uint8")
    assert all((a == b).all() for a, b in zip(tiff.read_images((tmp_path / "o.tif").read_bytes()), stack))
    assert sinks.to_tiff(frames).count() == 12
    cells = layout.frames_to_cells(frames)
    sinks.write_sequences({"a": cells, "b": cells}, str(tmp_path / "seq"))
    assert spark.read.parquet(str(tmp_path / "seq")).filter("seq_id = 'a'").count() == cells.count()
    traces = cells.filter("row = 0").select(F.concat(F.lit("c"), F.col("col").cast("string")).alias("tag"), "t", "value").filter("not (t = 3 and tag = 'c1')")
    sinks.write_table(traces, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["t", "c0", "c1", "c2", "c3", "c4"] and back.filter("c1 = 'NA'").count() == 1
    (tmp_path / "l.txt").write_text("Axis; A\n0,0;1,5\n1,0;2,5\n9,5;3,5\n")
    assert [tuple(r) for r in images.read_lasaf(spark, str(tmp_path / "l.txt")).orderBy("Axis").collect()] == [(0.0, 1.5, 0), (1.0, 2.5, 0), (9.5, 3.5, 1)]
    (tmp_path / "j.xml").write_text('<J nDelayTime_ms="12.5"><DimensionDescription DimID="X" NumberOfElements="100" Length="0.0002"/></J>')
    r = images.leica_properties(spark, str(tmp_path / "j.xml")).first()
    assert r["dt_ms"] == 12.5 and r["dims"][0]["n"] == 100 and r["dims"][0]["step_um"] == pytest.approx(2.0)
    low = sinks.lut(cells).agg(F.min("value"), F.max("value")).first()
    assert tuple(low) == (0.0, 1.0)


def test_png_and_bmp():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    x = rng.integers(0, 255, (4, 3, 3)).astype("uint8")
    lines = b""
    for r in range(4):  # one line of each kind of filter but 4
        line, up = x[r].ravel().astype(int), x[r - 1].ravel().astype(int) if r else np.zeros(9, int)
        left = np.concatenate([[0] * 3, line[:-3]])
        lines += bytes([r]) + ((line - [0, left, up, (left + up) // 2][r]) % 256).astype("uint8").tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.decode_png(png) == x).all()
    pad = b"".join(x[r, :, ::-1].tobytes() + b"\0" * 3 for r in range(3, -1, -1))
    bmp = struct.pack("<2sIII", b"BM", 54 + len(pad), 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 4, 1, 24, 0, len(pad), 0, 0, 0, 0) + pad
    assert (images.decode_bmp(bmp) == x).all()


def test_streams_equal_batches(spark, tmp_path):
    src = spark.range(60).select((F.col("id") % 3).alias("key"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") * 7 % 11).cast("double").alias("value"))
    src.repartition(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, f, mode in (("kalman", stateful.kalman, "append"), ("track", lambda d: stateful.track(d, 5.0), "append"), ("chunks", lambda d: stateful.chunk_means(d, "10 seconds"), "complete"), ("sessions", lambda d: stateful.sessions(d, "4 seconds"), "complete"), ("slide", lambda d: stateful.sliding_means(d, "10 seconds", "5 seconds"), "complete")):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(src).collect())), name


def test_spatial_truth(spark):
    mask = spark.createDataFrame([(0, r, c) for r in range(4) for c in range(4)] + [(0, 0, 7), (0, 2, 5)], "t long, row int, col int")
    reg = spatial.regions(mask, 10, 10)
    assert {r["region"]: r["size"] for r in spatial.region_stats(reg).collect()} == {0: 16, 7: 1, 25: 1}
    assert {r["linsize"] for r in spatial.region_linsize(reg).collect()} == {math.sqrt(18), 0.0}
    glued = spatial.glue_regions(reg, 3)
    assert {r["region"]: r["size"] for r in spatial.region_stats(glued).collect()} == {0: 18}
    cells = spark.range(25).select(F.lit(0).cast("long").alias("t"), F.floor(F.col("id") / 5).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col")).withColumn("value", 2.0 * F.col("col") - F.col("row") + 3)
    assert spatial.remove_plane(cells).agg(F.max(F.abs("value"))).first()[0] < 1e-9
    one = [0.0] * 100
    one[6 * 10 + 7] = 50.0
    one[6 * 10 + 6] = 20.0
    frame = spark.createDataFrame([(0, 10, 10, one)], "t long, h int, w int, data array<double>")
    assert [tuple(r) for r in cluster.converging_squares(frame, 5, 1, "max").collect()] == [(0, 6, 7, 1)]


def test_more_warps(spark):
    y, x = np.mgrid[:48, :48].astype(float)
    a = sum(np.exp(-((y - r) ** 2 + (x - c) ** 2) / 40) for r, c in ((12, 14), (30, 20), (22, 36), (38, 40)))
    for model, true in (("affine", [1.0, 0.02, 0.0, -0.8, 0.0, -0.01]), ("homography", [0.03, 0.02, 0.01, -0.02, 0.0, 0.01, 0.01, 0.0])):
        b = register.warp(a, model, true)
        p = register.FITS[model](b, a)
        assert np.abs(register.warp(a, model, p) - b).max() < 0.02, model
    b = register.warp(a, "shift", [1.5, -1.0])
    for model in ("mesh", "line_scan"):
        p = register.FITS[model](b, a)
        assert np.abs(register.warp(a, model, p) - b)[6:-6, 6:-6].mean() < 0.25 * np.abs(a - b)[6:-6, 6:-6].mean(), model
    frames = spark.createDataFrame([(0, 48, 48, a.ravel().tolist())], "t long, h int, w int, data array<double>")
    assert register.apply_warps(frames, register.register_model(frames, b, "mesh")).count() == 1


def test_walls_and_fronts(spark):
    lines = synthetic.vessel(spark, 50, 40, 10, 28)
    for f in (tracking.vessel_walls, tracking.contour_walls):
        rows = f(lines, "seq").toPandas()
        assert abs(rows["lower"].mean() - 10) < 2 and abs(rows["upper"].mean() - 28) < 2 and len(rows) == 50
    pts = spark.createDataFrame([("a", float(x), abs(x) / 2.0) for x in range(-20, 21)], "k string, x double, t double")
    assert {round(r["velocity"], 6) for r in tracking.front_velocity(pts, "k").collect()} == {2.0}
    t = spark.createDataFrame([(0, 0, (np.sin(np.arange(64)) ** 2).tolist())], "row int, col int, v array<double>")
    assert max(tracking.asymmetric_smooth(t, 3).first()["v"]) < 0.6


def test_shapes_and_names(spark):
    grid = spark.range(100).select(F.lit(0).cast("long").alias("t"), F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    assert grid.filter(spatial.in_polygon(F.col("row"), F.col("col"), [(-0.5, -0.5), (-0.5, 4.5), (4.5, 4.5), (4.5, -0.5)])).count() == 25
    assert spatial.zview(grid, (0, 4, 9, 4), 1).filter("i = 3").first()["value"] == pytest.approx(43)
    assert spatial.tiles(grid, 4, 2).groupBy("tr", "tc").count().filter("count = 16").count() == 16
    assert spatial.adaptive_median_mad(grid, 3.0).count() == 100
    names = spark.createDataFrame([("a/s_t3_c1.tif",), ("a/x.tif",)], "path string")
    assert [tuple(r)[1:] for r in images.axes_of_names(names, r"_t(\d+)_c(\d+)", ["t", "c"]).collect()] == [(3, 1), (None, None)]
    strip = images.cut_strip(grid, 5)
    assert strip.select("t").distinct().count() == 1 and strip.count() == 50


def test_spatiotemporal_ica(spark):
    rng = np.random.default_rng(0)
    masks = rng.exponential(size=(2, 300)) * (rng.random((2, 300)) < 0.2)
    t = np.arange(80)
    signals = np.array([np.exp(-((t % 20) / 4)), np.sin(t / 5) ** 8])
    data = masks.T @ signals + 0.01 * rng.normal(size=(300, 80))
    tr = spark.createDataFrame([(i // 20, i % 20, v.tolist()) for i, v in enumerate(data)], "row int, col int, v array<double>")
    maps_, _ = linalg.spatiotemporal_ica(tr, 2, 0.3)
    p = np.array([r["p"] for r in maps_.orderBy("row", "col").collect()])
    assert np.sort(np.abs(np.corrcoef(p.T, masks)[:2, 2:]).max(1)).min() > 0.9


def test_sequence(spark):
    from lumenstack.sequence import FrameSeq

    x = np.random.default_rng(0).random((7, 5, 4))
    s = FrameSeq.of_array(spark, x, [(0.5, "s")])
    assert [r["ts"] for r in s.times().orderBy("t").collect()] == [0.5 * t for t in range(7)] and s.axes[2].units == "s"
    back = lambda q: np.array([r["data"] for r in q.frames.orderBy("t").collect()])
    assert np.allclose(back(s.map_frames(lambda f: f[::2, :3] * 2)), (x[:, ::2, :3] * 2).reshape(7, -1))
    assert np.allclose(back(s.map_traces(lambda v: v[1:] - v[:-1])), np.diff(x, axis=0).reshape(6, -1))
    med = {(r["row"], r["col"]): r["value"] for r in s.project(np.median).collect()}
    assert med == pytest.approx({(r["row"], r["col"]): r["value"] for r in s.project("median").collect()})
    assert s.crop((1, 4), (0, 2)).cells.count() == 3 * 2 * 4 and s.masked(spark.createDataFrame([(0, 0)], "row int, col int")).cells.count() == 7
    assert np.allclose(back(s.dfof(3)), (x / x[:3].mean(0) - 1).reshape(7, -1))


def test_deeper_wavelets(spark):
    rng = np.random.default_rng(1)
    cube = rng.normal(size=(20, 9, 8))
    cells = spark.createDataFrame([(t, r, c, float(v)) for (t, r, c), v in np.ndenumerate(cube)], "t long, row int, col int, value double")
    w = wavelet.decompose3d(cells, 2, 20).toPandas()
    back = w.groupby(["t", "row", "col"]).value.sum().to_numpy().reshape(20, 9, 8)
    assert np.allclose(back, cube) and len(w) == 3 * cube.size
    tr = spark.createDataFrame([(0, 0, (rng.normal(size=400) * 2 + (np.arange(400) % 100 == 0) * 60).tolist())], "row int, col int, v array<double>")
    assert wavelet.estimate_sigma(tr, 4).first()["sigma"] == pytest.approx(2, rel=0.2)
    noise = spark.range(4000).select((F.randn(3) * 0.7235).alias("value"))
    assert wavelet.sigma_kclip(noise) == pytest.approx(1, rel=0.06)
    x = np.exp(-((np.arange(32)[:, None] - 16.0) ** 2 + (np.arange(32)[None] - 12.0) ** 2) / 18) * 10
    coefs = wavelet.starlet2d(x, 3)
    assert np.abs(wavelet.rebuild(coefs, np.abs(coefs) > 0.05) - x).max() < 1.0
    assert np.allclose(wavelet.hybrid_pyramid(x, 3).sum(0), x)
    supp = np.abs(coefs) > 0.02
    far = lambda y: (((coefs - wavelet.starlet2d(y, 3)) * supp) ** 2).sum()
    best = wavelet.rebuild_cg(coefs, supp)
    assert np.abs(best - x).max() < 0.05 and far(best) < 0.1 * far(np.maximum((coefs * supp).sum(0), 0)) and far(best) < 1e-6 * far(0 * x)


def test_concat_counts_from_zero(spark):
    one = spark.createDataFrame([(0, 0, 0, 1.0)], "t long, row int, col int, value double")
    assert sorted(r["t"] for r in layout.concat([one, one.limit(0), one, one]).collect()) == [0, 1, 2]


def test_quantiles_exact(spark):
    rng = np.random.default_rng(8)
    qs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    for x in (rng.normal(size=999), np.floor(rng.normal(size=500) * 3), np.array([4.0]), np.array([1.0, 1.0]), rng.normal(size=60) * 10.0 ** rng.integers(-30, 30, 60), np.array([-1.7e308, 0.0, 1.7e308, 5e-324])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "value double")
        for bins in (3, 4096):
            assert aggregate.quantiles(df, qs) == aggregate.quantiles(df, qs, bins=bins, fetched=0)
            assert aggregate.quantiles(df, qs, bins=bins, fetched=3) == pytest.approx([v for v in np.quantile(x, qs)], rel=1e-12) or np.abs(x).max() > 1e300
    assert aggregate.quantiles(df.limit(0), [0.5]) == [None]


def test_frames_that_miss_cells(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, 4.0), (1, 0, 0, 2.0)], "t long, row int, col int, value double")
    assert {r["t"]: r["data"] for r in layout.to_frames(cells, 0.0).collect()} == {0: [1.0, 0.0, 0.0, 4.0], 1: [2.0]}
    with pytest.raises(Exception, match="misses cells"):
        layout.to_frames(cells).collect()


def test_filters_where_cells_are_missing(spark):
    """Kernels on frames against the same rule cell by cell."""
    rng = np.random.default_rng(3)
    cells = {(t, r, c): float(rng.normal()) for t in range(2) for r in range(3, 9) for c in range(-2, 5) if rng.random() < 0.8}
    df = spark.createDataFrame([(*k, v, "x") for k, v in cells.items()], "t long, row int, col int, value double, more string")
    near = lambda k, n: [v for (t, r, c), v in cells.items() if t == k[0] and abs(r - k[1]) <= n and abs(c - k[2]) <= n]
    values = lambda x: {(r["t"], r["row"], r["col"]): r["value"] for r in x.collect()}
    med = spatial.median3(df)
    assert med.columns == df.columns and values(med) == pytest.approx({k: float(np.median(near(k, 1))) for k in cells})
    off = {k: float(np.median(n)) if len(n) == 9 and abs(v - np.mean(n)) > 0.8 * np.std(n) else v for k, v in cells.items() for n in [near(k, 1)]}
    assert values(spatial.adaptive_median3(df, 0.8)) == pytest.approx(off)
    mask = {(r["t"], r["row"], r["col"]): r["mask"] for r in spatial.adaptive_threshold(df, 2, 0.1).collect()}
    assert mask == {k: v > np.mean(near(k, 2)) - 0.1 for k, v in cells.items()}
    kernel = {(0, 0): 1.0, (1, 0): 2.0, (0, -2): 0.5}
    got = {}
    for (t, r, c) in cells:
        there = [(w, cells[t, r + i, c + j]) for (i, j), w in kernel.items() if (t, r + i, c + j) in cells]
        got[t, r, c] = sum(w * v for w, v in there) / sum(w for w, _ in there)
    assert values(spatial.convolve(df, kernel)) == pytest.approx(got)
    q = {k: float(np.median(near(k, 1))) for k in cells}
    want = {}
    for t in range(2):
        d = np.array([cells[k] - q[k] for k in cells if k[0] == t])
        noise = np.median(np.abs(d - np.median(d))) / 0.6745
        want |= {k: cells[k] if abs(cells[k] - q[k]) <= 1.5 * noise else q[k] for k in cells if k[0] == t}
    assert values(spatial.adaptive_median_mad(df, 1.5)) == pytest.approx(want)


def test_banded_solvers():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(40, 3)).cumsum(0)
    d = np.diff(np.eye(40), 2, axis=0)
    w, z = np.ones((40, 3)), None
    for _ in range(10):
        z = np.stack([np.linalg.solve(np.diag(w[:, k]) + 50.0 * d.T @ d, w[:, k] * y[:, k]) for k in range(3)], 1)
        w = np.where(y > z, 0.1, np.where(y < z, 0.9, 0.0))
    assert np.allclose(tracking.als(y, 50.0), z) and np.allclose(tracking.als(y[:, 0], 50.0), z[:, 0])
    assert tracking.als(y[:2], 50.0).tolist() == y[:2].tolist() and len(tracking.als(np.sin(np.arange(20_000) / 50), 1e4, rounds=2)) == 20_000
    x = np.sort(rng.choice(100, 12, replace=False)).astype(float)
    v, at = rng.normal(size=12), np.linspace(x[0], x[-1], 400)
    s = tracking.spline(x, v, at)
    assert np.allclose(tracking.spline(x, v, x), v)
    second = lambda t: (tracking.spline(x, v, t + 1e-3) - 2 * tracking.spline(x, v, t) + tracking.spline(x, v, t - 1e-3)) / 1e-6
    inner = x[1:-1]
    assert np.allclose(second(inner - 2e-3), second(inner + 2e-3), atol=0.05) and np.abs(second(x[[0]] + 2e-3)).max() < 0.05 and np.isfinite(s).all()


def test_wall_tracker_gain(spark):
    """A clean row moves the wall by three quarters, a row without a peak hardly at all."""
    clean = [0.0] * 40
    clean[20] = 1000.0
    lines = spark.createDataFrame([("a", 0, clean), ("b", 0, [1.0] * 39 + [1.0 + 1e-9])], "seq string, t long, v array<double>")
    got = {r["seq"]: r["value"] for r in tracking.track_kalman(lines, "seq", 16.0, seed_var=100.0).collect()}
    snr = 1000 / np.std(clean)
    g = (1 + snr) / (1 + 4 * snr)
    assert got["a"] == pytest.approx(g * 16 + (1 - g) * 20) and 0.25 < g < 0.4


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key, default):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        graph.shared_dir(Session())


def test_open_anything(spark, tmp_path):
    from lumenstack.sequence import FrameSeq

    rng = np.random.default_rng(7)
    stack = rng.integers(0, 60000, (5, 4, 6)).astype("<u2")
    values = lambda rows: np.array([r["data"] for r in rows]).reshape(-1, 4, 6)
    # Speckle files of both versions: the header says where and how large.
    for name, magic, kind, at in (("a.mlf", b"Moor FLPI Live Image Data file V2.0", "<u4", (0x8000, 0x8008, 0x8010, 0x8018)), ("b.mlf", b"moorFLPI Live Image Data File V3.0", "<i8", (0x1000, 0x1008, 0x1010, 0x1018))):
        head = bytearray(0x10000)
        head[: len(magic)] = magic
        for place, v in zip(at, (5, 6, 4, 40 if kind == "<u4" else 40_000)):
            head[place : place + np.dtype(kind).itemsize] = np.array([v], kind).tobytes()
        data = bytes(head) + b"".join(np.stack([x, 60000 - x]).astype("<u2").tobytes() for x in stack)
        (tmp_path / name).write_bytes(data)
        assert images.mlf_header(data)["dt"] == 40
        assert (values(images.open_seq(spark, str(tmp_path / name), 0).orderBy("t").collect()) == stack).all()
        assert (np.stack(list(images.decode_mlf(data, "contrast"))) == 60000 - stack).all()
    with pytest.raises(ValueError):
        images.mlf_header(bytes(100))
    np.save(tmp_path / "all.npy", stack)
    (tmp_path / "s.tif").write_bytes(tiff.write_images([*stack, np.zeros((2, 3), "u1")], description='<OME><Pixels SizeX="6" SizeT="5" PhysicalSizeX="0.25" TimeIncrement="1.5"/></OME>'))
    for name in ("all.npy", "s.tif"):
        assert (values(images.open_seq(spark, str(tmp_path / name), 0, pages=slice(0, 5)).orderBy("t").collect()) == stack).all()
        assert (values(images.open_seq(spark, str(tmp_path / name), 0, pages=[1, 3]).orderBy("t").collect()) == stack[[1, 3]]).all()
        assert (values(images.open_seq(spark, str(tmp_path / name), 0, pages=2).collect()) == stack[2]).all()
    data = (tmp_path / "s.tif").read_bytes()
    assert tiff.series(data) == [[0, 1, 2, 3, 4], [5]] and tiff.ome_axes(data) == {"SizeX": 6, "SizeT": 5, "PhysicalSizeX": 0.25, "TimeIncrement": 1.5}
    (tmp_path / "j.xml").write_text('<J nDelayTime_ms="12.5"><DimensionDescription DimID="X" NumberOfElements="100" Length="0.0002"/><DimensionDescription DimID="Y" NumberOfElements="50" Length="0.0002"/></J>')
    s = FrameSeq.open(spark, str(tmp_path / "all.npy"), xml=str(tmp_path / "j.xml"))
    assert [(a.scale, a.units) for a in s.axes] == [(0.0125, "s"), (4.0, "um"), (2.0, "um")] and s.kind == "T"
    assert FrameSeq.of(s, spark) is s and FrameSeq.of(stack, spark, axes=[(1.0, "um")]).kind == "Z" and FrameSeq.of(str(tmp_path / "all.npy"), spark).kind == ""
    names = images.axes_of_names(spark.createDataFrame([("a_t0_z0.tif",), ("a_t1_z1.tif",), ("a_t0_z1.tif",)], "path string"), r"_t(\d+)_z(\d+)", ["t", "z"])
    assert {(r["t"], r["z"]): r["path"] for r in images.complete_axes(names, ["t", "z"]).collect()} == {(0, 0): "a_t0_z0.tif", (1, 1): "a_t1_z1.tif", (0, 1): "a_t0_z1.tif", (1, 0): None}
    with pytest.raises((RuntimeError, ValueError)):
        images.open_seq(spark, str(tmp_path / "a.mes"))


def test_stabiliser_job(spark, tmp_path):
    from lumenstack import jobs

    job = jobs.Stabiliser.of_json('{"smooth": [["gauss", 1.0], ["median"]], "model": ["shifts", ["softmesh", {"wsize": 25}]], "type": "template", "ch": 0, "ncpu": 4}')
    assert job.suffix() == "-ch_0-gauss_1.0-median_3-template-shifts-softmesh-stab" and jobs.Stabiliser.of_json("{}", name="p.json").suffix() == "-p.json-stab"
    frames = layout.to_frames(synthetic.gauss_blobs(spark, 6, 40, 40, [(16, 16, 4, 10), (24, 22, 5, 7)], velocity=(0.5, -0.5)))
    still = lambda f: np.array([r["data"] for r in f.orderBy("t").collect()]).reshape(-1, 40, 40)[:, 8:32, 8:32].std(0).mean()
    for job in (jobs.Stabiliser(smooth=[["gauss", 0.7]], model=["shifts"]), jobs.Stabiliser(model=["shifts"], type="recursive")):
        out, warps = job.run(frames)
        assert still(out) < 0.4 * still(frames)
    path = str(tmp_path / "recipe")
    jobs.save_recipe(warps, path)
    again = jobs.apply_recipe(frames, jobs.load_recipe(spark, path))
    assert {r["t"]: r["data"] for r in again.collect()} == {r["t"]: r["data"] for r in out.collect()}
    (tmp_path / "p.json").write_text('{"model": ["shifts"],\n "type": "recursive"}\n', encoding="utf-8")
    assert jobs.Stabiliser.of_json(jobs.read_parameters(spark, f"file://{tmp_path}/p.json")) == jobs.Stabiliser(model=["shifts"], type="recursive")
    for bad in ({"model": ["none"]}, {"type": "none"}, {"smooth": [["none"]]}):
        with pytest.raises(ValueError):
            jobs.Stabiliser(**bad).run(frames)


def test_geometry():
    assert spatial.line_of(0, 1, 2, 5) == (2.0, 1.0) and spatial.line_of(3, 0, 3, 9) is None
    assert spatial.normal_of(0, 0, 3, 4) == (0.8, -0.6)


def test_random_places(spark):
    rows = spatial.random_places(spark, 500, 7, 3, 1).collect()
    assert {r["row"] for r in rows} == set(range(7)) and {r["col"] for r in rows} == set(range(3)) and rows == spatial.random_places(spark, 500, 7, 3, 1).collect()


def test_dbscan_options(spark):
    p = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((0, 1, 2, 9, 10, 30))], "id long, x array<double>")
    got = lambda **k: [r["label"] for r in cluster.dbscan(p, 1.0, 2, **k).orderBy("id").collect()]
    assert got() == [0, 0, 0, 3, 3, -1] and got(strict=True) == [-1] * 6
    assert got(with_self=False) == [1, 1, 1, -1, -1, -1]
