"""Frame readers: files come by Spark's binaryFile source, whatever the store, and are decoded in tasks.

A frame sequence is a set of files in natural order of their names (f2 before f10), or the frames inside one file.  Every
reader gives frames (path, t, ch, h, w, data array<double>).
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship
from ..functions.curves import natural_key
from ..operators.graph import written
from . import tiff

FRAMES = "path string, k long, ch int, h int, w int, data array<double>"


def decode_pnm(data: bytes) -> np.ndarray:
    """P2, P3, P5 or P6 (PGM and PPM), 8 or 16 bits."""
    tokens, at = [], 0
    while len(tokens) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        tokens.append(data[at:end])
        at = end
    kind, w, h, top = tokens[0], *map(int, tokens[1:])
    n = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P2", b"P3"):
        v = np.array(data[at:].split(), float)
    else:
        v = np.frombuffer(data, ">u2" if top > 255 else "u1", h * w * n, at + 1).astype(float)
    return v.reshape(h, w, n)[..., 0] if n == 1 else v.reshape(h, w, 3)


def decode_png(data: bytes) -> np.ndarray:
    """Not interlaced, 8 or 16 bits; grey, RGB or with alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", chunk) if kind == b"IHDR" else head
        body += chunk if kind == b"IDAT" else b""
        at += 12 + n
    w, h, bits, colour, _, _, interlace = head
    if interlace or bits not in (8, 16) or colour == 3:
        raise ValueError("this kind of PNG is not read")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    px = n * bits // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * px)
    out = np.zeros((h + 1, w * px + px), np.uint8)
    for r in range(h):
        f, line, up = raw[r, 0], raw[r, 1:], out[r]
        cur = out[r + 1]
        if f == 0:
            cur[px:] = line
        elif f == 2:
            cur[px:] = line + up[px:]
        else:
            for i in range(px, len(cur)):
                a, b, c = int(cur[i - px]), int(up[i]), int(up[i - px])
                if f == 4:
                    p = a + b - c
                    a = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                elif f == 3:
                    a = (a + b) // 2
                cur[i] = (int(line[i - px]) + a) & 255
    v = np.frombuffer(out[1:, px:].tobytes(), ">u2" if bits == 16 else "u1").astype(float).reshape(h, w, n)
    return v[..., 0] if n == 1 else v


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed, 8 (palette), 24 or 32 bits."""
    start, size, w, h, _, bits, packed = struct.unpack("<10xI I i i H H I", data[:34])
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP is not read")
    step = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, 1024, 14 + size).reshape(256, 4)[:, 2::-1]
        return palette[rows].astype(float)
    return rows.reshape(abs(h), w, bits // 8)[..., 2::-1].astype(float)


def decode_text(data: bytes) -> np.ndarray:
    return np.loadtxt(io.BytesIO(data), ndmin=2)


def decode_npy(data: bytes) -> Iterator[np.ndarray]:
    """One image, or the images of an array (t, h, w)."""
    x = np.load(io.BytesIO(data), allow_pickle=False).astype(float)
    yield from x if x.ndim == 3 else [x]


# Where the header of a speckle file has each number, and of what type, by the name of the format; frames begin at MLF_START.
MLF_START = 0x10000
MLF_HEADERS = {
    b"Moor FLPI Live Image Data file V2.0": {"nframes": (0x8000, "<u4"), "xdim": (0x8008, "<u4"), "ydim": (0x8010, "<u4"), "dt": (0x8018, "<u4"), "exposure": (0x8028, "<u4"), "sfilter": (0x8038, "<u4"), "mode": (0x8048, "<u4"), "tfilter": (0x8050, "<u4")},
    b"moorFLPI Live Image Data File V3.0": {"nframes": (0x1000, "<i8"), "xdim": (0x1008, "<i8"), "ydim": (0x1010, "<i8"), "dt": (0x1018, "<i8"), "exposure": (0x1028, "<i8"), "gain": (0x1030, "<i8"), "sfilter": (0x1038, "<i8"), "mode": (0x1048, "<i8"), "tfilter": (0x1050, "<i8")},
}


def mlf_header(data: bytes) -> dict[str, float]:
    """Numbers of a speckle file's header; dt in milliseconds (the newer format has microseconds)."""
    for name, table in MLF_HEADERS.items():
        if name in data[:64]:
            got = {k: int(np.frombuffer(data, kind, 1, at)[0]) for k, (at, kind) in table.items()}
            return got | {"dt": got["dt"] / 1000} if b"V3" in name else got
    raise ValueError("no speckle file of a known version")


def decode_mlf(data: bytes, what: str = "flux") -> Iterator[np.ndarray]:
    """Images of 16 bits, which take turns of flux and its contrast."""
    head = mlf_header(data)
    h, w = head["ydim"], head["xdim"]
    for k in range(min(head["nframes"], (len(data) - MLF_START) // (4 * h * w))):
        yield np.frombuffer(data, "<u2", h * w, MLF_START + (2 * k + (what != "flux")) * 2 * h * w).reshape(h, w)


def one(decode: Callable[[bytes], np.ndarray]) -> Callable[[bytes], Iterator[np.ndarray]]:
    return lambda data: iter([decode(data)])


#: By lower-case suffix: bytes to images of (h, w) or (h, w, channels).
DECODERS: dict[str, Callable[[bytes], Iterator[np.ndarray]]] = {
    "pgm": one(decode_pnm), "ppm": one(decode_pnm), "pnm": one(decode_pnm), "png": one(decode_png), "bmp": one(decode_bmp), "txt": one(decode_text), "npy": decode_npy, "mlf": decode_mlf,
    "tif": tiff.read_images, "tiff": tiff.read_images,
}


def decoder(suffix: str) -> Callable[[bytes], Iterator[np.ndarray]]:
    if suffix in ("h5", "hdf5"):
        return hdf5_images(None)
    if suffix not in DECODERS:
        raise ValueError(f"no reader for .{suffix}; there are {', '.join(sorted([*DECODERS, 'h5']))}")
    return DECODERS[suffix]


def frames_of(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[np.ndarray]]) -> DataFrame:
    """(path, k, ch, h, w, data) of every image in every file; k counts the images of a file."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                for k, x in enumerate(decode(data)):
                    planes = x[..., None] if x.ndim == 2 else x
                    rows = [(name, k, c, *planes.shape[:2], planes[..., c].astype(float).ravel()) for c in range(planes.shape[-1])]
                    yield pd.DataFrame(rows, columns=["path", "k", "ch", "h", "w", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, FRAMES)


def open_seq(spark: SparkSession, path: str, ch: int | None = None, suffix: str | None = None, pages: list[int] | slice | int | None = None) -> DataFrame:
    """Frames (path, t, ch, h, w, data) of a file, folder or glob of any kind that is read; t counts images in natural order of path.

    `pages` picks images of each file by their number, the others are not decoded to rows.  Only the names and image numbers
    are ranked in one place, not the images.
    """
    suffix = suffix or path.rsplit(".", 1)[-1].lower()
    found = frames_of(spark, path, picked(decoder(suffix), pages))
    if suffix in ("png", "bmp", "pgm", "ppm", "pnm", "txt"):  # one image in each file: names alone give the order
        names = spark.read.format("binaryFile").load(path).select("path", F.lit(0).cast("long").alias("k"))
    else:
        names = found.filter("ch = 0").select("path", "k")
    order = names.withColumn("t", F.row_number().over(Window.orderBy(natural_key(F.col("path")), "path", "k")).cast("long") - 1)
    out = found.join(order, ["path", "k"]).select("path", "t", "ch", "h", "w", "data")
    return out if ch is None else out.filter(F.col("ch") == ch)


def picked(decode: Callable[[bytes], Iterator[np.ndarray]], pages: list[int] | slice | int | None) -> Callable[[bytes], Iterator[np.ndarray]]:
    """The decoder's images of these numbers alone, in their order in the file."""
    if pages is None:
        return decode

    def some(data: bytes) -> Iterator[np.ndarray]:
        all_ = list(decode(data)) if isinstance(pages, slice) else decode(data)
        if isinstance(pages, slice):
            yield from all_[pages]
            return
        wanted = {pages} if isinstance(pages, int) else set(pages)
        yield from (x for k, x in enumerate(all_) if k in wanted)

    return some


def read_mlf(spark: SparkSession, path: str, h: int, w: int, header: int, what: str = "flux") -> DataFrame:
    """Frames of a speckle file: after the header, images of 16 bits in turns of flux and its contrast."""
    step, first = 2 * h * w, 0 if what == "flux" else 1

    def decode(data: bytes) -> Iterator[np.ndarray]:
        n = (len(data) - header) // (2 * step)
        for k in range(n):
            yield np.frombuffer(data, "<u2", h * w, header + (2 * k + first) * step).reshape(h, w)

    return frames_of(spark, path, decode).select("path", F.col("k").alias("t"), "ch", "h", "w", "data")


def read_lasaf(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Rows of a text export with `;` between fields and decimal commas, as doubles; `part` counts off at the largest time gap, the last of equal ones.

    Each file is an export of its own, or with `parts` all files of `path` are one.  Gaps lie between different times, so those
    are sorted by ranges, a task each; a range's first time is set against the last of the range before.
    """
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    names = [c.strip() for c in raw.columns]
    x = raw.toDF(*names).select(*[F.replace(F.col(f"`{c}`"), F.lit(","), F.lit(".")).cast("double").alias(c) for c in names])
    x = x.withColumn("_f", F.lit("") if parts else F.input_file_name())
    times = x.select("_f", F.col(f"`{names[0]}`").alias("_t")).distinct().repartitionByRange("_f", "_t")
    times = written(times.withColumn("_r", F.spark_partition_id()), "times")
    inside = times.select("_f", "_t", (F.col("_t") - F.lag("_t").over(Window.partitionBy("_f", "_r").orderBy("_t"))).alias("_g"))
    ends = times.groupBy("_f", "_r").agg(F.min("_t").alias("_t"), F.max("_t").alias("_last"))
    first = ends.select("_f", "_t", (F.col("_t") - F.lag("_last").over(Window.partitionBy("_f").orderBy("_r"))).alias("_g"))
    top = inside.unionByName(first).groupBy("_f").agg(F.max_by("_t", F.struct("_g", "_t")).alias("_at"))  # a row a file
    return x.join(F.broadcast(top), "_f").withColumn("part", (F.col(f"`{names[0]}`") >= F.col("_at")).cast("int")).drop("_f", "_at")


def leica_properties(spark: SparkSession, path: str) -> DataFrame:
    """(path, dt_ms, dims) of job files in XML: the frame delay, and size and step of each dimension; expressions only."""
    x = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))
    attr = lambda name: F.regexp_extract_all("xml", F.lit(rf'<DimensionDescription[^>]*\b{name}="([^"]*)"'), 1)
    dims = F.transform(F.arrays_zip(attr("DimID").alias("id"), attr("NumberOfElements").alias("n"), attr("Length").alias("length")), lambda d: F.struct(d["id"].alias("id"), d["n"].cast("long").alias("n"), (d["length"].cast("double") * 1e6 / d["n"].cast("double")).alias("step_um")))
    return x.select("path", F.expr("try_cast(regexp_extract(xml, 'nDelayTime_ms=\"([0-9.]+)\"', 1) as double)").alias("dt_ms"), dims.alias("dims"))


def leica_axes(spark: SparkSession, path: str) -> list[tuple[float, str]]:
    """(scale, unit) of time or depth, rows and columns, from the first job file; 1 without a unit where it has none."""
    job = leica_properties(spark, path).orderBy("path").first()
    step = {d["id"]: d["step_um"] for d in job["dims"]}
    first = (job["dt_ms"] / 1000, "s") if job["dt_ms"] is not None else (step["Z"], "um") if "Z" in step else (1.0, "")
    return [first, *[(step[k], "um") if k in step else (1.0, "") for k in ("Y", "X")]]


def axes_of_names(names: DataFrame, pattern: str, axes: list[str]) -> DataFrame:
    """`names` (path) with a column per axis, from the groups of a pattern over the file name; null where it does not match."""
    base = F.element_at(F.split("path", "/"), -1)
    got = lambda i: F.expr(f"try_cast(_m[{i}] as long)")
    x = names.withColumn("_m", F.array(*[F.regexp_extract(base, pattern, i + 1) for i in range(len(axes))]))
    return x.withColumns({a: got(i) for i, a in enumerate(axes)}).drop("_m")


def hdf5_images(dataset: str | None) -> Callable[[bytes], Iterator[np.ndarray]]:
    """A decoder of one dataset (the only one, unless named) of HDF5 files; needs h5py on driver and executors."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs the h5py package") from e

    def decode(data: bytes) -> Iterator[np.ndarray]:
        import h5py

        with h5py.File(io.BytesIO(data), "r") as f:
            names = [dataset] if dataset else list(f)
            if len(names) != 1 or names[0] not in f:
                raise ValueError(f"name one dataset of {sorted(f)}")
            yield from f[names[0]]

    return decode


def read_hdf5(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Frames of one dataset of HDF5 files."""
    return frames_of(spark, path, hdf5_images(dataset)).select("path", F.col("k").alias("t"), "ch", "h", "w", "data")


def complete_axes(names: DataFrame, axes: list[str]) -> DataFrame:
    """`names` (path and a column per axis) with a row for every combination of the axes' values; path is null where a file is missing."""
    grid = None
    for a in axes:
        values = names.select(a).filter(F.col(a).isNotNull()).distinct()
        grid = values if grid is None else grid.crossJoin(values)  # as many rows as the axes' lengths multiply to
    return grid.join(names, axes, "left")


def unmix_planes(frames: DataFrame, channels: int) -> DataFrame:
    """Frames of interleaved channels: t = k div channels, ch = k mod channels."""
    return frames.withColumns({"ch": F.pmod("t", F.lit(channels)).cast("int"), "t": F.floor(F.col("t") / channels).cast("long")})


def cut_strip(cells: DataFrame, lines: int) -> DataFrame:
    """Frames that lie side by side in one long strip, `lines` columns each; the first, which is incomplete, is left out."""
    out = cells.withColumns({"t": F.floor(F.col("col") / lines).cast("long") - 1, "col": F.pmod("col", F.lit(lines)).cast("int")})
    return out.filter("t >= 0")
