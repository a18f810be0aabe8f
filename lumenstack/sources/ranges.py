"""Frame stacks of any size as a Spark data source: partitions are ranges of frames, read by their place in the file.

Only headers are read when a scan is planned, from which each file's frames, their size and their places are known.  A
file is cut into as many tasks as its bytes ask for, and a filter on `t` takes the other frames out of the plan, so that
their bytes are never read.  Kinds: `npy` (t, h, w) or (h, w), `mlf` speckle files (`what`: flux or contrast), and `raw`
(`h`, `w`, `dtype`, `header` bytes).  Files are reached by pyarrow's filesystems, from driver and executors alike.

The sink writes one file for each partition under a name that does not count until the job commits.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .. import ship
from .images import MLF_HEADERS, MLF_START, mlf_header

NAME = "frame_ranges"
SCHEMA = "path string, t long, ch int, h int, w int, data array<double>"
#: Bytes of files that one task reads, unless the option `task_bytes` says otherwise, and that it holds at once.
TASK_BYTES, AT_ONCE = 64 << 20, 8 << 20


@dataclass(frozen=True)
class Layout:
    """Frame k of a file is at start + k * step."""

    frames: int
    h: int
    w: int
    dtype: str
    start: int
    step: int


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    t: int
    layout: Layout


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files in a folder but for hidden ones, in natural order."""
    import re

    from pyarrow import fs

    store, where = _filesystem(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(where)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    natural = lambda p: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", p)]
    return sorted(((f.path, f.size) for f in found), key=lambda f: (natural(f[0]), f[0]))


def layout(kind: str, head: bytes, size: int, options: dict) -> Layout:
    """What the first bytes of a file say of its frames; a file that is cut short has the frames that are whole."""
    if kind == "npy":
        f = io.BytesIO(head)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[np.lib.format.read_magic(f)]
        shape, columns_first, dtype = read(f)
        if columns_first or len(shape) not in (2, 3) or dtype.hasobject:
            raise ValueError("only arrays (h, w) or (t, h, w) in C order are read")
        n, h, w = (1, *shape)[-3:]
        start, step = f.tell(), h * w * dtype.itemsize
        return Layout(min(n, (size - start) // step) if step else 0, h, w, dtype.str, start, step)
    if kind == "mlf":
        x = mlf_header(head)
        h, w = x["ydim"], x["xdim"]
        second = 2 * h * w * (options.get("what", "flux") != "flux")
        return Layout(min(x["nframes"], (size - MLF_START) // (4 * h * w)), h, w, "<u2", MLF_START + second, 4 * h * w)
    if kind == "raw":
        h, w, dtype, start = int(options["h"]), int(options["w"]), np.dtype(options["dtype"]), int(options.get("header", 0))
        step = h * w * dtype.itemsize
        return Layout((size - start) // step, h, w, dtype.str, start, step)
    raise ValueError(f"no frame ranges for files of kind {kind}")


def _head(kind: str) -> int:
    return MLF_START if kind == "mlf" else 16_384 if kind == "npy" else 0


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.low, self.high, self.only = 0, 1 << 62, None

    def pushFilters(self, filters):
        """Comparisons of `t` with numbers; what is left over comes back to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("t",) or getattr(f, "value", None) is None:
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, f.value + 1)
            elif isinstance(f, LessThan):
                self.high = min(self.high, f.value)
            elif isinstance(f, In):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            else:
                yield f

    def partitions(self) -> list[Range]:
        kind, store = self.options["kind"], _filesystem(self.options["path"])[0]

        def look(file: tuple[str, int]) -> Layout:
            with store.open_input_file(file[0]) as f:
                return layout(kind, f.read_at(min(_head(kind), file[1]), 0) if _head(kind) else b"", file[1], self.options)

        files = _files(self.options["path"])
        with ThreadPoolExecutor(16) as pool:
            layouts = list(pool.map(look, files))
        out, at = [], 0
        for (path, _), x in zip(files, layouts, strict=True):
            each = max(1, int(self.options.get("task_bytes", TASK_BYTES)) // max(1, x.step))
            if self.only is None:
                spans = [(s, min(s + each, x.frames, self.high - at)) for s in range(max(0, self.low - at), max(0, min(x.frames, self.high - at)), each)]
            else:  # runs of the named frames
                spans = []
                for k in sorted(t - at for t in self.only if self.low <= t < self.high and 0 <= t - at < x.frames):
                    if spans and spans[-1][1] == k and k - spans[-1][0] < each:
                        spans[-1] = (spans[-1][0], k + 1)
                    else:
                        spans.append((k, k + 1))
            out += [Range(path, s, e - s, at + s, x) for s, e in spans]
            at += x.frames
        return out or [Range("", 0, 0, 0, Layout(0, 0, 0, "<u1", 0, 0))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        x, n = partition.layout, partition.layout.h * partition.layout.w
        dtype = np.dtype(x.dtype)
        together = max(1, AT_ONCE // max(x.step, 8 * n))
        with _filesystem(self.options["path"])[0].open_input_file(partition.path) as f:
            for k in range(0, partition.count, together):
                m = min(together, partition.count - k)
                # The last frame is read without what follows it up to the next step, which a file may lack.
                raw = f.read_at((m - 1) * x.step + n * dtype.itemsize, x.start + (partition.first + k) * x.step)
                v = np.lib.stride_tricks.as_strided(np.frombuffer(raw, dtype, n), (m, n), (x.step, dtype.itemsize)).astype(float)
                data = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * n, n), pa.int32()), pa.array(v.ravel()))
                same = lambda value, kind: pa.array([value] * m, kind)  # noqa: B023, E731
                t = pa.array(range(partition.t + k, partition.t + k + m), pa.int64())
                yield pa.RecordBatch.from_arrays([same(partition.path, pa.string()), t, same(0, pa.int32()), same(x.h, pa.int32()), same(x.w, pa.int32()), data], ["path", "t", "ch", "h", "w", "data"])


@dataclass
class Written(WriterCommitMessage):
    #: What a task wrote and what it shall be called: the first frame's number orders the files.
    held: str | None
    t: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        frames = ((t, h, w, d) for b in batches for t, h, w, d in zip(*(b.column(c).to_pylist() for c in ("t", "h", "w")), (b.column("data")[k].values.to_numpy() for k in range(b.num_rows)), strict=True))
        store, where = _filesystem(self.options["path"])
        store.create_dir(where)
        name, first, n, shape, last = f"{where}/.{uuid.uuid4().hex}", None, 0, None, None
        kind, dtype = self.options["kind"], np.dtype("<u2" if self.options["kind"] == "mlf" else self.options.get("dtype", "<f8"))
        with store.open_output_stream(f"{name}.body") as out:
            for t, h, w, d in frames:
                if (last is not None and t <= last) or shape not in (None, (h, w)):
                    raise ValueError(f"frame {t}: frames of a file are of one size, sorted and unlike in t")
                first, last, shape, n = t if first is None else first, t, (h, w), n + 1
                out.write(d.astype(dtype).tobytes())
                if kind == "mlf":
                    out.write(bytes(2 * h * w))  # no contrast
        if not n:
            store.delete_file(f"{name}.body")
            return Written(None, 0)
        with store.open_output_stream(name) as out, store.open_input_stream(f"{name}.body") as body:
            out.write(_header(kind, n, *shape, dtype))
            while part := body.read(AT_ONCE):
                out.write(part)
        store.delete_file(f"{name}.body")
        return Written(name, first)

    def commit(self, messages: list[Written | None]) -> None:
        """Give the files their names, in the order of their frames."""
        done = sorted((m for m in messages if m and m.held), key=lambda m: m.t)
        for k, m in enumerate(done):
            store, where = _filesystem(self.options["path"])
            store.move(m.held, f"{where}/part-{k:05}.{self.options['kind']}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and m.held:
                _filesystem(self.options["path"])[0].delete_file(m.held)


def _header(kind: str, n: int, h: int, w: int, dtype: np.dtype) -> bytes:
    if kind == "npy":
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": dtype.str, "fortran_order": False, "shape": (n, h, w)})
        return out.getvalue()
    if kind == "mlf":
        name, places = next((k, v) for k, v in MLF_HEADERS.items() if b"V3" in k)
        head = bytearray(MLF_START)
        head[: len(name)] = name
        for field, value in (("nframes", n), ("ydim", h), ("xdim", w)):
            at, number = places[field]
            head[at : at + np.dtype(number).itemsize] = np.array([value], number).tobytes()
        return bytes(head)
    return b""


class FrameRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("frame ranges are written to a new folder")
        return Writer(dict(self.options))


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else a source that takes filters is refused
    spark.dataSource.register(FrameRanges)


def read_ranges(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """Frames (path, t, ch, h, w, data) of a file, or of a folder's files in natural order; t counts on from file to file.

    Filters on `t` decide which ranges are read.  An empty folder gives no frames.
    """
    _registered(spark)
    return spark.read.format(NAME).options(path=path, kind=kind, **{k: str(v) for k, v in options.items()}).load()


def write_ranges(frames: DataFrame, path: str, kind: str, files: int, **options) -> None:
    """Frames (t, h, w, data) as `files` files at most, each a range of t in order; kinds as for reading, speckle files rounding to 16 bits.

    A task streams its frames to one file.  Frames of a file must be of one size and unlike in t.
    """
    _registered(frames.sparkSession)
    dealt = frames.select("t", "h", "w", F.col("data").cast("array<double>").alias("data")).repartitionByRange(files, "t").sortWithinPartitions("t")
    dealt.write.format(NAME).mode("append").options(path=path, kind=kind, **{k: str(v) for k, v in options.items()}).save()
