"""A frame sequence with its metadata, and the places where a user's own functions plug in.

Everything is lazy and returns a new sequence; `cells`, `traces` and `frames` give the DataFrame in each layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .operators import aggregate, layout, window
from .sources import images


@dataclass(frozen=True)
class Axis:
    scale: float = 1.0
    units: str = ""


@dataclass(frozen=True)
class FrameSeq:
    cells: DataFrame
    axes: tuple[Axis, Axis, Axis] = (Axis(), Axis(), Axis())

    @staticmethod
    def open(spark: SparkSession, path: str, ch: int = 0, axes: list[tuple[float, str]] | None = None, xml: str | None = None) -> FrameSeq:
        """Of files of any kind that is read; `xml` names a microscope's job file that has the axes, unless they are given."""
        if axes is None and xml:
            axes = images.leica_axes(spark, xml)
        return FrameSeq(layout.frames_to_cells(images.open_seq(spark, path, ch)), meta(axes or []))

    @staticmethod
    def of(x: FrameSeq | np.ndarray | str, spark: SparkSession, **how) -> FrameSeq:
        """A sequence as it is, an array, or a path."""
        return x if isinstance(x, FrameSeq) else FrameSeq.of_array(spark, x, **how) if isinstance(x, np.ndarray) else FrameSeq.open(spark, x, **how)

    @property
    def kind(self) -> str:
        """Z for a sequence in depth, T for one in time, by the unit of its first axis; empty if that says neither."""
        units = self.axes[0].units
        return "Z" if units in ("um", "mm", "m", "nm") else "T" if units in ("ms", "us", "s", "msec", "usec", "ns", "sec") else ""

    @staticmethod
    def of_array(spark: SparkSession, x: np.ndarray, axes: list[tuple[float, str]] | None = None) -> FrameSeq:
        """From an array (t, h, w) on the driver."""
        rows = [(t, *f.shape, f.astype(float).ravel().tolist()) for t, f in enumerate(x)]
        return FrameSeq(layout.frames_to_cells(spark.createDataFrame(rows, "t long, h int, w int, data array<double>")), meta(axes or []))

    @property
    def frames(self) -> DataFrame:
        return layout.to_frames(self.cells)

    @property
    def traces(self) -> DataFrame:
        return layout.to_traces(self.cells)

    def times(self) -> DataFrame:
        return layout.times(self.cells.select("t").distinct(), self.axes[0].scale, self.axes[0].units)

    def crop(self, t=None, rows=None, cols=None, step: int = 1) -> FrameSeq:
        return replace(self, cells=layout.crop(self.cells, t, rows, cols, step))

    def masked(self, mask: DataFrame) -> FrameSeq:
        """Only the pixels of `mask` (row, col)."""
        return replace(self, cells=self.cells.join(mask.select("row", "col"), ["row", "col"], "left_semi"))

    def pipe(self, *fns: Callable[[DataFrame], DataFrame]) -> FrameSeq:
        """Functions of cells, from left to right."""
        out = self.cells
        for f in fns:
            out = f(out)
        return replace(self, cells=out)

    def map_frames(self, fn: Callable[[np.ndarray], np.ndarray]) -> FrameSeq:
        """A function of an image, which may change its size."""
        ship(self.cells.sparkSession)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [np.asarray(fn(np.asarray(d, float).reshape(h, w)), float) for h, w, d in zip(b["h"], b["w"], b["data"], strict=True)]
                yield pd.DataFrame({"t": b["t"], "h": [g.shape[0] for g in got], "w": [g.shape[1] for g in got], "data": [g.ravel() for g in got]})

        return replace(self, cells=layout.frames_to_cells(self.frames.mapInPandas(run, "t long, h int, w int, data array<double>")))

    def map_traces(self, fn: Callable[[np.ndarray], np.ndarray]) -> FrameSeq:
        """A function of a pixel's time series, which may change its length."""
        ship(self.cells.sparkSession)

        @F.pandas_udf("array<double>")
        def each(s: pd.Series) -> pd.Series:
            return s.map(lambda v: np.asarray(fn(np.asarray(v, float)), float))

        return replace(self, cells=layout.traces_to_cells(self.traces.withColumn("v", each("v"))))

    def project(self, how: str | Callable[[np.ndarray], float]) -> DataFrame:
        """(row, col, value): a named reduction of each trace, or a function's."""
        if isinstance(how, str):
            return aggregate.time_project(self.cells, how)
        ship(self.cells.sparkSession)

        @F.pandas_udf("double")
        def each(s: pd.Series) -> pd.Series:
            return s.map(lambda v: float(how(np.asarray(v, float))))

        return self.traces.select("row", "col", each("v").alias("value"))

    def dfof(self, n: int) -> FrameSeq:
        return self.pipe(lambda c: window.dfof(c, ["row", "col"], n))

    def roi_traces(self, rois: DataFrame) -> DataFrame:
        return aggregate.roi_trace(self.cells, rois)


def meta(axes: list[tuple[float, str]]) -> tuple[Axis, Axis, Axis]:
    """Three axes (t, row, col); a short list is filled up with its last entry."""
    got = [Axis(*a) for a in axes] or [Axis()]
    got += [got[-1]] * (3 - len(got))
    return got[0], got[1], got[2]
