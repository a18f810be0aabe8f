"""Writers: sequences as Parquet or TIFF, tables of traces as CSV."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import quantiles, roi_trace
from ..operators.window import dfof
from . import tiff


def write_sequences(sequences: dict[str, DataFrame], path: str) -> None:
    """Cells of each sequence under seq_id=<name>, so that a filter on seq_id reads one folder only."""
    out = None
    for name, cells in sequences.items():
        x = cells.select(F.lit(name).alias("seq_id"), "t", "row", "col", "value")
        out = x if out is None else out.unionByName(x)
    out.write.partitionBy("seq_id").parquet(path)


def wide(traces: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(t, one column per tag) of (tag, t, value); the tags are found by a pass unless given."""
    p = traces.groupBy("t").pivot("tag", tags) if tags else traces.groupBy("t").pivot("tag")
    return p.agg(F.first("value")).orderBy("t")


def write_table(traces: DataFrame, path: str, sep: str = ",", tags: list[str] | None = None) -> None:
    """Columns by tag, NA where a trace has no value, every field quoted."""
    wide(traces, tags).write.csv(path, sep=sep, header=True, nullValue="NA", quoteAll=True)


def write_rois(rois: DataFrame, path: str) -> None:
    rois.write.json(path)


def read_rois(spark, path: str, schema: str = "tag string, cx double, cy double, r double") -> DataFrame:
    return spark.read.schema(schema).json(path)


def lut(cells: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values cut and scaled to 0 ... 1 for display, between the 1st and 99th percentile unless given."""
    if low is None or high is None:
        a, b = quantiles(cells, [0.01, 0.99])
        low, high = a if low is None else low, b if high is None else high
    return cells.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - low) / ((high - low) or 1.0))))


def to_tiff(frames: DataFrame, dtype: str = "float32") -> DataFrame:
    """(t, content): each frame (t, h, w, data) as the bytes of a TIFF file, for any sink of binary rows."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"t": b["t"], "content": [tiff.write_images([np.asarray(d, float).reshape(h, w).astype(dtype)]) for h, w, d in zip(b["h"], b["w"], b["data"], strict=True)]})

    return frames.select("t", "h", "w", "data").mapInPandas(run, "t long, content binary")


def save_stack(frames: DataFrame, path: str, dtype: str = "float32", most_bytes: int = 1 << 28) -> None:
    """One multi-page TIFF on the driver's disk, for stacks of bounded size that are to be opened elsewhere."""
    size = frames.agg(F.sum(F.col("h").cast("long") * F.col("w"))).first()[0] or 0
    if size * 8 > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes; write the frames with to_tiff")
    rows = sorted(frames.select("t", "h", "w", "data").collect())
    with open(path, "wb") as f:
        f.write(tiff.write_images([np.array(r["data"]).reshape(r["h"], r["w"]).astype(dtype) for r in rows]))


def export_roi_signals(cells: DataFrame, rois: DataFrame, path: str, baseline: int | None = None, sep: str = ",") -> None:
    """The mean trace of each region as a table with a column per tag, as dF/F over the first frames if their number is given."""
    traces = roi_trace(cells, rois)
    write_table(traces if baseline is None else dfof(traces, ["tag"], baseline), path, sep)


def write_walls(walls: DataFrame, key: str, path: str) -> None:
    """Tracked walls (key, t, lower, upper) with the diameter, as CSV."""
    walls.select(key, "t", "lower", "upper", (F.col("upper") - F.col("lower")).alias("diameter")).orderBy(key, "t").write.csv(path, header=True)
