"""The ordered operators over streams of samples (key, ts, value): state per key, event time, watermarks.

Each function takes a streaming or a batch frame; on a batch frame it gives what the stream gives once all has come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import in_order


def chunk_means(samples: DataFrame, size: str, late: str = "0 seconds") -> DataFrame:
    """Means of tumbling windows of event time; rows later than `late` are dropped."""
    w = samples.withWatermark("ts", late).groupBy("key", F.window("ts", size))
    return w.agg(F.count("value").alias("n"), F.avg("value").alias("value")).select("key", F.col("window.start").alias("start"), "n", "value")


def sliding_means(samples: DataFrame, size: str, step: str, late: str = "0 seconds") -> DataFrame:
    w = samples.withWatermark("ts", late).groupBy("key", F.window("ts", size, step))
    return w.agg(F.avg("value").alias("value")).select("key", F.col("window.start").alias("start"), "value")


def sessions(samples: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """Runs of samples of a key without a longer gap: objects that are seen, lost and seen again."""
    w = samples.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap))
    return w.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "top")


def _filter(p: float | None, e: float, m: float, gain: float, var: float) -> tuple[float, float]:
    """The next prediction and its error."""
    p = m if p is None else p
    k = 1 + gain * (e / (e + var) - 1)
    c = p + k * (m - p)
    return c, e * (1 - k) + ((c - p) ** 2 / (p * p) if p else 0.0)


def kalman(samples: DataFrame, gain: float = 0.5, var: float = 0.05) -> DataFrame:
    """(key, ts, value): a recursive filter of each key's samples; the state is the prediction and its error.

    Within a micro-batch samples are taken in order of ts; across them in order of arrival.
    """
    out = f"key {dict(samples.dtypes)['key']}, ts timestamp, value double"

    def make(k):
        p, e = None, var

        def step(row) -> list[tuple]:
            nonlocal p, e
            if row is None:
                return []
            p, e = _filter(p, e, row.value, gain, var)
            return [(k, row.ts, p)]

        return step

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p, e = state.get if state.exists else (None, var)
        rows, values = pd.concat(list(batches)).sort_values(["ts", "value"]), []
        for m in rows["value"]:
            p, e = _filter(p, e, m, gain, var)
            values.append(p)
        state.update((float(p), float(e)))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "value": values})

    if not samples.isStreaming:
        return in_order(samples.select("key", "ts", "value"), "key", ["ts", "value"], make, out)
    return samples.groupBy("key").applyInPandasWithState(run, out, "p double, e double", "append", GroupStateTimeout.NoTimeout)


def track(candidates: DataFrame, seed: float, memory: int = 5) -> DataFrame:
    """(key, ts, value): of each time's candidates the one nearest the mean of the last accepted ones."""
    out = f"key {dict(candidates.dtypes)['key']}, ts timestamp, value double"

    def nearest(last: list[float], values: list[float]) -> float:
        mean = sum(last[-memory:]) / len(last[-memory:])
        return float(min(values, key=lambda v: (abs(v - mean), v)))

    def make(k):
        last, ts, held = [seed], None, []

        def step(row) -> list[tuple]:
            nonlocal ts
            found = []
            if held and (row is None or row.ts != ts):
                last[:] = [*last[-memory:], nearest(last, held)]
                found = [(k, ts, last[-1])]
            if row is not None:
                if row.ts != ts:
                    ts = row.ts
                    held.clear()
                held.append(row.value)
            return found

        return step

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else [seed]
        found = []
        for ts, g in pd.concat(list(batches)).groupby("ts"):
            last.append(nearest(last, list(g["value"])))
            found.append((key[0], ts, last[-1]))
        state.update((last[-memory:],))
        yield pd.DataFrame(found, columns=["key", "ts", "value"])

    if not candidates.isStreaming:
        return in_order(candidates.select("key", "ts", "value"), "key", ["ts", "value"], make, out)
    return candidates.groupBy("key").applyInPandasWithState(run, out, "last array<double>", "append", GroupStateTimeout.NoTimeout)
