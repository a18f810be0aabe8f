"""State machines along an order: the rows of a key pass one by one, and only the state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .. import ship


def in_order(df: DataFrame, key: str, order: list[str], make: Callable, schema: str) -> DataFrame:
    """Rows that `make(key)` gives out: a function that takes each row of a key in order, and None after the last.

    A key's rows are sorted in one task, which spills, and stream through it in batches; memory is that of the state.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for b in batches:
            out: list[tuple] = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                if step is None or (k != now and not (k != k and now != now)):
                    out += step(None) if step else []
                    now, step = k, make(k)
                out += step(row)
            yield pd.DataFrame(out, columns=names)
        if step:
            yield pd.DataFrame(step(None), columns=names)

    ship(df.sparkSession)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
