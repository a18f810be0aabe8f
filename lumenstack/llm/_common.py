"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..operators.graph import connected_components, written

__all__ = ["SPACE", "arrow_map", "connected_components", "let", "table", "words_of", "written"]

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """`df.mapInArrow` with this package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def let(value: Column, body) -> Column:
    """`body` with its argument bound to `value`, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words `[^\x20\x09-\x0D]+` of a text; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")
