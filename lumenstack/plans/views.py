"""Frame sequences, traces and regions of interest over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..operators.layout import densify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells (t, row, col, value): 30 days of 8 x 8 user cells, the mean event value in each, 0 where none."""
    e = table(spark, sf_dir, "events").select(
        F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long").alias("t"),
        F.pmod("user_id", F.lit(8)).cast("int").alias("row"), F.pmod(F.floor(F.col("user_id") / 8), F.lit(8)).cast("int").alias("col"), "value",
    )
    return densify(e.groupBy("t", "row", "col").agg(F.avg("value").alias("value")), 30, 8, 8)


CUBE = """cube AS (
  SELECT g.t, g.row, g.col, coalesce(e.value, 0.0)::DOUBLE AS value
  FROM (SELECT i // 64 AS t, ((i // 8) % 8)::INTEGER AS row, (i % 8)::INTEGER AS col FROM range(1920) r(i)) g
  LEFT JOIN (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS t, (user_id % 8)::INTEGER AS row, ((user_id // 8) % 8)::INTEGER AS col, avg(value) AS value FROM events GROUP BY 1, 2, 3) e
  ON g.t = e.t AND g.row = e.row AND g.col = e.col)"""


def traces_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traces (row, col, v): an embedding as the time series of a pixel."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 25).cast("int").alias("row"), F.pmod("vec_id", F.lit(25)).cast("int").alias("col"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def trace_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as cells."""
    return traces_emb(spark, sf_dir).select(F.posexplode("v").alias("t", "value"), "row", "col").select(F.col("t").cast("long").alias("t"), "row", "col", "value")


TRACES = """tr AS (
  SELECT (vec_id // 25)::INTEGER AS row, (vec_id % 25)::INTEGER AS col, unnest(range(len(embedding))) AS t, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


def stack_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells: an embedding as an 8 x 8 frame."""
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("i", "v"))
    return x.select("t", F.floor(F.col("i") / 8).cast("int").alias("row"), F.pmod("i", F.lit(8)).cast("int").alias("col"), F.col("v").cast("double").alias("value"))


STACK = """st AS (
  SELECT vec_id AS t, (i // 8)::INTEGER AS row, (i % 8)::INTEGER AS col, v::DOUBLE AS value
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings))"""


def trace_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, t, value): revenue by ship day, one trace per return flag."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1995-01-01"))).cast("long").alias("t"))
    return x.agg(F.sum("l_extendedprice").alias("value"))


DAILY = """daily AS (
  SELECT l_returnflag AS flag, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS t, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"""

ROI_ROWS = [("r01", 2.0, 2.0, 1.5), ("r02", 5.0, 5.0, 2.0), ("r03", 1.0, 6.0, 1.0), ("r04", 6.0, 1.0, 2.5)]


def rois(spark: SparkSession) -> DataFrame:
    """(tag, cx, cy, r): circles over the 8 x 8 grid."""
    return spark.createDataFrame(ROI_ROWS, "tag string, cx double, cy double, r double")


ROIS = "rois AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {x}::DOUBLE, {y}::DOUBLE, {r}::DOUBLE)" for t, x, y, r in ROI_ROWS) + ") v(tag, cx, cy, r))"
