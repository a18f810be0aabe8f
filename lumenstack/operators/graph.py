"""Connected components of an edge list, for regions, clusters and links."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenstack-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str, instead_of: list[str] | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: later reads survive lost executors and do not repeat its work.

    `instead_of` holds the path of a table that only this frame is made of; it is deleted, and the new path put in its place.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if instead_of is not None:
        for old in instead_of:
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
        instead_of[:] = [path]
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of an edge (a, b) that is not the least of its component.

    Alternating large and small stars, each round a written table.  Rounds grow with the logarithm of the nodes; a node
    with many edges is met by partial aggregates and by joins that adaptive execution can split.  Loops, repeated edges
    and an empty frame are fine; edges with a null end are none.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    last: list[str] = []
    e = written(e, name, last)
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name, last)
