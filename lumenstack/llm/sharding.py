"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of ticks.  Virtual nodes sit on ticks by hash; a key falls on the tick of its own
hash and belongs to the first virtual node clockwise.  A shard that holds its bound passes further keys clockwise, so no
shard exceeds `ceil((1 + epsilon) * rows / shards)`; at `epsilon=0` the bounds add up to the number of rows and all
counts are at most one apart.

All keys of one tick see the shards in the same order, so the walk needs only the number of keys on each tick: at most
`ticks` numbers by salt reach the driver, whatever the input.  Rows find their shard by their rank within the tick.  The text
itself is never shuffled; its size and checksum are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

SALTS = 16


def _point(label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode(), digest_size=8).digest(), "big")


@dataclass(frozen=True)
class Ring:
    """Virtual nodes of `shards` shards, `vnodes` each, on `ticks` places; adding a shard leaves the others' nodes in place."""

    shards: int
    vnodes: int = 64
    ticks: int = 8192

    def nodes(self) -> list[tuple[int, int]]:
        return sorted((_point(f"shard {s} node {v}") % self.ticks, s) for s in range(self.shards) for v in range(self.vnodes))

    def tick(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.ticks)).cast("int")

    def assign(self, counts: dict[int, int], epsilon: float = 0.0) -> list[tuple[int, int, int, int, int]]:
        """(tick, first rank, end rank, shard, first slot) for the keys on each tick; ticks are served in hash order."""
        total = sum(counts.values())
        if epsilon:
            bound = [-(-int(total * (1 + epsilon) * 1_000_000) // (self.shards * 1_000_000)) + 1] * self.shards
        else:
            bound = [total // self.shards + (s < total % self.shards) for s in range(self.shards)]
        nodes = self.nodes()
        places = [p for p, _ in nodes]
        after = list(range(len(nodes) + 1))  # the next node that may have room, with path compression

        def open_node(i: int) -> int:
            path = []
            while i < len(nodes) and (after[i] != i or held[nodes[i][1]] >= bound[nodes[i][1]]):
                path.append(i)
                i = after[i] if after[i] != i else i + 1
            for p in path:
                after[p] = i
            return i

        held = [0] * self.shards
        out = []
        for tick in sorted(counts, key=lambda t: _point(f"tick {t}")):
            rank, left = 0, counts[tick]
            while left:
                i = open_node(bisect_left(places, tick))
                if i == len(nodes):
                    i = open_node(0)
                shard = nodes[i][1]
                take = min(left, bound[shard] - held[shard])
                out.append((tick, rank, rank + take, shard, held[shard]))
                held[shard] += take
                rank += take
                left -= take
        return out


def shard(df: DataFrame, key: str, order: list[Column], ring: Ring, epsilon: float = 0.0) -> DataFrame:
    """`df` with `shard` and `slot`, gapless from 0 in each shard.

    `key` decides the place on the ring, `order` breaks ties within a tick; rows equal in both are interchangeable.  A
    null key has a place as any other value.  An empty frame gives an empty result.  Columns of `df` named shard or slot
    are replaced, all others are kept.  Rows are ranked by tick and salt (a hash of key and order), so that one key with
    many rows is ranked in as many tasks as there are salts; only rows equal in key and order stay together.
    """
    spark, names = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    ties = [F.col(key), *order]
    salt = F.pmod(F.xxhash64(*ties, F.lit("salt")), F.lit(SALTS)).cast("int")
    placed = df.select(F.struct(*names).alias("row"), ring.tick(F.col(key)).alias("tick"), salt.alias("salt"), F.struct(F.xxhash64(key).alias("h"), *[c.alias(f"o{i}") for i, c in enumerate(ties)]).alias("ties"))
    counts: dict[int, int] = {}
    before = []
    for t, k, n in sorted(map(tuple, placed.groupBy("tick", "salt").agg(F.count(F.lit(1)).alias("n")).collect())):  # at most ring.ticks * SALTS rows
        before.append((t, k, counts.get(t, 0)))
        counts[t] = counts.get(t, 0) + n
    # Both tables are bounded by parameters, not by data: ticks * SALTS, and ticks + shards * vnodes rows.
    before = spark.createDataFrame(before, "tick int, salt int, before long")
    plan = spark.createDataFrame(ring.assign(counts, epsilon), "at int, low long, high long, shard int, first long")
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("tick", "salt").orderBy("ties")))
    ranked = ranked.join(F.broadcast(before), ["tick", "salt"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    found = ranked.join(F.broadcast(plan), (F.col("tick") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select("row.*", "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `rows`: counts at most one apart.

    size: UTF-8 bytes of the text plus 16 (null text: 16, checksum 0).
    """
    docs = table(spark, sf_dir, "documents")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shard(slim, "doc_id", [F.col("size"), F.col("text_crc32")], Ring(40))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
