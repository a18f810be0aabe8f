"""Packing of token pieces into sequences by exact complements, then best fit.

The plan is made from the histogram of piece lengths alone, which has as many entries as a sequence has tokens, however
many pieces there are.  An index holds, for each sum, how many pairs and triples of available lengths have it; it is kept
up to date as lengths run out.  From the longest piece down, the gap that it leaves is looked up among the single lengths,
then among the pairs, then among the triples, and a combination that fills it exactly is consumed as often as the counts
allow.  The rest is packed best fit, longest first.  Very short lengths are worth more as fillers of the rest than inside
combinations, so plans that spare more or fewer of them are compared, with best fit alone as the last.  A plan is a list
of patterns (lengths, how often); pieces take their places in it by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_map, table, written

END_ID = 2
SALTS = 32
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first of several may be shorter than `most`."""
    first = n % most or min(n, most)
    return [(0, first), *((s, most) for s in range(first, n, most))]


_ENCODERS: dict[str, object] = {}


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Ids of the added tokens of the json beside the rank file, which `tokenizers` finds inside texts; none if there is no json."""
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError(f"added tokens of {path} that take blanks or whole words only are not supported")
    return {t["content"]: t["id"] for t in found}


def _encoder(path: str, pattern: str):
    """This process's function from texts to ids; they are those of `tokenizers` for the same vocabulary, which a test holds it to."""
    if path not in _ENCODERS:
        import tiktoken

        from .bpe import load_ranks

        added = added_tokens(path)
        encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens=added)
        special = set(added)
        _ENCODERS[path] = lambda text: encoding.encode(text, allowed_special=special, disallowed_special=())
    return _ENCODERS[path]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut where longer than `capacity`; no shuffle.

    Added tokens of the vocabulary are found inside texts.  Null text counts as empty and gives the end id alone.  `with_ids` adds the ids as little-endian unsigned 32-bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path, pattern)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            met: dict[str, bytes] = {}  # copies in one batch are encoded once
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                if text not in met:
                    met[text] = np.array(encode(text), "<u4").tobytes() + end
                ids = met[text]
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, k, start, n, zlib.crc32(part), *[part] * with_ids))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return arrow_map(docs.select("doc_id", "text"), run, PIECE + ", ids binary" * with_ids)


class Sums:
    """How many pairs and triples of available lengths have each sum up to the capacity; a length counts in as often as it is there."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left, self.pairs, self.triples = (np.zeros(capacity + 1, np.int64) for _ in range(3))
        for k, n in counts.items():
            self.put(k, n)

    def put(self, k: int, n: int) -> None:
        """`n` more pieces of length k; fewer, if negative."""
        old, new = int(self.left[k]), int(self.left[k]) + n
        sign, end = 1 if n > 0 else -1, len(self.left)
        self.left[k] = 0
        others = np.flatnonzero(self.left)
        for twice in [v for v in (1, 2, 3) if min(old, new) < v <= max(old, new)][::sign]:  # the first, second and third piece of k
            sums = others + twice * k
            sums = sums[sums < end]
            if twice == 1:
                if sign < 0:
                    self.pairs[sums] -= 1
                self.triples[k:] += sign * self.pairs[: end - k]  # of other lengths only
                if sign > 0:
                    self.pairs[sums] += 1
            elif twice == 2 and 2 * k < end:
                self.pairs[2 * k] += sign
                self.triples[sums] += sign
            elif twice == 3 and 3 * k < end:
                self.triples[3 * k] += sign
        self.left[k] = new

    def find(self, total: int, size: int, most: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """The combination of `size` lengths of that sum, none above `most`, with the longest first length; None if there is none beside the pieces `held`."""
        by_size = self.left, self.pairs, self.triples
        if not by_size[size - 1][total]:
            return None
        if size == 1:
            return (total,) if total <= most and self.left[total] > held.count(total) else None
        ks = np.arange(min(most, total - size + 1), (total - 1) // size, -1)
        for k in map(int, ks[(self.left[ks] > 0) & (by_size[size - 2][total - ks] > 0)]):
            if self.left[k] > held.count(k) and (rest := self.find(total - k, size - 1, k, (*held, k))):
                return (k, *rest)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that use each length as often as `counts` says: the plan of fewest sequences, by exact sums where they tie with best fit alone."""
    spared = [plan_by(counts, capacity, 3, max(1, capacity // k)) for k in (32, 16, 12, 8, 6, 5, 4, 3, 2)]
    return min([*spared, plan_by(counts, capacity, 0, 1)], key=lambda p: sum(n for _, n in p))


def plan_by(counts: dict[int, int], capacity: int, parts: int, spare: int) -> list[tuple[tuple[int, ...], int]]:
    """Gaps filled exactly by up to `parts` lengths of `spare` tokens or more, then best fit of what is left."""
    index = Sums({k: n for k, n in counts.items() if k >= spare and n}, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    for size in range(1, parts + 1):
        for k in range(capacity - 1, 0, -1):
            while index.left[k] and (combo := index.find(capacity - k, size, k, (k,))):
                pattern = (k, *combo)
                times = min(int(index.left[x]) // pattern.count(x) for x in pattern)
                for x in set(pattern):
                    index.put(x, -times * pattern.count(x))
                out.append((pattern, times))
    left = {k: int(index.left[k]) if k >= spare else n for k, n in counts.items()}
    return out + best_fit(left, capacity)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of best fit, longest pieces first; pieces of one length go into sequences of one gap together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap: patterns, and how often
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            gap = next((g for g in range(k, capacity) if bins.get(g)), None)
            if gap is None:
                each = capacity // k
                for size, times in ((each, n // each), (n % each, 1)):
                    if size and times:
                        bins.setdefault(capacity - size * k, []).append(((k,) * size, times))
                break
            pattern, times = bins[gap].pop()
            m = min(n, times)
            if times > m:
                bins[gap].append((pattern, times - m))
            bins.setdefault(gap - k, []).append(((*pattern, k), m))
            n -= m
    return [(p, t) for found in bins.values() for p, t in found]


def pack(parts: DataFrame, order: list[str], capacity: int = 1024) -> DataFrame:
    """`parts` (with a `length` from 1 to capacity) with sequence_id and offset.

    `parts` is read twice, so it should be a written table.  Ranks are counted by length and salt (a hash of `order`),
    so that a length which many pieces share is no single task's; the counts that reach the driver are at most
    capacity * SALTS.  Rows equal in `order` may swap places.  An empty frame gives an empty result.  Columns named
    sequence_id or offset are replaced, all others are kept.
    """
    spark, names = parts.sparkSession, [c for c in parts.columns if c not in ("sequence_id", "offset")]
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")
    salted = parts.select(F.struct(*names).alias("row"), F.col("length").cast("long").alias("size"), salt.alias("salt"), F.struct(*order).alias("ties"))
    counts = salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).collect()
    total: dict[int, int] = {}
    before = []
    for k, at, n in sorted(map(tuple, counts)):
        before.append((k, at, total.get(k, 0)))
        total[k] = total.get(k, 0) + n
    taken: dict[int, int] = dict.fromkeys(total, 0)
    places, base = [], 0
    for pattern, times in plan(total, capacity):
        at = 0
        for k in pattern:
            places.append((k, taken[k], taken[k] + times, base, at))
            taken[k] += times
            at += k
        base += times
    # Both tables are bounded by the capacity and the salts, not by the data.
    before = spark.createDataFrame(before, "size long, salt int, before long")
    places = spark.createDataFrame(places, "k long, low long, high long, base long, offset long")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("ties")))
    ranked = ranked.join(F.broadcast(before), ["size", "salt"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    found = ranked.join(F.broadcast(places), (F.col("size") == F.col("k")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select("row.*", (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences themselves, of pieces packed with their ids: sequence_id, ids (binary), lengths of the pieces."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths")
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    parts = written(pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), "pieces")
    return pack(parts, ["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; one row per piece."""
    return pack_documents(table(spark, sf_dir, "documents"))
