"""Exact top-k by inner product over an impact-ordered index, score at a time.

Index.  Vectors are dealt into blocks by hash.  The components of a block are postings (vector, component) in segments by
dimension and quantised impact: the magnitudes of a block are cut at quantiles, and a posting lies in the segment of its
dimension and level.  Beside the segments, which are written once, a block has the norms of what is unread after each
level, and its vectors in a forward store, from which possible members are scored.

Search.  A block of queries goes through a block's segments from the highest level down; a level is decoded when the first
query asks for it.  After a level, what a candidate has left can add at most the norm of its unread components times the
norm of the query's largest components, as many as are unread.  With that bound, a candidate is a possible member while it
can reach the k-th best proven score; a query stops where its possible members are few, which is the proof, and scores
exactly those.  Bounds are tried after every level, in blocks of any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship
from ._common import table, written

#: Shares of a block's postings above the lower end of each level of impact, from the highest level down; the last is 1.
LEVELS = (0.6, 0.75, 0.82, 0.9, 0.95)
GROUP = 16
LONG = (-(1 << 63), (1 << 63) - 1)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them all; float64 for those beyond 64 bits, which it holds exactly."""
    most = float(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else np.float64)


class Segments:
    """Postings of one block of vectors: ids, its vectors in a forward store, and its levels as they are stored."""

    def __init__(self, ids: np.ndarray, forward: np.ndarray, levels: list[list[tuple[int, bytes, bytes, str]]], rest: list[np.ndarray], left: list[np.ndarray]):
        #: `levels` has (dimension, places, components, their type); rest and left, before each level, the square of the norm and the number of unread components.
        self.ids, self.forward, self.levels, self.rest, self.left = ids, forward, levels, rest, left
        self.width = forward.shape[1]
        self.total = sum(len(at) // 4 for level in levels for _, at, _, _ in level)
        self.bytes = sum(len(at) + len(v) for level in levels for _, at, v, _ in level)
        self.most = float(np.abs(forward).max(initial=0))

    @staticmethod
    def build(ids: np.ndarray, c: np.ndarray, shares: tuple[float, ...] = LEVELS) -> Segments:
        """From ascending ids and a matrix of whole numbers (float64)."""
        size = np.abs(c)
        there = size[size > 0]
        cuts = np.unique(np.quantile(there, [1 - s for s in shares], method="lower"))[::-1] if len(there) else np.zeros(0)
        level = (size[:, :, None] < cuts).sum(2) if len(cuts) else np.zeros(c.shape, int)
        out, rest, left = [], [], []
        for k in range(len(cuts) + 1):
            in_it = (level == k) & (size > 0)
            found = [(d, np.flatnonzero(in_it[:, d])) for d in range(c.shape[1])]
            if segments := [(d, at.astype("<u4").tobytes(), (v := _narrow(c[at, d])).tobytes(), v.dtype.str) for d, at in found if len(at)]:
                unread = (level >= k) & (size > 0)
                out.append(segments)
                rest.append((np.where(unread, np.minimum(size, 1e150), 0) ** 2).sum(1))  # larger ones are scored without bounds
                left.append(unread.sum(1).astype("<i4"))
        return Segments(ids, _narrow(c), out, rest, left)

    def rows(self) -> list[tuple[int, int, bytes, bytes, str]]:
        """(level, dimension, places, components, their type): the stored form.  Level -1 has the ids and the forward store, with
        the width as dimension; dimension -1 of a level has the norms before it."""
        out = [(-1, self.width, self.ids.astype("<i8").tobytes(), self.forward.tobytes(), self.forward.dtype.str)]
        for k, level in enumerate(self.levels):
            out.append((k, -1, self.rest[k].tobytes(), self.left[k].tobytes(), ""))
            out += [(k, *segment) for segment in level]
        return out

    @staticmethod
    def read(rows: pd.DataFrame) -> Segments:
        ids, forward, levels, rest, left = np.zeros(0, np.int64), np.zeros((0, 0)), [], [], []
        for k, d, at, v, kind in rows.sort_values(["level", "dim"])[["level", "dim", "places", "impacts", "kind"]].itertuples(index=False):
            if k < 0:
                ids, forward = np.frombuffer(at, "<i8"), np.frombuffer(v, kind).reshape(-1, d) if d else np.zeros((len(at) // 8, 0))
            elif d < 0:
                levels.append([])
                rest.append(np.frombuffer(at, "<f8"))
                left.append(np.frombuffer(v, "<i4"))
            else:
                levels[-1].append((d, at, v, kind))
        return Segments(ids, forward, levels, rest, left)

    def search(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
        """((places, scores) of each query's k best, best first, ties to the smaller id; postings read; bytes of segments decoded).

        A row of the query's own id is no candidate.  Scores are exact: 64-bit where no sum can pass them; otherwise all
        candidates are scored in Python's whole numbers, and cut to the range of a long.
        """
        n, width = len(self.ids), max(self.width, q.shape[1], 1)
        q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
        own = np.searchsorted(self.ids, q_ids)
        own = np.where((own < n) & (self.ids[np.minimum(own, n - 1)] == q_ids), own, -1)
        top = float(np.abs(q).max(initial=0)) * self.most * width
        kind = np.float32 if top < 1 << 24 else np.float64  # sums of whole numbers, exact in float32 below 2 ** 24
        safe = top * (2.0**-20 if kind is np.float32 else width * 2.0**-50)  # rounding of sums and bounds
        whole = np.int64 if top < 1 << 62 else object
        exact = lambda x: np.array([[int(y) for y in r] for r in x], object).reshape(x.shape) if whole is object else x.astype(np.int64)
        qx = exact(q)
        out: list = [None] * len(q)
        read, loaded, kk = 0, 0, min(k, n - (own >= 0).any())

        def close(i: int, at: np.ndarray) -> None:
            at = at[at != own[i]]
            s = exact(self.forward[at]) @ qx[i, : self.width] if len(at) else np.zeros(0, np.int64)
            if len(at) > k and whole is not object:
                bar = np.partition(s, len(s) - k)[len(s) - k]
                # Of those at the bar the first suffice, since ids ascend with the place.
                pick = np.concatenate([np.flatnonzero(s > bar), np.flatnonzero(s == bar)[:k]])
                at, s = at[pick], s[pick]
            s = np.array([min(max(int(x), LONG[0]), LONG[1]) for x in s], np.int64)
            order = np.array(sorted(range(len(at)), key=lambda j: (-int(s[j]), at[j]))[:k], np.int64)
            out[i] = at[order], s[order]

        if whole is object:  # no bound on floating sums: every candidate is a possible member
            for i in range(len(q)):
                close(i, np.arange(n))
            return out, self.total * len(q), self.bytes
        # norms[m]: of the m largest components of each query, a little up
        norms = np.sqrt(np.concatenate([np.zeros((len(q), 1)), np.cumsum(np.sort(q**2, 1)[:, ::-1], 1)], 1)).T * (1 + 1e-5)
        open_ = np.arange(len(q))
        partial, qt = np.zeros((n, len(q)), kind), np.ascontiguousarray(q.T.astype(kind))
        # Groups are there for speed; a block with few of them has one for each candidate.
        group = max(1, min(GROUP, n // (4 * max(kk, 1))))
        pad = -n % group
        for level, segments in enumerate(self.levels):
            for d, at, v, form in segments:
                at, v = np.frombuffer(at, "<u4"), np.frombuffer(v, form)
                partial[at] += v.astype(kind)[:, None] * qt[d]
                read += len(at) * len(open_)
                loaded += at.nbytes + v.nbytes
            if level == len(self.levels) - 1 or kk <= 0:
                continue
            slack = norms[np.ix_(self.left[level + 1], open_)].astype(kind) * np.sqrt(self.rest[level + 1])[:, None].astype(kind) + kind(safe)
            low = partial - slack
            mine = np.flatnonzero(own[open_] >= 0)
            low[own[open_[mine]], mine] = -np.inf
            # The k-th best of the groups' best proven scores is a score that k candidates have.
            best = np.pad(low, ((0, pad), (0, 0)), constant_values=-np.inf).reshape(-1, group, len(open_)).max(1)
            bar = np.partition(best, len(best) - kk, 0)[len(best) - kk]
            possible = partial + slack >= bar - kind(safe)
            done = possible.sum(0) <= max(4 * k, n // 16)
            for j in np.flatnonzero(done):
                close(open_[j], np.flatnonzero(possible[:, j]))
            if done.any():
                open_, partial, qt = open_[~done], np.ascontiguousarray(partial[:, ~done]), np.ascontiguousarray(qt[:, ~done])
            if not len(open_):
                break
        for j, i in enumerate(open_):
            p = partial[:, j].astype(np.float64)
            if own[i] >= 0:
                p[own[i]] = -np.inf
            bar = np.partition(p, n - k)[n - k] if n > k else -np.inf
            close(i, np.flatnonzero(p >= bar - 2 * safe))
        return out, read, loaded


def _matrix(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of rows vec_id, v; of rows that repeat a vec_id the one with the least v, shorter vectors filled with 0."""
    rows = sorted(zip(g["vec_id"].tolist(), (np.asarray(v, np.float64).tolist() for v in g["v"]), strict=True), key=lambda r: r[0])
    one: dict[int, list[float]] = {}
    for i, v in rows:
        one[i] = min(v, one.get(i, v))
    out = np.zeros((len(one), max(map(len, one.values()), default=0)))
    for r, v in enumerate(one.values()):
        out[r, : len(v)] = v
    return np.array(list(one), np.int64), out


def build_index(vectors: DataFrame, block: int, shares: tuple[float, ...] = LEVELS) -> tuple[DataFrame, int]:
    """(cb, level, dim, places, impacts, kind) of every vector, as a written table, and the number of blocks."""
    blocks = max(1, -(-vectors.count() // block))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rows = Segments.build(*_matrix(g), shares).rows()
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["cb", "level", "dim", "places", "impacts", "kind"])

    ship(vectors.sparkSession)
    placed = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("cb"), "vec_id", "v")
    return written(placed.groupBy("cb").applyInPandas(one, "cb int, level int, dim int, places binary, impacts binary, kind string"), "segments"), blocks


def search_index(index: DataFrame, blocks: int, queries: DataFrame, k: int = 20, query_block: int = 1024, with_work: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of each row of `queries` (vec_id, v).  `with_work` gives postings read and held, and bytes of segments decoded and held, by block pair instead."""
    parts = max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(every(blocks).alias("cb"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("qb"), "vec_id", "v")
    held = index.withColumn("qb", every(parts))

    def run(q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        found, read, full, loaded, held_bytes = [(np.zeros(0, np.int64),) * 3], 0, 0, 0, 0
        if len(q) and len(g):
            s = Segments.read(g)
            ids, x = _matrix(q)
            for a in range(0, len(ids), 128):
                got, n, m = s.search(x[a : a + 128], ids[a : a + 128], k)
                read, full, loaded, held_bytes = read + n, full + s.total * len(got), loaded + m, held_bytes + s.bytes
                found += [(np.full(len(at), ids[a + i]), s.ids[at], v) for i, (at, v) in enumerate(got)]
        if with_work:
            return pd.DataFrame({"postings_read": [read], "postings_held": [full], "bytes_read": [loaded], "bytes_held": [held_bytes]})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    ship(index.sparkSession)
    out = asked.groupBy("cb", "qb").cogroup(held.groupBy("cb", "qb")).applyInPandas(run, "postings_read long, postings_held long, bytes_read long, bytes_held long" if with_work else "query_id long, vec_id long, score long")
    if with_work:
        return out
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other rows, by exact inner product.

    `vectors` has vec_id (not null) and v (array of whole numbers, as long or double, not null); further columns are left out.
    Rows repeated in vec_id count once (that of least v); vectors of unlike length are compared on the dimensions that both
    have.  Ties go to the smaller vec_id.  A score beyond a long counts as the nearest
    long.  An empty frame gives an empty result.  A task never holds more than about `block` rows and `query_block` queries,
    and k rows a query leave it.
    """
    index, blocks = build_index(vectors, block)
    return search_index(index, blocks, vectors.filter(is_query), k, query_block)


def quantised(x: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v = floor(scale * x) as double, of the rows whose id, vector and components are there and finite."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = x.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    # From 2 ** 53 on, a double is a whole number; Spark's floor would cut it to a long.
    floor = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    return whole.select("vec_id", F.transform("embedding", lambda e: floor(e.cast("double") * scale)).alias("v"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for each whose vec_id is divisible by 20, by inner product of floor(64 * x)."""
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
