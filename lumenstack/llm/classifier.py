"""A quality classifier of supervised subword embeddings.

A word's features are the word, its character n-grams and the pairs of neighbouring words, hashed into one table of
vectors; a document is the average of its features' vectors, and a softmax layer gives the score.  Vectors and layer
are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, table


@dataclass(frozen=True)
class Params:
    """`sample_rows` bounds the labelled rows of each class that reach training."""

    buckets: int = 1 << 16
    dim: int = 16
    least: int = 2
    most: int = 4
    epochs: int = 8
    rate: float = 0.7
    sample_rows: int = 2000
    seed: int = 7


def word_features(words: list[str], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, bounds, codes) of many words at once: word k's are buckets[bounds[k] : bounds[k + 1]], codes its hash.

    They are the word itself and its character n-grams; `<` and `>` mark its ends.
    """
    codes = np.array([crc32(w.encode()) for w in words], np.uint64)
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    ids, whose, h = [_bucket(codes, p)], [np.arange(len(words))], np.zeros(len(chars), np.uint64)
    for n in range(1, p.most + 1):
        h = h[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(1)
        if n >= p.least:
            inside = np.flatnonzero(np.arange(len(h)) + n <= end[: len(h)])
            ids.append(_bucket(h[inside] + np.uint64(n), p))
            whose.append(owner[inside])
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return np.concatenate(ids)[order], np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(words)))]), codes.astype(np.int64)


def _bucket(h: np.ndarray, p: Params) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)) % np.uint64(p.buckets)).astype(np.int64)


def pair_features(codes: np.ndarray, p: Params) -> np.ndarray:
    """Buckets of neighbouring words, from the words' hashes; all pairs of one word with itself share a bucket."""
    c = codes.astype(np.uint64)
    return np.where(c[:-1] == c[1:], crc32(b"twice") % p.buckets, (c[:-1] * np.uint64(2654435761) + c[1:]) % np.uint64(p.buckets)).astype(np.int64)


def document_features(text: str, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = {w: i for i, w in enumerate(dict.fromkeys(words))}
    where = np.array([at[w] for w in words])
    buckets, bounds, codes = word_features(list(at), p)
    often = np.bincount(where)
    flat = np.concatenate([buckets, pair_features(codes[where], p)])
    weight = np.concatenate([np.repeat(often, np.diff(bounds)), np.ones(len(words) - 1, np.int64)])
    ids, back = np.unique(flat, return_inverse=True)
    return ids, np.bincount(back, weight).astype(np.int64)


@dataclass
class Model:
    params: Params
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def score(self, mean: np.ndarray) -> float:
        z = mean @ self.layer + self.bias
        return float(1 / (1 + np.exp(np.clip(z[0] - z[1], -50, 50))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], p: Params) -> Model:
    """SGD on the softmax loss, one document at a time, at a rate that falls to 0.  Without rows, all scores are 0.5."""
    rng = np.random.default_rng(p.seed)
    m = Model(p, rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32), np.zeros((p.dim, 2), np.float32), np.zeros(2, np.float32))
    rows = [(i, (n / n.sum()).astype(np.float32), y) for i, n, y in rows if len(i)]
    steps, done = p.epochs * len(rows), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(rows)):
            ids, w, y = rows[k]
            rate = np.float32(p.rate * (1 - done / steps))
            done += 1
            mean = w @ m.vectors[ids]
            z = mean @ m.layer + m.bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[y] -= 1
            back = m.layer @ g
            m.layer -= rate * np.outer(mean, g)
            m.bias -= rate * g
            # A document's vectors share its step; scaled by the number of distinct features, so that long texts learn too.
            m.vectors[ids] -= (rate * np.minimum(1, w * len(ids)))[:, None] * back
    return m


class Scorer:
    """Scores of texts, with the summed vectors of words met before; the table is bounded."""

    def __init__(self, model: Model, most: int = 400_000):
        self.m, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.zeros((1024, self.m.params.dim), np.float32)
        self.sizes = np.zeros(1024, np.int64)
        self.codes = np.zeros(1024, np.int64)

    def _meet(self, words: list[str]) -> None:
        first, last = len(self.at), len(self.at) + len(words)
        while last > len(self.sums):
            self.sums, self.sizes, self.codes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.sizes, self.codes))
        buckets, bounds, codes = word_features(words, self.m.params)
        self.sums[first:last] = np.add.reduceat(self.m.vectors[buckets], bounds[:-1], axis=0)
        self.sizes[first:last], self.codes[first:last] = np.diff(bounds), codes
        self.at.update(zip(words, range(first, last), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        split = [t.split() for t in texts]
        if len(self.at) > self.most:
            self._clear()
        new: dict[str, None] = {}
        known = self.at.get
        rows = []
        for words in split:
            found = [known(w) for w in words]
            if None in found:
                new.update(dict.fromkeys(w for w, i in zip(words, found, strict=True) if i is None))
                found = None
            rows.append(found)
        if new:
            self._meet(list(new))
        at = self.at
        return [self._score(np.array([at[w] for w in words] if found is None else found, np.int64)) for words, found in zip(split, rows, strict=True)]

    def _score(self, rows: np.ndarray) -> float:
        m = self.m
        if not len(rows):
            return m.score(np.zeros(m.params.dim, np.float32))
        pairs = pair_features(self.codes[rows], m.params)
        one = np.ones(len(rows), np.float32)  # sums by matrix product
        total = one @ self.sums[rows] + one[1:] @ m.vectors[pairs]
        return m.score(total / (self.sizes[rows].sum() + len(pairs)))


#: This process's scorer, kept from task to task.
_SCORER: list[Scorer] = []


def scorer(model: Model) -> Scorer:
    if not _SCORER or _SCORER[0].m is not model:
        _SCORER[:] = [Scorer(model)]
    return _SCORER[0]


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, label: str, p: Params = Params()) -> Model:
    """The model of at most `sample_rows` rows of each class outside fold 0, those of least key hash.

    Rows without label or text teach nothing; of several labels of one document the highest counts, and of several texts
    under one doc_id that of least hash, so that the sample is bounded however many rows share an id.
    """
    known = labels.filter(F.col(label).isin(0, 1) & (fold("doc_id") != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    some = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_rows) for y in (0, 1)]
    # At most 2 * sample_rows ids: bounded by a parameter.
    sample = docs.select("doc_id", "text").dropna().join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("_y").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [document_features(t.as_py(), p) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([i.astype("<u4").tobytes() for i, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())],
                ["doc_id", "y", "ids", "n"],
            )

    rows = arrow_map(sample.select("doc_id", "text", "_y"), run, "doc_id long, y int, ids binary, n binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["ids"])))
    return train([(np.frombuffer(r["ids"], "<u4").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(np.int64), r["y"]) for r in rows], p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; no shuffle.  The model's size is fixed by its parameters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = scorer(sent.value)
        for b in batches:
            for i in range(0, len(b), 128):
                part = b.slice(i, 128)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mine.scores([t or "" for t in part.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text, learnt from `labels.quality` outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels"), "quality"))
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
