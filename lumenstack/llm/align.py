"""Alignment of two tokenizers: which tokens of one stand for the bytes of which tokens of the other, and how often.

Cumulative ends of both token sequences are merged; where both end, a group ends.  All tokens of one side of a group are
linked to all of the other.  A count belongs to a pair of ids: how many texts hold it linked.

The merge is one of sorted arrays: each end of the left side is led to its place among those of the right, both pointers
only moving on, for all ends in one pass.  Both vocabularies end a token wherever a letter, mark, digit, punctuation or
symbol is followed by a blank, whatever else the text holds (checked when they are loaded), so long texts are taken in
parts between such places.  Texts are gathered into blocks; a block has a dictionary of the pairs that its texts hold and,
for each text, their places in it.  Spark groups the dictionaries' rows by pair, joins the counts and the highest of each
left id back to them, and each block's counts to the block.  So the rows that are shuffled are the different pairs of a
block, not the links of each text.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, table, written
from .token_count import STABLE, byte_level, pieces

#: Links of texts with so many different pairs in sum, or so many texts, make a block; one text is never divided.
BLOCK_LINKS, BLOCK_TEXTS = 2_000_000, 20_000
#: Characters of a text that are taken at once, where it has a place to part it, and links of a group that are written out one by one.
AT_ONCE, SMALL_GROUP = 500_000, 1024


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side lie before each end that both have."""
    at = np.searchsorted(ends_b, ends_a)
    both = ends_b[at] == ends_a
    return np.flatnonzero(both) + 1, at[both] + 1


class Aligner:
    """Both vocabularies."""

    def __init__(self, a_path: str, b_path: str):
        import regex

        self.encoding, bytes_a, _ = byte_level(a_path)
        self.model, self.bytes_b = pieces(b_path)
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]
        self.blank = [self.model.piece_to_id("▁")]
        self.len_a, self.len_b = (np.array([len(x) for x in said], np.int64) for said in (self.bytes_a, self.bytes_b))
        if not all(bytes_a.values()) or not all(self.bytes_b):
            raise ValueError("a token without bytes belongs to no group")
        text = lambda n, after: np.array([f"{i}{after}" for i in range(n)], object)
        self.said_a = text(len(self.len_a), ","), text(len(self.len_a), "|")
        self.said_b = text(len(self.len_b), ","), text(len(self.len_b), ";")
        self.place = regex.compile(STABLE)

    def parts(self, text: str) -> Iterator[str]:
        """The text from one place that surely ends a token to the next, each part long enough."""
        start = 0
        while (m := self.place.search(text, start + AT_ONCE)) if len(text) - start > AT_ONCE else None:
            yield text[start : m.end()]
            start = m.end()
        yield text[start:]

    def text(self, text: str) -> tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links), the groups' digest, the pairs in ascending order and how often each is linked."""
        nothing = (0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return nothing
        sha, total, pairs, times, before = hashlib.sha256(), np.zeros(4, np.int64), [], [], ""
        for part in self.parts(" " + text):
            if (got := self.aligned(part)) is None:
                return nothing
            total += got[0]
            sha.update((before + got[1]).encode())
            before = ";"
            pairs.append(got[2])
            times.append(got[3])
            if len(pairs) > 1:
                merged = _summed(np.concatenate(pairs), np.concatenate(times))
                pairs, times = [merged[0]], [merged[1]]
        return tuple(total.tolist()), sha.hexdigest(), pairs[0], times[0]

    def aligned(self, part: str) -> tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray] | None:
        """The same of a part, which begins with a blank, with the groups in full; none where the tokens' bytes are not the part's."""
        a = self.encoding.encode_to_numpy(part, disallowed_special=()).astype(np.int64)
        b = self.model.encode(part[1:], num_threads=1) if len(part) > 1 else self.blank
        data = part.encode()
        if b"".join([self.bytes_a[t] for t in a.tolist()]) != data or b"".join([self.bytes_b[t] for t in b]) != data:
            return None
        b = np.array(b, np.int64)
        to_a, to_b = merge(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        from_b = to_b - n_b
        # Each side's tokens go behind those of the other side before them; the last of a group is followed by another mark.
        said = np.empty(len(a) + len(b), object)
        at_a, at_b = np.arange(len(a)) + np.repeat(from_b, n_a), np.arange(len(b)) + np.repeat(to_a, n_b)
        said[at_a], said[at_b] = self.said_a[0][a], self.said_b[0][b]
        said[at_a[to_a - 1]], said[at_b[to_b - 1]] = self.said_a[1][a[to_a - 1]], self.said_b[1][b[to_b - 1]]
        n_links = n_a * n_b
        # Groups of a few links: every token of the left side beside every one of the right.
        small = n_links <= SMALL_GROUP
        left = np.flatnonzero(np.repeat(small, n_a))
        each = np.repeat(n_b, n_a)[left]
        right = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(from_b, n_a)[left], each)
        pairs, times = np.unique(np.repeat(a[left], each) << 32 | b[right], return_counts=True)
        for g in np.flatnonzero(~small):
            (x, n), (y, m) = (np.unique(ids[to[g] - k[g] : to[g]], return_counts=True) for ids, to, k in ((a, to_a, n_a), (b, to_b, n_b)))
            pairs, times = _summed(np.concatenate([pairs, (x[:, None] << 32 | y).ravel()]), np.concatenate([times, (n[:, None] * m).ravel()]))
        return (len(a), len(b), len(to_a), int(n_links.sum())), "".join(said.tolist())[:-1], pairs, times


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(unique), np.int64)
    np.add.at(out, at, times)
    return unique, out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}

TEXTS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "upto": pa.int64()}
BLOCK = "block long, a array<int>, b array<int>, texts array<int>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, upto array<long>, place binary, times binary"


def _list(values, kind: pa.DataType) -> pa.Array:
    values = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(x: np.ndarray) -> pa.Array:
    import zstandard

    return pa.array([zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").tobytes())], pa.binary())


def _unpacked(x: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u4").astype(np.int64)


def _blocks(a_path: str, b_path: str):
    def block(at: int, rows: list[tuple], pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        unique, place = np.unique(np.concatenate(pairs), return_inverse=True)
        # A text's places ascend, so that their differences are small.
        step = np.concatenate([np.diff(place[s:e], prepend=0) for s, e in itertools.pairwise([0, *(r[-1] for r in rows)])])
        columns = [
            pa.array([at], pa.int64()), _list((unique >> 32).astype(np.int32), pa.int32()), _list((unique & 0xFFFFFFFF).astype(np.int32), pa.int32()),
            _list(np.bincount(place, minlength=len(unique)).astype(np.int32), pa.int32()),
            *[_list(x, k) for x, k in zip(zip(*rows, strict=True), TEXTS.values(), strict=True)], _packed(step), _packed(np.concatenate(times)),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (a_path, b_path) not in _ALIGNERS:
            _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
        aligner, at, n = _ALIGNERS[a_path, b_path], TaskContext.get().partitionId() << 32, 0
        rows, pairs, times = [], [], []
        for b in batches:
            copies: dict[str, tuple] = {}  # copies in one batch are aligned once
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                if text not in copies:
                    copies[text] = aligner.text(text)
                sums, sha, p, t = copies[text]
                n += len(p)
                rows.append((doc, *sums, sha, n))
                pairs.append(p)
                times.append(t)
                if n >= BLOCK_LINKS or len(rows) >= BLOCK_TEXTS:
                    yield block(at, rows, pairs, times)
                    rows, pairs, times, n, at = [], [], [], 0, at + 1
        if rows:
            yield block(at, rows, pairs, times)

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their pairs' `value` (2 * count + whether it is its left id's highest), as texts with their sums."""
    for b in batches:
        for k in range(b.num_rows):
            get = lambda c: b.column(c)[k]  # noqa: B023, E731
            upto = get("upto").values.to_numpy()
            value = get("value").values.to_numpy() if get("value").is_valid else np.zeros(0, np.int64)
            step, times = _unpacked(get("place").as_py()), _unpacked(get("times").as_py())
            first = np.concatenate([[0], upto[:-1]])
            # Differences are summed within each text: what was summed before its first place is taken off.
            place = np.cumsum(step)
            place -= np.repeat(np.where(first > 0, place[np.maximum(first, 1) - 1], 0) if len(place) else first, upto - first)
            found = value[place] if len(place) else place
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto], prepend=0)  # noqa: B023, E731
            columns = [get(c).values for c in TEXTS if c != "upto"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums(times * (found & 1)), pa.int64()), pa.array(sums(times * (found >> 1)), pa.int64())], [*[c for c in TEXTS if c != "upto"], "n_best", "count_sum"])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def blocks_of(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks of aligned texts, as a written table; `a`, `b` and `texts` are a block's pairs and how many of its texts hold each."""
    return written(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _blocks(a_path, b_path), BLOCK), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): how many texts hold the pair linked, and the highest count of its left id."""
    held = blocks.select(F.explode(F.arrays_zip("a", "b", "texts")).alias("e")).groupBy("e.a", "e.b").agg(F.sum("e.texts").alias("count"))
    held = written(held, "pair-counts")
    # At most as many rows as the left vocabulary has ids.
    return held.join(F.broadcast(held.groupBy("a").agg(F.max("count").alias("best"))), "a").select("a", "b", "count", "best")


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text), with its groups, links and their corpus-wide counts.

    Null and empty texts, and those whose tokens' bytes are not a blank and the text, have no tokens: zeros and an empty
    digest.  Copies and rows that share or lack an id are texts of their own.  Other columns are not read.
    """
    blocks = blocks_of(docs, a_path, b_path)
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "e")).select("block", "at", "e.a", "e.b")
    valued = pairs.join(pair_counts(blocks), ["a", "b"]).select("block", F.struct("at", (2 * F.col("count") + (F.col("count") == F.col("best")).cast("long")).alias("value")).alias("v"))
    values = valued.groupBy("block").agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["value"]).alias("value"))
    return arrow_map(blocks.drop("a", "b", "texts").join(values, "block", "left"), _scores, RESULT)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE against pieces, over every whole text."""
    import public_tokenizers as P

    out = align_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
