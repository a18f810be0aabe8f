"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of smaller id, or earlier in
its own.  A document is a doc_id and a text, known by the text's hash (`text_id`), which also orders unlike texts under one
doc_id.  Every such string is a window, and each window belongs to its anchor, the least of its k-mers by hash (the
leftmost of equal ones); equal windows have equal anchors at the same place.  So:

1. Each text's anchors, about two in every `length - k` bytes, are listed with the run of windows that belong to them.
2. Anchors whose k-mer occurs once in the whole corpus are dropped: their windows cannot repeat.
3. The others' contexts, the bytes of their windows, go to the partition of the k-mer.  There they come in order of (doc_id,
   text_id, start) and are taken in batches.  A batch gets a suffix array (its windows' starts, sorted by the bytes that
   follow), is merge-scanned against the arrays of the existing levels for matches of the whole length, and then becomes a
   level itself; levels of one size class are merged, so a partition of m windows has at most log2(m) levels.
4. The runs of repeated windows go back to their documents.

Hashes only deal out work: bytes are removed where bytes were found equal.  Equal contexts within one batch of texts are sent
once, so copies do not pile up in one partition.  K-mers that are common in a hash sample go another way: they are taken as
repeated, and their contexts are cut into short runs of windows, at fixed offsets from the anchor, that are dealt by the hash
of the bytes which all windows of the run share.

`SuffixStore` keeps the levels as tables, so that later batches of documents meet what earlier ones held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship
from ._common import arrow_map, table

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 20


@dataclass(frozen=True)
class Settings:
    """Bytes of a match and of an anchor; windows of a batch; bytes of texts that are listed together.

    A k-mer in more of about `sample_rows` sampled rows than `common` partitions should hold, and in 8 at least, is dealt
    by runs of `short` windows; at most `most_common` are.
    """

    length: int = 100
    k: int = 24
    batch_windows: int = 1 << 16
    short: int = 16
    common: float = 4.0
    sample_rows: int = 4000
    most_common: int = 4096
    chunk_bytes: int = 1 << 19


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def _sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial whose differences are the hashes of substrings."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(len(x) + 1)[0][:-1], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def kmer_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place."""
    return _mix((sums[k:] - sums[:-k]) * _powers(len(sums))[1][: len(sums) - k])


def anchors(x: np.ndarray, ends: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of each anchor of the texts concatenated in `x`; `ends` are their ends.

    Pieces of more than 2 ** PLACE_BITS places are worked off in overlapping parts.
    """
    n, w = len(x), s.length - s.k + 1
    part = 1 << PLACE_BITS
    if n < s.length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    sums = _sums(x)
    h = kmer_hashes(sums, s.k)
    where = np.empty(n - s.length + 1, np.int64)
    for a in range(0, len(where), part - w):
        b = min(len(where), a + part - w)
        key = (h[a : b + w - 1] >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(b + w - 1 - a, dtype=np.uint64)
        span = 1
        while 2 * span <= w:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < w:
            key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
        where[a:b] = (key & np.uint64(part - 1)).astype(np.int64) + a
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n + 1, np.int8)
    good = ends - starts >= s.length
    np.add.at(inside, starts[good], 1)
    np.add.at(inside, ends[good] - s.length + 1, -1)
    p = np.flatnonzero(np.cumsum(inside)[: len(where)])
    if not len(p):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    new = np.concatenate([[True], (where[p[1:]] != where[p[:-1]]) | (p[1:] != p[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(p)]]) - 1
    place = where[p[first]]
    return place, h[place], p[first], p[last]


def _chunks(batch: pa.RecordBatch, at_most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(rows, texts as bytes) of a batch, `at_most` bytes at a time; a longer text comes alone."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(batch.column("text")):
        b = (t.as_py() or "").encode()
        if texts and size + len(b) > at_most:
            yield np.array(rows), texts
            rows, texts, size = [], [], 0
        rows.append(i)
        texts.append(b)
        size += len(b)
    if texts:
        yield np.array(rows), texts


#: What is to be done with a context: compared with others, or cut into short runs and compared; and whether its k-mer is
#: known to be met again.
COMPARE, SHORT, AGAIN = 0, 1, 2


def _pack(first: np.ndarray, span: np.ndarray, off: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return (first << 25) | (span << 17) | (off << 9) | kind


def _unpack(place: int) -> tuple[int, int, int, int]:
    """(first window, run, the anchor's offset, what is to be done)."""
    return place >> 25, (place >> 17) & 255, (place >> 9) & 255, place & 1


def _partitions(docs: DataFrame) -> int:
    return 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def common_kmers(docs: DataFrame, rows: int, s: Settings) -> np.ndarray:
    """Hashes of the k-mers that are common in a sample, ascending; at most `most_common` reach the driver.

    The sample is one in so many documents, by hash of row_key, that about `sample_rows` of `rows` are in it.  It is
    anchored where it is read, so no row of it moves and it costs the reading of the table.
    """
    every = max(1, rows // s.sample_rows)
    some = docs.filter(F.pmod(F.xxhash64("row_key"), F.lit(every)) == 0)
    seen = list_anchors(some, s, np.zeros(0, np.uint64)).select("kmer", "row_key").distinct()
    enough = s.common * (rows / every) / _partitions(docs)
    top = seen.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 8) & (F.col("n") > enough)).orderBy(F.desc("n"), "kmer").limit(s.most_common)
    return np.sort(np.array([r["kmer"] for r in top.collect()], np.int64).view(np.uint64))


def list_anchors(docs: DataFrame, s: Settings, common: np.ndarray) -> DataFrame:
    """(key, row_key, place, kmer) of the anchors of `docs` (row_key, text): key is the k-mer's hash; place is as `_unpack` has it.

    Rows whose k-mer is known to be met again, as it is common or met twice in the same chunk of texts, are marked; all but
    the first of a chunk get keys of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row_key").to_numpy()
            for rows, texts in _chunks(batch, s.chunk_bytes):
                sizes = np.array([len(t) for t in texts])
                ends = np.cumsum(sizes)
                place, h, first, last = anchors(np.frombuffer(b"".join(texts), np.uint8), ends, s)
                at = np.searchsorted(ends, first, "right")
                start = (ends - sizes)[at]
                row, first_ = ids[rows[at]].astype(np.int64), first - start
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                later, again = np.zeros(len(h), bool), np.zeros(len(h), bool)
                if len(h):
                    later[order[1:]] = same
                    again[order[1:]] = same
                    again[order[:-1]] |= same
                frequent = np.isin(h, common)
                kind = np.where(frequent, SHORT, COMPARE) | np.where(again | frequent, AGAIN, 0)
                own = (row.view(np.uint64) * np.uint64(BASE)) ^ (first_.astype(np.uint64) * np.uint64(INVERSE))
                key = np.where(later | frequent, own, h).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(row), pa.array(_pack(first_, last - first, place - first, kind)), pa.array(h.view(np.int64))], ["key", "row_key", "place", "kmer"]
                )

    return arrow_map(docs, run, "key long, row_key long, place long, kmer long")


def to_look_at(found: DataFrame) -> DataFrame:
    """(row_key, place) of the anchors whose k-mer is met more than once."""
    x = found.select("row_key", "place", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("n"))
    return x.filter((F.col("place").bitwiseAND(F.lit(AGAIN)) != 0) | (F.col("n") > 1)).select("row_key", "place")


def _short_runs(anchor: int, start: int, span: int, s: Settings) -> list[tuple[int, int, int]]:
    """(start, run, core) of the windows start ... start + span, cut where their offset before the anchor is a multiple of
    `short`; the `length + 1 - short` bytes from the core on lie in every window of such offsets."""
    out = []
    low, high = anchor - start - span, anchor - start  # offsets, the last window's first
    for block in range(low // s.short, high // s.short + 1):
        a, b = max(low, block * s.short), min(high, (block + 1) * s.short - 1)
        out.append((anchor - b, b - a, anchor - block * s.short))
    return out


def contexts(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_id, start, span, context) of each listed place of `docs` (doc_id, text_id, _row with text, places).

    The context holds as many windows as the lowest 8 bits of `span` say, and one more; the rest is for `bucket`.  A null
    context says that all these windows repeat: the same bytes are sent from an earlier place.  Rows of a batch come in order of the
    bytes that deal them out, so that like contexts lie together where the exchange compresses them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_id", "start", "span", "context"]
        for batch in batches:
            best: dict[bytes, tuple[int, int, int, int]] = {}  # the earliest of equal contexts
            whole: list[list[int]] = []  # [doc, text, first window, last window] of runs that repeat
            for doc, tid, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text_id").to_pylist(), _texts(batch), batch.column("places"), strict=True):
                data = (text.as_py() or "").encode()
                for place in sorted(places.as_py()):
                    start, span, off, short = _unpack(place)
                    if start + span + s.length > len(data):  # of another document of the same key
                        continue
                    anchor = start + off
                    for begin, run_, core in _short_runs(anchor, start, span, s) if short else [(start, span, anchor)]:
                        piece = data[begin : begin + run_ + s.length]
                        # Equal pieces of unlike anchors cannot be: the anchor depends on the windows alone.
                        old, mine = best.get(piece), (doc, tid, begin, run_ | (core - begin) << 8 | short << 16)
                        if old is None:
                            best[piece] = mine
                            continue
                        if mine < old:
                            best[piece], mine, old = mine, old, mine
                        if mine[:3] > old[:3]:
                            if whole and whole[-1][:2] == [mine[0], mine[1]] and whole[-1][2] <= mine[2] <= whole[-1][3] + s.length:
                                whole[-1][3] = max(whole[-1][3], mine[2] + run_)
                            else:
                                whole.append([mine[0], mine[1], mine[2], mine[2] + run_])
            like = sorted(best.items(), key=lambda x: x[0][(x[1][3] >> 8) & 255 :][: s.k])
            out = [(*v, piece) for piece, v in like] + [(doc, tid, a, b - a, None) for doc, tid, a, b in whole]
            if out:
                kinds = [pa.int64()] * 3 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return arrow_map(docs, run, "doc_id long, text_id long, start long, span long, context binary")


def bucket(s: Settings) -> Column:
    """What deals a context out: the hash of its k-mer, or of the bytes that a short run's windows share; rows without bytes go anywhere."""
    off, short = F.shiftright("span", 8).bitwiseAND(F.lit(255)).cast("int"), F.shiftright("span", 16) == 1
    core = F.substring("context", off + 1, F.when(short, s.length + 1 - s.short).otherwise(s.k))
    return F.when(F.col("context").isNull(), F.xxhash64("doc_id", "start")).otherwise(F.xxhash64(core))


@dataclass
class Level:
    """A suffix array over contexts: their bytes and ends, the document and place of each, and the starts of windows in the
    order of the bytes that follow; in a store, also the numbers of the stored levels that are in it."""

    data: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    starts: np.ndarray
    held: tuple[int, ...] = ()

    def windows(self, length: int, part: slice = slice(None)) -> np.ndarray:
        """Windows of a part of the array, in a form that is compared byte by byte."""
        view = np.lib.stride_tricks.sliding_window_view(self.data, length)
        return np.ascontiguousarray(view[self.starts[part]]).view(f"V{length}").ravel()

    def where(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, place in it) of starts."""
        c = np.searchsorted(self.ends, at, "right")
        return self.doc[c], self.place[c] + at - (self.ends - np.diff(self.ends, prepend=0))[c]

    def keep(self, starts: np.ndarray) -> Level:
        """The level of these starts, without the contexts that none of them lies in."""
        c = np.searchsorted(self.ends, starts, "right")
        used = np.zeros(len(self.ends), bool)
        used[c] = True
        size = np.diff(self.ends, prepend=0)
        gone = np.cumsum(np.where(used, 0, size))
        return Level(self.data[np.repeat(used, size)], np.cumsum(size[used]), self.doc[used], self.place[used], starts - gone[c])


class SuffixLevels:
    """Suffix arrays in size classes; each window is held once, with its first occurrence."""

    def __init__(self, length: int, levels: list[Level] | None = None, scan: int = 1 << 16):
        self.length, self.scan = length, scan
        self.levels = sorted(levels or [], key=lambda x: -len(x.starts))

    def add(self, found: list[bytes], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether it starts earlier too, document, place) of each window of a batch's contexts; batches and their contexts come
        in order of (doc, place)."""
        size = np.array([len(c) for c in found], np.int64)
        runs, ends = size - self.length + 1, np.cumsum(size)
        starts = np.arange(runs.sum()) + np.repeat(ends - size - (np.cumsum(runs) - runs), runs)
        batch = Level(np.frombuffer(b"".join(found), np.uint8), ends, doc, place, starts)
        keys = batch.windows(self.length)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        head, mine = order[new], ordered[new]
        own_doc, own_place = batch.where(starts)
        first_doc, first_place, met = own_doc[head], own_place[head], np.zeros(len(head), bool)
        for level in self.levels:
            at, hit = self._merge_scan(level, mine)
            d, p = level.where(level.starts[at[hit]])
            earlier = (d < first_doc[hit]) | ((d == first_doc[hit]) & (p < first_place[hit]))
            first_doc[hit], first_place[hit] = np.where(earlier, d, first_doc[hit]), np.where(earlier, p, first_place[hit])
            met |= hit
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first_doc, first_place = first_doc[group], first_place[group]
        if not met.all():  # windows that a level has need no second entry
            self._push(batch.keep(starts[head[~met]]))
        return (first_doc < own_doc) | ((first_doc == own_doc) & (first_place < own_place)), own_doc, own_place

    def _merge_scan(self, level: Level, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the level, whether it is there) of each of ascending windows; both are passed once, `scan` windows of the level at a time."""
        n, low = len(level.starts), 0
        at, hit = np.full(len(keys), n), np.zeros(len(keys), bool)
        for a in range(0, n, self.scan):
            b = min(n, a + self.scan)
            high = np.searchsorted(keys, level.windows(self.length, slice(b - 1, b))[0], "right")
            if high > low:
                some = level.windows(self.length, slice(a, b))
                k = np.searchsorted(some, keys[low:high])
                at[low:high], hit[low:high] = a + k, some[k] == keys[low:high]
            low = high
        return at, hit

    def _push(self, level: Level) -> None:
        # Levels of a size class merge; they have no window in common.
        while self.levels and len(self.levels[-1].starts).bit_length() <= len(level.starts).bit_length():
            old = self.levels.pop()
            at, _ = self._merge_scan(old, level.windows(self.length))
            join = lambda x, y: np.concatenate([x, y])
            level = Level(join(old.data, level.data), join(old.ends, level.ends + len(old.data)), join(old.doc, level.doc), join(old.place, level.place), np.insert(old.starts, at, level.starts + len(old.data)), old.held + level.held)
        self.levels.append(level)


class Scan:
    """Takes contexts in order of (doc_id, text_id, start), a batch at a time, and tells the runs of bytes that repeat."""

    def __init__(self, s: Settings, levels: list[Level] | None = None):
        self.s, self.index = s, SuffixLevels(s.length, levels)
        self.doc: list[int] = []
        self.named: list[tuple[int, int]] = []  # (doc_id, text_id) of the batch's documents, whose numbers follow one another
        self.place: list[int] = []
        self.found: list[bytes] = []
        self.windows = self.number = 0

    def take(self, doc: int, tid: int, start: int, context: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        if not self.named or self.named[-1] != (doc, tid):
            self.number += 1
            self.named.append((doc, tid))
        self.doc.append(self.number)
        self.place.append(start)
        self.found.append(context)
        self.windows += len(context) - self.s.length + 1
        if self.windows >= self.s.batch_windows:
            yield self.flush()

    def flush(self) -> tuple[np.ndarray, ...]:
        """(doc_id, text_id, start, stop) of the batch's runs: places that follow one another in a document."""
        if not self.found:
            return (np.zeros(0, np.int64),) * 4
        again, doc, place = self.index.add(self.found, np.array(self.doc, np.int64), np.array(self.place, np.int64))
        doc, place = doc[again], place[again]
        new = np.concatenate([np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(doc)]])[: len(first)] - 1
        names = np.array(self.named, np.int64)[doc[first] - (self.number - len(self.named) + 1)]
        self.named = self.named[-1:]  # the next batch may go on with the same document
        self.doc, self.place, self.found, self.windows = [], [], [], 0
        return names[:, 0], names[:, 1], place[first], place[last] + self.s.length


RUN = "doc_id long, text_id long, start long, stop long"


def repeated_runs(rows: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_id, start, stop) of bytes covered by repeated windows; each partition has whole buckets in order of (doc_id, text_id, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, names = Scan(s), ["doc_id", "text_id", "start", "stop"]
        for batch in batches:
            whole = []
            for doc, tid, start, span, context in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_id", "start", "span", "context")], strict=True):
                if context is None:
                    whole.append((doc, tid, start, start + span + s.length))
                    continue
                for runs in scan.take(doc, tid, start, context):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in runs], names)
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*whole, strict=True)], names)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in scan.flush()], names)

    return arrow_map(rows, run, RUN)


class SuffixStore:
    """Levels kept as tables in a folder, so that a batch of documents meets those before it, whose documents all count as earlier.

    Each of `parts` parts of the buckets has its own family.  A batch adds one table: a row for each level that is new, with
    the numbers of the stored levels merged into it, which are then read no more.  As any later text may repeat a place that
    is unique so far, all contexts are held.

    The folder is all that there is of a store: whoever opens it finds the batches that were committed, which a marker
    written last says, and what an unfinished batch left is written anew.  A batch that has a name and was committed under it
    is not added again; its runs are read back.  One batch is added at a time, and all with the same settings and parts.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _files(self):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return there, there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> dict[str, tuple[str, str]]:
        """Committed batches by their path, in order: (name, what they were made with)."""
        there, files = self._files()
        if not files.exists(there):
            return {}
        done = sorted(x.getPath().getName() for x in files.listStatus(there) if x.getPath().getName().endswith(".done"))
        lines = {x: self.spark.read.text(f"{self.path}/{x}").orderBy(F.monotonically_increasing_id()).collect() for x in done}
        return {f"{self.path}/{x.removesuffix('.done')}": (lines[x][0]["value"], lines[x][1]["value"]) for x in done}

    def _commit(self, path: str, name: str, made_with: str) -> None:
        _, files = self._files()
        out = files.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.done"), False)
        try:
            out.write(bytearray(f"{name}\n{made_with}\n".encode()))
        finally:
            out.close()

    def levels(self) -> DataFrame:
        """The levels in force: part, number, data, ends, starts, merged."""
        schema = "part int, number long, data binary, ends binary, starts binary, merged array<long>"
        paths = [f"{b}-levels" for b in self.batches()]
        all_ = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return all_.join(all_.select("part", F.explode("merged").alias("number")), ["part", "number"], "left_anti")

    def add(self, rows: DataFrame, s: Settings, name: str | None = None) -> DataFrame:
        """`repeated_runs` of the contexts of a batch, against themselves and all batches before; the batch is then stored."""
        made_with = f"{self.parts} parts, {s}"
        before = self.batches()
        for path, (was, how) in before.items():
            if how != made_with:
                raise ValueError(f"the store was made with {how}")
            if was == name:
                return self.spark.read.schema(RUN + ", kind string").parquet(path).filter("kind = 'runs'").drop("kind")
        if name is not None and (not name or "\n" in name):
            raise ValueError("a batch's name is one line")
        number = len(before)
        kind = RUN + ", part int, number long, data binary, ends binary, starts binary, merged array<long>"
        names = [c.split()[0] for c in kind.split(", ")]
        i8 = lambda x: np.asarray(x, "<i8").tobytes()

        def run(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            read = lambda b: np.frombuffer(b, "<i8")
            held = [Level(np.frombuffer(d, np.uint8), read(e), np.zeros(len(e) // 8, np.int64), np.zeros(len(e) // 8, np.int64), read(x), (n,)) for n, d, e, x in zip(old["number"], old["data"], old["ends"], old["starts"], strict=True)]
            scan, out = Scan(s, held), []
            for doc, tid, start, span, context in new.sort_values(["doc_id", "text_id", "start"])[["doc_id", "text_id", "start", "span", "context"]].itertuples(index=False):
                for runs in [(([doc], [tid], [start], [start + span + s.length]),)] if context is None else [scan.take(doc, tid, start, context)]:
                    out += [(*r, *[None] * 6) for cols in runs for r in zip(*cols, strict=True)]
            out += [(*r, *[None] * 6) for r in zip(*scan.flush(), strict=True)]
            fresh = [x for x in scan.index.levels if all(x is not h for h in held)]
            # Levels of one batch and part are numbered from batch * 64; there are never as many.
            out += [(*[None] * 4, key[0], number * 64 + i, x.data.tobytes(), i8(x.ends), i8(x.starts), list(x.held)) for i, x in enumerate(fresh)]
            frame = pd.DataFrame(out, columns=names, dtype=object)
            return frame.astype({c: "Int64" for c in ("doc_id", "text_id", "start", "stop", "number")} | {"part": "Int32"})

        ship(self.spark)
        placed = rows.withColumn("part", F.pmod(bucket(s), F.lit(self.parts)).cast("int"))
        both = placed.groupBy("part").cogroup(self.levels().groupBy("part")).applyInPandas(run, kind)
        path = f"{self.path}/batch-{number:06d}"
        both.withColumn("kind", F.when(F.col("part").isNull(), "runs").otherwise("levels")).write.mode("overwrite").partitionBy("kind").option("maxRecordsPerFile", 100_000).parquet(path)
        there = self.spark.read.schema(kind + ", kind string").parquet(path)
        there.filter("kind = 'levels'").select("part", "number", "data", "ends", "starts", "merged").write.mode("overwrite").parquet(f"{path}-levels")
        self._commit(path, name or f"batch {number}", made_with)
        return there.filter("kind = 'runs'").select("doc_id", "text_id", "start", "stop")


#: Stands for a null doc_id while rows are matched, so that joins need no filter and share one exchange of the texts.
NO_ID = -(1 << 63)


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("_row").field("text")


def removals(docs: DataFrame, s: Settings = Settings(), store: SuffixStore | None = None, batch: str | None = None) -> DataFrame:
    """(doc_id, _row, _cuts) of each row of `docs`: _row holds its columns, _cuts is null or [{start, stop}] in bytes of
    the text, which may overlap, in no order.

    A row without doc_id has no place in the order: it neither loses nor takes anything.  Rows travel whole, so that both
    joins share one exchange of the texts.
    """
    known, text_id = F.coalesce("doc_id", F.lit(NO_ID)), F.xxhash64("text")
    # One key of 64 bits stands for both in the anchors' rows and in the joins.  Documents that share it look at each other's
    # places, which are places of their own text like any other, and take back the runs of their own only.
    key = F.xxhash64(known, text_id).alias("row_key")
    packed = docs.select(key, known.alias("doc_id"), text_id.alias("text_id"), F.struct(*docs.columns).alias("_row"))
    long = docs.select(key, "text").filter((F.octet_length("text") >= s.length) & F.col("doc_id").isNotNull())
    if store is None:
        there = to_look_at(list_anchors(long, s, common_kmers(long, docs.count(), s)))
    else:
        there = list_anchors(long, s, np.zeros(0, np.uint64)).select("row_key", "place")
    places = there.groupBy("row_key").agg(F.collect_list("place").alias("places"))
    rows = contexts(packed.join(places, "row_key"), s)
    runs = store.add(rows, s, batch) if store else repeated_runs(rows.repartition(_partitions(docs), bucket(s)).sortWithinPartitions("doc_id", "text_id", "start"), s)
    cuts = runs.groupBy(F.xxhash64("doc_id", "text_id").alias("row_key")).agg(F.collect_list(F.struct("doc_id", "text_id", "start", "stop")).alias("_cuts"))
    mine = F.filter("_cuts", lambda c: (c["doc_id"] == F.col("doc_id")) & (c["text_id"] == F.col("text_id")))
    return packed.join(cuts, "row_key", "left").select("doc_id", "_row", mine.alias("_cuts"))


def cut_bytes(data: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    out, at, gone, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted(cuts):
        if a > end:
            runs += 1
            out.append(data[at:a])
            gone += b - a
            end = at = b
        elif b > end:
            gone += b - end
            end = at = b
    out.append(data[at:])
    return b"".join(out), gone, runs


def _left(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(text, what is left of it, bytes removed, runs removed) of each row of `removals`."""
    for text, cuts in zip(_texts(batch), batch.column("_cuts"), strict=True):
        data = (text.as_py() or "").encode()
        yield data, *cut_bytes(data, [(c["start"], c["stop"]) for c in cuts.as_py() or ()])


def remove_repeats(docs: DataFrame, s: Settings = Settings(), store: SuffixStore | None = None, batch: str | None = None) -> DataFrame:
    """`docs` without repeated strings: same columns, text and n_chars (where there) changed.

    With a store, `docs` is a further batch: strings of the batches before are cut too, and the store then holds this one.  A
    batch that is given again under its name has the outcome that it had.

    Characters cut in part go whole.  A document repeated as a row is one document: neither row is the earlier one.  A
    null text stays null.  Unlike texts under one doc_id are documents of their own, in the order of their hashes.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("_row")
            was = _texts(b).is_null().to_pylist()
            new = [None if null else left.decode("utf-8", "ignore") for null, (_, left, _, _) in zip(was, _left(b), strict=True)]
            put = {"text": new, "n_chars": [None if t is None else len(t) for t in new]}
            yield pa.RecordBatch.from_arrays([pa.array(put[c], rows.field(c).type) if c in put else rows.field(c) for c in names], names)

    return arrow_map(removals(docs, s, store, batch), run, docs.schema)


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(data), gone, runs, hashlib.sha256(left).hexdigest()) for data, left, gone, runs in _left(b)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("_row").field("doc_id"), *[pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(removals(docs.select("doc_id", "text"), s), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's bytes that no earlier 100-byte match covers."""
    return digests(table(spark, sf_dir, "documents"))


#: Every window as hexadecimal digits; a window is repeated if it is not the first of its text.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM r),
i AS (SELECT doc_id, p, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM g),
c AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY 1, 2),
k AS (SELECT d.doc_id, any_value(h) AS h, coalesce(sum(b - a), 0) AS gone, count(run) AS spans, list({'a': a, 'b': b} ORDER BY a) FILTER (run IS NOT NULL) AS cuts FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id),
parts AS (SELECT doc_id, h, gone, spans, CASE WHEN cuts IS NULL THEN [h] ELSE list_concat([substr(h, 1, 2 * cuts[1].a)], list_transform(range(1, len(cuts) + 1), lambda j: CASE WHEN j < len(cuts) THEN substr(h, 2 * cuts[j].b + 1, 2 * (cuts[j + 1].a - cuts[j].b)) ELSE substr(h, 2 * cuts[j].b + 1) END)) END AS ps FROM k)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, gone::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(array_to_string(ps, ''))) AS kept_sha256 FROM parts
"""
