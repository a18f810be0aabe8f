"""N-gram Jaccard join with a MinHash LSH forest, and exact verification.

Each document has a label in each of `trees` trees: `levels` MinHash values of its word 5-grams.  The labels of a tree, sorted,
are a prefix trie: rows that share a prefix stand together, and what neighbours share is the length of their longest common
prefix.  One sort over all trees gives every trie, cut by range, so that a common prefix is no single task's.

Matching starts with the longest prefix, the whole label.  The documents that a prefix links are verified exactly, and their
verified similarities say which share of all links such a prefix finds: a pair of similarity s shares d levels of some tree
with probability 1 - (1 - s^d)^trees.  While that share is short of the target recall, the prefix is shortened to the longest
one that would reach it, and the pairs that are new are verified.  It is never cut below the length that reaches the target
for pairs at the very similarity asked for, so the rounds are few and bounded.

Documents of equal 5-gram sets are one node throughout.  Nodes linked by a prefix are verified all against all within their
connected component, in blocks of bounded size and without emitting the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, connected_components, table, written

MULT = np.uint64(0x9E3779B97F4A7C15)
#: Levels and bits of a level in the first half of a label, below the tree's number, and in the second half.
HALF, HIGH_BITS, LOW_BITS = 4, 14, 16
BINS = 100


@dataclass(frozen=True)
class Forest:
    """Words of a shingle, Jaccard similarity asked for, trees (256 at most), recall to reach; texts of a block."""

    n: int = 5
    similarity: float = 0.8
    trees: int = 32
    recall: float = 0.9999
    block: int = 512
    seed: int = 11

    levels = 2 * HALF

    def found(self, depth: int, s):
        """The probability that a pair of similarity s shares `depth` levels of some tree."""
        return 1 - (1 - np.power(s, depth)) ** self.trees

    def shortest(self) -> int:
        """The longest prefix that reaches the recall at the similarity asked for; the first half of a label at least."""
        return max([HALF, *(d for d in range(1, self.levels + 1) if self.found(d, self.similarity) >= self.recall)])

    def next_depth(self, depth: int, links: np.ndarray) -> int:
        """The longest prefix that finds the target share of all links, judged by the similarities (in BINS) of those that `depth` found."""
        s = np.maximum((np.arange(BINS + 1)) / BINS, self.similarity)
        there = links / self.found(depth, s)
        for d in range(depth, self.shortest(), -1):
            if (there * self.found(d, s)).sum() >= self.recall * there.sum():
                return d
        return self.shortest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes; hashes of words met before are kept, up to a bound."""

    def __init__(self, n: int, most: int = 500_000):
        import xxhash

        self.n, self.most, self.hash, self.met = n, most, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str) -> np.ndarray:
        """Distinct 64-bit hashes of the word n-grams, ascending; a shorter text is one shingle, one without words has none.

        bytes.split() splits at the six ASCII blanks, so words are `[^\\x20\\x09-\\x0D]+`.
        """
        words, met = text.encode().split(), self.met
        if not words:
            return np.zeros(0, np.uint64)
        try:
            h = np.array([met[w] for w in words], np.uint64)
        except KeyError:
            if len(met) > self.most:
                met.clear()
            for w in set(words):
                if w not in met:
                    met[w] = self.hash(w)
            h = np.array([met[w] for w in words], np.uint64)
        m = max(1, len(h) - self.n + 1)
        s = np.full(m, min(len(h), self.n), np.uint64)
        for i in range(min(self.n, len(h))):
            s = s * MULT + h[i : i + m]
        return np.unique(_mix(s))


def min_hashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each function a * x + b modulo 2 ** 32 over the upper halves of the shingles' hashes."""
    out, x = np.full(len(a), np.iinfo(np.uint32).max, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * a + b).min(0), out=out)
    return out


def label(least: np.ndarray, trees: int) -> np.ndarray:
    """(2, trees): both halves of each tree's label; the first begins with the tree's number."""
    v = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64).reshape(trees, 2 * HALF)
    high, low = np.arange(trees, dtype=np.uint64), np.zeros(trees, np.uint64)
    for k in range(HALF):
        high = (high << np.uint64(HIGH_BITS)) | (v[:, k] >> np.uint64(16 - HIGH_BITS))
        low = (low << np.uint64(LOW_BITS)) | v[:, HALF + k]
    return np.stack([high, low]).view(np.int64)


def row_key() -> Column:
    """16 bytes of a row's doc_id and text; rows equal in both, nulls included, have one key."""
    text = F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col("text")))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)))


def signatures(docs: DataFrame, f: Forest) -> DataFrame:
    """doc_id, row (its key), set_hash (16 bytes; null without words), n (size of the set), high and low (halves of each tree's label)."""
    rng = np.random.default_rng(f.seed)
    a = (rng.integers(0, 1 << 31, f.trees * f.levels, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
    b = rng.integers(0, 1 << 32, f.trees * f.levels, np.uint64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingler(f.n)
        for batch in batches:
            sets, sizes, halves = [], [], ([], [])
            for t in batch.column(1):
                s = shingles(t.as_py() or "")
                sizes.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                both = label(min_hashes(s, a, b), f.trees) if len(s) else ([], [])
                for half, x in zip(halves, both, strict=True):
                    half.append(x)
            columns = [batch.column(0), batch.column(2), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), *[pa.array(h, pa.list_(pa.int64())) for h in halves]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "set_hash", "n", "high", "low"])

    return arrow_map(docs.select("doc_id", "text", row_key().alias("row")), run, "doc_id long, row binary, set_hash binary, n int, high array<long>, low array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted labels: each row and the first of the run that shares its longest common prefix with the row before.

    Rows of one prefix so hang on its first one, directly or over the first rows of longer prefixes.  The partition's first
    and last row come out too, with `shared` -1 and 2 * partition (+ 1) as `a`, to be compared with its neighbours'.
    """
    from pyspark import TaskContext

    place = TaskContext.get().partitionId()
    names, last, firsts = ["a", "b", "shared", "high", "low"], None, None
    none = lambda n: pa.nulls(n, pa.int64())

    def end(k: int, row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([2 * place + k], pa.int64()), *[pa.array([x], t) for x, t in ((row[2], pa.int64()), (-1, pa.int32()), (row[0], pa.int64()), (row[1], pa.int64()))]], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, node = (batch.column(c).to_numpy() for c in ("high", "low", "node"))
        if last is None:
            yield end(0, (int(high[0]), int(low[0]), int(node[0])))
            before = np.array([high[0] ^ 1]), low[:1], node[:1]
            firsts = [int(node[0])] * (HALF + 1)
        else:
            before = tuple(np.array([x]) for x in last)
        shared = shared_levels(np.concatenate([before[0], high]), np.concatenate([before[1], low]))
        first = np.empty(len(node), np.int64)
        for k in range(HALF + 1):
            new = shared < HALF + k
            at = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
            here = np.where(at < 0, firsts[k], node[at])
            firsts[k] = int(here[-1])
            mine = shared == HALF + k
            first[mine] = here[mine]
        linked = shared >= HALF
        n = int(linked.sum())
        yield pa.RecordBatch.from_arrays([pa.array(first[linked]), pa.array(node[linked]), pa.array(shared[linked].astype(np.int32)), none(n), none(n)], names)
        last = int(high[-1]), int(low[-1]), int(node[-1])
    if last is not None:
        yield end(1, last)


def shared_levels(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Levels that each label but the first shares with the one before, in one tree; 0 for fewer than HALF."""
    x = (low[1:] ^ low[:-1]).view(np.uint64)
    more = sum((x >> np.uint64(LOW_BITS * k) == 0).astype(np.int64) for k in range(HALF))
    return np.where(high[1:] == high[:-1], HALF + more, 0)


def forest_links(labels: DataFrame) -> DataFrame:
    """(a, b, shared) of nodes that share a prefix of HALF levels or more, enough to connect all that do; `labels`: node, high, low (arrays)."""
    spark = labels.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = labels.select("node", F.explode(F.arrays_zip("high", "low")).alias("x")).select("x.high", "x.low", "node")
    order = ["high", "low", "node"]  # rows of equal labels can be cut apart by their node
    sorted_ = each.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = written(arrow_map(sorted_, _runs, "a long, b long, shared int, high long, low long"), "forest")
    # Two rows of each partition that has any.
    ends = sorted((r["a"], r["high"], r["low"], r["b"]) for r in found.filter("shared = -1").collect())
    across = []
    for (_, h, w, a), (_, h2, w2, b) in zip(ends[1::2], ends[2::2], strict=False):
        n = int(shared_levels(np.array([h, h2]), np.array([w, w2]))[0])
        if n:
            across.append((a, b, n))
    return found.filter("shared >= 0").select("a", "b", "shared").unionByName(spark.createDataFrame(across, "a long, b long, shared int"))


def links_within(sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray, right: np.ndarray, part: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted links, root) of each set, of pairs of a set in `left` with a different one in `right` (masks, equal or disjoint),
    and the number of linked pairs by similarity.  Pairs of one `part` are left out; they have been verified before."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    where = np.repeat(np.arange(n), size.astype(np.int64))
    _, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[col] > 1  # shingles of one set alone are in no intersection
    where, col = where[shared], np.unique(col[shared], return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(col, kind="stable")
    where, col = where[order], col[order]
    width = 4096
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [c, c + width])
        m = np.zeros((n, min(width, int(col[-1]) + 1 - c)), np.float32)
        m[where[a:b], col[a:b] - c] = 1
        common += m @ m.T
    inter = common.astype(np.float64)
    union = size[:, None] + size[None, :] - inter
    linked = inter >= similarity * union - 1e-9
    linked &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    linked &= part[:, None] != part[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    seen = np.bincount(np.floor(inter[i, j] / union[i, j] * BINS + 1e-9).astype(np.int64), minlength=BINS + 1)
    root = np.arange(n)
    while True:  # least neighbour's root until nothing changes
        new = np.minimum(root, np.where(linked, root[None, :], n).min(1))
        new = new[new]
        if (new == root).all():
            return linked @ weights, root, seen
        root = new


def verify(members: DataFrame, f: Forest) -> DataFrame:
    """(comp, node, links, root, seen) for each node and block pair; `members`: comp, bi, bj, home, node, part, copies, text.

    `seen`, the number of linked pairs by similarity, is in one row of each block pair.
    """
    run_ = lambda batches: _verify_groups(batches, f)
    return arrow_map(members, run_, "comp long, node long, links long, root long, seen array<long>")


def _verify_groups(batches: Iterator[pa.RecordBatch], f: Forest) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by comp, bi, bj, node; a group may span batches."""
    shingles = Shingler(f.n)
    names = ["comp", "node", "links", "root", "seen"]
    key, group, out = None, [], []

    def close() -> None:
        if len(group) < 2:
            return
        home, node, copies, part = (np.array([r[k] for r in group], np.int64) for k in range(4))
        comp, bi, bj = key
        links, root, seen = links_within([r[4] for r in group], copies, home == bi, home == bj, part, f.similarity)
        out.extend((comp, int(i), int(k), int(node[t]), seen if at == 0 else None) for at, (i, k, t) in enumerate(zip(node, links, root, strict=True)))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        out.clear()
        return done

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("comp", "bi", "bj", "home", "node", "copies", "part")]
        for comp, bi, bj, home, node, copies, part, text in zip(*cols, batch.column("text"), strict=True):
            if (comp, bi, bj) != key:
                close()
                key, group = (comp, bi, bj), []
            elif group[-1][1] == node:  # a repeated row, of the same text
                continue
            group.append((home, node, copies, part, shingles(text.as_py() or "")))
        yield flush()
    close()
    yield flush()


def with_roots(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of all nodes of `edges`, the roots themselves too."""
    found = connected_components(edges, name)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def verified_links(docs: DataFrame, nodes: DataFrame, comps: DataFrame, f: Forest) -> DataFrame:
    """`verify` of all pairs of nodes of one component and unlike parts; `comps`: node, comp, part.

    Members of large components are dealt into blocks by size band and hash, so no component is ranked in one task; pairs
    of blocks whose sizes are too unlike for the similarity, or that are of one part, are left out.
    """
    comps = comps.join(nodes.select("node", "row", "copies", "n"), "node")
    large = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("total"), F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y")
    sized = comps.join(large.select("comp", "total"), "comp")
    banded = sized.withColumn("band", F.when(F.col("total") > f.block, F.floor(F.log("n") / F.log(F.lit(1.1)))).otherwise(F.lit(0)))
    parts_of = banded.groupBy("comp", "band").agg(F.ceil(F.count(F.lit(1)) / f.block).alias("parts"))
    salt = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = banded.join(parts_of, ["comp", "band"]).withColumn("home", (F.col("band") * (1 << 24) + salt).cast("long"))
    blocks = placed.groupBy("comp", "home").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("part").alias("first"), F.max("part").alias("last"))
    unlike = (F.col("x.first") != F.col("x.last")) | (F.col("y.first") != F.col("y.last")) | (F.col("x.first") != F.col("y.first"))
    pairs = blocks.alias("x").join(blocks.alias("y"), (F.col("x.comp") == F.col("y.comp")) & (F.col("x.home") <= F.col("y.home")) & (F.col("x.high") >= f.similarity * F.col("y.low")) & unlike)
    homes = F.when(F.col("x.home") == F.col("y.home"), F.array("x.home")).otherwise(F.array("x.home", "y.home"))
    tasks = pairs.select(F.col("x.comp").alias("comp"), F.col("x.home").alias("bi"), F.col("y.home").alias("bj"), F.explode(homes).alias("home"))
    work = placed.select("comp", "home", "node", "part", "row", "copies").join(tasks, ["comp", "home"])
    texts = docs.select(row_key().alias("row"), "text")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    members = texts.join(work, "row").select("comp", "bi", "bj", "home", "node", "part", "copies", "text")
    members = members.repartition(parts, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "node")
    return written(verify(members, f), "verified")


def _classes(docs: DataFrame, f: Forest) -> tuple[DataFrame, DataFrame]:
    """(signatures of the rows, what is known of each 5-gram set); the latter: set_hash, class_id, copy_of, n_links, kept (the key of the class's one row).

    A set is a node with a number of its own, so neither null nor shared doc_ids make one node of different texts.
    """
    sig = written(signatures(docs, f), "signatures")
    first = lambda doc: F.min(F.struct(F.col(doc).isNull(), F.col(doc).alias("doc_id"), "row"))
    nodes = sig.filter(F.col("set_hash").isNotNull()).groupBy("set_hash").agg(first("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
    nodes = written(nodes.select("set_hash", F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("copy_of"), "first.row", "copies", "n"), "nodes")
    # Rows that repeat a doc_id and text have one key, so a node's labels may come more than once, which adds no link.
    links = forest_links(sig.select("row", "set_hash", "high", "low").join(nodes.select("row", "set_hash", "node"), ["row", "set_hash"]))
    checked, before, seen, depth = None, None, np.zeros(BINS + 1), f.levels
    while True:
        comps = with_roots(links.filter(F.col("shared") >= depth).select("a", "b"), "candidates").withColumnRenamed("root", "comp")
        old = comps.withColumn("part", F.col("node")) if before is None else comps.join(before.select("node", F.col("comp").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
        new = verified_links(docs, nodes, old, f)
        checked, before = new if checked is None else checked.unionByName(new), comps
        for r in new.filter(F.col("seen").isNotNull()).select(F.posexplode("seen").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS + 1 rows
            seen[r["bin"]] += r["n"]
        shorter = f.next_depth(depth, seen)
        if shorter == depth:
            break
        depth = shorter
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    linked = with_roots(checked.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "links")
    heads = linked.join(nodes.select("node", "copy_of", "row"), "node").groupBy("root").agg(first("copy_of").alias("head"))
    heads = linked.join(heads, "root").select("node", "head")
    graph = nodes.select("set_hash", "node", "copy_of", "row", "copies").join(links, "node", "left").join(heads, "node", "left")
    return sig, graph.select(
        "set_hash", F.coalesce("head.doc_id", "copy_of").alias("class_id"), "copy_of", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head.row", "row").alias("kept")
    )


def jaccard_classes(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """doc_id, class_id, copy_of, n_links for each row of `docs` (doc_id, text).

    class_id: the least doc_id that links lead to; copy_of: the least doc_id of the same 5-gram set; n_links: documents
    of similarity `f.similarity` or more, copies included.  A null text, or one without words, has no links; a text
    shorter than a shingle is one shingle.  Repeated rows of a doc_id count as copies.  Rows are compared by their texts,
    whatever their ids: those without doc_id have classes and links like any other, and a class_id or copy_of is null
    where no doc_id is in reach; unlike texts under one doc_id are documents of their own.  An empty frame gives an empty one.
    """
    sig, graph = _classes(docs, f)
    return sig.select("doc_id", "set_hash").join(graph.drop("kept"), "set_hash", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """One row of each class, with the columns of `docs`: that of least doc_id, null ones last.

    Rows without words are classes of their own; of those that repeat a doc_id and text, one stays.
    """
    sig, graph = _classes(docs, f)
    bare = sig.filter(F.col("set_hash").isNull()).select("row", F.col("doc_id").isNull().alias("each"))
    kept = graph.select(F.col("kept").alias("row"), F.lit(False).alias("each")).unionByName(bare).distinct()
    rows = docs.select(row_key().alias("row"), F.struct(*docs.columns).alias("doc")).join(kept, "row").withColumn("each", F.when(F.col("each"), F.monotonically_increasing_id()))
    return rows.dropDuplicates(["row", "each"]).select("doc.*")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and link counts of all documents at 5 words and similarity 0.8, over whole texts."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, for tables small enough to join so.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n, list_sort(g) AS g FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node WHERE walk.root < e.b),
c AS (SELECT node, min(root) AS root FROM walk GROUP BY node),
k AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT n.doc_id, c.root AS class_id, CASE WHEN n.n = 0 THEN n.doc_id ELSE min(n.doc_id) OVER (PARTITION BY n.g) END AS copy_of, coalesce(k.k, 0)::BIGINT AS n_links
FROM n JOIN c ON c.node = n.doc_id LEFT JOIN k ON k.a = n.doc_id
"""
