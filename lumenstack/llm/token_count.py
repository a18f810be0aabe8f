"""Token counts of texts of any length, by overlapping chunks that are spliced where their tokens meet again.

A long text is cut into chunks, each read on into the next by an overlap, and the chunks are dealt out to all tasks.  Two
chunks that are neighbours have tokenised their overlap from different beginnings.  They are spliced at the first place in
it where a token ends in both and the place is proven stable: no token can lie across it, and what follows is tokenised
alike wherever the text before it began.  A letter, mark, digit, punctuation or symbol followed by a blank is such a place
where the vocabulary's rule says so, which is checked when it is loaded.  The tokens before the splice are counted in the
left chunk, those after it in the right one.  Texts with an overlap that has no such place are taken again with wider
overlaps, and wider chunks where the overlap would be more than a quarter of one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, table, written

CHUNK, OVERLAP, WIDER = 16_384, 512, 8


class Vocabulary(NamedTuple):
    #: Ids of a text, and the bytes of text that each id stands for.
    ids: Callable[[str], list[int]]
    width: np.ndarray
    #: The bytes that the ids stand for before the text's own first byte.
    lead: int
    #: A character that is taken for a blank.
    blank: str


def byte_level(path: str):
    """(tiktoken's encoding, bytes of each id, added tokens) of a `.json` file of byte-level BPE."""
    import tiktoken

    from .packing import added_tokens

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
    if spec["normalizer"] or not plain or model["type"] != "BPE":
        raise ValueError(f"{path}: only byte-level BPE with its own pattern and without a normalizer has proven splices")
    # Bytes are written as printable characters: themselves where they print, and those from 256 on in order otherwise.
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = added_tokens(path)
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"][t] for t in made] != sorted(model["vocab"][t] for t in made):
        raise ValueError(f"{path}: ids are not in the order of the merges")
    from public_tokenizers import PATTERN

    encoding = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return encoding, {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in added.items()}, added


def _byte_level(path: str) -> Vocabulary:
    import regex

    encoding, said, added = byte_level(path)
    if any(regex.search(r"\S\s", t) for t in added):
        raise ValueError(f"{path}: an added token holds a blank, so that no place is proven stable")
    width = np.zeros(max(said) + 1, np.int64)
    for i, t in said.items():
        width[i] = len(t)
    special = set(added)
    return Vocabulary(lambda text: encoding.encode(text, allowed_special=special, disallowed_special=()), width, 0, " ")


def pieces(path: str):
    """(sentencepiece's processor, bytes of each id) of a `.model` file whose pieces hold blanks at their beginning alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁", n) for n in names) or model.normalize(odd := "a  ﬁ é\xa0½ ") != "▁" + odd.replace(" ", "▁"):
        raise ValueError(f"{path}: a piece holds a blank after another character, or texts are normalised, so that no place is proven stable")
    return model, [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


def _pieces(path: str) -> Vocabulary:
    model, said = pieces(path)
    width = np.array([len(x) for x in said], np.int64)
    return Vocabulary(lambda text: model.encode(text, num_threads=1), width, int(width[model.encode("a")].sum()) - 1, "▁")


_VOCABULARIES: dict[str, Vocabulary] = {}
#: What may stand before a stable place; none of it is white space in any version of Unicode.
STABLE = r"[\p{L}\p{M}\p{N}\p{P}\p{S}](?= )"


def vocabulary(path: str) -> Vocabulary:
    """This process's vocabulary: `.json` of byte-level BPE as `tokenizers` reads it, `.model` as `sentencepiece` does."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = (_byte_level if os.path.splitext(path)[1] == ".json" else _pieces)(path)
    return _VOCABULARIES[path]


def stable_ends(vocab: Vocabulary, ids: list[int], text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Characters after `start` of the stable places in text[start:end] where a token ends, and how many tokens end there or before."""
    import regex

    text = text.replace(vocab.blank, " ")
    zone = text[start:end]
    places = [m.end() for m in regex.finditer(STABLE, zone)]
    if not places:
        return [], []
    sizes = np.cumsum(np.frombuffer(zone.encode("utf-32-le"), "<u4").astype(np.int64)[:, None] >= np.array([0, 0x80, 0x800, 0x10000]), axis=0).sum(axis=1)
    at = sizes[np.array(places) - 1] + len(text[:start].encode()) + (vocab.lead if text else 0)
    ends = np.cumsum(vocab.width[np.array(ids, np.int64)])
    n = np.searchsorted(ends, at, "right")
    here = (n > 0) & (ends[np.maximum(n, 1) - 1] == at)
    return np.array(places)[here].tolist(), n[here].tolist()


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                starts = range(0, len(text), chunk)
                for s in range(0, len(starts), 64):
                    part = [(row, k, text[k * chunk : (k + 1) * chunk + overlap], k == len(starts) - 1) for k in range(s, min(s + 64, len(starts)))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.bool_()), strict=True)], ["row", "k", "text", "last"])

    return run


def _ends(path: str, chunk: int, overlap: int):
    """For each chunk, what it knows of the overlap at its beginning (junction k) and of that at its end (k + 1)."""
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            rows = []
            for row, k, text, last in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                text = text.as_py()
                ids = vocab.ids(text)
                if k:
                    rows.append((row, k, None, None, *stable_ends(vocab, ids, text, 0, min(overlap, len(text)))))
                # After the last chunk there is nothing to meet: all its tokens are its own.
                right = ([0], [len(ids)]) if last else stable_ends(vocab, ids, text, chunk, len(text))
                rows.append((row, k + 1, *right, *(([0], [0]) if last else (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["row", "junction", "left_at", "left_n", "right_at", "right_n"])

    return run


def long_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, n_tokens) of `texts` (row long, text string, not null), a written table; texts whose chunks did not meet come again, wider."""
    done: DataFrame | None = None
    while True:
        dealt = arrow_map(texts, _chunks(chunk, overlap), "row long, k int, text string, last boolean").repartition("row", "k")
        sides = arrow_map(dealt, _ends(path, chunk, overlap), "row long, junction int, left_at array<int>, left_n array<long>, right_at array<int>, right_n array<long>")
        met = sides.groupBy("row", "junction").agg(*[F.max(c).alias(c) for c in ("left_at", "left_n", "right_at", "right_n")])
        at = F.array_min(F.array_intersect("left_at", "right_at"))
        tokens = lambda side: F.element_at(f"{side}_n", F.array_position(f"{side}_at", F.col("at")).cast("int"))
        spliced = met.withColumn("at", at).select("row", F.when(F.col("at").isNotNull(), tokens("left") - tokens("right")).alias("n"))
        sums = written(spliced.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.bool_or(F.col("n").isNull()).alias("apart")), "token-sums")
        good = sums.filter("not apart").select("row", "n_tokens")
        done = good if done is None else done.unionByName(good)
        apart = sums.filter("apart")
        if apart.isEmpty():
            return done
        texts = texts.join(apart.select("row"), "row", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of `docs` (doc_id, text); null texts count as empty and have no tokens.

    Texts of at most `chunk` characters are counted where they are, copies in a batch once; longer ones are written with a
    number for each row, so that rows that share an id or a text, or have none, stay apart.  `path` is read by every task,
    as a file installed with the library that provides it.  No beginning, end or added special tokens are counted; the
    special strings inside texts are what the library takes them for by default.
    """
    if overlap < 2 or 4 * overlap > chunk:
        raise ValueError("chunks must be at least four overlaps long")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary(path).ids
        for b in batches:
            met: dict[str, int] = {}
            out = []
            for text in b.column(1):
                text = text.as_py()
                if text not in met:
                    met[text] = len(ids(text))
                out.append(met[text])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    short = arrow_map(known.filter(F.length("text") <= chunk), run, "doc_id long, n_bytes long, n_tokens long")
    long = written(known.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    counted = long.select("row", "doc_id", "n_bytes").join(long_counts(long.select("row", "text"), path, chunk, overlap), "row")
    return short.unionByName(counted.select("doc_id", "n_bytes", "n_tokens"))


def op11_token_counts(spark: SparkSession, sf_dir: str, most: int = 1024) -> DataFrame:
    """Token counts of every whole text, and whether they exceed what a sequence holds."""
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))
