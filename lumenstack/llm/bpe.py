"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one BPE encoding, so one valid last token.  A token `t` that ends at byte `i` and
begins at `j` is that token just if the pair (last token of the prefix up to `j`, `t`) is valid, that is, if no merge
across their boundary comes before the merges inside them.  The table of last tokens makes appends exact and cheap, and
after an edit only the bytes near it are computed again.

Documents are split by a pattern first, each match being encoded on its own.  Tasks keep a table of the matches they
have met; its size is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow_map, table

BYTE_BPE = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBPE:
    """The vocabulary with, for each token, the parts at its right and left edge while its merges are undone."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._edges: dict[int, tuple[list, list]] = {}
        self._valid: dict[tuple[int, int], bool] = {}
        self.prefix: dict[bytes, int] = {}  # last tokens of the prefixes of short strings, which strings share

    def _merge(self, data: bytes, stop: int) -> list[bytes]:
        """Plain BPE until `stop` parts are left or nothing merges."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[at] + parts[at + 1] not in self.ranks:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, t: int) -> tuple[list, list]:
        """(right edge, left edge): (part, rank of the merge that consumes it), the whole token first."""
        got = self._edges.get(t)
        if got is None:
            data = self.token[t]
            if len(data) == 1:
                got = ([(data, 1 << 60)], [(data, 1 << 60)])
            else:
                parts = self._merge(data, 2)
                if len(parts) != 2:
                    got = ([], [])  # no sequence of merges makes this token
                else:
                    right, left = self.edges(self.ranks[parts[1]])[0], self.edges(self.ranks[parts[0]])[1]
                    got = ([(data, 1 << 60), (right[0][0], t), *right[1:]], [(data, 1 << 60), (left[0][0], t), *left[1:]])
            self._edges[t] = got
        return got

    def valid(self, p: int, t: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just [p, t]; at equal rank the merge further left comes first."""
        got = self._valid.get((p, t))
        if got is None:
            rank, left = self.ranks.get, self.edges(t)[1]
            got = bool(left) and not any((c := rank(a + b)) is not None and c < before and c <= until for a, before in self.edges(p)[0] for b, until in left)
            if len(self._valid) > 2_000_000:
                self._valid.clear()
            self._valid[p, t] = got
        return got

    def extend(self, data: bytes, last: list[int], until: int) -> None:
        """Append to `last` the last tokens of the prefixes up to `until`; last[i] belongs to the prefix of i + 1 bytes."""
        ranks = self.ranks
        for i in range(len(last) + 1, until + 1):
            for j in range(max(0, i - self.longest), i):
                t = ranks.get(data[j:i])
                if t is not None and (self.edges(t)[0] if j == 0 else self.valid(last[j - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError(f"byte {data[i - 1]} is not in the vocabulary")

    def encode_short(self, data: bytes, most: int = 1_500_000) -> list[int]:
        """The encoding of a short string; computes only those of its prefixes that no string before it had."""
        prefix, ranks, token = self.prefix, self.ranks, self.token
        n = len(data)
        i = n
        while i and data[:i] not in prefix:
            i -= 1
        if i < n and len(prefix) > most:
            prefix.clear()
            i = 0
        known = self._valid.get
        while i < n:
            i += 1
            for j in range(i - 1, -1, -1):
                t = ranks.get(data[j:i])
                if t is not None:
                    if j:
                        p = prefix[data[:j]]
                        ok = known((p, t))
                        if ok is None:
                            ok = self.valid(p, t)
                    else:
                        ok = self.edges(t)[0]
                    if ok:
                        prefix[data[:i]] = t
                        break
            else:
                raise ValueError(f"byte {data[i - 1]} is not in the vocabulary")
        out = []
        while n:
            out.append(t := prefix[data[:n]])
            n -= len(token[t])
        return out[::-1]

    def read(self, last: list[int]) -> list[int]:
        """The encoding, walked back from the last token."""
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.token[out[-1]])
        return out[::-1]


class PrefixTable:
    """A byte string with the last token of each prefix."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` in place of data[start:end]; returns how many prefixes were computed anew.

        Beyond the edit, a prefix's last token depends on those of the `longest` prefixes before it alone: once so many
        equal the old ones, the rest do.
        """
        old, moved = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        same, done = 0, 0
        for i in range(start, len(self.data)):
            if same >= self.bpe.longest:
                self.last += old[i - moved :]
                break
            self.bpe.extend(self.data, self.last, i + 1)
            done += 1
            # A token reaching into the edit may have equal ids by chance only if its bytes are equal, so ids decide.
            same = same + 1 if i >= start + len(new) and self.last[i] == old[i - moved] else 0
        return done

    def ids(self) -> list[int]:
        return self.bpe.read(self.last)


class TextEncoder:
    """Encoding of texts, each match of the pattern separately, with a bounded table of matches met before."""

    def __init__(self, bpe: PrefixBPE, pattern: str, most: int = 500_000):
        import regex

        self.bpe, self.split, self.most = bpe, regex.compile(pattern).findall, most
        self.met: dict[str, bytes] = {}

    def piece(self, word: str) -> list[int]:
        data = word.encode()
        whole = self.bpe.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.bpe.encode_short(data) if len(data) <= 48 else PrefixTable(self.bpe, data).ids()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words, met = self.split(text), self.met
        try:
            return b"".join([met[w] for w in words])
        except KeyError:
            if len(met) > self.most:
                met.clear()
            for w in set(words):
                if w not in met:
                    met[w] = np.array(self.piece(w), "<u4").tobytes()
            out = b"".join([met[w] for w in words])
            return out

    def edit(self, text: str, start: int, end: int, new: str) -> tuple[str, list[str]]:
        """The text with text[start:end] replaced, and its matches, found anew only near the edit.

        Matching goes on from a match's beginning by what follows alone, so it can begin two matches before the edit
        (a match looks at most one character ahead) and ends where an old boundary is met.
        """
        words = self.split(text)
        bounds = np.cumsum([0, *map(len, words)])
        first = max(0, int(np.searchsorted(bounds, start, "right")) - 3)
        after, moved = text[:start] + new + text[end:], len(new) - (end - start)
        out, at, old = words[:first], int(bounds[first]), {int(b): i for i, b in enumerate(bounds) if b >= end}
        import regex

        find = regex.compile(self.split.__self__.pattern).match
        while at < len(after):
            if at >= start + len(new) and at - moved in old:
                return after, out + words[old[at - moved] :]
            out.append(find(after, at).group())
            at += len(out[-1])
        return after, out


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(ranks_path: str, pattern: str) -> TextEncoder:
    """This process's encoder, kept from task to task."""
    if (ranks_path, pattern) not in _ENCODERS:
        _ENCODERS[ranks_path, pattern] = TextEncoder(PrefixBPE(load_ranks(ranks_path)), pattern)
    return _ENCODERS[ranks_path, pattern]


def decode(ids: bytes, token: dict[int, bytes]) -> bytes:
    return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row; null text counts as empty.

    `ranks_path` is read by every task, as a file installed with the library that provides it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode(x.as_py() or "") for x in b.column(1)], pa.binary())], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as digests; no shuffle."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in b.column(1):
                ids = enc.encode(x.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decode(ids, enc.bpe.token)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(table(spark, sf_dir, "documents").select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
