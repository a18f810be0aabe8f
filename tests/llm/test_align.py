"""Alignment of two tokenizers against the libraries and plain counting."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from lumenstack.llm import align

SF = "/root/testdata/sf0.001"
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenized():
    """text -> lists of (id, bytes) of both sides, from the libraries over the whole text, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    byte = {}
    for x in range(256):
        printable = 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
        byte[chr(x) if printable else chr(256 + len([y for y in byte.values() if not (33 <= y <= 126 or 161 <= y <= 172 or 174 <= y <= 255)]))] = x

    def one(text):
        if not text:
            return None
        left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else None

    return one


def brute(tokenized, texts):
    docs = []
    for t in texts:
        pair, cut = tokenized(t), []
        if pair:
            ends = []
            for side in pair:
                at, e = 0, []
                for _, x in side:
                    at += len(x)
                    e.append(at)
                ends.append(e)
            both = sorted(set(ends[0]) & set(ends[1]))
            cut = [[[i for (i, _), e in zip(side, es, strict=True) if lo < e <= hi] for side, es in zip(pair, ends, strict=True)] for lo, hi in zip([0, *both], both, strict=False)]
        docs.append((pair, cut, Counter((x, y) for a, b in cut for x in a for y in b)))
    count = Counter(p for _, _, links in docs for p in links)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    for pair, cut, links in docs:
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in cut)
        yield (
            len(pair[0]) if pair else 0, len(pair[1]) if pair else 0, len(cut), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if pair else "",
        )


ORDER = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    rng = random.Random(9)
    units = ["the", " and", " ", "  ", "   ", "\n", "\n ", " \n", "\t", "\xa0", "\x1c", " ", "é", " 中文字", "😀", "'s", " don't", "1234", "<|endoftext|>", "</s>", "...", " ====", "=" * 70, "\x00", "-", "x" * 60, "<0x41>", "क्ष", "▁"]
    odd = [None, "", " ", "  ", "a", " a", "a ", "▁", "a▁ b", "<unk>", "aaaa" * 100, " " * 200, "a b " * 300, "=" * 999, "ab\n" * 100, "中" * 300, "end </s> <|endoftext|> x"]
    return odd + ["".join(rng.choices(units[:-1] if rng.random() < 0.9 else units, k=rng.randint(1, 120))) for _ in range(120)]


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, tokenized, monkeypatch, small):
    if small:  # blocks that are full at once, and texts in parts
        for name, value in {"AT_ONCE": 7, "SMALL_GROUP": 3, "BLOCK_LINKS": 60}.items():
            monkeypatch.setattr(align, name, value)
        assert [align.Aligner(*PATHS).text(t or "")[0] for t in odd_texts()] == [r[:4] for r in brute(tokenized, odd_texts())]
    texts = odd_texts()
    rows = [(i % 40 or None, t, "mine") for i, t in enumerate(texts)] + [(7, "a b " * 300, "mine")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, block string").selectExpr("*", "1 as a", "2 as value", "3 as count")
    got = Counter((r["doc_id"], *(r[c] for c in ORDER)) for r in align.align_documents(df, *PATHS).collect())
    assert got == Counter((i, *r) for (i, _, _), r in zip(rows, brute(tokenized, [t for _, t, _ in rows]), strict=True))
    assert align.align_documents(df.limit(0), *PATHS).count() == 0
    assert align.align_documents(df.filter("text is null"), *PATHS).drop("groups_sha256").collect()[0][1:] == (0,) * 6


def test_long_text(tokenized):
    """Two megabytes in parts, and one stretch of 16 kB without a blank."""
    aligner = align.Aligner(*PATHS)
    for text in ("Es war so, nicht anders. " * 80_000, "QmFzZTY0" * 2_000):
        sums, sha, pairs, times = aligner.text(text)
        a, b = tokenized(text)
        assert sums[:2] == (len(a), len(b)) and times.sum() == sums[3] and len(set(pairs.tolist())) == len(pairs)


def test_query(spark, tokenized):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r["doc_id"], *x) for r, x in zip(docs, brute(tokenized, [r["text"] for r in docs]), strict=True))
    df = align.op13_alignment(spark, SF)
    assert df.columns == ["doc_id", *ORDER]
    assert sorted(map(tuple, df.collect())) == want
