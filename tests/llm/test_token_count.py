"""Token counts against the tokenizer libraries on whole texts."""

import random
from collections import Counter

import public_tokenizers as P
import pytest

from lumenstack.llm import token_count

SF = "/root/testdata/sf0.001"
NAMES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def whole(name):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(P.path(name))
        return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
    return lambda x: len(t.encode(x or ""))


def odd_texts():
    rng = random.Random(3)
    units = ["the", " and", " ", "  ", "\n", "\n ", "\t", "\xa0", "\x1c", " ", "é", " 中文", "😀", "'s", " don't", "123", " 4,5", "<|endoftext|>", "<|endof", "text|>", "</s>", "▁", "é", "...", " ====", "\x00", "-", "x" * 30]
    return [None, "", " ", "a", "aaaa" * 500, " " * 2000, "a b " * 700, "x" * 900 + " end", "ab\n" * 700, "<|endoftext|>" * 150, "中" * 1500] + ["".join(rng.choices(units, k=rng.randint(1, 700))) for _ in range(60)]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("chunk,overlap", [(64, 16), (256, 64), (100_000, 512)])
def test_odd_texts(spark, name, chunk, overlap):
    """Chunks end everywhere: inside words, special strings and runs of blanks longer than any overlap; some texts are taken again, wider."""
    texts = odd_texts()
    rows = [(i % 50, t, "x") for i, t in enumerate(texts)] + [(None, "a b " * 400, "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("*", "1 as n_tokens", "2 as k", "3 as junction")
    count = whole(name)
    got = Counter(map(tuple, token_count.count_tokens(df, P.path(name), chunk, overlap).collect()))
    assert got == Counter((i, len((t or "").encode()), count(t)) for i, t, _ in rows)
    assert token_count.count_tokens(df.limit(0), P.path(name)).count() == 0


def test_splices_and_widening(spark):
    """One chunk's tokens at a splice are the other's, and a run without a stable place needs several rounds."""
    vocab = token_count.vocabulary(P.path("byte_bpe_50k.json"))
    text = "é word " * 50
    at, n = token_count.stable_ends(vocab, vocab.ids(text), text, 10, 100)
    assert at and all(len(vocab.ids(text[: 10 + a])) == k for a, k in zip(at, n, strict=True))
    run = "ab" * 3000
    docs = spark.createDataFrame([(1, "w " * 400 + run + " w" * 400)], "doc_id long, text string")
    n = token_count.count_tokens(docs, P.path("byte_bpe_50k.json"), 128, 16).first()["n_tokens"]
    assert n == whole("byte_bpe_50k.json")(docs.first()["text"])
    with pytest.raises(ValueError):
        token_count.vocabulary(P.path("word_bpe_49k.json"))


def test_query(spark):
    count = whole("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), n := count(r["text"]), n > 1024) for r in docs)
    assert sorted(map(tuple, token_count.op11_token_counts(spark, SF).collect())) == want
