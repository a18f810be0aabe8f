"""The ten operators against brute force, round trips and held-out accuracy, on small tables with every odd case."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lumenstack.llm import bpe, chat_format, classifier, ngram_join, packing, pii, quality_rules, sharding, suffix_dedup, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t ", "a", "one two three", "x" * 3000, "ab " * 2000, "ab " * 2000, "é ü 中 😀 \x00 z", " line"]


def test_oracles(spark):
    for module, name in ((chat_format, "op3_chat_format"), (quality_rules, "op4_quality_rules"), (ngram_join, "op6_ngram_join"), (suffix_dedup, "op2_suffix_dedup"), (topk, "op10_exact_topk")):
        con = duckdb.connect()
        for t in ("documents", "conversations", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        mine = sorted(map(tuple, getattr(module, name)(spark, SF).collect()))
        cur = con.execute(f"SELECT {', '.join(getattr(module, name)(spark, SF).columns)} FROM ({module.ORACLE})")
        assert mine == sorted(cur.fetchall())


# 1


def test_sharding_counts_and_brute_force(spark):
    n = 1003
    out = sharding.shard(spark.range(n).withColumnRenamed("id", "doc_id"), "doc_id", [], sharding.Ring(7, 16, 64)).toPandas()
    size = out.groupby("shard").size()
    assert size.max() - size.min() <= 1 and len(out) == n
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    # One key after another on the ring: the first node clockwise with room.
    ring = sharding.Ring(5, 8, 32)
    counts = {t: random.Random(t).randint(0, 9) for t in range(32)}
    total = sum(counts.values())
    bound = [total // 5 + (s < total % 5) for s in range(5)]
    held, want = [0] * 5, []
    nodes = ring.nodes()
    for t in sorted(counts, key=lambda t: sharding._point(f"tick {t}")):
        for r in range(counts[t]):
            walk = [s for p, s in nodes if p >= t] + [s for p, s in nodes if p < t]
            s = next(s for s in walk if held[s] < bound[s])
            want.append((t, r, s, held[s]))
            held[s] += 1
    got = [(t, r, s, slot + r - a) for t, a, b, s, slot in ring.assign(counts) for r in range(a, b)]
    assert sorted(got) == sorted(want)


def test_sharding_moves_little():
    counts = {t: 100 for t in range(512)}
    where = lambda n, eps: {(t, r): s for t, a, b, s, _ in sharding.Ring(n, 64, 512).assign(counts, eps) for r in range(a, b)}
    a, b = where(10, 0.25), where(11, 0.25)
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)
    assert max(Counter(b.values()).values()) <= 1.25 * len(b) / 11 + 2


def test_sharding_query(spark):
    """The query's rows against one key after another: sizes, checksums, counts, slots and the places on the ring."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    text = lambda r: (r["text"] or "").encode()
    rows = sharding.op1_sharding(spark, SF).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((r["doc_id"], len(text(r)) + 16, zlib.crc32(text(r))) for r in docs)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    by = Counter(r["shard"] for r in rows)
    assert set(by) == set(range(40)) and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s])) for s in by)
    ring, F = sharding.Ring(40), chat_format.F
    ids = spark.createDataFrame([(r["doc_id"],) for r in docs], "k long").select("k", ring.tick(F.col("k")).alias("t")).collect()
    room = [len(docs) // 40 + (s < len(docs) % 40) for s in range(40)]
    nodes, want = ring.nodes(), Counter()
    ticks = Counter(r["t"] for r in ids)
    for t in sorted(ticks, key=lambda t: sharding._point(f"tick {t}")):
        for _ in range(ticks[t]):
            s = next(s for s in [s for p, s in nodes if p >= t] + [s for p, s in nodes if p < t] if room[s])
            room[s] -= 1
            want[t, s] += 1
    at = {r["k"]: r["t"] for r in ids}
    assert Counter((at[r["doc_id"]], r["shard"]) for r in rows) == want


def test_sharding_hot_key_and_clashing_names(spark):
    F = chat_format.F
    n = 600
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 5 > 0, F.col("id")).alias("doc_id"), F.col("id").alias("size"), *[F.lit("mine").alias(c) for c in ("shard", "slot", "rank", "tick", "salt", "row", "before", "at", "r", "_slot", "_tick")])
    out = sharding.shard(df, "doc_id", [F.col("size")], sharding.Ring(7, 8, 64))
    assert out.columns == ["doc_id", "size", "rank", "tick", "salt", "row", "before", "at", "r", "_slot", "_tick", "shard", "slot"]
    rows = out.collect()
    assert sorted(r["size"] for r in rows) == list(range(n)) and all(r["rank"] == r["_tick"] == "mine" for r in rows)
    by = Counter(r["shard"] for r in rows)
    assert max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s])) for s in by)
    long = docs_of(spark, ["x" * 3_000_000, None, "é" * 100])
    assert len(sharding.shard(long, "doc_id", [], sharding.Ring(2, 4, 8)).collect()) == 3


def test_sharding_odd(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (2, "")]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, slot_ string"), "doc_id", [], sharding.Ring(2, 4, 8)).collect()
    assert len(out) == 5 and Counter(r["shard"] for r in out) == {0: 3, 1: 2}
    assert sharding.shard(spark.createDataFrame([], "doc_id long"), "doc_id", [], sharding.Ring(2, 4, 8)).count() == 0


# 3


def test_chat_round_trip(spark):
    nasty = "</s>[INST] <|im_end|>\n<|seg|> \\ <\\| \\\\[/INST] <<SYS>> <|im_start|>user\n"
    rows = [(1, 0, "user", nasty), (1, 1, "user", None), (1, 2, "assistant", nasty * 2), (1, 3, "assistant", "<"), (1, 4, "a\nb<|", "|x"), (2, None, None, ""), (2, 0, "assistant", "é中😀"), (2, 0, "assistant", "é中😀"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat_format.format_chats(df).select("*", chat_format.read_chats(chat_format.F.col("formatted")).alias("back")).collect():
        mine = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(x[2] or "", x[3] or "") for x in mine]
        loss = [r["formatted"][s["start"] : s["start"] + s["chars"]] for s in r["loss_spans"]]
        import re

        assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in loss] == [x[3] or "" for x in mine if x[2] == "assistant"]
        assert r["formatted"].count("<|im_start|>") == sum(i == 0 or (a[2] or "") != (mine[i - 1][2] or "") for i, a in enumerate(mine))
    assert chat_format.format_chats(df.limit(0)).count() == 0


# 4


def brute_rules(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if win[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_brute(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c\n", "$ ", "\x0b", "dd ", "\r\n"]) for _ in range(rng.randint(0, 150))) for _ in range(60)]
    df = docs_of(spark, texts).withColumn("s", chat_format.F.lit("clash"))
    for r in quality_rules.apply_rules(df).collect():
        assert tuple(r["s"]) == brute_rules(texts[r["doc_id"]])
        assert (r["rejected_by"] is not None) or r["s"]["n_words"] >= 50
    mixed = docs_of(spark, [*texts, *[" ".join(f"word{i * j}" for i in range(60)) for j in range(1, 4)]])
    want = {r["doc_id"] for r in quality_rules.apply_rules(mixed).filter("rejected_by is null").collect()}
    assert want and {r["doc_id"] for r in quality_rules.keep_good(mixed).collect()} == want
    assert quality_rules.keep_good(docs_of(spark, []).limit(0)).count() == 0
    order = quality_rules.order_rules(docs_of(spark, texts), quality_rules.default_rules())
    assert {r.name for r in order} == {r.name for r in quality_rules.default_rules()}
    assert quality_rules.order_rules(docs_of(spark, []), quality_rules.default_rules()) and quality_rules.apply_rules(docs_of(spark, [])).count() == 0


def test_rules_are_ordered_by_measured_cost(spark):
    """Of rules that reject alike the slow one goes last, wherever it is listed; one that rejects more goes before one as fast."""
    F = chat_format.F
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(300)) for i in range(400)]
    slow = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(150)), x.text, lambda a, _: F.concat(F.sha2(a, 256), x.text)).like("a%")
    rules = [quality_rules.Rule("slow", lambda x: slow(x) | x.text.contains("w5")), quality_rules.Rule("fast", lambda x: x.text.contains("w5")), quality_rules.Rule("rare", lambda x: x.text.contains("none of them"))]
    costs, seen = quality_rules.measure_rules(docs_of(spark, texts), rules)
    assert costs[0] > 3 * costs[1] and sum(seen.values()) == len(texts)
    for shuffled in (rules, rules[::-1]):
        assert quality_rules.order_rules(docs_of(spark, texts), shuffled)[0].name == "fast"
    # The default rules have one order in every call, the dear ones after cheap ones that reject as many.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    orders = [[r.name for r in quality_rules.order_rules(docs, rules)] for rules in (quality_rules.default_rules(), *[quality_rules.default_rules()[::-1]] * 2, *[quality_rules.default_rules()] * 2)]
    assert all(o == orders[0] for o in orders) and orders[0][0] == "few_words" and orders[0].index("symbols") < orders[0].index("repeated_words")
    # A sample holds rows of every part of the table, and about as many as asked for.
    _, some = quality_rules.measure_rules(docs_of(spark, texts), rules[1:], 50)
    assert 20 < sum(some.values()) < 110


# 8


def test_pii_formats_and_inverse(spark):
    text = "a.b9@mail.example.com 10.20.30.40. v4.0. card 4111 1111 1111 1111 4111111111111112 +1 (499) 555-6503, +14995556503 ssn 123-45-6789 000-45-6789 2020-02-29 2021-02-29 DE89 3704 0044 0532 0130 00 token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\"!! password: 'hunter22x'"
    df = docs_of(spark, [text, None, "", "none", text + " " + text, *ODD]).withColumn("pii", chat_format.F.lit(1))
    out = pii.pseudonymise(df, "k")
    rows = {r["doc_id"]: r for r in out.collect()}
    new = rows[0]["text"]
    assert {k["kind"]: k["n"] for k in rows[0]["pii"]} == {"email": 1, "secret": 2, "ipv4": 1, "date": 1, "ssn": 1, "iban": 1, "phone": 2, "card": 1}
    assert rows[4]["text"] == new + " " + new and rows[1]["text"] is None and rows[2]["text"] == "" and rows[3]["text"] == "none"
    assert [len(w) for w in new.split(" ") if "." not in w] == [len(w) for w in text.split(" ") if "." not in w]
    for kept in ("4111111111111112", "000-45-6789", "2021-02-29", "v4.0."):
        assert kept in new
    for gone in ("a.b9@mail", "10.20.30.40", "4111 1111", "555-6503", "123-45-6789", "2020-02-29", "DE89", "1eb9c6", "hunter22x"):
        assert gone not in new
    import re

    phone = re.findall(r"\+1[ (\d)\-]{9,}\d", new)
    assert re.sub(r"\D", "", phone[0]) == re.sub(r"\D", "", phone[1])
    digits = re.search(r"card ([\d ]{19})", new)[1].replace(" ", "")
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    iban = re.search(r"DE\d\d [\d ]+\d", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "k", inverse=True).collect()}
    assert back == {r["doc_id"]: r["text"] for r in df.collect()}


def test_pii_each_kind_alone(spark):
    alone = ["a@bc.de", "10.20.30.40", "2020-02-29", "123-45-6789", "DE89370400440532013000", "+14995556503", "4111111111111111", "abcdefabcdef" * 3, "ABCDEFABCDEF" * 3]
    alone += [f"{name}{sign}{q}correcthorse{q}" for name in ("token", "secret", "password", "passwd", "PassWd", "api_key", "apikey", "API_KEY", "key") for sign in ("=", ": ", " = ") for q in "'\""]
    df = docs_of(spark, [f"so {a} it goes" for a in alone])
    out = pii.pseudonymise(df, "k")
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, a in enumerate(alone):
        assert a not in rows[i]["text"] and [k["n"] for k in rows[i]["pii"]] == [1]
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "k", inverse=True).collect()} == {r["doc_id"]: r["text"] for r in df.collect()}


def test_pii_more_formats(spark):
    import datetime
    import re

    dates = {"03/04/1985": "%m/%d/%Y", "25/12/1985": "%d/%m/%Y", "2020/01/02": "%Y/%m/%d", "31.01.1999": "%d.%m.%Y", "March 3, 1985": "%B %d, %Y", "March 03, 1985": "%B %d, %Y", "14 July 2001": "%d %B %Y", "04 July 2001": "%d %B %Y"}
    phones = ["(555) 223-4567", "555-223-4567", "555.223.4567", "(555)223-4567"]
    nets = ["2001:db8:85a3:0:0:8a2e:370:7334", "2001:DB8::1", "fe80::1", "2001:db8::8a2e:370:7334"]
    cards = {"4111 1111 1111 1111 12/27": " 12/27", "4111-1111-1111-1111 123": " 123"}
    texts = [f"so {x} it goes" for x in [*dates, *phones, *nets, *cards]]
    left = ["at 12:30:45 sharp", "std::vector a::b::c", "13/13/1985 02/30/1985 1/2/3 1.2.2003.4", "055-123-4567 555-123-45678 1-555-123-4567", "chapter 3, 1985", "aa:bb:cc:dd:ee:ff"]
    df = docs_of(spark, texts + left)
    out = pii.pseudonymise(df, "k")
    rows = {r["doc_id"]: r for r in out.collect()}
    kinds = ["date"] * len(dates) + ["phone"] * len(phones) + ["ipv6"] * len(nets) + ["card"] * len(cards)
    assert [[(k["kind"], k["n"]) for k in rows[i]["pii"]] for i in range(len(texts))] == [[(k, 1)] for k in kinds]
    new = [rows[i]["text"][3:-8] for i in range(len(texts))]
    for x, (old, form) in zip(new, dates.items()):
        assert datetime.datetime.strptime(x, form).year >= 1900 and x != old and (old[0] != "0" or x[0] == "0" or form.startswith("%m"))
    shape = lambda x: re.sub(r"[A-F]", "F", re.sub(r"[0-9a-f]", "0", x))
    assert all(shape(a) == shape(b) and a != b for a, b in zip(new[len(dates) : -2], [*phones, *nets]))
    assert all(x.endswith(tail) and not x.startswith("4111 1111") for x, tail in zip(new[-2:], cards.values()))
    assert [rows[len(texts) + i]["text"] for i in range(len(left))] == left
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "k", inverse=True).collect()} == {r["doc_id"]: r["text"] for r in df.collect()}
    many = spark.range(400).select("id", chat_format.F.date_format(chat_format.F.date_add(chat_format.F.lit("1950-01-01").cast("date"), (chat_format.F.col("id") * 37).cast("int")), "dd/MM/yyyy").alias("text"))
    there = pii.pseudonymise(many, "k")
    assert there.select("text").distinct().count() == 400 and sorted(map(tuple, pii.pseudonymise(there, "k", inverse=True).select("id", "text").collect())) == sorted(map(tuple, many.collect()))


def test_pii_query(spark):
    """Whole table: with the session's key the texts turn back, the counts are those of the plain patterns, and no key is no run."""
    import re

    with pytest.raises(ValueError):
        pii.pseudonymise(docs_of(spark, ["a"]), "")
    spark.conf.set(pii.KEY_SETTING, "of the test")
    try:
        out = pii.op8_pii(spark, SF)
        rows = {r["doc_id"]: r for r in out.collect()}
        docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "of the test", inverse=True).collect()}
        assert back == docs and set(rows) == set(docs)
        changed = 0
        for i, r in rows.items():
            assert r["n_replaced"] == sum(k["n"] for k in r["pii"]) and (r["n_replaced"] > 0) == (r["text"] != docs[i])
            kinds = {k["kind"]: k["n"] for k in r["pii"]}
            assert kinds.get("email", 0) == len(re.findall(r"(?<![\w.%+\-])[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", docs[i] or ""))
            changed += bool(kinds)
        assert changed > 5
        again = {r["doc_id"]: r["text"] for r in pii.op8_pii(spark, SF).collect()}
        assert again == {i: r["text"] for i, r in rows.items()}
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark) != pii.session_key(spark)


def test_pii_secret_with_at(spark):
    texts = ['password="p@ssw0rdX"', "token: 'a@b.example.com'", 'key="@@@@@@@@"', 'mail a@b.example.com password = "x@y!zz12"']
    df = docs_of(spark, texts)
    out = pii.pseudonymise(df, "k")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [{k["kind"]: k["n"] for k in rows[i]["pii"]} for i in range(4)] == [{"secret": 1}, {"secret": 1}, {"secret": 1}, {"email": 1, "secret": 1}]
    assert rows[0]["text"].startswith('password="') and len(rows[0]["text"]) == len(texts[0]) and "p@ssw0rdX" not in rows[0]["text"]
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "k", inverse=True).collect()} == dict(enumerate(texts))


def test_pii_hex_key_like_iban(spark):
    texts = ["so DE12" + "3704ABCD" * 3 + "0123 it goes", "so AB12" + "ABCDEF01" * 3 + "4567ABC it goes"]
    out = pii.pseudonymise(docs_of(spark, texts), "k")
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert [(k["kind"], k["n"]) for k in rows[i]["pii"]] == [("secret", 1)] and t[3:-8] not in rows[i]["text"]
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "k", inverse=True).collect()} == dict(enumerate(texts))


def test_feistel_brute(spark):
    def brute(x, key, kind, rounds=4):
        def shift(s, tag, other):
            out = []
            seed = hashlib.sha256(f"{key}|{tag}|{other}".encode()).hexdigest()
            for i, c in enumerate(s):
                block = hashlib.sha256(f"{seed}|{i // 16}".encode()).hexdigest()
                step = int(block[i % 16 * 4 : i % 16 * 4 + 4], 16)
                a = next((a for a in pii.ALPHABETS if c in a), None)
                out.append(c if a is None else a[(a.index(c) + step) % len(a)])
            return "".join(out)

        a, b = x[: len(x) // 2], x[len(x) // 2 :]
        for r in range(1, rounds + 1):
            a = shift(a, f"{kind}a{r}", b)
            b = shift(b, f"{kind}b{r}", a)
        return a + b

    xs = ["12", "123456789012345", "Ab9é.-_z", "q", "x" * 50]
    got = spark.createDataFrame([(x,) for x in xs], "x string").select(pii.feistel(chat_format.F.col("x"), "k", "card")).collect()
    assert [r[0] for r in got] == [brute(x, "k", "card") for x in xs]
    assert len({r[0] for r in spark.range(1000).select(pii.feistel(chat_format.F.lpad(chat_format.F.col("id").cast("string"), 3, "0"), "k", "n")).collect()}) == 1000


def test_pii_megabytes(spark):
    """Nothing in a long text stops the matcher or takes more than linear time."""
    import time

    n = 1_000_000
    texts = {
        "x@" + "a." * 2000 + "com": None, "x@" + "a." * (n // 2) + "com": None, "x@" + "q" * n: None, "x@" + "q" * n + ".com": "email", "0123456789abcdef" * (n // 16): "secret",
        "7" * n: "secret", 'key="' + "aB3" * (n // 3) + '"': "secret", "a@" * (n // 2): None, "1." * (n // 2): None, "a:" * (n // 2): None, "1-" * (n // 2): None, "q@" + "a." * 120 + "com": "email",
    }
    df = docs_of(spark, list(texts))
    pii.pseudonymise(docs_of(spark, ["a@b.de"]), "k").collect()
    begin = time.time()
    out = pii.pseudonymise(df, "k")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert time.time() - begin < 12 + 5 * len(texts)
    for i, (t, kind) in enumerate(texts.items()):
        assert [k["kind"] for k in rows[i]["pii"]] == [kind] * (kind is not None) and len(rows[i]["text"]) == len(t) and (rows[i]["text"] == t) == (kind is None)
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(out, "k", inverse=True).collect()} == dict(enumerate(texts))


def test_chat_megabytes(spark):
    F, n = chat_format.F, 1_000_000
    rows = [(1, 0, "r" * n, "x" * n), (1, 1, "\\" * 100_000, "\\" * n), (1, 2, "\n<|" * 100_000, "<|" * n), (1, 3, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat_format.format_chats(df).select(chat_format.read_chats(F.col("formatted")).alias("b")).first()["b"]
    assert [(b["role"], b["text"]) for b in back] == [(r[2], r[3] or "") for r in rows]


# 5


def test_packing(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    texts = [*ODD, "word " * 3000, *[f"text {i} " * (i % 90) for i in range(300)]]
    texts += ["a <|endoftext|> b", "<|endoftext|>" * 3]
    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    df = docs_of(spark, texts)
    out = packing.pack_documents(df).toPandas()
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        mine = out[out.doc_id == i].sort_values("piece")
        assert mine.start.tolist() == np.concatenate([[0], mine.length.cumsum()[:-1]]).tolist() and mine.length.sum() == len(ids)
        assert mine.length.iloc[1:].eq(1024).all() and (len(mine) == 1 or len(ids) > 1024)
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length)]
    g = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (g.length.cumsum() - out.sort_values(["sequence_id", "offset"]).length == out.sort_values(["sequence_id", "offset"]).offset).all()
    assert g.length.sum().max() <= 1024 and g.ngroups <= -(-out.length.sum() // 1024) + 2
    whole = packing.pack(packing.written(packing.pieces(df, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, with_ids=True), "p"), ["doc_id", "piece"])
    assert sum(len(r["ids"]) for r in packing.assemble(whole).collect()) == 4 * out.length.sum()
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_added_tokens(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    e = "<|endoftext|>"
    texts = [f"end of text {e} next", e, e + e, f" {e} ", f"a{e}b", f"<|{e}|>", f"{e[:-1]}{e}", "<|endoftext|", f"  \n {e}\n\n  x", f"'s{e}'s", f"é{e}中😀", f"word {e} " * 700]
    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    rows = packing.pieces(docs_of(spark, texts), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, with_ids=True).orderBy("doc_id", "piece").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    assert got[0] == [437, 286, 2420, 220, 50256, 1306, 2]


def test_packing_query(spark):
    """The whole table: ids by `tokenizers` as the contract calls it, and every place in the sequences."""
    import public_tokenizers as p
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    out = packing.op5_packing(spark, sf).toPandas().sort_values(["doc_id", "piece"])
    want = []
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()):
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert list(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy())) == want
    o = out.sort_values(["sequence_id", "offset"])
    assert ((o.groupby("sequence_id").length.cumsum() - o.length) == o.offset).all() and o.groupby("sequence_id").length.sum().max() <= 1024
    # The least number that the tokens need is 962; best fit alone comes to 964.
    assert -(-o.length.sum() // 1024) <= o.sequence_id.nunique() <= -(-o.length.sum() // 1024) + 2


def test_packing_clashing_names(spark):
    F = chat_format.F
    df = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 60 + 1).alias("length"), *[F.lit("mine").alias(c) for c in ("offset", "sequence_id", "row", "size", "salt", "ties", "rank", "k", "low", "base", "before", "r", "_salt")])
    df = df.unionByName(df)  # repeated rows
    out = packing.pack(df, ["doc_id"], 64)
    assert out.columns == ["doc_id", "length", "row", "size", "salt", "ties", "rank", "k", "low", "base", "before", "r", "_salt", "sequence_id", "offset"]
    o = out.toPandas().sort_values(["sequence_id", "offset"])
    assert len(o) == 400 and ((o.groupby("sequence_id").length.cumsum() - o.length) == o.offset).all() and o.groupby("sequence_id").length.sum().max() <= 64


def test_plan_uses_counts():
    rng = random.Random(1)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
        for plan in (packing.plan(counts, 64), *[packing.plan_by(counts, 64, n, k) for n in range(4) for k in (4, 20, 32)]):
            used = Counter()
            for pattern, n in plan:
                assert sum(pattern) <= 64 and n > 0
                for k in pattern:
                    used[k] += n
            assert used == counts


def test_plan_by_depth():
    """Where only pairs or triples fill the gaps, each depth needs fewer sequences; where short pieces are scarce, none needs more."""
    n = lambda counts, parts: sum(t for _, t in packing.plan_by(counts, 100, parts, 1))
    assert [n({60: 30, 40: 30}, k) for k in range(4)] == [30] * 4
    pairs, triples = {70: 20, 13: 20, 17: 20, 19: 20}, {70: 20, 5: 20, 12: 20, 13: 20, 19: 20}
    assert n(pairs, 2) < n(pairs, 1) and n(triples, 3) < n(triples, 2) <= n(triples, 1)
    assert (70, 17, 13) in [p for p, _ in packing.plan_by(pairs, 100, 2, 1)]
    rng = random.Random(4)
    for _ in range(20):
        counts = {rng.randint(1, 99): rng.randint(1, 40) for _ in range(40)}
        best = sum(t for _, t in packing.plan(counts, 100))
        assert -(-sum(k * c for k, c in counts.items()) // 100) <= best <= n(counts, 0)


def test_sums_are_counted_as_lengths_run_out():
    rng, top = random.Random(8), 40
    counts = {k: rng.randint(1, 4) for k in rng.sample(range(1, top), 14)}
    index = packing.Sums(counts, top)

    def brute(size, total):
        combos = itertools.combinations_with_replacement(sorted(counts), size)
        return sorted(c for c in combos if sum(c) == total and all(c.count(k) <= counts[k] for k in c))

    for _ in range(40):
        for total in range(1, top + 1):
            assert [index.pairs[total], index.triples[total]] == [len(brute(n, total)) for n in (2, 3)]
            for size in (1, 2, 3):
                got = index.find(total, size, top, ())
                assert (tuple(sorted(got)) in brute(size, total)) if got else not brute(size, total)
        k = rng.choice(sorted(counts))
        n = rng.randint(-counts[k], 3)
        index.put(k, n)
        counts[k] += n


def test_exact_sums_win_over_best_fit():
    """Pieces cut from full sequences, with short fillers: exact sums need fewer sequences than best fit on some tables and more on none."""
    rng, saved = random.Random(5), 0
    for _ in range(25):
        counts = Counter()
        for _ in range(60):
            cuts = sorted(rng.sample(range(1, 200), rng.choice([1, 2, 3])))
            counts.update(b - a for a, b in zip([0, *cuts], [*cuts, 200], strict=True))
        n = sum(t for _, t in packing.plan(counts, 200))
        alone = sum(t for _, t in packing.plan_by(counts, 200, 0, 1))
        assert 60 <= n <= alone
        saved += alone - n
    assert saved >= 5


# 7


def test_bpe_equals_library_and_edits():
    import public_tokenizers as p
    import tiktoken

    ranks = bpe.load_ranks(p.path(bpe.BYTE_BPE))
    enc = bpe.TextEncoder(bpe.PrefixBPE(ranks), p.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    letters = [chr(c) for c in range(300)] + list("aaaa   \n\t'stlldthe") + ["é", "中", "😀", "​", " ", "<|endoftext|>"]
    for s in ["", " " * 500, "a" * 700, *["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]]:
        ids = enc.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(s)
        assert bpe.decode(ids, enc.bpe.token) == s.encode()
    for _ in range(150):
        x = bytes(rng.choice(b"aabbthe ng") for _ in range(rng.randint(0, 400)))
        a = rng.randint(0, len(x))
        b = rng.randint(a, len(x))
        new = bytes(rng.choice(b"ab the") for _ in range(rng.randint(0, 9)))
        t = bpe.PrefixTable(enc.bpe, x)
        t.replace(a, b, new)
        fresh = bpe.PrefixTable(enc.bpe, x[:a] + new + x[b:])
        assert t.last == fresh.last and t.ids() == fresh.ids()
        t.append(b"the end")
        assert t.last == bpe.PrefixTable(enc.bpe, fresh.data + b"the end").last
        text, words = enc.edit(x.decode(), a, b, new.decode())
        assert words == enc.split(text)


def test_bpe_query(spark):
    import public_tokenizers as p

    out = bpe.encode_documents(docs_of(spark, ODD), p.path(bpe.BYTE_BPE), p.PATTERN).collect()
    token = {v: k for k, v in bpe.load_ranks(p.path(bpe.BYTE_BPE)).items()}
    assert {r["doc_id"]: bpe.decode(r["ids"], token).decode() for r in out} == {i: t or "" for i, t in enumerate(ODD)}
    got = {r["doc_id"]: r["decoded_sha256"] for r in bpe.op7_bpe(spark, SF).collect()}
    assert got == {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_bpe_whole_table_equals_library(spark):
    import public_tokenizers as p
    import tiktoken

    sf = "/root/testdata/sf0.01"
    lib = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.load_ranks(p.path(bpe.BYTE_BPE)), special_tokens={})
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(lib.encode_ordinary(r["text"] or ""), "<u4")
        want.add((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(lib.decode_bytes(ids.tolist())).hexdigest()))
    assert {tuple(r) for r in bpe.op7_bpe(spark, sf).collect()} == want


def test_bpe_odd(spark):
    """Clashing names, repeated rows, null ids, an empty table and a very long text."""
    import public_tokenizers as p

    long = "word é中 " * 60_000
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, long)], "doc_id long, text string").withColumns({"ids": chat_format.F.lit(1), "n_tokens": chat_format.F.lit("x")})
    out = bpe.encode_documents(df, p.path(bpe.BYTE_BPE), p.PATTERN)
    token = {v: k for k, v in bpe.load_ranks(p.path(bpe.BYTE_BPE)).items()}
    assert sorted(((r["doc_id"], bpe.decode(r["ids"], token).decode()) for r in out.collect()), key=str) == sorted([(1, "a b"), (1, "a b"), (None, "a b"), (2, ""), (3, long)], key=str)
    assert bpe.encode_documents(df.limit(0), p.path(bpe.BYTE_BPE), p.PATTERN).count() == 0


# 9


def test_classifier_query_is_the_model(spark):
    """Every row of the query against the model's plain formula; labels of fold 0 make no difference."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = classifier.fit(docs, labels, "quality")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = classifier.op9_quality_classifier(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids, n = classifier.document_features(texts[r["doc_id"]] or "", m.params)
        plain = m.score((n / n.sum()) @ m.vectors[ids]) if len(ids) else m.score(np.zeros(m.params.dim, np.float32))
        assert r["score"] == pytest.approx(plain, abs=1e-5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
    other = labels.withColumn("quality", chat_format.F.when(classifier.fold("doc_id") == 0, 1 - chat_format.F.col("quality")).otherwise(chat_format.F.col("quality")))
    assert (classifier.fit(docs, other, "quality").vectors == m.vectors).all()


def test_classifier_clashing_names_ties_and_shared_ids(spark):
    F = chat_format.F
    small = classifier.Params(buckets=64, dim=4, sample_rows=5)
    df = docs_of(spark, [f"word{i % 3} text" for i in range(30)]).withColumns({c: F.lit("mine") for c in ("score", "_y", "y", "ids", "n", "quality")})
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(1).alias("text"))
    got = {r["doc_id"]: r["score"] for r in classifier.score(df, classifier.fit(df, labels, "quality", small)).collect()}
    assert len(got) == 30 and all(got[i] == got[i % 3] for i in range(30))  # equal texts have equal scores
    many = spark.createDataFrame([(1, f"text {i}") for i in range(200)], "doc_id long, text string")
    assert classifier.score(many, classifier.fit(many, labels, "quality", small)).count() == 200


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = classifier.op9_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    j = out.merge(labels, on="doc_id")
    held = j[j.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all() and len(out) == 1000
    assert (held.predicted == held.quality).mean() > 0.93
    assert out.score.between(0, 1).all()


def test_classifier_odd(spark):
    df = docs_of(spark, ODD)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 1), (None, 0)], "doc_id long, quality int")
    out = classifier.score(df, classifier.fit(df, labels, "quality", classifier.Params(buckets=64, dim=4))).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    none = classifier.score(df, classifier.fit(df, labels.limit(0), "quality", classifier.Params(buckets=64, dim=4))).collect()
    assert {r["score"] for r in none} == {0.5}
    m = classifier.fit(df, labels, "quality", classifier.Params(buckets=64, dim=4))
    words = classifier.Scorer(m)
    ids, n = classifier.document_features("one two two é", m.params)
    assert words.scores(["one two two é"])[0] == pytest.approx(m.score((n / n.sum()) @ m.vectors[ids]), abs=1e-6)


# 10


def test_topk_brute(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (300, 16))
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (1000, [1, 2])]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>")
    for block in (37, 8192):
        out = topk.top_k(df, topk.F.col("vec_id") % 20 == 0, 20, block).collect()
        full = np.zeros((301, 16), int)
        full[:300], full[300, :2] = x, [1, 2]
        ids = np.append(np.arange(300), 1000)
        want = []
        for q in np.flatnonzero(ids % 20 == 0):
            s = full @ full[q]
            best = sorted((-int(s[i]), int(ids[i])) for i in range(301) if i != q)[:20]
            want += [(int(ids[q]), r + 1, i, -v) for r, (v, i) in enumerate(best)]
        assert sorted(map(tuple, out)) == sorted(want)
    wide = df.select("vec_id", topk.F.transform("v", lambda e: e.cast("double")).alias("v"), topk.F.lit("x").alias("cb"), topk.F.lit(1).alias("rank"))
    assert sorted(map(tuple, topk.top_k(wide, topk.F.col("vec_id") % 20 == 0, 20, 37, 4).collect())) == sorted(want)
    few = topk.top_k(df.filter("vec_id < 3"), topk.F.col("vec_id") == 0).collect()
    assert len(few) == 2 and topk.top_k(df.limit(0), topk.F.col("vec_id") == 0).count() == 0


def test_topk_stops_on_proof(spark):
    """Queries stop before the last segments, and the results are those of all products; ids repeat and vectors are equal in places."""
    rng = np.random.default_rng(1)
    x = np.floor(64 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(3000, 24))))
    x[100:160] = x[40]
    ids = np.arange(3000) * 3
    s = topk.Segments.read(topk.pd.DataFrame(topk.Segments.build(ids, x).rows(), columns=["level", "dim", "places", "impacts", "kind"]))
    assert (s.forward == x).all() and s.total == (x != 0).sum()
    got, read, loaded = s.search(x[:200], ids[:200], 20)
    assert 0 < loaded <= s.bytes
    assert 0 < read < 0.9 * s.total * 200
    full = (x @ x[:200].T).astype(int)
    for i, (at, score) in enumerate(got):
        assert list(zip(score, at)) == [(-v, j) for v, j in sorted((-int(full[j, i]), j) for j in range(3000) if j != i)[:20]]
    small = topk.Segments.build(ids[:1000], x[:1000])  # blocks of any size stop
    got, read, _ = small.search(x[:50], ids[:50], 20)
    assert read < small.total * 50 and all(list(score) == sorted((x[:1000] @ x[i])[np.arange(1000) != i].astype(int), reverse=True)[:20] for i, (_, score) in enumerate(got))
    for sf in ("sf0.01", "sf0.1"):
        emb = topk.quantised(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
        index, blocks = topk.build_index(emb, 8192)
        work = topk.search_index(index, blocks, emb.filter("vec_id % 20 = 0"), with_work=True).collect()
        assert sum(r["postings_read"] for r in work) < 0.97 * sum(r["postings_held"] for r in work)


def test_topk_large_components(spark):
    """Components beyond an int, and sums beyond a long: scores are exact and cut to a long."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=4) * 10.0 ** rng.integers(0, p)]) for i, p in enumerate([1] * 40 + [9] * 40 + [14] * 40)]
    rows += [(200, [1e9] * 4), (201, [-1e9] * 4), (202, [1e300, 0.0, 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [None, 1.0]), (205, None), (None, [1.0]), (206, []), (207, [float("nan")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", topk.F.lit(1))
    out = topk.top_k(topk.quantised(df), topk.F.lit(True), 200).collect()
    v = {i: [math.floor(64 * y) for y in e] for i, e in rows if i is not None and i not in (203, 204, 205, 207)}
    score = lambda a, b: min(max(sum(p * q for p, q in zip(v[a], v[b])), -(1 << 63)), (1 << 63) - 1)
    want = []
    for q in v:
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((-score(q, i), i) for i in v if i != q))]
    assert sorted(map(tuple, out)) == sorted(want)


# 6


def brute_jaccard(texts, n=5, least=0.8):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root, links = {i: i for i in sets}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in range(a):
            u = len(sets[a] | sets[b])
            if u and len(sets[a] & sets[b]) >= least * u - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [512, 7])
def test_ngram_join_brute(spark, block):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, 9)):
            new = list(base)
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(len(new))] = rng.choice(words)
            texts.append(" ".join(new))
    texts += [texts[-1]] * 5
    out = ngram_join.jaccard_classes(docs_of(spark, texts), ngram_join.Forest(block=block)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out} == brute_jaccard(texts)
    kept = ngram_join.keep_one(docs_of(spark, texts), ngram_join.Forest(block=block))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in brute_jaccard(texts).values()}) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_ngram_join_odd(spark):
    empty = docs_of(spark, ["a"]).limit(0)
    assert ngram_join.jaccard_classes(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert ngram_join.jaccard_classes(same).count() == 4
    assert ngram_join.keep_one(same).filter("doc_id is not null").count() == 2
    f = ngram_join.Forest()
    assert f.found(f.shortest(), 0.8) >= 0.9999 and f.found(f.shortest() + 1, 0.8) < 0.9999


def test_forest_prefixes(spark):
    """The links of the sorted labels connect just what shares a prefix, at every length and across partitions."""
    rng = np.random.default_rng(9)
    n, trees = 150, 3
    least = rng.integers(0, 2, (n, trees * 8), np.uint64).astype(np.uint32) * np.uint32(12345)
    least[100:] = least[7]  # a third has one label
    halves = [ngram_join.label(x, trees) for x in least]
    df = spark.createDataFrame([(i, *map(np.ndarray.tolist, h)) for i, h in enumerate(halves)], "node long, high array<long>, low array<long>")
    links = [tuple(r) for r in ngram_join.forest_links(df).collect()]
    for d in range(4, 9):
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b, shared in links:
            if shared >= d:
                root[find(a)] = find(b)
        mine = {tuple(sorted(g)) for g in {find(i): [j for j in range(n) if find(j) == find(i)] for i in range(n)}.values()}
        want = list(range(n))

        def top(i):
            while want[i] != i:
                i = want[i]
            return i

        for t in range(trees):
            first = {}
            for i in range(n):
                want[top(i)] = top(first.setdefault(tuple(least[i, 8 * t : 8 * t + d]), i))
        assert mine == {tuple(sorted(g)) for g in {top(i): [j for j in range(n) if top(j) == top(i)] for i in range(n)}.values()}


def test_forest_shortens_by_what_it_finds():
    f = ngram_join.Forest()
    links = np.zeros(101)
    links[99] = 1000.0  # all copies nearly equal: the whole label finds them
    assert f.next_depth(8, links) == 8
    links[80] = 1000.0
    assert f.next_depth(8, links) == f.shortest() == 6
    links[80] = 30.0
    assert f.next_depth(8, links) in (7, 8) and f.next_depth(8, np.zeros(101)) == 8


@pytest.mark.parametrize("block", [512, 2])
def test_ngram_join_null_and_shared_ids(spark, block):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"]
    near = lambda i: base[i] + " more"
    rows = [(None, base[0]), (None, near(0)), (None, base[1]), (None, base[2]), (7, near(2)), (3, base[3]), (3, base[4]), (5, near(4)), (5, base[4] + " most"), (None, base[5]), (None, base[5])]
    rows += [(None, ""), (None, ""), (None, None), (8, ""), (8, ""), (8, " "), (8, base[6]), (9, near(6)), (9, near(3))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    got = sorted(map(tuple, ngram_join.jaccard_classes(df, ngram_join.Forest(block=block)).collect()), key=str)
    links = {i: n for i, (_, n) in brute_jaccard([t for _, t in rows]).items()}
    root = {i: c for i, (c, _) in brute_jaccard([t for _, t in rows]).items()}
    reach = lambda i, same: min((d for j, (d, t) in enumerate(rows) if d is not None and same(j)), default=rows[i][0])
    bare = lambda i: not (rows[i][1] or "").split()
    want = [(d, d if bare(i) else reach(i, lambda j: root[j] == root[i]), d if bare(i) else reach(i, lambda j: rows[j][1] == t), links[i]) for i, (d, t) in enumerate(rows)]
    assert got == sorted(want, key=str)
    kept = ngram_join.keep_one(df, ngram_join.Forest(block=block))
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert sum(left[None, t] for t in (base[0], near(0))) == 1
    either = {(None, base[0]), (None, near(0))}
    assert kept.columns == df.columns and {k: n for k, n in left.items() if k not in either} == {
        (None, base[1]): 1, (7, near(2)): 1, (3, base[3]): 1, (3, base[4]): 1, (None, base[5]): 1, (8, base[6]): 1, (None, ""): 2, (None, None): 1, (8, ""): 1, (8, " "): 1
    }


# 2


def brute_repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(b))), kept)
    return out


@pytest.mark.parametrize("settings", [suffix_dedup.Settings(), suffix_dedup.Settings(common=0.0, sample_rows=60, batch_windows=500, chunk_bytes=2000)])
def test_suffix_dedup_brute(spark, settings):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    base = [some(300) for _ in range(5)]
    texts = [*ODD, "a" * 99, "a" * 100, "a" * 101, "ab" * 600]
    texts += [rng.choice(["", some(50)]) + rng.choice(base)[rng.randint(0, 100) : rng.randint(150, 300)] + some(rng.randint(0, 120)) + rng.choice(base) for _ in range(80)]
    texts.append(texts[20])
    want = brute_repeats(texts)
    rows = suffix_dedup.digests(docs_of(spark, texts), settings).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {i: (n, g, k, hashlib.sha256(b).hexdigest()) for i, (n, g, k, b) in want.items()}
    new = suffix_dedup.remove_repeats(docs_of(spark, texts), settings).collect()
    assert {r["doc_id"]: r["text"] for r in new} == {i: None if texts[i] is None else b.decode("utf-8", "ignore") for i, (_, _, _, b) in want.items()}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in new)


def test_suffix_dedup_odd(spark):
    rows = [(None, "z" * 300), (1, "y" * 100 + "q"), (1, "y" * 100 + "q"), (2, "y" * 100), (None, "y" * 150)]
    got = sorted(r["text"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_cuts", chat_format.F.lit(1)).drop("x")).collect())
    assert got == sorted(["z" * 300, "y" * 100 + "q", "y" * 100 + "q", "", "y" * 150])
    assert suffix_dedup.remove_repeats(docs_of(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("settings", [suffix_dedup.Settings(), suffix_dedup.Settings(common=0.0, sample_rows=60, batch_windows=500, chunk_bytes=2000)])
def test_suffix_dedup_shared_ids(spark, settings):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abc \n") for _ in range(n))
    base = [some(300) for _ in range(4)]
    rows = [(i // 3, some(rng.randint(0, 60)) + rng.choice(base)[rng.randint(0, 100) :] + some(rng.randint(0, 80)) + rng.choice(base)) for i in range(60)]
    rows += [(2, base[0] + "q"), (2, base[0] + "r" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    inorder = [tuple(r) for r in df.orderBy("doc_id", chat_format.F.xxhash64("text")).collect()]
    want = sorted((inorder[i][0], b.decode()) for i, (_, _, _, b) in brute_repeats([t for _, t in inorder]).items())
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df, settings).collect())) == want


def test_suffix_levels_merge():
    rng = np.random.default_rng(0)
    for scan in (3, 1 << 16):
        index, seen = suffix_dedup.SuffixLevels(4, scan=scan), set()
        for doc in range(60):
            texts = [rng.integers(97, 100, rng.integers(4, 30)).astype(np.uint8).tobytes() for _ in range(rng.integers(1, 6))]
            place = np.arange(len(texts)) * 100
            got, _, at = index.add(texts, np.full(len(texts), doc), place)
            windows = [t[i : i + 4] for t in texts for i in range(len(t) - 3)]
            assert at.tolist() == [100 * k + i for k, t in enumerate(texts) for i in range(len(t) - 3)]
            for w, g in zip(windows, got, strict=True):
                assert (w in seen) == g
                seen.add(w)
            sizes = [len(x.starts) for x in index.levels]
            assert len(sizes) <= max(1, math.ceil(math.log2(sum(sizes) + 1)) + 1) and sum(sizes) == len(seen)
            for x in index.levels:
                held = [x.data[i : i + 4].tobytes() for i in x.starts]
                assert held == sorted(held) == [w.tobytes() for w in x.windows(4)]


@pytest.mark.parametrize("settings", [suffix_dedup.Settings(), suffix_dedup.Settings(batch_windows=300, chunk_bytes=2000)])
def test_suffix_store(spark, tmp_path, settings):
    """Later batches meet the levels that earlier ones wrote; the outcome is that of all documents at once."""
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abc \n") for _ in range(n))
    base = [some(300) for _ in range(4)]
    texts = [some(rng.randint(0, 60)) + rng.choice(base)[rng.randint(0, 150) :] + some(rng.randint(0, 200)) + rng.choice(["", *base]) for _ in range(50)] + ODD
    path = str(tmp_path / "levels")
    df, got = docs_of(spark, texts), {}
    for a, b in ((0, 20), (20, 25), (25, 25), (25, 60)):
        store = suffix_dedup.SuffixStore(spark, path, 3)  # opened anew for each batch
        batch = df.filter(f"doc_id >= {a} and doc_id < {b}")
        got |= {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(batch, settings, store, f"{a} to {b}").collect()}
    assert got == {i: None if texts[i] is None else b.decode("utf-8", "ignore") for i, (_, _, _, b) in brute_repeats(texts).items()}
    live = store.levels().collect()
    assert any(r["merged"] for r in live) and max(Counter(r["part"] for r in live).values()) <= 16
    # A batch given again has the outcome that it had, and is not held twice.
    again = suffix_dedup.remove_repeats(df.filter("doc_id >= 20 and doc_id < 25"), settings, store, "20 to 25").collect()
    assert {r["doc_id"]: r["text"] for r in again} == {i: got[i] for i in range(20, 25)} and len(store.batches()) == 4
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, settings, suffix_dedup.SuffixStore(spark, path, 4))


def test_suffix_store_of_two_processes(spark, tmp_path):
    """Another process adds the first batch, and leaves an unfinished one behind; this one goes on from its folder."""
    import os
    import subprocess
    import sys

    path, texts = str(tmp_path / "levels"), ["the quick brown fox " * 9 + str(i) for i in range(4)]
    code = f"""
from pyspark.sql import SparkSession
from lumenstack.llm import suffix_dedup
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/other").getOrCreate()
docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate({texts[:2]!r})], {DOCS!r})
suffix_dedup.remove_repeats(docs, suffix_dedup.Settings(), suffix_dedup.SuffixStore(spark, {path!r}, 2), "first").collect()
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root})
    store = suffix_dedup.SuffixStore(spark, path, 2)
    assert [v[0] for v in store.batches().values()] == ["first"]
    os.makedirs(f"{path}/batch-000001-levels")  # no marker: it does not count and is written over
    rest = docs_of(spark, texts).filter("doc_id >= 2")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(rest, suffix_dedup.Settings(), store, "second").collect()}
    want = brute_repeats(texts)
    assert got == {i: want[i][3].decode() for i in (2, 3)} and len(suffix_dedup.SuffixStore(spark, path, 2).batches()) == 2


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = packing.written(stage(spark, now, SF), "t")
        assert now.columns == docs.columns
        got[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    stats = {i: brute_rules(t) for i, t in texts.items()}
    kept = got["quality_rules"]
    assert set(kept) <= {i for i, s in stats.items() if s[0] >= 50 and 2 * s[4] <= s[0]}
    ids = sorted(kept)
    classes = brute_jaccard([kept[i] for i in ids])
    assert set(got["ngram_join"]) == {ids[c] for c, _ in classes.values()}
    ids = sorted(got["ngram_join"])
    cut = brute_repeats([got["ngram_join"][i] for i in ids])
    assert got["suffix_dedup"] == {ids[k]: t for k, (_, _, _, b) in cut.items() if (t := b.decode("utf-8", "ignore"))}
    assert set(got["pii"]) == set(got["suffix_dedup"])
    spark.conf.set(pii.KEY_SETTING, "of the test")
    try:
        hidden = corpus_pipeline.hide_personal(spark, docs_like(spark, docs, got["suffix_dedup"]), SF)
        assert {r["doc_id"]: r["text"] for r in pii.pseudonymise(hidden, "of the test", inverse=True).collect()} == got["suffix_dedup"]
        last = {r["doc_id"]: r["text"] for r in hidden.collect()}
        rows = corpus_pipeline.run(spark, SF).toPandas().sort_values(["doc_id", "piece"])
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    import public_tokenizers as p
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(p.path("byte_bpe_50k.json")), []
    for i in sorted(last):
        ids = np.array([*t.encode(last[i], add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 1024))]
    assert list(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy())) == want
    o = rows.sort_values(["sequence_id", "offset"])
    assert ((o.groupby("sequence_id").length.cumsum() - o.length) == o.offset).all() and o.groupby("sequence_id").length.sum().max() <= 1024


def docs_like(spark, docs, texts):
    return docs.filter(chat_format.F.col("doc_id").isin(list(texts))).drop("text").join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id").select(*docs.columns)


def test_pipeline_odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, extra columns, and no rows at all, through every stage."""
    import corpus_pipeline

    F = chat_format.F
    prose = lambda k, n=80: " ".join(f"{w}{(i * k) % 1_000_003}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * (n // 4)))
    rows = [(1, prose(3), "en", "a", 5), (1, prose(3), "en", "a", 5), (1, prose(5), None, None, None), (None, prose(7), "en", "a", 5), (None, prose(11), "en", "a", 5), (None, prose(7), "en", "b", 5), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, "short", "en", "a", 5), (5, prose(13, 40_000), "en", "a", 5), (6, prose(3) + " more", "en", "a", 5)]
    df = spark.createDataFrame(rows, DOCS)
    more = {c: F.lit("mine") for c in ("s", "rejected_by", "_row", "_cuts", "_each", "row", "node", "pii", "_p", "kind", "comp", "row_key")}
    now = df.withColumns(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = packing.written(stage(spark, now, SF), "odd")
        assert now.columns == [*df.columns, *more], name
        held = now.collect()
        if name == "ngram_join":
            # One row of each class of near copies; unlike texts stay, whatever their ids.
            assert sorted(r["text"] for r in held) == sorted([prose(3), prose(5), prose(7), prose(11), prose(13, 40_000)])
        assert all(r[c] == "mine" for r in held for c in more)
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in held} and len(out) >= len(held)
    now = df.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = packing.written(stage(spark, now, SF), "none")
        assert now.count() == 0 and now.columns == df.columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == 0
