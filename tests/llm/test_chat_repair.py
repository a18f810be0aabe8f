"""Conversation repair against a search over all edits, and its SQL."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

from lumenstack.llm import chat_repair

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def brute(turns):
    """(cost, audit, repaired) of turns (role, text, fault): uniform-cost search by cost, then audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, said, out = heapq.heappop(heap)
        ok = not said or said[-1] == "a"
        if i == len(turns) and ok:
            return cost, audit, out
        if (i, said[-1:], not said) in done:
            continue
        done.add((i, said[-1:], not said))
        legal = "su" if not said else {"s": "u", "u": "a", "a": "u"}[said[-1]]
        give = "a" if legal == "a" else "u"
        name = {"u": "user", "a": "assistant"}[give]
        heapq.heappush(heap, (cost + 2, audit + "I", i, said + give, (*out, (name, ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, said, out))
            if fault in ("clean", "truncated"):
                more = fault == "truncated"
                if role[:1] and role[:1] in legal:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, said + role[0], (*out, (role, text))))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, said + give, (*out, (name, text))))
    raise AssertionError


def judged(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "clean" if end[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(rows):
    """The digest row of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    marks = judged(rows)
    cost, audit, out = brute(marks)
    turns = {t for t, _, _ in rows if t is not None}
    n = lambda f: sum(m[2] == f for m in marks)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()


def test_against_search(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(300):
        for _ in range(rng.randint(1, 7)):
            turn = rng.choice([None, *range(6)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "", None, "tool", "ua"]), rng.choice(["Yes.", "No!", "cut off", "", " \t\x0b", "\xa0", None, "two\nlines?\r\n ", "x" * 40 + "."])))
    rows += [(None, 1, "user", "a?"), (None, 2, "assistant", "b."), (None, 2, "assistant", "b.")]
    got = {r[0]: tuple(r)[1:] for r in chat_repair.digests(chat_repair.repair(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == {c: expected([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_edits_and_long_conversations(spark):
    n = 30_000
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(n) if t != 20_001] + [(2, 0, "s" * 6000, "y" * 2_000_000 + "?"), (2, 1, "user", "z. ")]
    df = spark.createDataFrame(rows, TURNS)
    clash = df.selectExpr("*", "'mine' as fault", "'mine' as edit", "0 as copy", "0 as kind", "1 as togo")
    out = chat_repair.repair(clash).collect()
    one = [r for r in out if r["conv_id"] == 1]
    # The lost turn is put back; as cheap would be nothing else.
    assert [r["edit"] for r in one] == ["K"] * 20_001 + ["I"] + ["K"] * (n - 20_002) and one[20_001]["role"] == "assistant"
    assert [(r["edit"], r["role"][:4]) for r in out if r["conv_id"] == 2] == [("K", "ssss"), ("K", "user"), ("I", "assi")]
    assert chat_repair.digests(chat_repair.repair(df.limit(0))).count() == 0


def damaged(rows):
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        text = "" if kind == 1 else said[3].translate(str.maketrans("", "", ".!?")) if kind == 2 else said[3]
        yield from [(conv, turn, "user" if kind == 4 else said[2], text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


@pytest.mark.parametrize("odd", [False, True])
def test_query(spark, tmp_path, odd):
    """The query against the search and against DuckDB, on the given table and on one with nulls, ties, repeats and lost conversations."""
    where = SF
    if odd:
        rng, where = random.Random(1), str(tmp_path)
        rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "system", None, ""]), rng.choice([None, "", "a.", "b", "c!? ", "..."])) for _ in range(400)]
        spark.createDataFrame(rows, TURNS).withColumn("text_", chat_repair.F.lit(1)).write.parquet(f"{where}/conversations.parquet")
    rows = list(map(tuple, spark.read.parquet(f"{where}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    df = chat_repair.op12_chat_repair(spark, where)
    mine = {r[0]: tuple(r)[1:] for r in df.collect()}
    by = {c: [] for c in {r[0] for r in rows}}
    for r in damaged(rows):
        by[r[0]].append(r[1:])
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert mine == {c: expected(x) if x else empty for c, x in by.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{where}/conversations.parquet{'/*.parquet' if odd else ''}'")
    theirs = con.execute(f"SELECT {', '.join(df.columns)} FROM ({chat_repair.ORACLE})").fetchall()
    assert {r[0]: r[1:] for r in theirs} == mine
