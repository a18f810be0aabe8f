"""Repair of conversations whose turns were lost, emptied, cut, repeated or given to the wrong speaker.

A repaired conversation has the role initials `(s?(ua)+)?`.  Turns may be kept, given another role, deleted, or inserted
with an empty text; the cheapest edits are found by dynamic programming over the turns and the state of that grammar.

A conversation's turns go to one task, sorted by Spark, and stream past it twice.  Backwards, the cost to go of the four
grammar states is all that is held; forwards, a walk takes the edit of the least ASCII initial among those that keep to
the cost.  So a conversation of any length needs the memory of one batch of turns; only its order, which its digest
needs too, keeps it in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_map, table

BLANKS = " \t\n\x0b\x0c\r"
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a.  What each role leads to, and the one role that may be given or inserted.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Costs to go when no turn is left.
END = (0, 4, 2, 0)

SORTED = ["conv_id", "turn", "role", "text", "copy"]


def judge(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and fault of each turn, all turns of a conversation in one partition.

    A null role or text is one space; rows with a null conv_id are one conversation.  Turns are in the order of turn
    (null first), role, text; `copy` numbers the rows of equal role and text in that order.  A turn's first fault counts:
    blank, repeating role and text of an earlier turn, or not ending in `.`, `!` or `?` (blanks after it aside).
    """
    ends = F.rtrim("text", F.lit(BLANKS))
    copy = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(ends == "", BLANK).when(F.col("copy") > 1, DUPLICATE).when(~F.substring(ends, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    known = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return known.repartition("conv_id").withColumn("copy", copy).withColumn("fault", fault)


def options(state: int, role: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, state after) of what may be done with a turn, in ASCII order but for insertions, which stay at the turn."""
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        cut = CUT if fault == TRUNCATED else 0
        if (to := AFTER[state].get(role[:1])) is not None:
            yield "K", KEEP + cut, to
        yield "R", REROLE + cut, NEXT[state]


def before(role: str, fault: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a turn, of those after it."""
    w = [min(cost + after[to] for _, cost, to in options(g, role, fault)) for g in range(4)]
    u, a = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    return min(w[0], INSERT + u), min(w[1], INSERT + u), u, a


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns, last first, with the costs to go before and after each."""
    conv, last = object(), END
    for b in batches:
        togo, after = [], []
        for c, role, fault in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "fault")), strict=True):
            if c != conv:
                conv, last = c, END
            after.append(last)
            last = before(role, fault, last)
            togo.append(last)
        cells = [pa.array(x, pa.list_(pa.int64())) for x in (togo, after)]
        yield pa.RecordBatch.from_arrays([*b.columns, *cells], [*b.schema.names, "togo", "after"])


OUT = "conv_id long, turn long, edit string, role string, text string, was string, fault int"
_OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("was", pa.string()), ("fault", pa.int32())])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each conversation in order, one row each."""
    conv, state, first = None, 0, True
    rows: list[tuple] = []

    def insert(togo: tuple[int, ...] | list[int]) -> bool:
        nonlocal state
        if INSERT + togo[NEXT[state]] != togo[state]:
            return False
        state = NEXT[state]
        rows.append((conv, None, "I", ROLE[state], "", None, None))
        return True

    def finish() -> None:
        while not first and insert(END):
            pass

    for b in batches:
        for c, turn, role, text, fault, togo, after in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "fault", "togo", "after")), strict=True):
            if first or c != conv:
                finish()
                conv, state, first = c, 0, False
            while True:
                tight = {e: to for e, cost, to in options(state, role, fault) if cost + after[to] == togo[state]}
                if "D" in tight or not insert(togo):
                    break
            edit = min(tight)
            state = tight[edit]
            rows.append((c, turn, edit, None if edit == "D" else role if edit == "K" else ROLE[state], None if edit == "D" else text, role, fault))
        yield _batch(rows)
        rows = []
    finish()
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _OUT, strict=True)], schema=_OUT)


def repair(turns: DataFrame) -> DataFrame:
    """The edits, one row each: conv_id, turn, edit (D, I, K or R), role and text afterwards, the role it `was`, fault.

    Deleted turns have no role and text afterwards, inserted ones no turn, former role and fault.  The rows of a
    conversation are adjacent, in order, in one partition, so that operators on partitions can go on from here.  See
    `judge` for nulls, ties and repeated rows.  Very long texts stream past; an empty table gives no row; only the four
    columns named there are read.
    """
    judged = judge(turns)
    schema = "conv_id long, turn long, role string, text string, copy int, fault int"
    back = judged.sortWithinPartitions("conv_id", *[F.col(c).desc() for c in SORTED[1:]])
    costs = arrow_map(back, _backward, schema + ", togo array<long>, after array<long>")
    return arrow_map(costs.sortWithinPartitions(*SORTED), _forward, OUT)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    conv, open_ = None, False
    out: list[tuple] = []
    n, audit, sha, some, turns, seen, illegal = [0] * 4, [], hashlib.sha256(), False, None, 0, 0
    prior, cost = None, 0

    def close() -> None:
        gaps = turns[1] - turns[0] + 1 - seen if turns else 0
        out.append((conv, gaps, n[BLANK], n[DUPLICATE], n[TRUNCATED], illegal, cost, "".join(audit), sha.hexdigest()))

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], [f.split()[0] for f in DIGEST.split(", ")])

    for b in batches:
        for c, turn, edit, role, text, was, fault in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if not open_ or c != conv:
                if open_:
                    close()
                conv, open_ = c, True
                n, audit, sha, some, turns, seen, illegal = [0] * 4, [], hashlib.sha256(), False, None, 0, 0
                prior, cost = None, 0
            audit.append(edit)
            cost += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[edit] + (CUT if fault == TRUNCATED and edit != "D" else 0)
            if edit != "I":
                n[fault] += 1
                illegal += prior is not None and prior + was[:1] not in ("su", "ua", "au")
                prior = was[:1]
                if turn is not None and (turns is None or turn != turns[1]):
                    turns, seen = (turns[0] if turns else turn, turn), seen + 1
            if edit != "D":
                sha.update(("\n" * some + role + ":").encode())
                sha.update(text.encode())
                some = True
        yield ready()
        out.clear()
    if open_:
        close()
    yield ready()


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of `repair`'s rows: counts of faults before, cost, edits, and the digest of the repaired turns."""
    return arrow_map(edits, _digest, DIGEST)


def damage(turns: DataFrame) -> DataFrame:
    """Turns with reproducible faults, by checksum of `conv_id:turn`; nulls are one space in it, in roles and in texts."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    hurt = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), "text", kind.alias("kind")).filter("kind <> 0")
    return hurt.select("conv_id", "turn", "role", text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_")).drop("_")


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; those that lost all their turns have zeros and empty strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = digests(repair(damage(turns))).withColumnRenamed("conv_id", "found_id").withColumn("found", F.lit(True))
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def _w(g: int) -> str:
    """The least cost of doing something with the turn itself, in state g."""
    keep = " ".join(f"WHEN '{r}' THEN v[{to + 1}]" for r, to in AFTER[g].items())
    return f"least({DELETE} + v[{g + 1}], CASE WHEN fault IN ({BLANK}, {DUPLICATE}) THEN 99999999 ELSE cut + least({REROLE} + v[{NEXT[g] + 1}], CASE left(role, 1) {keep} ELSE 99999999 END) END)"


_KEPT = "CASE " + " ".join(f"WHEN g = {g} AND left(role, 1) = '{r}' THEN {to}" for g in range(4) for r, to in AFTER[g].items()) + " END"
_NEXT = "CASE g " + " ".join(f"WHEN {g} THEN {to}" for g, to in enumerate(NEXT)) + " END"
ORACLE = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), crc AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda r, b:
    list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS kind FROM c
), d AS (
  SELECT coalesce(conv_id, -9223372036854775807) AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copied FROM crc
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copied) AS copy, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends FROM d
), o AS (
  SELECT conv, turn, role, text, CASE WHEN ends = '' THEN {BLANK} WHEN copy > 1 THEN {DUPLICATE} WHEN right(ends, 1) IN ('.', '!', '?') THEN {CLEAN} ELSE {TRUNCATED} END AS fault,
    row_number() OVER w AS i, lag(role) OVER w AS prior FROM n WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy)
), size AS (SELECT conv, count(*) AS n FROM o GROUP BY conv
), v AS (
  SELECT conv, n + 1 AS i, {list(END)}::BIGINT[] AS v FROM size
  UNION ALL
  SELECT conv, i, [least(w[1], {INSERT} + least(w[3], {INSERT} + w[4])), least(w[2], {INSERT} + least(w[3], {INSERT} + w[4])), least(w[3], {INSERT} + w[4]), least(w[4], {INSERT} + w[3])] AS v
  FROM (SELECT conv, i, [{', '.join(_w(g) for g in range(4))}]::BIGINT[] AS w
    FROM (SELECT o.*, v.v, CASE WHEN fault = {TRUNCATED} THEN {CUT} ELSE 0 END AS cut FROM v JOIN o ON o.conv = v.conv AND o.i = v.i - 1))
), walk AS (
  SELECT conv, 1::BIGINT AS i, 0 AS g, '' AS audit, NULL::VARCHAR AS said FROM size
  UNION ALL
  SELECT conv, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN g WHEN 'K' THEN kept ELSE nxt END, audit || edit,
    CASE WHEN edit = 'D' THEN said ELSE coalesce(said || chr(10), '') || CASE WHEN edit = 'K' THEN role WHEN nxt = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END END
  FROM (SELECT *, CASE WHEN fault IS NOT NULL AND {DELETE} + a[g + 1] = b[g + 1] THEN 'D' WHEN {INSERT} + b[nxt + 1] = b[g + 1] THEN 'I'
      WHEN fault IN ({CLEAN}, {TRUNCATED}) AND kept IS NOT NULL AND cut + a[kept + 1] = b[g + 1] THEN 'K' WHEN fault IS NOT NULL THEN 'R' END AS edit
    FROM (SELECT walk.*, b.v AS b, a.v AS a, role, text, fault, CASE WHEN fault = {TRUNCATED} THEN {CUT} ELSE 0 END AS cut, {_KEPT} AS kept, {_NEXT} AS nxt
      FROM walk JOIN v b ON b.conv = walk.conv AND b.i = walk.i LEFT JOIN v a ON a.conv = walk.conv AND a.i = walk.i + 1 LEFT JOIN o ON o.conv = walk.conv AND o.i = walk.i))
  WHERE edit IS NOT NULL
), best AS (SELECT conv, arg_max(audit, length(audit)) AS audit, arg_max(coalesce(said, ''), length(audit)) AS said FROM walk GROUP BY conv
), count AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
    count(*) FILTER (fault = {TRUNCATED}) AS truncated, count(*) FILTER (prior IS NOT NULL AND left(prior, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -9223372036854775807) AS conv FROM conversations) c
LEFT JOIN count USING (conv) LEFT JOIN best USING (conv) LEFT JOIN v ON v.conv = c.conv AND v.i = 1
"""
