"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a block by
aggregating slices of the array; blocks are concatenated:

    <|im_start|>role\\n text <|seg|> text ... <|im_end|>\\n

Control strings inside a text or role (this template's and those of other common chat templates) are broken by a
backslash after their first character, and backslashes are doubled, so that reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, table

START, SEG, END = "<|im_start|>", "<|seg|>", "<|im_end|>\n"
#: The first character of a control string, where the rest of one follows: `<|...`, `<s>`, `</s>`, `[INST]`, `[/INST]`, `<<SYS>>`.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points).

    Turns are ordered by turn, then role, then text; nulls come first, null roles and texts are empty strings.  Rows
    whose conv_id is null form one conversation.  The loss spans cover the text of each turn of `loss_role`.  A
    conversation becomes one string, so it must fit in a row.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))

    def blocks(t: Column) -> Column:
        """[{role, texts}] of maximal runs of one role."""
        at = F.sequence(F.lit(0), F.size(t) - 1)
        begins = F.filter(at, lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        ends = F.filter(at, lambda i: (i == F.size(t) - 1) | (F.get(t, i)["role"] != F.get(t, i + 1)["role"]))
        return F.zip_with(begins, ends, lambda b, e: F.struct(F.get(t, b)["role"].alias("role"), F.transform(F.slice(t, b + 1, e - b + 1), lambda x: escape(x["text"])).alias("texts")))

    talks = talks.select("conv_id", let(F.col("t"), blocks).alias("b"))
    heads = lambda b: F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform("b", lambda b: F.concat(heads(b), F.array_join(b["texts"], SEG), F.lit(END))), "")

    def step(acc: Column, b: Column) -> Column:
        """The spans of one more block; acc.at is where it begins."""
        first = acc["at"] + F.length(heads(b))
        inner = F.aggregate(
            b["texts"],
            F.struct(first.cast("int").alias("at"), F.lit(None).cast("array<struct<start:int,chars:int>>").alias("spans")),
            lambda a, x: F.struct((a["at"] + F.length(x) + len(SEG)).cast("int").alias("at"), F.concat(F.coalesce(a["spans"], F.array().cast("array<struct<start:int,chars:int>>")), F.array(F.struct(a["at"].alias("start"), F.length(x).alias("chars")))).alias("spans")),
        )
        return let(inner, lambda i: F.struct((i["at"] - len(SEG) + len(END)).cast("int").alias("at"), F.when(b["role"] == loss_role, F.concat(acc["spans"], i["spans"])).otherwise(acc["spans"]).alias("spans")))

    spans = F.aggregate("b", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans")), step, lambda a: a["spans"])
    return talks.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_chats(formatted: Column) -> Column:
    """[{role, text}] of a formatted conversation, one for each original turn."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)
    head = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"

    def turns(b: Column) -> Column:
        role = F.regexp_extract(b, head, 1)
        body = F.substring(b, F.length(role) + 2, F.length(b) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, r"<\|seg\|>", -1), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted string and its loss spans, of every conversation and of conversation -1."""
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["chars"]))), "")
    back = chats.select("conv_id", read_chats(F.col("formatted")).alias("turns"), under.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def _esc_sql(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, coalesce(role <> lag(role) OVER w, true) AS first FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_esc_sql('text')}) + CASE WHEN first THEN length(replace({_esc_sql('role')}, chr(10), '\\' || chr(10))) + {len(START) + 1 + len(END)} ELSE {len(SEG)} END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
