"""Quality rules as a short-circuit cascade, in Spark expressions only.

Each rule is a rejecting predicate over the text.  On a sample by hash, every rule is timed and judged: its cost is the time
it takes a document, its selectivity the share that it rejects of those which the rules before it keep; the order is greedy by
rejection per cost.  The order decides which expressions most rows never evaluate, and the reason that is reported; it cannot
change the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, table, words_of, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, "")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more; `words` must be bound (let or lambda).

    Windows are told apart by 64 bits of hash.  Where none repeats, which one pass over a hash set shows, the answer is 0;
    otherwise hashes are sorted with their places, and each place covers its next three words.
    """
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    twice = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    places = lambda h: let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.array_sort(F.transform(twice(s), lambda x: x["i"])))
    covered = lambda p: F.aggregate(F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places(h), covered))).cast("long")


def base_stats(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"),
    ))


@dataclass(frozen=True)
class Stats:
    """What rules look at.  Each is an expression of its own, so a rule that is not reached computes nothing."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @staticmethod
    def of_words(text: Column, words: Column) -> Stats:
        """From a text and its words, which are bound."""
        return Stats(text, words, F.size(words).cast("long"), word_chars(text), n_symbols(text), n_dup_lines(text), n_repeat_words(words))

    @staticmethod
    def of_struct(text: Column, s: Column) -> Stats:
        """From counts that are there already."""
        return Stats(text, words_of(text), s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"])


@dataclass(frozen=True)
class Rule:
    """`rejects` is a predicate over Stats."""

    name: str
    rejects: Callable[[Stats], Column]


def default_rules() -> list[Rule]:
    """Limits of public web-corpus filters: words, symbols per word, repeated lines and words, mean word length, capitals, letters."""
    letters = lambda x, c: F.length(x.text) - F.length(F.regexp_replace(x.text, c, ""))
    return [
        Rule("few_words", lambda x: x.n_words < 50),
        Rule("repeated_words", lambda x: 100 * x.n_repeat_words > 50 * x.n_words),
        Rule("symbols", lambda x: 10 * x.n_symbols > x.n_words),
        Rule("repeated_lines", lambda x: 100 * x.n_dup_lines > 30 * F.size(F.split(x.text, "\n", -1)).cast("long")),
        Rule("word_length", lambda x: let(x.word_chars, lambda c: (c < 3 * x.n_words) | (c > 12 * x.n_words))),
        Rule("capitals", lambda x: 2 * letters(x, r"\p{Lu}+") > letters(x, r"\p{L}+")),
        Rule("letters", lambda x: 100 * F.size(F.filter(x.words, lambda w: w.rlike(r"\p{L}"))).cast("long") < 80 * x.n_words),
    ]


def _clock() -> Column:
    """Nanoseconds now, read anew for each row."""
    return F.expr("reflect('java.lang.System', 'nanoTime')")


def measure_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 1000, repeats: int = 8) -> tuple[list[float], dict[tuple[bool, ...], int]]:
    """(nanoseconds that each rule takes over the sample, how often each combination of verdicts is met there).

    The sample is one in so many rows, by hash of their first column and text, that about `sample_rows` are in it.  It is
    written once, so what is timed does not read the corpus.  In one job, the clock is read between the rules of every row,
    which are evaluated as the cascade evaluates them, from words that are found before; each row is timed `repeats` times and
    the least counts, so that compiling, collecting garbage and being scheduled do not.  What reading the clock takes is
    taken off.  No more than 2 ** rules combinations, and never more than the sample has rows, reach the driver.
    """
    every = max(1, docs.count() // sample_rows)
    held = docs.select(*{c: F.col(c) for c in (docs.columns[0], "text")}.values())
    sample = held.filter(F.pmod(F.xxhash64(*held.columns), F.lit(every)) == 0).select(F.coalesce("text", F.lit("")).alias("text"))
    sample = written(sample.repartition(4).withColumn("row", F.monotonically_increasing_id()), "rule-sample")
    over = lambda f: let(words_of(F.col("text")), lambda w: f(Stats.of_words(F.col("text"), w)))
    read = over(lambda x: F.array(_clock(), _clock(), *[c for r in rules for c in (r.rejects(x).cast("string"), _clock())]))
    timed = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).select("row", read.alias("at"))
    at = lambda i: F.get("at", F.lit(i)).cast("long")
    took = [at(1) - at(0), *[at(2 * i + 3) - at(2 * i + 1) for i in range(len(rules))]]
    least = timed.groupBy("row").agg(*[F.min(c).alias(f"t{i}") for i, c in enumerate(took)])
    idle, *sums = [x or 0 for x in least.agg(*[F.sum(f"t{i}") for i in range(len(rules) + 1)]).first()]
    costs = [float(max(x - idle, 1)) for x in sums]
    verdicts = over(lambda x: F.array(*[F.coalesce(r.rejects(x), F.lit(False)) for r in rules]))
    return costs, {tuple(r["v"]): r["n"] for r in sample.groupBy(verdicts.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 1000) -> list[Rule]:
    """Greedy order by rejection per cost among documents that the rules before it keep; costs are timed, so rules of nearly like worth may change places."""
    costs, left = measure_rules(docs, rules, sample_rows)
    rest, out = list(range(len(rules))), []
    while rest:
        gain = {i: sum(n for v, n in left.items() if v[i]) / costs[i] for i in rest}
        best = max(rest, key=lambda i: (gain[i], -costs[i], -i))
        out.append(rules[best])
        rest.remove(best)
        left = {v: n for v, n in left.items() if not v[best]}
    return out


def cascade(rules: list[Rule], x: Stats) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated then."""
    out = None
    for r in rules:
        out = F.when(r.rejects(x), r.name) if out is None else out.when(r.rejects(x), r.name)
    return F.lit(None).cast("string") if out is None else out


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """`docs` with s (base_stats) and rejected_by, null where every rule keeps the document.

    A null or empty text has no words, so the word rule rejects it.  Repeated rows are judged alike; further columns
    pass through, but for a column named s or rejected_by, which is replaced.  All of base_stats is asked for in every row,
    so only what rules need beyond it (line counts, capitals, letters) is left for the cascade to skip; `keep_good` has no
    such columns and computes nothing for a rule that is not reached.
    """
    rules = order_rules(docs, default_rules() if rules is None else rules, sample_rows)
    counted = docs.drop("s", "rejected_by").withColumn("s", base_stats(F.col("text")))
    return counted.withColumn("rejected_by", cascade(rules, Stats.of_struct(F.coalesce(F.col("text"), F.lit("")), F.col("s"))))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """The documents that every rule keeps, with the columns of `docs`; words are found once, the rest as rules need it."""
    rules = order_rules(docs, default_rules() if rules is None else rules, sample_rows)
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.filter(let(words_of(t), lambda w: cascade(rules, Stats.of_words(t, w))).isNull())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, over whole texts."""
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("s")
    return out.select(
        "doc_id", "s.*", ((s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT k, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT k, i, word, lead(word, 1) OVER x AS w2, lead(word, 2) OVER x AS w3 FROM u WINDOW x AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, word, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
cover AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM r WHERE c > 1) GROUP BY k),
l AS (SELECT k, len(ls) - len(list_distinct(ls)) AS n_dup FROM (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)),
s AS (SELECT d.doc_id, d.text, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
  FROM d JOIN w USING (k) JOIN l USING (k) LEFT JOIN cover USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * len(string_split(text, chr(10))) OR word_chars < 3 * n_words OR word_chars > 12 * n_words
    OR 2 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) OR 100 * n_letter_words < 80 * n_words) AS kept
FROM b
"""
