"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule rejects a text. On a sample, written out once, each rule is timed and its verdicts are taken. The order is then
built greedily: of the rules left, next comes the one that rejects the most of what the rules before it have let pass
per unit of its time. The first rule that rejects a text ends its evaluation. The order changes the work, never the
verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANK_CLASS, BLANKS, discard, materialize, quoted

#: Fixed value: the characters that count as symbols.
SYMBOLS = "[#*$%&|<>]+"
#: Rows, about, of the sample that orders the rules, and times that each rule is timed.
SAMPLE_ROWS, TIMINGS = 1000, 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and controls 9 to 13."""
    bare = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANK_CLASS}]+"))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(whole(text), f"[{BLANK_CLASS}]+", "")).cast("long")


def symbols(text: Column) -> Column:
    return (F.length(whole(text)) - F.length(F.regexp_replace(whole(text), SYMBOLS, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(whole(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are compared by 64-bit hash; sorting (hash, place) pairs costs n log n, however often a window repeats.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        )

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(places, i + 1) - p), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def twice(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        pairs = F.filter(ordered, lambda x, i: same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))))
        return let(F.sort_array(F.transform(pairs, lambda x: x["i"])), covered)

    def count(found: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(found, lambda x: x["h"])))
        return F.when(distinct == F.size(found), F.lit(0)).otherwise(let(F.sort_array(found), twice))

    return let(tokens, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), count))).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects``: true for a text to go."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Measures:
    """What rules compare. Made from a text each is an expression; where a table holds them each is a column of it."""

    n_words: Column
    n_repeat_words: Column
    word_chars: Column
    n_symbols: Column
    n_lines: Column
    n_dup_lines: Column
    n_capitals: Column

    @classmethod
    def of(cls, text: Column) -> Measures:
        n_capitals = F.length(F.regexp_replace(whole(text), r"\P{Lu}+", ""))
        return cls(F.size(words(text)), repeated_words(words(text)), word_chars(text), symbols(text), F.size(worded_lines(text)), duplicate_lines(text), n_capitals)


def production_rules(m: Measures) -> list[Rule]:
    """Each rule evaluates what it needs, so a cascade that ends early has not paid for the rest."""
    return [
        Rule("few_words", m.n_words < 50),
        Rule("repeated_words", 100 * m.n_repeat_words > 50 * m.n_words),
        Rule("symbols", m.n_symbols > F.lit(0.25) * m.n_words),
        Rule("duplicate_lines", 100 * m.n_dup_lines > 40 * m.n_lines),
        Rule("word_length", (m.word_chars > F.lit(18.0) * m.n_words) | (m.word_chars < F.lit(2.0) * m.n_words)),
        Rule("capitals", 2 * m.n_capitals > m.word_chars),
    ]


def measured(df: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> tuple[list[float], list[list[bool]]]:
    """Seconds that each rule takes over a sample of about ``sample_rows`` rows, and its verdicts row by row.

    The sample is drawn row by row where rows lie, at a rate that follows from their count: no text is shuffled, and
    rows that repeat count by their share. What comes to the driver is bounded by the sample: a flag a rule and row.
    """
    n = df.count()
    rate = min(1.0, sample_rows / n) if n else 0.0
    sample = materialize(df.where(F.rand(17) < rate) if rate < 1 else df)
    flags = [F.coalesce(r.rejects, F.lit(False)) for r in rules]
    seconds = []
    for flag in flags:
        took = []
        for _ in range(TIMINGS):
            begin = time.perf_counter()
            sample.agg(F.sum(flag.cast("int"))).collect()  # a new plan: one that has run would read its own shuffle
            took.append(time.perf_counter() - begin)
        seconds.append(min(took))
    verdicts = [list(r) for r in sample.select(*[f.alias(f"f{k}") for k, f in enumerate(flags)]).collect()]
    discard(sample)
    return seconds, verdicts


def greedy_order(seconds: Sequence[float], verdicts: Sequence[Sequence[bool]]) -> list[int]:
    """Places of the rules: each time the most rejections, of rows still there, a second; ties keep the given order.

    The time that every rule shares (a job's start) is taken off first, down to a hundredth of the slowest rule.
    """
    floor, most = min(seconds, default=0.0), max(seconds, default=0.0)
    cost = [max(s - 0.9 * floor, 0.01 * most, 1e-9) for s in seconds]
    rows, left, order = list(verdicts), list(range(len(seconds))), []
    while left:
        best = max(left, key=lambda k: (sum(r[k] for r in rows) / cost[k], -left.index(k)))
        left.remove(best)
        order.append(best)
        rows = [r for r in rows if not r[best]]
    return order


def ordered_rules(df: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` in the greedy order of rejection per cost on a sample of ``df``; an empty table keeps the given order."""
    if len(rules) < 2:
        return list(rules)
    return [rules[k] for k in greedy_order(*measured(df, rules, sample_rows))]


def first_rejection(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    chain = F
    for rule in rules:
        chain = chain.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return chain.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that no production rule rejects, with all their columns, whatever those are named.

    A null, empty or blank text has no words, and goes. Repeated rows are judged one by one; an empty table gives an
    empty one. A text is one expression's value at a time, so its length is bounded by a row of Spark alone.
    """
    rules = ordered_rules(df.select(quoted(text).alias("text")), production_rules(Measures.of(F.col("text"))))
    known = {r.name: r for r in production_rules(Measures.of(quoted(text)))}
    return df.where(first_rejection([known[r.name] for r in rules]).isNull())


def rule_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every row; other columns are not read.

    A null, empty or blank text has no words and fails. Repeated rows give repeated rows, an empty table an empty one.
    The base measures are asked for of every row, so the rules behind base_failed compare those columns; what only
    a rule needs is computed if the cascade gets there.
    """
    text = F.col("text")
    made = docs.select(
        "doc_id",
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        word_chars(text).alias("word_chars"),
        symbols(text).alias("n_symbols"),
        let(worded_lines(text), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        "text",
    )
    of_text = Measures.of(text)
    held = Measures(F.col("n_words"), F.col("n_repeat_words"), F.col("word_chars"), F.col("n_symbols"), F.col("n_lines"), F.col("n_dup_lines"), of_text.n_capitals)
    base = ("few_words", "repeated_words")
    extra = [r for r in production_rules(held) if r.name not in base]
    order = [r.name for r in ordered_rules(docs.select("text"), [r for r in production_rules(of_text) if r.name not in base])]
    verdict = first_rejection(sorted(extra, key=lambda r: order.index(r.name)))
    rows = made.select("doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("lines.n").alias("n_lines"), "text")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict.isNull())
    return rows.withColumn("kept", kept).drop("text", "n_lines")


#: DuckDB SQL with the same rows, over the table ``documents``.
REPORT_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, unnest([0, 1, 2]) AS u(o) GROUP BY rid),
m AS (SELECT w.rid, doc_id, text, lines, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS capitals
  FROM w LEFT JOIN cov ON cov.rid = w.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.25 * n_words OR 100 * n_dup_lines > 40 * len(lines)
    OR word_chars > 18 * n_words OR word_chars < 2 * n_words OR 2 * capitals > word_chars) AS kept
FROM b
"""
