"""Operator 6: quality rules as a short-circuit cascade, in DataFrame functions only.

Rules are expressions that are true for a text to reject. On a sample drawn by hash, the cost of each rule (its time,
compiled, less that of a pass without a rule) and its selectivity (share that it rejects) are estimated; rules then run
by rejection per cost, each only on what the earlier ones left (CASE WHEN evaluates no later branch). The order changes
the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm.common import documents, shared, whole_text, word_array

#: Rows of the sample on which costs and selectivities are estimated, the longest text in it, how often each of its rows
#: is measured in a pass, and timed passes; verdicts do not depend on it.
SAMPLE_ROWS, SAMPLE_BYTES, TIMES, PASSES = 500, 1 << 16, 4, 2
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Limits of the cascade's own rules, beside the two base rules.
MOST_SYMBOLS_PER_WORD = 0.1
MOST_CAPITALS = 0.5
MOST_DUPLICATE_LINES = 0.3
WORD_LENGTHS = (2.0, 25.0)


@dataclass(frozen=True)
class Rule:
    """``reject`` gets the text (null texts are empty) and its words, and tells whether the text is to go."""

    name: str
    reject: Callable[[Column, Column], Column]
    base: bool = False


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for each row, also where ``use`` reads it within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows of ``window`` words that the text has twice or more.

    Windows are 64-bit hashes of their words' 64-bit hashes. Most texts repeat none, which the number of distinct ones
    tells; else, sorted by hash, equal windows are neighbours, and their starts are sorted to add up what they cover.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda x, i: F.least(F.coalesce(F.get(starts, i + 1) - x, F.lit(window)), F.lit(window))), F.lit(0), lambda a, b: a + b)

    def starts(placed: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(placed, i)["h"] == x["h"], F.lit(False))
        found = F.transform(placed, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["at"]))
        return let(F.sort_array(F.filter(found, lambda x: x.isNotNull())), covered)

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, starts))

    def windows(of_words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(of_words) - window)
        return let(F.transform(at, lambda i: F.xxhash64(*[F.get(of_words, i + k) for k in range(window)])), count)

    return F.when(F.size(words) >= window, let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(0).cast("long")


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 10


def repetitive(text: Column, words: Column) -> Column:
    return 100 * n_repeat_words(words) > 20 * F.size(words)


def symbol_heavy(text: Column, words: Column) -> Column:
    return n_symbols(text) > MOST_SYMBOLS_PER_WORD * F.size(words)


def line_heavy(text: Column, words: Column) -> Column:
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x)) > MOST_DUPLICATE_LINES * F.size(x))


def odd_words(text: Column, words: Column) -> Column:
    return ~(word_chars(words) / F.greatest(F.size(words), F.lit(1))).between(*WORD_LENGTHS)


def shouting(text: Column, words: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * word_chars(words)


RULES = (
    Rule("few_words", few_words, base=True),
    Rule("repetitive", repetitive, base=True),
    Rule("symbol_heavy", symbol_heavy),
    Rule("line_heavy", line_heavy),
    Rule("odd_words", odd_words),
    Rule("shouting", shouting),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on about ``rows`` rows, best rejection per cost first.

    The sample is of all partitions, by a hash of id and text; texts of more than ``SAMPLE_BYTES`` are not in it.
    """
    text = whole_text()
    hit = F.pmod(F.xxhash64("doc_id", text), F.lit(max(1, docs.count() // rows))) == 0
    drawn = docs.where(hit & (F.octet_length(text) <= SAMPLE_BYTES)).select(text.alias("t"), word_array(text).alias("w")).limit(rows)
    sample = shared(drawn).select("t", "w", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def timed(condition: Column) -> tuple[float, int]:
        counted, seconds = sample.agg(F.count_if(condition)), []
        for _ in range(1 + PASSES):  # the first compiles
            began = time.perf_counter()
            hits = counted.first()[0]
            seconds.append(time.perf_counter() - began)
        return min(seconds[1:]), hits

    n = max(1, sample.count())
    empty, _ = timed(F.length("t") + F.size("w") < 0)
    found = []
    for rule in rules:
        seconds, hits = timed(rule.reject(F.col("t"), F.col("w")))
        found.append(Estimate(rule, max(seconds - empty, 1e-3), hits / n))
    return sorted(found, key=lambda e: (-e.rejected / e.seconds, e.seconds, e.rule.name))


def cascade(text: Column, words: Column, rules: list[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects the text; null where none does."""
    first, *rest = rules
    out = F.when(first.reject(text, words), first.name)
    for rule in rest:
        out = out.when(rule.reject(text, words), rule.name)
    return out


def quality(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and so fails; repeated rows get the same row each; other columns are ignored. The cascade
    here holds the rules that are not base rules, run on what those left.
    """
    order = [e.rule for e in estimate(docs, tuple(r for r in RULES if not r.base))]
    text, words = F.col("t"), F.col("w")
    split = docs.select("doc_id", whole_text().alias("t")).withColumn("w", word_array(text))
    measured = split.select("doc_id", "t", "w", F.size(words).cast("long").alias("n_words"), word_chars(words).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(words).alias("n_repeat_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = F.when(failed, False).otherwise(cascade(text, words, order).isNull())
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without what the whole cascade rejects. Texts are cut into words once, within the condition."""
    order = [e.rule for e in estimate(docs, rules)]
    text = whole_text()
    return docs.where(let(word_array(text), lambda words: cascade(text, words, order).isNull()))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), p AS (
  SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS piece FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)
), twice AS (
  SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, piece) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS o(k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT n_symbols > {MOST_SYMBOLS_PER_WORD} * n_words
         AND NOT n_dup_lines > {MOST_DUPLICATE_LINES} * n_lines
         AND word_chars / greatest(n_words, 1) BETWEEN {WORD_LENGTHS[0]} AND {WORD_LENGTHS[1]}
         AND NOT n_capitals > {MOST_CAPITALS} * word_chars AS kept
FROM m
"""
