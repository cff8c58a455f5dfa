"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample. Built-in functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, pairs_of, quoted

#: White space between words, and the characters counted as symbols (fixed values).
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GRAM = 8

#: Rows on which the rules are timed; a documented bound, for the order only. Verdicts don't depend on it.
SAMPLE_ROWS = 2_000


#: The least cost of a rule, in seconds over the sample: below it, times of jobs can't be told apart.
LEAST_SECONDS = 0.002

#: Documents that fail whatever the rules say.
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents that fail. It may use the base columns and ``_text``."""

    name: str
    rejects: str


RULES = (
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("few_letters", "2 * length(regexp_replace(_text, '[^\\\\p{L}]', '')) < word_chars"),
    Rule("shouting", "10 * length(regexp_replace(_text, '[^\\\\p{Lu}]', '')) > 7 * word_chars"),
)


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    Words are [^\\x20\\x09-\\x0D]+. Arrays that a lambda reads by position are columns of
    their own, so they are made once a row. Repeated 8-word windows: if all window hashes
    differ (the usual case) there is nothing to do; else (hash, start) pairs are sorted and
    starts with an equal neighbour are merged into covered words: n log n at any length.
    """
    words = docs.select(F.col(quoted(id_col)).cast("long").alias("_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("_text")).withColumn(
        "_words", F.array_remove(F.split("_text", "[ \\t-\\r]+", -1), "")
    )
    hashed = words.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    grams = hashed.withColumn(
        "_g", F.when(F.size("_h") >= GRAM, F.transform(F.sequence(F.lit(1), F.size("_h") - GRAM + 1), lambda i: F.xxhash64(F.slice("_h", i, GRAM))))
    )
    pairs = grams.withColumn(
        "_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    starts = pairs.withColumn(
        "_p",
        F.expr("CASE WHEN _s IS NOT NULL THEN array_sort(transform(filter(_s, (e, k) -> get(_s, k - 1).h <=> e.h OR get(_s, k + 1).h <=> e.h), e -> e.i)) END"),
    )
    lines = starts.withColumn("_lines", F.expr(f"filter(split(_text, '\\n', -1), l -> length(translate(l, '{SPACE}', '')) > 0)"))
    return lines.select(
        "_id",
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"coalesce(aggregate(_p, named_struct('n', 0L, 'e', 0), (a, p) -> named_struct('n', a.n + p + {GRAM} - greatest(p, a.e), 'e', p + {GRAM}), a -> a.n), 0L)"
        ).alias("n_repeat_words"),
    )


def seconds_of(sample: DataFrame, rejects: str, runs: int = 3) -> float:
    """The least time of some runs of a rule over the sample, after one that compiles it."""
    times = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        sample.agg(F.count_if(F.expr(rejects))).first()
        times.append(time.perf_counter() - began)
    return min(times[1:])


def cascade(patterns: list[tuple[tuple[bool, ...], int]], costs: list[float]) -> list[tuple[int, float]]:
    """[(rule, share it rejects of what reaches it)], the best rejection per cost first, given which rules reject how many rows together."""
    left, out = list(range(len(costs))), []
    while left:
        reach = sum(n for _, n in patterns)
        share = {r: sum(n for hit, n in patterns if hit[r]) / reach if reach else 0.0 for r in left}
        best = max(left, key=lambda r: (share[r] / costs[r], -costs[r], -r))
        out.append((best, share[best]))
        patterns = [(hit, n) for hit, n in patterns if not hit[best]]
        left.remove(best)
    return out


def order_rules(base: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """[(rule, share it rejects of the rows that reach it, seconds)] by rejection per cost, best first.

    The sample is written once and holds rows that pass the base test, as only those reach the rules. A rule's
    cost is its time over the sample less that of a rule that does nothing (a job's floor), its share is
    counted on the rows that the rules before it let pass. An empty table keeps the given order.
    """
    # written before it is filtered: a filter pushed below the base columns would make their arrays anew for each element
    sample = cut(base.limit(2 * sample_rows), "rule-sample").filter(f"NOT ({BASE_FAILED})")
    if sample.isEmpty():
        return [(r, 0.0, 0.0) for r in rules]
    floor = seconds_of(sample, "n_words < 0")
    costs = [max(seconds_of(sample, r.rejects) - floor, LEAST_SECONDS) for r in rules]
    hits = [F.coalesce(F.expr(r.rejects), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    found = sample.select(*hits).groupBy(*[f"r{i}" for i in range(len(rules))]).count().collect()  # a row for each combination of verdicts
    return [(rules[i], share, costs[i]) for i, share in cascade([(tuple(r[:-1]), r[-1]) for r in found], costs)]


def verdict(rules: list[Rule]) -> Column:
    """True if no rule rejects. CASE leaves off at the first rule that does."""
    case = None
    for rule in rules:
        when = F.expr(rule.rejects)
        case = F.when(when, False) if case is None else case.when(when, False)
    return F.lit(True) if case is None else case.otherwise(True)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each document: base columns, ``base_failed`` and ``kept``; no shuffle of texts.

    The base test comes first in the cascade; then the rules, cheapest rejection first. The
    order changes the work, never the verdict. The base columns are always returned, so what the order
    can save is the rules' own work: the rules on letters scan the text, the others compare numbers. A null
    or empty text has no words and fails; whole texts are judged, however long; null ids stay null; rows
    repeat as they come; ties between rules go by cost, then by the given order; other columns are ignored; an empty
    table gives an empty table.
    """
    source = pairs_of(docs, id_col, text_col)
    n = source.count()
    share = min(1.0, 1.5 * sample_rows / n) if n else 1.0
    order = [r for r, *_ in order_rules(base_columns(source.sample(share, seed=11), "_id", "_text"), rules, sample_rows)]
    base = base_columns(source, "_id", "_text")
    failed = base.withColumn("base_failed", F.expr(BASE_FAILED))
    return failed.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(verdict(order)).alias("kept"),
    )
