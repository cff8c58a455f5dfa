"""Line and text functions as column expressions: JVM-side, but for the vote of similar lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line chunking (fixed values): from THRESHOLD lines on, pieces of SIZE; a tail below TAIL is dealt out among the others.
THRESHOLD, SIZE, TAIL, WINDOW = 700, 600, 50, 2_000

#: Scores of stated confidence (fixed values); anything else is 0.5.
CONFIDENCE = {"high": 0.9, "medium": 0.7, "low": 0.5}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(text: Column | str) -> Column:
    """Lines at \\n; a closing line end leaves an empty last line."""
    return F.split(col(text), "\n", -1)


def split_lines(text: Column | str) -> Column:
    """Lines at any Unicode line boundary, without an empty last one."""
    parts = F.split(F.regexp_replace(col(text), "\r\n", "\n"), "[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_range(start: Column | str, end: Column | str) -> Column:
    """struct(start, end) if both are numbers, 1 at least and in order, else null."""
    s, e = col(start).try_cast("int"), col(end).try_cast("int")
    return F.when((s >= 1) & (e >= 1) & (s <= e), F.struct(s.alias("start"), e.alias("end")))


def overlaps(s1: Column | str, e1: Column | str, s2: Column | str, e2: Column | str) -> Column:
    """Closed intervals share a line."""
    return (col(s1) <= col(e2)) & (col(s2) <= col(e1))


def overlaps_or_unknown(s1: Column | str, e1: Column | str, s2: Column | str, e2: Column | str) -> Column:
    """Like ``overlaps``; a null bound of the first range lets it through."""
    return col(s1).isNull() | col(e1).isNull() | overlaps(s1, e1, s2, e2)


def line_slice(text: Column | str, start: Column, end: Column, first: int = 1) -> Column:
    """Lines start..end by absolute number, clamped to the text, whose first line has the number ``first``."""
    all_lines = lines(text)
    a = F.greatest(start - first, F.lit(0))
    b = F.least(end - first + 1, F.size(all_lines))
    return F.when(a < b, F.array_join(F.slice(all_lines, a + 1, b - a), "\n")).otherwise("")


def number_lines(text: Column | str, first: Column | int = 1) -> Column:
    """Each line as '%4d | line'."""
    base = F.lit(first) if isinstance(first, int) else first
    return F.array_join(F.transform(lines(text), lambda x, i: F.format_string("%4d | %s", i + base, x)), "\n")


def strip_numbers(text: Column | str) -> Column:
    """Undo ``number_lines``."""
    return F.regexp_replace(col(text), r"(?m)^\s*\d+ \| ?", "")


def chunk_of_lines(text: Column | str, start: Column, end: Column) -> Column:
    """Lines start..end if the range lies within the text, else the whole text."""
    ok = line_range(start, end).isNotNull() & (start <= F.size(lines(text)))
    return F.when(ok, line_slice(text, start, end)).otherwise(col(text))


def needs_chunks(text: Column | str, threshold: int = THRESHOLD) -> Column:
    return F.size(lines(text)) > threshold


def _chunks(all_lines: Column, starts: Column, size_of, first: int) -> Column:
    def made(start: Column) -> Column:
        n = size_of(start)
        return F.struct(
            (start + first).alias("start_line"), (start + first + n - 1).alias("end_line"), n.alias("total_lines"),
            F.array_join(F.slice(all_lines, start + 1, n), "\n").alias("content"),
        )

    return F.transform(starts, made)


def chunk_lines(text: Column | str, size: int = SIZE, threshold: int = THRESHOLD, first: int = 1) -> Column:
    """Non-overlapping chunks (start_line, end_line, total_lines, content) of large texts.

    Up to ``threshold`` lines are one chunk. A remainder below TAIL lines makes one chunk less,
    whose lines are dealt evenly, the first ones a line longer. An empty or null text is one empty chunk.
    """
    all_lines = lines(F.coalesce(col(text), F.lit("")))
    n = F.size(all_lines)
    one = F.array(F.struct(F.lit(first).alias("start_line"), F.when(n == 1, F.lit(first)).otherwise(n + first - 1).alias("end_line"), F.when(F.coalesce(col(text), F.lit("")) == "", 0).otherwise(n).alias("total_lines"), F.coalesce(col(text), F.lit("")).alias("content")))
    plain = _chunks(all_lines, F.sequence(F.lit(0), n - 1, F.lit(size)), lambda s: F.least(F.lit(size), n - s), first)
    k = F.greatest((F.ceil(n / size) - 1).cast("int"), F.lit(1))
    each, extra = F.floor(n / k).cast("int"), n % k
    dealt = _chunks(all_lines, F.transform(F.sequence(F.lit(0), k - 1), lambda i: i * each + F.least(i, extra)), lambda s: each + F.when(s < extra * (each + 1), 1).otherwise(0), first)
    short_tail = (n % size > 0) & (n % size < TAIL) & (n > size)
    return F.when(n <= threshold, one).when(short_tail, dealt).otherwise(plain)


def fixed_chunks(text: Column | str, size: int = SIZE) -> Column:
    """Chunks of ``size`` lines, the last one shorter."""
    all_lines = lines(F.coalesce(col(text), F.lit("")))
    n = F.size(all_lines)
    return _chunks(all_lines, F.sequence(F.lit(0), n - 1, F.lit(size)), lambda s: F.least(F.lit(size), n - s), 1)


def line_windows(n_lines: Column, size: int = WINDOW) -> Column:
    """(start, end) windows of ``size`` lines over 1..n."""
    return F.transform(F.sequence(F.lit(1), F.greatest(n_lines, F.lit(1)), F.lit(size)), lambda a: F.struct(a.alias("start"), F.least(a + size - 1, n_lines).alias("end")))


def snippet_lines(spec: Column | str) -> Column:
    """'a-b' or 'n' as a list of line numbers; anything else is an empty list."""
    parts = F.split(F.trim(col(spec)), "-")
    a, b = F.get(parts, F.lit(0)).try_cast("int"), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))).try_cast("int")
    return F.when(a.isNotNull() & b.isNotNull() & (a <= b) & (F.size(parts) <= 2), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def find_lines(needle: Column, hay: Column) -> Column:
    """First (start, end), from 1, of the list of lines ``needle`` within ``hay``; null if it isn't there. One string search."""
    n = F.size(needle)
    whole = F.concat(F.lit("\n"), F.array_join(hay, "\n", ""), F.lit("\n"))
    at = F.position(F.concat(F.lit("\n"), F.array_join(needle, "\n", ""), F.lit("\n")), whole)
    start = F.regexp_count(F.substr(whole, F.lit(1), at), F.lit("\n"))
    return F.when((n > 0) & (F.size(hay) > 0) & (at > 0), F.struct(start.alias("start"), (start + n - 1).alias("end")))


def best_window(want: list[str], have: list[str]) -> tuple[float, int] | None:
    """(share of equal lines, place from 0) of the window of ``have`` that is most like ``want``, the first of equals; None if
    ``want`` is empty or longer. Each pair of equal lines is a vote for one place, so the time goes with the matches."""
    n, places = len(want), len(have) - len(want) + 1
    if not n or places <= 0:
        return None
    at: dict[str, list[int]] = {}
    for i, line in enumerate(have):
        at.setdefault(line, []).append(i)
    votes = np.zeros(places, np.int64)
    wanted: dict[str, list[int]] = {}
    for k, line in enumerate(want):
        if line in at:
            wanted.setdefault(line, []).append(k)
    for line, offsets in wanted.items():
        found, offsets = np.array(at[line]), np.array(offsets)
        few, many, sign = (offsets, found, 1) if len(offsets) <= len(found) else (found, offsets, -1)
        for x in few:
            to = sign * (many - x)
            votes[to[(to >= 0) & (to < places)]] += 1
    best = int(votes.argmax())
    return int(votes[best]) / n, best


def similar_lines(needle: Column, hay: Column, threshold: float = 0.2) -> Column:
    """Best window of ``hay`` by the share of equal trimmed lines; the first of equals; null below ``threshold``."""

    @F.pandas_udf("struct<start:int,end:int,score:double>")
    def run(needles: pd.Series, hays: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(needles, hays, strict=True):
            best = None if a is None or b is None else best_window([(x or "").strip(" ") for x in a], [(x or "").strip(" ") for x in b])
            out.append((best[1] + 1, best[1] + len(a), best[0]) if best and best[0] >= threshold else (None, None, None))
        return pd.DataFrame(out, columns=["start", "end", "score"])

    found = run(needle, hay)
    return F.when(found["score"].isNotNull(), found)


def confidence(word: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(col(word))), F.lit(0.5))


def pascal_case(name: Column | str) -> Column:
    """Words at blanks, dashes and underscores, each with a capital, joined."""
    return F.array_join(F.transform(F.split(F.trim(col(name)), r"[\s_\-]+"), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")


def upper_snake(name: Column | str) -> Column:
    """Word boundaries, dashes and blanks become underscores; all capitals."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(col(name)), r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s\-]+", "_"))


def signature(kind: Column | str, params: Column) -> Column:
    """'kind|k:v|...' of a map, keys in order, nulls left out."""
    pairs = F.transform(F.map_entries(params), lambda e: F.when(e["value"].isNotNull(), F.concat(e["key"], F.lit(":"), e["value"])))
    return F.array_join(F.concat(F.array(col(kind)), F.array_sort(F.array_compact(pairs))), "|")


def element_id(path: Column, start: Column, end: Column, kind: Column, name: Column) -> Column:
    """'elem_' and six hex digits of a key's MD5."""
    return F.concat(F.lit("elem_"), F.substr(F.md5(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), kind, F.lit(":"), name)), F.lit(1), F.lit(6)))


def metadata_header(path: Column, kind: Column, name: Column, language: Column) -> Column:
    """Header lines of a block; absent parts leave no line."""
    part = lambda label, x: F.when(x.isNotNull() & (x != ""), F.concat(F.lit(label + ": "), x))
    return F.concat_ws("\n", part("FILE", path), part("LANGUAGE", language), part("TYPE", kind), part("NAME", name))


def similarity(distance: Column | str) -> Column:
    return 1 / (1 + col(distance))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for dotted versions compared part by part."""
    nums = lambda v: F.transform(F.split(v, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("int"), F.lit(0)))
    return F.when(nums(a) < nums(b), -1).when(nums(a) > nums(b), 1).otherwise(0)
