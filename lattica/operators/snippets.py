"""Snippets of code in memory: taken in one by one, each row against what the rows before it have left."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.text import line_slice, number_lines
from lattica.operators.changes import with_islands
from lattica.operators.delivery import ranked
from lattica.operators.diffs import relocated


class Ranges:
    """Snippets of one file in the order they came, over disjoint pieces of lines, each owned by the first snippet that holds it.

    A new range looks at the pieces it touches: the smallest owner is the first snippet that overlaps it. That snippet grows
    over the range and takes its pieces over, so each piece is taken once, and n ranges cost n log n.
    """

    def __init__(self) -> None:
        self.spans: list[list[int]] = []
        self._starts: list[int] = []
        self._pieces: dict[int, tuple[int, int]] = {}  # start -> (end, owner)

    def add(self, start: int, end: int) -> tuple[str, int]:
        """(add, skip or expand; number of the snippet it went to)."""
        i = bisect_right(self._starts, start) - 1
        if i < 0 or self._pieces[self._starts[i]][0] < start:
            i += 1
        j = bisect_right(self._starts, end)
        touched = [(s, *self._pieces[s]) for s in self._starts[i:j]]
        if not touched:
            self.spans.append([start, end])
            self._put(start, end, len(self.spans) - 1)
            return "add", len(self.spans) - 1
        owner = min(o for *_, o in touched)
        if self.spans[owner] == [start, end]:
            return "skip", owner
        low, high = min(start, self.spans[owner][0]), max(end, self.spans[owner][1])
        self.spans[owner] = [low, high]
        for s, *_ in touched:
            del self._pieces[s]
        del self._starts[i:j]
        first, last = touched[0], touched[-1]
        if first[0] < start:
            self._put(first[0], start - 1, first[2])
        if last[1] > end:
            self._put(end + 1, last[1], last[2])
        self._put(start, end, owner)
        return "expand", owner

    def hold(self, start: int, end: int) -> None:
        """A snippet as it is, whatever it overlaps: lines that earlier ones hold stay theirs."""
        self.spans.append([start, end])
        i = bisect_right(self._starts, start) - 1
        at = max(start, self._pieces[self._starts[i]][0] + 1) if i >= 0 else start
        for s in self._starts[bisect_left(self._starts, at) : bisect_right(self._starts, end)]:
            if at < s:
                self._put(at, s - 1, len(self.spans) - 1)
            at = self._pieces[s][0] + 1
        if at <= end:
            self._put(at, end, len(self.spans) - 1)

    def _put(self, start: int, end: int, owner: int) -> None:
        insort(self._starts, start)
        self._pieces[start] = (end, owner)


_ACTION = "action string, snippet long"


def ingested(memory: DataFrame, rows: DataFrame) -> DataFrame:
    """What becomes of each of ``rows`` (seq, file_path, start_line, end_line) added to ``memory`` (id, and the same columns but seq), in the
    order of seq: (seq, file_path, start_line, end_line, action, snippet, snippet_start, snippet_end).

    Action is skip if the first snippet that overlaps has the same lines, expand if it has others and grows over these, add if
    there is none; snippet is the id in memory, or minus the seq of the row that was added, and its lines are those after all rows. Rows
    with a missing part, or an end before the start, are left out. Ranges of a file that no chain of common lines ties together
    can't meet, so they are dealt out apart; a chain streams through one task, which holds its pieces only.
    """
    whole = "file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL AND start_line <= end_line"
    held = memory.select(F.col("id").cast("long").alias("_id"), F.lit(0).cast("long").alias("seq"), "file_path", "start_line", "end_line")
    came = rows.select(F.lit(None).cast("long").alias("_id"), F.col("seq").cast("long").alias("seq"), "file_path", "start_line", "end_line")
    both = with_islands(held.unionAll(came).filter(whole), "file_path", gap=0).withColumn("_come", F.col("_id").isNull())
    dealt = both.repartition("file_path", "_island").sortWithinPartitions("file_path", "_island", "_come", F.coalesce("_id", "seq"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ranges, ids = None, Ranges(), []
        for b in batches:
            out = []
            for key, row_id, seq, start, end in zip(zip(*(b.column(c).to_pylist() for c in ("file_path", "_island")), strict=True), *(b.column(c).to_pylist() for c in ("_id", "seq", "start_line", "end_line")), strict=True):
                if key != at:
                    at, ranges, ids = key, Ranges(), []
                if row_id is not None:  # memory keeps its snippets as they are, overlaps and all
                    ranges.hold(start, end)
                    ids.append(row_id)
                    out.append(("held", row_id))
                else:
                    action, n = ranges.add(start, end)
                    if action == "add":
                        ids.append(-seq)
                    out.append((action, ids[n]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=[*b.schema.names, "action", "snippet"])

    done = dealt.mapInArrow(fold, T.StructType([*dealt.schema.fields, *T.StructType.fromDDL(_ACTION).fields]))
    spans = done.groupBy("snippet").agg(F.min("start_line").alias("snippet_start"), F.max("end_line").alias("snippet_end"))
    return done.filter("_come").join(spans, "snippet").select("seq", "file_path", "start_line", "end_line", "action", "snippet", "snippet_start", "snippet_end")


def ingest(memory: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """The memory (id, file_path, start_line, end_line, description, code) after ``rows`` (seq, file_path, start_line, end_line, description):
    grown snippets with their new lines, added ones behind with ids that go on from the largest, in the order of seq. Code is
    fetched from ``files`` anew, numbered; a row without a description is left out like one without lines."""
    told = ingested(memory, rows.filter("description IS NOT NULL"))
    grown = told.filter("action = 'expand' AND snippet > 0").select(F.col("snippet").alias("id"), F.col("snippet_start").alias("_a"), F.col("snippet_end").alias("_b")).distinct()
    kept = memory.select("id", "file_path", "start_line", "end_line", "description").join(grown, "id", "left")
    old = kept.select("id", "file_path", F.coalesce("_a", "start_line").alias("start_line"), F.coalesce("_b", "end_line").alias("end_line"), "description")
    fresh = told.filter("action = 'add'").select("seq", "file_path", F.col("snippet_start").alias("start_line"), F.col("snippet_end").alias("end_line")).join(rows.select("seq", "description"), "seq")
    top = memory.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = ranked(fresh, "seq").join(F.broadcast(top)).withColumn("id", F.col("_rank") + F.col("_top"))
    every = old.unionByName(numbered.select(*old.columns))
    met = every.join(files.select("file_path", "content"), "file_path", "left")
    return met.select(*old.columns, number_lines(line_slice("content", F.col("start_line"), F.col("end_line")), F.col("start_line")).alias("code"))


def refreshed(memory: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """The memory (id, file_path, start_line, end_line, description, code) after files changed: (…, action) with keep, move, update or remove.

    Snippets of ``changed`` files (file_path) are looked for in the files' present texts and take their new lines and code; of
    those that aren't found, and of files that are gone, the row says remove. All others are kept as they are.
    """
    due = memory.join(changed.select("file_path").distinct(), "file_path", "left_semi").join(files.select("file_path", "content"), "file_path", "left")
    r = relocated(F.coalesce("code", F.lit("")), F.col("start_line"), F.col("end_line"), F.col("content"))
    told = due.withColumn("_r", r).withColumn("action", F.col("_r.action"))
    start, end = F.coalesce("_r.start", "start_line").cast("long"), F.coalesce("_r.end", "end_line").cast("long")
    code = F.when(F.col("action") == "remove", F.col("code")).otherwise(number_lines(line_slice("content", start, end), start))
    moved = told.select("id", "file_path", start.alias("start_line"), end.alias("end_line"), "description", code.alias("code"), "action")
    rest = memory.join(changed.select("file_path").distinct(), "file_path", "left_anti")
    return rest.select("id", "file_path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "description", "code", F.lit("keep").alias("action")).unionByName(moved)
