"""Batches by a budget, filled in order, without any key in one task.

Filling batches is a fold: what becomes of a row hangs on how much of the budget the rows before it have used. Rows are dealt by
ranges of (key, order) and cut into blocks. In a block the next batch's start of each possible start follows from prefix
sums and a sorted search, and pointer doubling over these successors gives what any batch that begins there leads to; so a
block is a table from the budget used on its entry to that on its exit. Blocks are composed in a tree, and the entries
come down the same tree, so no task holds more than a block or a few tables, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.graph import saved

#: Rows of a block, and of it for each unit of a large budget; tables composed at a time.
BLOCK, PER_UNIT, FAN = 16_384, 8, 32


@dataclass(frozen=True)
class Successors:
    """Rows of a block in order: ``size`` if a batch begins with the row, ``more`` if it goes on with it (at most size), ``opens``
    where a key begins. ``after``: the next row that begins a batch, for each row that does; the number of rows for none."""

    size: np.ndarray
    more: np.ndarray
    opens: np.ndarray
    sums: np.ndarray
    after: np.ndarray
    limit: int

    @classmethod
    def of(cls, size: np.ndarray, more: np.ndarray, opens: np.ndarray, limit: int) -> Successors:
        n = len(size)
        sums = np.concatenate([[0], np.cumsum(more)])
        here = np.arange(n)
        full = np.maximum(np.searchsorted(sums[1:], limit - size + sums[1:], side="right"), here + 1)
        used = size + sums[np.minimum(full, n)] - sums[1:]
        after = np.where((used == 0) & (full < n), full + 1, full)  # an empty batch admits any row
        places = np.append(np.flatnonzero(opens), n)
        return cls(size, more, opens, sums, np.minimum(after, places[np.searchsorted(places, here + 1)]), limit)

    def entry(self) -> np.ndarray:
        """First row that begins a batch, for each budget used on entry: 0 .. limit, and limit + 1 for all above."""
        n = len(self.size)
        used = np.arange(self.limit + 2)
        first = np.searchsorted(self.sums[1:], self.limit - used, side="right")
        if first[0] < n and self.sums[first[0]] == 0:
            first[0] += 1
        opened = np.flatnonzero(self.opens)
        return np.minimum(first, opened[0] if len(opened) else n)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(used on exit, batches begun, whether they count from a key's start), for each budget used on entry."""
        n = len(self.size)
        # a row's chain of batches: the rows after it until none is left, in doubling steps
        to, begun, anew, last = self.after.copy(), np.where(self.opens, 0, 1), self.opens.copy(), np.arange(n)
        while (to < n).any():
            going = np.flatnonzero(to < n)
            at = to[going]
            begun[going] = np.where(anew[at], begun[at], begun[going] + begun[at])
            anew[going] |= anew[at]
            last[going] = last[at]
            to[going] = to[at]
        left = self.size[last] + self.sums[n] - self.sums[last + 1] if n else np.zeros(0, np.int64)
        first = self.entry()
        some = first < n
        at = np.where(some, first, 0)
        through = np.arange(self.limit + 2) + self.sums[n]
        out = np.where(some, left[at], through) if n else through
        return np.minimum(out, self.limit + 1), np.where(some, begun[at], 0) if n else np.zeros(self.limit + 2, np.int64), some & anew[at] if n else np.zeros(self.limit + 2, bool)

    def batches(self, used: int, batch: int) -> np.ndarray:
        """The rows' batch numbers, from what was used of which batch on entry."""
        n = len(self.size)
        begun = np.zeros(n, np.int64)
        at = int(self.entry()[used])
        while at < n:
            begun[at] = 1
            at = int(self.after[at])
        begun[self.opens] = 0
        whole = np.cumsum(begun)
        start = np.maximum.accumulate(np.where(self.opens, np.arange(n), -1))
        return np.where(start >= 0, whole - whole[start], batch + whole)


def composed(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One table for several in a row."""
    used, begun, anew = tables[0]
    for out, more, fresh in tables[1:]:
        used, begun, anew = out[used], np.where(fresh[used], more[used], begun + more[used]), anew | fresh[used]
    return used, begun, anew


_TABLE = "g bigint, used array<int>, begun array<bigint>, anew array<boolean>"
_ENTRY = "g bigint, entry_used int, entry_batch bigint"


def _tables(part: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    lists = lambda c, kind: [np.array(v.values.to_numpy(zero_copy_only=False), kind) for v in part.column(c)]
    return list(zip(lists("used", np.int64), lists("begun", np.int64), lists("anew", bool), strict=True))


def _row(g: int, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.bool_())
    return pa.table([pa.array([g], pa.int64()), *(pa.array([x], pa.list_(k)) for x, k in zip(table, kinds, strict=True))], names=["g", "used", "begun", "anew"])


def entries(tables: DataFrame, count: int) -> DataFrame:
    """(g, entry_used, entry_batch) of ``count`` blocks, numbered from 0, by their tables: up a tree of FAN, and down again."""

    def up(part: pa.Table) -> pa.Table:
        part = part.sort_by("g")
        return _row(part.column("g")[0].as_py() // FAN, composed(_tables(part)))

    levels = [tables]
    while count > 1:
        count = -(-count // FAN)
        levels.append(saved(levels[-1].groupBy(F.floor(F.col("g") / FAN)).applyInArrow(up, _TABLE)))
    found = tables.sparkSession.createDataFrame([(0, 0, 0)], _ENTRY)

    def down(part: pa.Table) -> pa.Table:
        part = part.sort_by("g")
        used, batch = part.column("entry_used")[0].as_py(), part.column("entry_batch")[0].as_py()
        out = []
        for g, (to, begun, anew) in zip(part.column("g").to_pylist(), _tables(part), strict=True):
            out.append((g, used, batch))
            used, batch = int(to[used]), int(begun[used]) + (0 if anew[used] else batch)
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["g", "entry_used", "entry_batch"])

    for level in reversed(levels[:-1]):
        above = found.withColumnRenamed("g", "above")
        found = saved(level.join(above, F.floor(F.col("g") / FAN) == F.col("above")).groupBy("above").applyInArrow(down, _ENTRY))
    return found


def _changes(column: pa.ChunkedArray, before: object, first: bool) -> np.ndarray:
    """Where a column differs from the row before it; ``before`` is the value before the first row, unless there is none."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    out = np.ones(len(codes), bool)
    out[1:] = codes[1:] != codes[:-1]
    out[:1] = first or column[0].as_py() != before
    return out


def _running(ends: np.ndarray, fresh: np.ndarray, carry: int | None) -> np.ndarray:
    """Largest end of the rows before, within runs; ``carry`` goes with the first run unless it is fresh. -1: none."""
    run = np.cumsum(fresh)
    carry = None if fresh[:1].any() else carry
    step = int(max(ends.max(initial=0), carry or 0, 0)) + 2  # runs lie one above the other, so a plain maximum stays in its run
    own = np.maximum.accumulate(run * step + np.maximum(ends, -1) + 1)
    before = np.concatenate([[0 if carry is None else int(run[0]) * step + carry + 1 if len(run) else 0], own[:-1]])
    if carry is not None:
        before = np.maximum(before, np.where(run == run[0], run * step + carry + 1, 0))
    return np.where(fresh, -1, before - run * step - 1)


def _packed(rows: DataFrame, key: str, order: list[str], limit: int, size: str, spans: tuple[str, str, str] | None = None, block: int | None = None) -> DataFrame:
    """Rows with their batch. ``spans``: columns of file, start and end, whose lines count once where ranges of a file overlap."""
    columns, block = rows.columns, block or max(BLOCK, PER_UNIT * limit)
    dealt = saved(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_p", F.spark_partition_id()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last, top = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            opens = _changes(t.column(key), last and last[0], n == 0)
            more = [pa.array(np.arange(n, n + len(t))), pa.array(opens)]
            if spans:
                fresh = opens | _changes(t.column(spans[0]), last and last[1], n == 0)
                ends = t.column(spans[2]).to_numpy()
                before = _running(ends, fresh, top)
                top = max(int(before[-1]), int(ends[-1]))
                more += [pa.array(before), pa.array(np.maximum(before, ends)), pa.array(fresh)]
            last = (t.column(key)[-1].as_py(), t.column(spans[0])[-1].as_py() if spans else None)
            n += len(t)
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "_i", "_opens", "_before", "_after", "_fresh"][: len(b.columns) + len(more)])

    extra = "_i bigint, _opens boolean" + ", _before bigint, _after bigint, _fresh boolean" * bool(spans)
    schema = T.StructType([*dealt.schema.fields, *T.StructType.fromDDL(extra).fields])
    at = saved(dealt.mapInArrow(placed, schema))
    run = F.struct(F.col(key).alias("k"), *([F.col(spans[0]).alias("f")] if spans else []))
    top = F.col("_after") if spans else F.lit(None).cast("long")
    later = F.min(F.when(F.col("_fresh") & (F.col("_i") > 0), F.col("_i"))) if spans else F.lit(None).cast("long")
    edges = at.groupBy("_p").agg(F.count("*").alias("n"), F.min_by(run, "_i").alias("first"), F.max_by(run, "_i").alias("last"), F.max_by(top, "_i").alias("top"), later.alias("until")).collect()
    # a row for each partition: where its blocks begin, and whether its first rows go on with those before
    number, joins, carry, last, top_before = {}, {}, {}, None, None
    total = 0
    for e in sorted(edges, key=lambda e: e["_p"]):
        number[e["_p"]] = total
        total += -(-e["n"] // block)
        joins[e["_p"]] = last is not None and e["first"]["k"] == last["k"]
        goes_on = joins[e["_p"]] and bool(spans) and e["first"]["f"] == last["f"]
        carry[e["_p"]] = top_before if goes_on else None
        top_before = max(e["top"], top_before) if goes_on and e["until"] is None else e["top"]
        last = e["last"]
    if not total:
        return rows.withColumn("batch", F.lit(None).cast("int"))

    def successors(part: pa.Table) -> Successors:
        p, i = part.column("_p")[0].as_py(), part.column("_i").to_numpy()
        opens = part.column("_opens").to_numpy(zero_copy_only=False).copy()
        if i[0] == 0 and joins[p]:
            opens[0] = False
        n = np.maximum(part.column(size).to_numpy(), 0)
        if not spans:
            return Successors.of(n, n, opens, limit)
        before, start, end = (part.column(c).to_numpy() for c in ("_before", spans[1], spans[2]))
        if carry[p] is not None:  # the partition's first run began in an earlier one
            first = i < (part.column("_until")[0].as_py() or len(i) + i[-1] + 1)
            before = np.where(first, np.maximum(before, carry[p]), before)
        return Successors.of(n, n - np.clip(np.minimum(end, before) - start + 1, 0, n), opens, limit)

    places = at.sparkSession.createDataFrame([(e["_p"], number[e["_p"]], e["until"]) for e in edges], "_p int, _first bigint, _until bigint")
    blocks = at.join(F.broadcast(places), "_p").withColumn("_g", F.col("_first") + F.floor(F.col("_i") / block))

    def table(part: pa.Table) -> pa.Table:
        part = part.sort_by("_i")
        return _row(part.column("_g")[0].as_py(), successors(part).table())

    found = entries(saved(blocks.groupBy("_g").applyInArrow(table, _TABLE)) if total > 1 else blocks.sparkSession.createDataFrame([], _TABLE), total)

    def finished(part: pa.Table) -> pa.Table:
        part = part.sort_by("_i")
        out = successors(part).batches(part.column("entry_used")[0].as_py(), part.column("entry_batch")[0].as_py())
        return part.select(columns).append_column("batch", pa.array(out.astype(np.int32)))

    met = blocks.join(found.withColumnRenamed("g", "_g"), "_g")
    return met.groupBy("_g").applyInArrow(finished, T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())]))


def packed(rows: DataFrame, key: str, order: list[str], size: str, limit: int, block: int | None = None) -> DataFrame:
    """(key, order, size) with the number of its batch: filled in order up to ``limit``, a batch's first row always admitted.

    Equal rows of the order come by size; a null or negative size counts 0. A null key is a key like others.
    """
    kept = rows.select(key, *order, F.col(size).cast("long").alias(size)).withColumn("_n", F.coalesce(F.col(size), F.lit(0)))
    return _packed(kept, key, [*order, size], limit, "_n", block=block).drop("_n")


def packed_with_overlap(rows: DataFrame, limit: int = 2000, block: int | None = None) -> DataFrame:
    """Batches of line ranges (project_id, id, file_id, start_line, end_line) of ``limit`` lines within a project; lines that a
    range shares with those before it in its file aren't counted again, unless it begins a batch. Lines count from 1."""
    lines = rows.select(*[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) if c.endswith("line") else F.col(c).cast("long").alias(c) for c in ("project_id", "id", "file_id", "start_line", "end_line")])
    sized = lines.withColumn("_n", F.col("end_line") - F.col("start_line") + 1)
    return _packed(sized, "project_id", ["file_id", "start_line", "end_line", "id"], limit, "_n", ("file_id", "start_line", "end_line"), block).drop("_n")
