"""Snapshot comparison, change-log compaction and incremental maintenance as batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_changes(current: DataFrame, stored: DataFrame, key: str = "file_path", digest: str = "content_hash") -> DataFrame:
    """(key, change) with change new, deleted, changed or unchanged: one full outer join. A null digest equals a null one only."""
    a = current.select(key, F.struct(F.col(digest).alias("h")).alias("_now"))
    b = stored.select(key, F.struct(F.col(digest).alias("h")).alias("_was"))
    kind = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now.h").eqNullSafe(F.col("_was.h")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("change"))


def patch(stored: DataFrame, fresh: DataFrame, changes: DataFrame, key: str = "file_path") -> DataFrame:
    """The stored rows without those of changed and deleted keys, and the fresh rows of changed and new ones."""
    gone = changes.filter("change IN ('changed', 'deleted')").select(key)
    come = changes.filter("change IN ('changed', 'new')").select(key)
    return stored.join(gone, key, "left_anti").unionByName(fresh.join(come, key, "left_semi"))


def compact(changes: DataFrame, key: str = "file_id", order: tuple[str, ...] = ("ts", "event_id"), op: str = "op", code: str = "code") -> DataFrame:
    """One entry for each key: the first old code, the last new code. One change stays as it is; more are
    'deleted' if the last is, else 'modified'. A group-by with partial sums, so a hot key is no burden."""
    at = F.struct(*order)
    g = changes.groupBy(key).agg(F.count("*").alias("_n"), F.max_by(op, at).alias("_last"), F.min_by(code, at).alias("old_code"), F.max_by(code, at).alias("new_code"))
    kind = F.when(F.col("_last") == "deleted", "deleted").when(F.col("_n") == 1, F.col("_last")).otherwise("modified")
    return g.select(key, kind.alias("change_type"), "old_code", "new_code")


def merge_checkpoint(checkpoint: DataFrame, batch: DataFrame, key: str = "file_path") -> DataFrame:
    """A stored checkpoint with a compacted batch laid over it: old code of the first, new code of the last."""
    b = batch.select(key, F.col("change_type").alias("_t"), F.col("old_code").alias("_o"), F.col("new_code").alias("_c"))
    kind = F.when(F.col("change_type").isNull(), F.col("_t")).when(F.col("_t").isNull(), F.col("change_type")).when(F.col("_t") == "deleted", "deleted").otherwise("modified")
    old = F.when(F.col("change_type").isNull(), F.col("_o")).otherwise(F.col("old_code"))
    new = F.when(F.col("_t").isNull(), F.col("new_code")).otherwise(F.col("_c"))
    return checkpoint.join(b, key, "full_outer").select(key, kind.alias("change_type"), old.alias("old_code"), new.alias("new_code"))


def by_type(checkpoint: DataFrame, project: str = "project_id") -> DataFrame:
    """Changes of each project by kind."""
    return checkpoint.groupBy(project).pivot("change_type", ["added", "modified", "deleted"]).count().na.fill(0)


def newest_first(checkpoint: DataFrame, *order: str) -> DataFrame:
    """All entries, the newest first."""
    return checkpoint.orderBy(*[F.desc(c) for c in order])


def consumed(checkpoint: DataFrame, read_ids: DataFrame) -> DataFrame:
    """A checkpoint without the entries that a reader has finished; later ones stay."""
    return checkpoint.join(read_ids.select("id"), "id", "left_anti")


def has_changes(checkpoint: DataFrame) -> bool:
    return not checkpoint.limit(1).isEmpty()


def old_content(changes: DataFrame, previous: DataFrame, key: str = "file_path") -> DataFrame:
    """Changed and deleted keys with the text they had."""
    return changes.filter("change IN ('changed', 'deleted')").join(previous.select(key, F.col("content").alias("old_code")), key, "left")


def with_islands(rows: DataFrame, *keys: str, start: str = "start_line", end: str = "end_line", gap: int = 1) -> DataFrame:
    """Rows with _island: a number for each chain of ranges of a key that lie ``gap`` lines apart at most (0: that share lines)."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_fresh", F.when(F.col(start) <= before + gap, 0).otherwise(1))
    return marked.withColumn("_island", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merged_ranges(rows: DataFrame, *keys: str, start: str = "start_line", end: str = "end_line", gap: int = 1) -> DataFrame:
    """Overlapping or adjacent ranges of a key as one: a running maximum, then islands."""
    isles = with_islands(rows, *keys, start=start, end=end, gap=gap)
    return isles.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def consecutive(rows: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    """Runs of consecutive numbers of a key, repeats counting once."""
    by = Window.partitionBy(*keys).orderBy(line)
    isles = rows.select(*keys, line).distinct().withColumn("_island", F.col(line) - F.row_number().over(by))
    return isles.groupBy(*keys, "_island").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line")).drop("_island")
