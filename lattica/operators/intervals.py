"""Joins of line ranges and lines without comparing all of a file's with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bin of the overlap join, and of a stretch of the running sums.
BIN, STRETCH = 64, 1024

#: Levels of the halved number line: lines are integers from 0 below 2 ** LEVELS.
LEVELS = 32


def cover(start: Column, end: Column) -> Column:
    """Array of (level, node): the fewest aligned ranges of 2 ** level lines that make up start .. end. Empty if end < start."""
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    level = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    node = lambda k, x: F.struct(k.cast("int").alias("level"), x.alias("node"))

    def step(s: Column, k: Column) -> Column:
        low, high = s["low"], s["high"]
        here = low <= high
        left, right = here & (low % 2 == 1), here & (high % 2 == 0)
        at_left = F.when(left, F.array(node(k, low))).otherwise(none)
        at_right = F.when(right & ~(left & (low == high)), F.array(node(k, high))).otherwise(none)
        more = F.concat(s["found"], at_left, at_right)
        low, high = F.when(left, low + 1).otherwise(low), F.when(right, high - 1).otherwise(high)
        on = low <= high  # a bound below 0 would be halved to 0
        return F.struct(more.alias("found"), F.when(on, F.shiftright(low, 1)).otherwise(F.lit(1).cast("bigint")).alias("low"), F.when(on, F.shiftright(high, 1)).otherwise(F.lit(0).cast("bigint")).alias("high"))

    first = F.struct(none.alias("found"), start.cast("bigint").alias("low"), end.cast("bigint").alias("high"))
    return F.aggregate(level, first, step, lambda s: s["found"])


def lines_outside(lines: DataFrame, ranges: DataFrame, key: str = "file_id") -> DataFrame:
    """Lines (key, line) that no range (key, start_line, end_line) holds.

    A range is cut into its cover of at most 2 * LEVELS aligned ranges, a line lies in one aligned range of each level, so both
    meet by equality of (key, level, node), whatever a key holds. Lines or bounds that are null lie outside.
    """
    nodes = ranges.select(key, F.explode(cover(F.when(F.col("start_line") < 0, 0).otherwise(F.col("start_line")), F.col("end_line"))).alias("_c")).select(key, "_c.level", "_c.node").distinct()
    at = lines.select(key, "line").distinct().select(key, "line", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.call_function("shiftright", F.col("line").cast("bigint"), k))).alias("level", "node"))
    held = at.join(nodes, [key, "level", "node"], "left_semi").select(key, "line").distinct()
    return lines.join(held, [key, "line"], "left_anti")


def overlapping(left: DataFrame, right: DataFrame, key: str = "file_id", width: int = BIN) -> DataFrame:
    """Pairs of left (key, start_line, end_line, …) and right (key, r_start, r_end, …) ranges of a key that share a line.

    Ranges are cut into bins of ``width`` lines and met by (key, bin); a pair is told in the bin of its first common line alone.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    l_ = left.filter("start_line <= end_line").withColumn("_bin", bins("start_line", "end_line"))
    r_ = right.filter("r_start <= r_end").withColumn("_bin", bins("r_start", "r_end"))
    met = l_.join(r_, [key, "_bin"]).filter("start_line <= r_end AND r_start <= end_line")
    return met.filter(F.col("_bin") == F.floor(F.greatest("start_line", "r_start") / width)).drop("_bin")


def shift_ranges(ranges: DataFrame, changes: DataFrame) -> DataFrame:
    """Ranges (file_id, id, start_line, end_line) moved by changes (file_id, line, kind): starts by the lines added less removed
    before them, ends by those up to them. Running sums of the sorted union of bounds and changes, in stretches of STRETCH lines
    above running sums of whole stretches."""
    by = F.when(F.col("kind").isin("added", "insert"), 1).when(F.col("kind").isin("removed", "delete"), -1).otherwise(0).cast("bigint")
    key = ["file_id", "id", "start_line", "end_line"]
    moves = changes.select("file_id", F.col("line").cast("bigint").alias("at"), F.lit(1).alias("o"), by.alias("by"))
    bound = lambda c, o: ranges.select(*key, F.col(c).cast("bigint").alias("at"), F.lit(o).alias("o"), F.lit(c).alias("bound"))
    bounds = bound("start_line", 0).unionAll(bound("end_line", 2)).distinct()
    events = bounds.unionByName(moves, allowMissingColumns=True).withColumn("_s", F.floor(F.col("at") / STRETCH))
    whole = events.groupBy("file_id", "_s").agg(F.sum("by").alias("_sum")).withColumn("_before", F.sum("_sum").over(Window.partitionBy("file_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))
    here = F.sum("by").over(Window.partitionBy("file_id", "_s").orderBy("at", "o"))
    summed = events.withColumn("_here", here).filter("bound IS NOT NULL").join(whole.select("file_id", "_s", "_before"), ["file_id", "_s"])
    moved = lambda c: F.col(c) + F.max(F.when(F.col("bound") == c, F.coalesce("_here", F.lit(0)) + F.coalesce("_before", F.lit(0))))
    return summed.groupBy(*key).agg(moved("start_line").alias("new_start"), moved("end_line").alias("new_end"))
