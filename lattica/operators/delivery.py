"""Paging of results: pages are columns; a reader's place is a row of a cursor table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import lines
from lattica.operators.graph import saved
from lattica.operators.packing import packed


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with _rank (from 1) and _total over the whole table: ranges of the order are counted, then ranked apart.

    Only one row for each partition is broadcast. The dealt rows are at a checkpoint, so a lost task finds the same ranges.
    """
    dealt = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_rank", here).join(F.broadcast(places), "_part").withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before")


def by_count(rows: DataFrame, size: int, *order: Column | str, within: list[str] | None = None) -> DataFrame:
    """Rows with page (from 0) and pages, ``size`` rows on each; of the whole table, or within keys."""
    if within:
        keys = Window.partitionBy(*within)
        placed = rows.withColumn("_rank", F.row_number().over(keys.orderBy(*order))).withColumn("_total", F.count("*").over(keys))
    else:
        placed = ranked(rows, *order)
    paged = placed.withColumn("page", F.floor((F.col("_rank") - 1) / size).cast("long")).withColumn("pages", F.ceil(F.col("_total") / size).cast("long"))
    return paged.drop("_rank", "_total")


def by_lines(rows: DataFrame, key: str, order: list[str], content: str, limit: int = 500) -> DataFrame:
    """Rows of a key in batches of ``limit`` lines of content; the first of a batch is always admitted."""
    return packed(rows.withColumn("_lines", F.size(lines(content))), key, order, "_lines", limit).withColumnRenamed("_lines", "n_lines")


def page(rows: DataFrame, n: int) -> DataFrame:
    return rows.filter(F.col("page") == n)


def status(rows: DataFrame, key: str, delivered: int) -> DataFrame:
    """(key, total, delivered, remaining, percent, complete) after ``delivered`` pages."""
    g = rows.groupBy(key).agg((F.max("page") + 1).alias("total"))
    done = F.least(F.lit(delivered), "total")
    return g.select(key, "total", done.alias("delivered"), (F.col("total") - done).alias("remaining"), F.round(100 * done / F.col("total"), 1).alias("percent"), (done >= F.col("total")).alias("complete"))


def register(cursors: DataFrame, requests: DataFrame) -> DataFrame:
    """Cursors (session, signature, position, total, complete) after requests (session, signature, total), one for a session.

    A new signature, or more pages than before, starts at page 0; so does a complete delivery that is asked for again.
    Any other cursor keeps its place. Sessions without a request, or with a null one, stay as they are.
    """
    r = requests.select("session", F.col("signature").alias("_s"), F.col("total").cast("long").alias("_n"))
    met = cursors.select("session", "signature", F.col("position").cast("long").alias("position"), F.col("total").cast("long").alias("total"), "complete").join(r, "session", "full")
    asked = F.col("_s").isNotNull()
    same = F.coalesce(F.col("signature") == F.col("_s"), F.lit(False))
    again = same & F.col("complete")
    afresh = asked & (~same | F.col("complete") | (F.col("total") < F.col("_n")))
    out = met.select(
        "session", F.when(asked, F.col("_s")).otherwise(F.col("signature")).alias("signature"),
        F.when(afresh, F.lit(0).cast("long")).otherwise(F.col("position")).alias("position"),
        F.when(afresh & ~again, F.col("_n")).otherwise(F.col("total")).alias("total"),
        F.when(afresh, F.lit(False)).otherwise(F.col("complete")).alias("complete"),
    )
    return out.filter("signature IS NOT NULL")


def advance(cursors: DataFrame) -> DataFrame:
    """Cursors one page on, with the page (from 0) that is delivered now; null when nothing is left."""
    left = ~F.col("complete") & (F.col("position") < F.col("total"))
    after = F.col("position") + 1
    return cursors.select(
        "session", "signature", F.when(left, F.col("position")).alias("page"), F.when(left, after).otherwise(F.col("position")).alias("position"), "total",
        F.when(left, after >= F.col("total")).otherwise(F.col("complete")).alias("complete"),
    )


def clear(cursors: DataFrame, sessions: DataFrame) -> DataFrame:
    """Cursors without those of the sessions named."""
    return cursors.join(sessions.select("session"), "session", "left_anti")
