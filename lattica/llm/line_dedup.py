"""Line deduplication by overlapping three-line windows. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, pairs_of, quoted

WINDOW = 3
SPACE = " \t\n\x0b\x0c\r"


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, starts): starts of the windows of ``docs`` (_id, _text) that occur earlier, by (_id, start).

    A window is ``window`` consecutive \\n-split lines, at least one with a word; its key is two
    64-bit hashes. First places come from a group-by that sums up before it shuffles, so a window
    in a third of all rows is one row a task; the join back may be split where a key is hot.
    """
    lines = docs.filter("_id IS NOT NULL AND _text IS NOT NULL").select("_id", F.split("_text", "\n", -1).alias("_l"))
    of = ", ".join(f"get(_l, i + {k})" for k in range(window))
    windows = lines.filter(F.size("_l") >= window).select(
        "_id",
        F.posexplode(
            F.expr(
                f"transform(sequence(0, size(_l) - {window}), i -> CASE WHEN length(translate(concat({of}), '{SPACE}', '')) > 0 "
                f"THEN named_struct('a', xxhash64({of}), 'b', xxhash64('b', {of})) END)"
            )
        ).alias("_pos", "_w"),
    )
    # written once: both the first places and the later ones are read from it
    windows = cut(windows.filter("_w IS NOT NULL").select("_id", "_pos", F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b")), "windows")
    first = windows.groupBy("_a", "_b").agg(F.min(F.struct("_id", "_pos")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = windows.join(first, ["_a", "_b"]).filter(F.struct("_id", "_pos") > F.col("_first"))
    return later.groupBy("_id").agg(F.collect_set("_pos").alias("_starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: tuple[str, str] | None = ("_n_lines", "_n_removed")) -> DataFrame:
    """All columns of ``docs`` with the text's repeated lines removed, and two columns ``counts`` (None: without them).

    Every place of a window but the first, by (id, start), is later; the lines that later places
    cover are removed, overlaps merged. Windows are judged on the input. A null text stays null
    with 0 lines; a row with a null id is left as it is and gives no windows; texts of under
    three lines are left as they are; rows with the same id count as one document, each is
    returned with the lines at the covered positions removed; equal places don't tie, as (id, start) tells
    them apart. Other columns may have any name but those of ``counts``. An empty table gives an empty table.
    """
    # the other columns travel in a struct, so no name can clash
    names = [f"c{i}" for i in range(len(docs.columns))]
    rest = F.struct(*[F.col(quoted(c)).alias(n) for c, n in zip(docs.columns, names, strict=True) if c != text_col], F.lit(0).alias("none"))
    keyed = docs.select(rest.alias("_rest"), F.col(quoted(id_col)).cast("long").alias("_id"), F.col(quoted(text_col)).cast("string").alias("_text"))
    marks = repeated_windows(pairs_of(docs, id_col, text_col), window)
    met = keyed.join(marks, "_id", "left").withColumn("_l", F.split("_text", "\n", -1))
    kept = met.withColumn(
        "_keep",
        F.expr(f"CASE WHEN _starts IS NOT NULL THEN array_except(sequence(0, size(_l) - 1), flatten(transform(_starts, p -> sequence(p, p + {window - 1})))) END"),
    )
    text = F.expr("CASE WHEN _keep IS NULL THEN _text ELSE array_join(transform(_keep, i -> get(_l, i)), '\n') END")
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_l")).cast("long")
    n_kept = F.when(F.col("_keep").isNull(), n_lines).otherwise(F.size("_keep")).cast("long")
    columns = [text.alias(c) if c == text_col else F.col("_rest")[n].alias(c) for c, n in zip(docs.columns, names, strict=True)]
    return kept.select(*columns, *([n_lines.alias(counts[0]), (n_lines - n_kept).alias(counts[1])] if counts else []))
