"""Working memory as tables: tasks, snippets, history and traced elements, folded from an operation log."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.text import number_lines

STATUS = ("pending", "current", "completed")
HISTORY = 30


def tasks(log: DataFrame) -> DataFrame:
    """(id, description, status) from an ordered log (seq, op, id, description, status): the last add or move of an id
    counts, unless removed after; of several current tasks the latest stays, the others wait."""
    by = Window.partitionBy("id").orderBy(F.desc("seq"))
    held = log.filter(F.col("op").isin("add", "move", "remove"))
    text = held.filter("op = 'add'").groupBy("id").agg(F.max_by("description", "seq").alias("description"))
    last = held.withColumn("k", F.row_number().over(by)).filter("k = 1 AND op <> 'remove'").select("id", "status", "seq")
    newest = last.agg(F.max(F.when(F.col("status") == "current", F.col("seq"))).alias("top"))
    one = F.when((F.col("status") == "current") & (F.col("seq") < F.col("top")), "pending").otherwise(F.col("status"))
    return last.join(F.broadcast(newest)).select("id", one.alias("status")).join(text, "id").select("id", "description", "status")


def of_status(table: DataFrame, status: str) -> DataFrame:
    return table.filter(F.col("status") == status)


def clear_completed(table: DataFrame) -> DataFrame:
    return table.filter("status <> 'completed'")


def for_phase(table: DataFrame, phase: int) -> DataFrame:
    return table.filter(F.coalesce(F.col("target_phase") == phase, F.lit(False)))


def recent_history(log: DataFrame, n: int = HISTORY) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)


def deduplicated(table: DataFrame) -> DataFrame:
    """Tasks whose normalised descriptions are equal count once, the smallest id."""
    norm = F.regexp_replace(F.lower(F.trim("description")), r"\s+", " ")
    return table.withColumn("_n", norm).groupBy("_n").agg(F.min_by(F.struct(*table.columns), "id").alias("t")).select("t.*")


def snippets_of(snippets: DataFrame, path: str) -> DataFrame:
    """Snippets of a file: equal path, else one that ends in it, else the same base name."""
    base = path.rsplit("/", 1)[-1]
    rank = F.when(F.col("file_path") == path, 0).when(F.col("file_path").endswith("/" + path.lstrip("/")), 1).when(F.element_at(F.split("file_path", "/"), -1) == base, 2)
    hit = snippets.withColumn("_r", rank).filter("_r IS NOT NULL")
    best = hit.agg(F.min("_r").alias("_b"))
    return hit.join(F.broadcast(best)).filter("_r = _b").drop("_r", "_b")


def with_code(snippets: DataFrame, files: DataFrame) -> DataFrame:
    """Snippets (id, file_path, start_line, end_line) with their numbered lines."""
    from lattica.functions.text import line_slice

    met = snippets.join(files.select("file_path", "content"), "file_path", "left")
    return met.withColumn("code", number_lines(line_slice("content", F.col("start_line"), F.col("end_line")), F.col("start_line"))).drop("content")


def summary(task_table: DataFrame, snippets: DataFrame, history: DataFrame) -> DataFrame:
    t = task_table.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUS])
    return t.join(snippets.agg(F.count("*").alias("snippets"))).join(history.agg(F.count("*").alias("history")))


def problems(task_table: DataFrame) -> DataFrame:
    """Rows against the rules: more than one current task, unknown states, empty descriptions."""
    many = task_table.filter("status = 'current'").groupBy().agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("several current tasks").alias("problem"), F.lit(None).cast("string").alias("id"))
    state = task_table.filter(~F.col("status").isin(*STATUS)).select(F.lit("unknown status").alias("problem"), F.col("id").cast("string").alias("id"))
    empty = task_table.filter(F.trim("description") == "").select(F.lit("empty description").alias("problem"), F.col("id").cast("string").alias("id"))
    return many.unionAll(state).unionAll(empty)


def upsert_elements(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """Traced elements (element_id, parent_id, name, type): equal ids, or equal name and type below one parent, are one."""
    both = tree.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    key = F.coalesce("element_id", F.concat_ws(":", "parent_id", "type", "name"))
    by = Window.partitionBy(key).orderBy(F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k", "_new")


def insert_paths(tree: DataFrame, paths: DataFrame) -> DataFrame:
    """The tree (element_id long, parent_id, name, type) with every way of ``paths`` (path_id, path: list of name and type from the root down) in it.

    Level by level the elements of a way are looked up by (parent, name, type): one that is there gives its id to those below it, one
    that isn't is made, once for all ways, with ids that go on from the largest in the order of parent, name and type. A
    level is one join; parts with a null name or type end their way.
    """
    from lattica.operators.delivery import ranked
    from lattica.operators.graph import saved

    key = ["parent_id", "name", "type"]
    at = paths.select("path", F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("d"))
    tree = tree.select("element_id", *key)
    while True:
        part = F.get("path", F.col("d"))
        at = saved(at.withColumn("name", part["name"]).withColumn("type", part["type"]).filter("name IS NOT NULL AND type IS NOT NULL"))
        if at.isEmpty():
            return tree
        same = lambda a, b: a["parent_id"].eqNullSafe(b["parent_id"]) & (a["name"] == b["name"]) & (a["type"] == b["type"])
        wanted = at.select(*key).distinct()
        missing = wanted.join(tree, same(wanted, tree), "left_anti")
        top = tree.agg(F.coalesce(F.max("element_id"), F.lit(0)).alias("_top"))
        made = ranked(missing, F.asc_nulls_first("parent_id"), "name", "type").join(F.broadcast(top)).select((F.col("_rank") + F.col("_top")).cast("long").alias("element_id"), *key)
        tree = saved(tree.unionByName(made))
        ids = tree.groupBy(*key).agg(F.min("element_id").alias("_id"))
        at = at.join(ids, same(at, ids)).select("path", F.col("_id").alias("parent_id"), (at["d"] + 1).alias("d"))


def rendered(elements: DataFrame) -> DataFrame:
    """Elements in pre-order with indented names; siblings in the order of their ids, numbers by their value."""
    from lattica.operators.graph import block_paths

    at = block_paths(elements.select(F.col("element_id").alias("id"), F.col("parent_id").alias("parent_block_id"), "name"))
    digits = lambda x: F.regexp_extract(x.cast("string"), "([0-9]*)$", 1)
    padded = lambda x: F.concat(F.regexp_replace(x.cast("string"), "[0-9]*$", ""), F.lpad(digits(x), F.lit(20), F.lit("0")))
    order: Column = F.array_join(F.transform("ids", padded), "/")
    return elements.join(at.withColumnRenamed("id", "element_id"), "element_id").select(order.alias("place"), F.concat(F.repeat(F.lit("    "), F.size("ids") - 1), "name").alias("line"))


def reassigned(table: DataFrame, *order: str, within: list[str]) -> DataFrame:
    """Tasks with ids from 1 in the given order, anew in each memory (``within``)."""
    return table.withColumn("id", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))


#: What may happen to a file in the change log.
FILE_OPS = ("added", "modified", "deleted")


def append_changes(log: DataFrame, rows: DataFrame, op: str = "op") -> DataFrame:
    """A file-change log with new rows at its end; rows with an unknown operation are left out."""
    return log.unionByName(rows.filter(F.col(op).isin(*FILE_OPS)).select(*log.columns))


def snippet_context(snippets: DataFrame, key: str, text: str = "code_snippet") -> DataFrame:
    """(key, context): snippets of a key in the order of their ids, apart by an empty line. Null texts are left out."""
    held = snippets.filter(F.col(text).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", text))).alias("s"))
    return held.select(key, F.array_join(F.col(f"s.{text}"), "\n\n").alias("context"))


def export_state(tables: dict[str, DataFrame], path: str) -> None:
    """A memory's tables as JSON lines, a folder for each, with their schemas beside them."""
    for name, table in tables.items():
        table.write.json(f"{path}/{name}")
        table.sparkSession.createDataFrame([(table.schema.json(),)], "schema string").coalesce(1).write.text(f"{path}/_{name}")


def import_state(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables that ``export_state`` wrote, with the same types."""
    schema = lambda name: T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_{name}").first()[0]))
    return {name: spark.read.schema(schema(name)).json(f"{path}/{name}") for name in names}
