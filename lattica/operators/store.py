"""Writes as plans over immutable tables: keep-first, keep-last, cascades and updates; and the Parquet store itself."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.plans.schemas import SCHEMAS


def keep_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Insert-or-replace: of equal keys the last by ``order``."""
    by = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")


def keep_first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Insert-or-ignore: of equal keys the first by ``order``."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with the same keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose keys are new come in."""
    return table.unionByName(rows.join(table.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def update(table: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set columns where ``rows`` has a value."""
    new = rows.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    met = table.join(new, key, "left")
    return met.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


_FLAT = "file_id long, ordinal int, source_id long, type string, name string, content string, start_line int, end_line int, start_col int, end_col int, parent_ordinal int"


def flattened(blocks: list[dict]) -> Iterator[dict]:
    """Blocks in pre-order with ordinals from 1 and their parents' ordinals; children may nest to any depth."""
    stack: list[tuple[dict, int | None]] = [(b, None) for b in reversed(blocks)]
    for ordinal in itertools.count(1):
        if not stack:
            return
        block, parent = stack.pop()
        yield {**block, "ordinal": ordinal, "parent_ordinal": parent}
        stack += [(c, ordinal) for c in reversed(block.get("children") or [])]


def with_block_ids(blocks: DataFrame) -> DataFrame:
    """``id`` and ``parent_block_id`` of blocks known by (file_id, ordinal): 63-bit hashes, the same on every machine and run."""
    key = lambda ordinal: F.xxhash64("file_id", F.col(ordinal).cast("long")).bitwiseAND(F.lit((1 << 63) - 1))
    return blocks.withColumn("id", key("ordinal")).withColumn("parent_block_id", F.when(F.col("parent_ordinal").isNotNull(), key("parent_ordinal")))


def flatten_blocks(extraction: DataFrame) -> DataFrame:
    """Blocks of (file_id, blocks: JSON list with nested ``children``) as rows with ``id`` and ``parent_block_id``.

    Ids are made from file and place, as ids in an extraction repeat from one project to the next; those are kept as ``source_id``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FLAT.split(", ")]
        for batch in batches:
            rows = [{**b, "file_id": i, "source_id": b.get("id")} for i, text in zip(batch["file_id"], batch["blocks"], strict=True) for b in flattened(json.loads(text) if text else [])]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("source_id", "start_line", "end_line", "start_col", "end_col", "parent_ordinal")})

    return with_block_ids(extraction.select("file_id", "blocks").mapInPandas(run, _FLAT))


def delete_project(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """All tables without a project: files, blocks, edges, connections, mappings, checkpoints and vectors go with it."""
    out = dict(tables)
    gone = tables["projects"].filter(F.col("name") == name).select(F.col("id").alias("project_id"))
    files = tables["files"].join(gone, "project_id", "left_semi").select(F.col("id").alias("file_id"))
    out["projects"] = tables["projects"].filter(~F.col("name").eqNullSafe(name))
    out["files"] = tables["files"].join(gone, "project_id", "left_anti")
    for t in ("code_blocks", "incoming_connections", "outgoing_connections"):
        if t in tables:
            out[t] = tables[t].join(files, "file_id", "left_anti")
    if "relationships" in tables:
        r = tables["relationships"]
        r = r.join(files.withColumnRenamed("file_id", "source_id"), "source_id", "left_anti")
        out["relationships"] = r.join(files.withColumnRenamed("file_id", "target_id"), "target_id", "left_anti")
    if "connection_mappings" in tables:
        m = tables["connection_mappings"]
        m = m.join(out["outgoing_connections"].select(F.col("id").alias("sender_id")), "sender_id", "left_semi")
        out["connection_mappings"] = m.join(out["incoming_connections"].select(F.col("id").alias("receiver_id")), "receiver_id", "left_semi")
    for t in ("checkpoints", "embeddings", "vectors"):
        if t in tables:
            out[t] = tables[t].join(gone, "project_id", "left_anti")
    return out


def delete_files(tables: dict[str, DataFrame], file_ids: DataFrame) -> dict[str, DataFrame]:
    """Files, their blocks, edges and vectors go; connections stay, to be restored or dropped later."""
    ids = file_ids.select("file_id").distinct()
    out = dict(tables)
    out["files"] = tables["files"].join(ids.withColumnRenamed("file_id", "id"), "id", "left_anti")
    lost = tables["code_blocks"].join(ids, "file_id", "left_semi").select(F.concat(F.lit("block_"), F.col("id").cast("string")).alias("node_id"))
    out["code_blocks"] = tables["code_blocks"].join(ids, "file_id", "left_anti")
    r = tables["relationships"].join(ids.withColumnRenamed("file_id", "source_id"), "source_id", "left_anti")
    out["relationships"] = r.join(ids.withColumnRenamed("file_id", "target_id"), "target_id", "left_anti")
    if "vectors" in tables:
        nodes = lost.unionAll(ids.select(F.concat(F.lit("file_"), F.col("file_id").cast("string")).alias("node_id")))
        out["vectors"] = tables["vectors"].join(nodes, "node_id", "left_anti")
    return out


def restore_connections(kept: DataFrame, files: DataFrame) -> DataFrame:
    """Kept connections whose file still is there."""
    return kept.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def delete_connections(table: DataFrame, doomed: DataFrame, direction: str) -> DataFrame:
    return table.join(doomed.filter(F.col("direction") == direction).select("id"), "id", "left_anti")


def connections_from_result(result: DataFrame, direction: str) -> DataFrame:
    """Rows of a nested result map<technology, map<file, list of (snippet_lines, description)>>."""
    from lattica.functions.text import snippet_lines

    by_tech = result.select(F.explode(f"{direction}_connections").alias("technology_name", "m"))
    by_file = by_tech.select("technology_name", F.explode("m").alias("file_path", "d")).select("technology_name", "file_path", F.explode("d").alias("x"))
    lines = snippet_lines("x.snippet_lines")
    return by_file.select("technology_name", "file_path", F.col("x.description").alias("description"), F.array_min(lines).alias("start_line"), F.array_max(lines).alias("end_line"))


def technologies_of(result: DataFrame, column: str) -> DataFrame:
    """(technology): distinct keys of a column of nested maps technology -> file -> details."""
    return result.select(F.explode(F.map_keys(column)).alias("technology")).distinct()


def checked_vectors(rows: DataFrame, size: int) -> DataFrame:
    """Rows whose vectors have ``size`` elements; the job fails on any other, so a write is all or nothing."""
    return rows.withColumn("embedding", F.when(F.assert_true(F.size("embedding") == size, F.lit(f"a vector has not {size} elements")).isNull(), F.col("embedding")))


class ParquetStore:
    """Tables below a folder, each a Parquet directory with versions; a version is never overwritten.

    What readers see is a manifest: a small file with the version of every table. ``commit`` writes new versions of some tables
    first and then puts the next manifest in place by one rename, which fails if another writer was faster. So several tables change
    as one or not at all, and what a failed job has written is seen by none.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> None:
        """Make the tables that are missing, empty."""
        held = self.manifest()["tables"]
        missing = {t: self.spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS if t not in held}
        if missing:
            self.commit(missing)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """{number, tables: {table: version}, batches: {stream: last batch}} of the newest commit, or of an earlier one."""
        numbers = self._numbers()
        number = number if number is not None else numbers[-1] if numbers else 0
        if not number:
            return {"number": 0, "tables": {}, "batches": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/_manifests/{number}.json").collect()))

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table as of the newest commit, or of commit ``number``."""
        version = self.manifest(number)["tables"].get(table)
        if version is None:
            raise FileNotFoundError(f"{self.path}/{table}")
        reader = self.spark.read.schema(SCHEMAS[table]) if table in SCHEMAS else self.spark.read
        return reader.parquet(f"{self.path}/{table}/{version}")

    def commit(self, tables: dict[str, DataFrame], stream: str | None = None, batch: int | None = None) -> int:
        """Write new versions of ``tables`` and show them all at once; the number of the commit.

        With ``stream`` and ``batch`` a batch that the stream has committed already changes nothing, so a repeated one is harmless.
        """
        last = self.manifest()
        if stream is not None and batch is not None and last["batches"].get(stream, -1) >= batch:
            return last["number"]
        version = f"v{last['number'] + 1}-{uuid.uuid4().hex[:12]}"
        for table, rows in tables.items():
            rows.write.parquet(f"{self.path}/{table}/{version}")
        batches = last["batches"] | ({stream: batch} if stream is not None and batch is not None else {})
        self._publish({"number": last["number"] + 1, "tables": last["tables"] | dict.fromkeys(tables, version), "batches": batches})
        return last["number"] + 1

    def _publish(self, manifest: dict) -> None:
        fs, draft = self._fs(f"{self.path}/_manifests/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        _, to = self._fs(f"{self.path}/_manifests/{manifest['number']}.json")
        if fs.exists(to) or not fs.rename(draft, to):
            fs.delete(draft, False)
            raise RuntimeError(f"commit {manifest['number']} was taken by another writer")

    def write(self, table: str, rows: DataFrame) -> None:
        self.commit({table: rows})

    def clear(self) -> None:
        """Empty tables, except the checkpoints."""
        self.commit({t: self.spark.createDataFrame([], SCHEMAS[t]) for t in SCHEMAS if t != "checkpoints"})

    def follow(self, changes: DataFrame, name: str, apply: Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]], tables: list[str], checkpoint: str) -> None:
        """Take what a stream of changes holds, a commit for each of its batches: ``apply`` makes the new tables from those of the store."""

        def one(batch: DataFrame, number: int) -> None:
            if self.manifest()["batches"].get(name, -1) < number:
                self.commit(apply({t: self.read(t) for t in tables}, batch), name, number)

        changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def json_safe(x: object) -> object:
    """Enums by value, bytes as text, paths and sets as lists, objects by their public attributes."""
    if isinstance(x, (str, int, float, bool)) or x is None:
        return x
    if hasattr(x, "value") and hasattr(x, "name"):
        return json_safe(x.value)
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    if isinstance(x, PurePath):
        return str(x)
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [json_safe(v) for v in x]
    if hasattr(x, "__dict__"):
        return {k: json_safe(v) for k, v in vars(x).items() if not k.startswith("_")}
    return str(x)


def dumps(x: object) -> str:
    return json.dumps(json_safe(x))


def stamped(rows: DataFrame, column: str, at: str | None = None) -> DataFrame:
    """Rows with a timestamp: the time given, else that of the query's start, the same in every row."""
    return rows.withColumn(column, F.current_timestamp() if at is None else F.lit(at).cast("timestamp"))
