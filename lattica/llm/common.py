"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: they bound the Python memory when texts are long.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20

#: Words kept in a worker's memo before it starts anew.
MEMO_WORDS = 500_000

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that go to Python workers: a default of the session, the same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, the folder all executors see.

    The setting is read from the session. Where it is unset, a local session (tests) gets one; a
    cluster must name its own, as its machines share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as SQL has it, whatever dots and quotes are in it."""
    return "`" + name.replace("`", "``") + "`"


def pairs_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names no other column can clash with."""
    return df.select(F.col(quoted(id_col)).cast("long").alias("_id"), F.col(quoted(text_col)).cast("string").alias("_text"))


def give_back() -> None:
    """Return free memory of this process to the system: after work on the driver that needed much of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run ``fn`` on each Arrow batch. Batches of no rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    tuned(df.sparkSession)
    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """Memo from a word's bytes to a 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() knows exactly that white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Polynomial hashes of all windows of some length, from prefix sums modulo 2**64. ``base`` is odd."""

    def __init__(self, base: int = _BASE) -> None:
        self._n, self._base = 0, base
        self._grow(4096)

    def _grow(self, n: int) -> None:
        self._n = n
        self.up = np.cumprod(np.full(n, self._base, np.uint64))
        self.down = np.cumprod(np.full(n, pow(self._base, -1, 1 << 64), np.uint64))

    def windows(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """One hash for each start 0 .. n - length; empty if the text is shorter."""
        n = len(hashes)
        if n < length:
            return np.empty(0, np.uint64)
        if n > self._n:
            self._grow(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=sums[1:])
        return _mix((sums[length:] - sums[: n - length + 1]) * self.down[: n - length + 1])


#: Rows from which a key counts as heavy, and heavy keys at most: each has more than 1 / HEAVY_KEYS of all rows.
HEAVY_ROWS, HEAVY_KEYS = 64, 10_000


def heavy_join(rows: DataFrame, small: DataFrame, on: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``small`` (one row a key), whose column ``weight`` counts the key's ``rows`` out of ``total``.

    Keys with more than a ten-thousandth of all rows are fewer than HEAVY_KEYS, whatever the input, so they
    are broadcast; the rest is shuffled, and none of its keys is large. ``how``: inner or left.
    """
    limit = max(HEAVY_ROWS, total // HEAVY_KEYS)
    heavy = small.filter(F.col(weight) > limit)
    light = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(small.filter(F.col(weight) <= limit), on, how)
    return rows.join(F.broadcast(heavy), on).unionByName(light)


def connected_components(edges: DataFrame, name: str, rounds: int = 30) -> DataFrame:
    """(node, root): the smallest node of each component, for edges (a, b) of any type with an order.

    Alternating large-star and small-star steps; each step is a group-by and a join on the node
    (hubs with many edges are broadcast) and ends in a written table. Nothing but counters reaches the driver.
    """

    def star(e: DataFrame, n: int, small: bool) -> DataFrame:
        if small:
            side = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            side = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(side.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree"), name)
        met = heavy_join(side, least, "u", "degree", 2 * n)
        if small:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    size, state = now.count(), None
    for _ in range(rounds):
        if not size:
            break
        now = cut(star(cut(star(now, size, small=False), name), size, small=True), name)
        size, mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (size, mark) == state:
            break
        state = size, mark
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
