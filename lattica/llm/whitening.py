"""Whitening of embeddings from an exact covariance.

Entries become integers x. With n vectors and sums S, y = n * x - S is the exactly centred vector times n. Its Gram matrix
is made by a digit-slice GEMM: y is split into limbs of 20 bits, so that a product of two limb matrices of up to 4,096 rows
stays below 2**53 and float64 BLAS is exact; the products are recombined as big integers in the task, merged over tasks by
Spark, and divided once by n**3. Only then doubles begin: eigenvectors of a width x width matrix on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, quoted, tuned
from lattica.llm.vectors import matrix

#: Units of an entry, what is added, and components given.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8

#: Bits of a limb and rows of a block: LIMB + LIMB + log2(BLOCK) <= 53, and PASSES blocks add up within a long.
LIMB, BLOCK, PASSES = 20, 4096, 512

#: Big integers travel as two parts, the lower one of so many bits.
PART = 60

#: Integers up to this size; a vector with a larger entry counts as non-finite.
MOST = 1 << 52


def _integers(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x) of the vectors that take part."""
    rows, v = matrix(column, width)
    x = np.floor(SCALE * v)
    small = (np.abs(x) <= MOST).all(axis=1)
    return rows[small], x[small].astype(np.int64) + SHIFT


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    tuned(df.sparkSession)
    return df.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).alias("v"))


@dataclass(frozen=True)
class Whitening:
    """n vectors of a width, their sums, the components' directions over the roots of their eigenvalues (width x components,
    NaN where the eigenvalue is none), shares of the variance and the largest error of the whitened covariance."""

    n: int
    sums: tuple[int, ...]
    most: int
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    @property
    def width(self) -> int:
        return len(self.sums)


def sums(df: DataFrame, id_col: str, vector_col: str) -> tuple[int, list[int], int]:
    """(n, sums by dimension, largest x in size) of the vectors of the commonest width (the smaller of equally common ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            column = b.column(1)
            for width in np.unique(np.diff(column.offsets.to_numpy())).tolist():
                x = _integers(column, width)[1] if width else ()
                if len(x):
                    n, total, most = held.get(width, (0, 0, 0))
                    held[width] = [n + len(x), total + x.sum(axis=0).astype(object), max(most, int(np.abs(x).max()))]
        rows = [(w, d, n, Decimal(int(s)), most) for w, (n, total, most) in held.items() for d, s in enumerate(total)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["width", "dim", "n", "s", "most"])

    parts = _vectors(df, id_col, vector_col).mapInArrow(run, "width int, dim int, n bigint, s decimal(38,0), most bigint")
    by = cut(parts.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")), "sums")
    top = by.orderBy(F.desc("n"), "width").first()
    if top is None:
        return 0, [], 0
    return top["n"], [int(r["s"]) for r in by.filter(F.col("width") == top["width"]).orderBy("dim").collect()], top["most"]


def centred(x: np.ndarray, n: int, total: np.ndarray, most: int) -> np.ndarray:
    """n * x - S, in longs if they hold it, else in big integers."""
    if 2 * n * most < 1 << 62:
        return n * x - total.astype(np.int64)
    return n * x.astype(object) - total


def limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """y = sum of limb[a] << (LIMB * a): the lower ones within 0 .. 2**LIMB - 1, the highest with the sign."""
    low = (1 << LIMB) - 1
    return [((y >> LIMB * a) & low if a + 1 < count else y >> LIMB * a).astype(np.float64) for a in range(count)]


def gram(blocks: Iterator[np.ndarray], width: int, count: int) -> np.ndarray:
    """Exact sum of y'y over blocks of integer rows, as a matrix of big integers."""
    whole = np.zeros((width, width), object)
    held = {(a, b): np.zeros((width, width), np.int64) for a in range(count) for b in range(a, count)}
    passes = 0

    def recombined() -> None:
        nonlocal whole
        for (a, b), m in held.items():
            big = m.astype(object)
            whole = whole + ((big if a == b else big + big.T) << LIMB * (a + b))
            m[:] = 0

    for y in blocks:
        for i in range(0, len(y), BLOCK):
            parts = limbs(y[i : i + BLOCK], count)
            for a, b in held:
                held[a, b] += (parts[a].T @ parts[b]).astype(np.int64)
            passes += 1
            if passes % PASSES == 0:
                recombined()
    recombined()
    return whole


def covariance(df: DataFrame, id_col: str, vector_col: str, n: int, total: list[int], most: int) -> np.ndarray:
    """The covariance matrix in doubles, each entry rounded once from its exact value."""
    width, s = len(total), np.array(total, object)
    count = max(1, math.ceil((2 * n * most).bit_length() / LIMB))
    upper = [(i, j) for i in range(width) for j in range(i, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = gram((centred(x, n, s, most) for b in batches if len(x := _integers(b.column(1), width)[1])), width, count)
        entries = [int(g[i, j]) for i, j in upper]
        high, low = ([Decimal(v >> PART) for v in entries], [Decimal(v & (1 << PART) - 1) for v in entries])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(upper)), pa.int64()), pa.array(high, pa.decimal128(38, 0)), pa.array(low, pa.decimal128(38, 0))], names=["k", "high", "low"])

    parts = _vectors(df, id_col, vector_col).mapInArrow(run, "k bigint, high decimal(38,0), low decimal(38,0)")
    v = np.zeros((width, width))
    for r in parts.groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        i, j = upper[r["k"]]
        v[i, j] = v[j, i] = ((int(r["high"]) << PART) + int(r["low"])) / n**3
    return v


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of the commonest width whose entries are finite and within MOST; None without any.

    Components are numbered by falling eigenvalue; of each direction the entry largest in size is positive. An eigenvalue
    within rounding of zero has no whitening. The driver holds width * width numbers.
    """
    n, total, most = sums(df, id_col, vector_col)
    if not n:
        return None
    v = covariance(df, id_col, vector_col, n, total, most)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = math.fsum(np.diag(v))
    real = values > max(trace, 0.0) * len(v) * np.finfo(float).eps
    directions = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), np.nan)
    w = directions[:, real]
    error = float(np.abs(w.T @ v @ w - np.eye(w.shape[1])).max()) if real.any() else None
    return Whitening(n, tuple(total), most, directions, np.where(real, values, 0.0) / trace if trace > 0 else np.zeros(len(values)), error)


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null, of another width than the model's, or hold null, non-finite or too large entries give no rows;
    repeated rows and repeated or null ids count as they stand, other columns don't matter. A deviation beyond a
    long is null, and so is whitened where the component has no variance. Without a model the result is empty.
    """
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    s, c = np.array(model.sums, object), len(model.explained)
    exact = model.width * (2 * model.n * model.most) ** 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _integers(b.column(1), model.width)
            if not len(rows):
                continue
            y = centred(x, model.n, s, model.most)
            if exact:
                deviation = pa.array((y * y).sum(axis=1).repeat(c), pa.int64())
            else:
                big = (y.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([v if v < 1 << 63 else None for v in big for _ in range(c)], pa.int64())
            out = ((y / model.n).astype(np.float64) @ model.directions).ravel()
            columns = [
                b.column(0).take(pa.array(rows.repeat(c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(out), model.n)), deviation,
                pa.array(out, mask=np.isnan(out)), pa.array(np.tile(model.explained, len(rows))), pa.array([model.identity_error] * len(out), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return _vectors(df, id_col, vector_col).mapInArrow(run, schema)


def whitening(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``whiten`` by a model fitted on the same vectors."""
    return whiten(df, fit(df, id_col, vector_col, components), id_col, vector_col)
