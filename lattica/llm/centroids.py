"""Centroid clustering of integer vectors with Hamerly's bounds.

Every vector keeps one upper bound (distance to its own centroid) and one lower bound (distance to the second nearest) in a
written table. When centroids move, the bounds are loosened by the drift; while the upper one stays below the lower one, or
below half the way from the own centroid to the next, the vector can't change its cluster and nothing is computed for it.
Of the others the upper bound is made exact, and those still open get a full scan in exact integers. Bounds are doubles
with directed slack, so rounding only ever opens a vector, and a tie always leads to a scan.

Vectors stay where they are: a round is a pass of Arrow batches and a sum of one row for each cluster and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import quoted, tuned
from lattica.llm.vectors import listed, matrix, replaced

#: Entries of a vector, units of an entry, centroids, and rounds before the last assignment.
WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3

#: Integers up to this size keep the squared distance of 64 entries within a long: 64 * (2 * 2**27)**2 < 2**63.
MOST = 1 << 27

#: Relative slack of the bounds, far above the error of their few double operations.
SLACK = 1e-12

_STATE = "vec_id bigint, x array<int>, cluster int, upper double, lower double, scanned boolean"


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """State of the vectors with ``width`` finite entries: each entry as floor(scale * entry), and no cluster yet.

    A vector with an integer beyond MOST is left out as well, as its distances wouldn't fit a long.
    """
    tuned(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = matrix(b.column(1), width)
            x = np.floor(scale * x)
            small = (np.abs(x) <= MOST).all(axis=1)
            rows, x = rows[small], x[small]
            n = len(rows)
            if n:
                columns = [b.column(0).take(pa.array(rows)), listed(x.astype(np.int32), pa.int32()), pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, np.inf)), pa.array(np.full(n, -np.inf)), pa.array(np.zeros(n, bool))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "upper", "lower", "scanned"])

    return df.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).alias("v")).mapInArrow(run, _STATE)


def first_centroids(state: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in their order: (k, width) integers. Equal ids come by their
    vectors, null ids last. Of fewer vectors each is a centroid."""
    rows = state.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def settle(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Bring cluster and bounds (changed in place) up to centroids that drifted so far; tells which vectors were scanned."""
    k = len(centroids)
    gaps = np.sqrt(distances(centroids, centroids).astype(float))
    np.fill_diagonal(gaps, np.inf)
    half = gaps.min(axis=1) / 2 * (1 - SLACK)
    order = np.argsort(-drift, kind="stable")
    top, second = order[0], drift[order[1]] if k > 1 else 0.0
    at = np.maximum(cluster, 0)
    upper += np.where(cluster >= 0, drift[at], 0.0)
    upper *= 1 + SLACK
    away = np.where(at == top, second, drift[top])
    lower -= away + SLACK * (away + np.abs(np.where(np.isfinite(lower), lower, 0.0)))
    bound = np.maximum(lower, np.where(cluster >= 0, half[at], -np.inf))
    open_ = np.flatnonzero(~(upper < bound))
    known = open_[cluster[open_] >= 0]
    upper[known] = np.sqrt(((x[known] - centroids[cluster[known]]) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
    open_ = open_[~(upper[open_] < bound[open_])]
    far = distances(x[open_], centroids)
    best = far.argmin(axis=1)  # the first of equal ones
    here = np.arange(len(open_))
    cluster[open_], upper[open_] = best, np.sqrt(far[here, best].astype(float)) * (1 + SLACK)
    if k > 1:
        rest = far.copy()
        rest[here, best] = np.iinfo(np.int64).max
        lower[open_] = np.sqrt(rest.min(axis=1).astype(float)) * (1 - SLACK)
    else:
        lower[open_] = np.inf
    scanned = np.zeros(len(x), bool)
    scanned[open_] = True
    return scanned


def assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, last: bool = False) -> DataFrame:
    """The state with every vector at its nearest centroid; with ``last`` its exact squared distance, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, values = matrix(b.column("x"), centroids.shape[1])
            x = values.astype(np.int64)
            cluster, upper, lower = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
            scanned = settle(x, cluster, upper, lower, centroids, drift)
            columns = [b.column("vec_id"), b.column("x"), pa.array(cluster), pa.array(upper), pa.array(lower), pa.array(scanned)]
            if last:
                columns.append(pa.array(((x - centroids[cluster]) ** 2).sum(axis=1)))
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "upper", "lower", "scanned", "distance"][: len(columns)])

    return state.mapInArrow(run, _STATE + ", distance bigint" * last)


def sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of each cluster, exact: a row for each cluster and dimension of a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            if b.num_rows:
                x, cluster = matrix(b.column("x"), width)[1].astype(np.int64), b.column("cluster").to_numpy()
                counts += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(axis=0)
        used = np.flatnonzero(counts)
        names = ["cluster", "dim", "n", "s"]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array(np.repeat(counts[used], width)), pa.array(total[used].ravel())], names=names)

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, dim int, n bigint, s bigint")
    n, s = np.zeros(k, object), np.zeros((k, width), object)
    for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        n[r["cluster"]], s[r["cluster"], r["dim"]] = r["n"], int(r["s"])
    return n, s


def centroid_clusters(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS
) -> DataFrame:
    """(vec_id, x, cluster, upper, lower, scanned, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector.

    Kept are vectors with exactly ``width`` entries, none null, non-finite or beyond MOST after scaling; repeated rows and
    repeated or null ids are rows like others, other columns don't matter. Without any kept vector the result is empty. A
    sum of distances beyond a long is null. Broadcast: the centroids, k * width numbers, and one row for each cluster.
    The start rows (k of them) and the sums (k * width) are all that reaches the driver. Each round's table replaces the one before.
    """
    spark = df.sparkSession
    state, path = replaced(integers(df, id_col, vector_col, width, scale), "vectors")
    at = first_centroids(state, k)
    if not len(at):
        none = assigned(state, np.zeros((1, width), np.int64), np.zeros(1), last=True)
        return none.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    drift = np.zeros(len(at))
    for _ in range(rounds):
        state, path = replaced(assigned(state, at, drift), "vectors", path)
        n, s = sums(state, len(at), width)
        moved = np.array([[int(v) // int(m) for v in row] if m else c.tolist() for c, m, row in zip(at, n, s, strict=True)], np.int64)
        drift = np.sqrt(((moved - at) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        at = moved
    state, _ = replaced(assigned(state, at, drift, last=True), "vectors", path)
    far = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    as_long = lambda v: v if v < 1 << 63 else None
    rows = [(c, as_long(far[c]), as_long(sum(far.values())), hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()) for c in far]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(told), "cluster").select(*state.columns, "cluster_inertia", "inertia", "centroid_sha256")
