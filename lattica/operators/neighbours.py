"""Exact nearest neighbours of many queries: rings around pivots, left out by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots drawn (the vectors of smallest hashes), rings a cell is cut into, greatest expected rows of a block, queries of a block.
PIVOTS, RINGS, ROWS, QUERIES = 64, 8, 8_192, 256

#: Relative slack of distances to pivots: far above the rounding of double sums.
SLACK = 1e-10


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances by differences, so equal vectors are at zero."""
    out = np.empty((len(a), len(b)))
    for k in range(0, len(a), 128):
        out[k : k + 128] = np.sqrt(((a[k : k + 128, None, :] - b[None]) ** 2).sum(2))
    return out


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, width))


def nearest_in_block(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, distances) of the k nearest rows of ``v`` for each row of ``q``, exactly; ties go to smaller ids.

    The expanded square |q|^2 - 2 q.v + |v|^2 is off by no more than (width + 4) roundings of (|q| + |v|)^2. Whatever may be
    among the k nearest within that error is measured by differences.
    """
    nq, nv = (q * q).sum(1), (v * v).sum(1)
    near = nq[:, None] + nv[None, :] - 2 * q @ v.T
    error = 4 * (q.shape[1] + 4) * np.finfo(np.float64).eps * (np.sqrt(nq)[:, None] + np.sqrt(nv)[None, :]) ** 2
    most = np.partition(near + error, k - 1, axis=1)[:, k - 1] if k < len(v) else np.full(len(q), np.inf)
    for row, low, top in zip(q, near - error, most, strict=True):
        may = np.flatnonzero(low <= top)
        exact = np.sqrt(((row - v[may]) ** 2).sum(1))
        first = np.lexsort((ids[may], exact))[:k]
        yield ids[may][first], exact[first]


class Index:
    """Vectors in blocks: each belongs to its nearest pivot and there to a ring of distances.

    ``blocks`` is a written table of (ring, salt, ids, vectors), a row a block. The driver holds pivots and one row a ring: sizes that
    don't grow with the input. The width is the commonest among the drawn vectors; vectors of another aren't held. A ring of copies is dealt into as many blocks as its cell needs, whatever its share of all rows.
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        from lattica.operators.graph import saved

        held = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL AND size(v) > 0")
        drawn = held.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()
        widths = [len(r["v"]) for r in drawn]
        self.width = width = max(sorted(widths), key=widths.count, default=0)
        drawn = [r["v"] for r in drawn if len(r["v"]) == width]
        self.pivots = pivots = np.unique(np.array(drawn, dtype=np.float64).reshape(len(drawn), width), axis=0)

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                d = _distances(_matrix(batch["v"], width), pivots)
                yield batch.assign(cell=d.argmin(1).astype(np.int32), d=d.min(1))

        at = held.filter(F.size("v") == width).mapInPandas(placed, "id long, v array<double>, cell int, d double")
        cells = at.groupBy("cell").agg(F.percentile_approx("d", [x / RINGS for x in range(1, RINGS)], 1_000).alias("cuts"), F.ceil(F.count("*") / ROWS).cast("int").alias("salts"))
        ring = F.col("cell") * RINGS + F.size(F.filter("cuts", lambda c: c < F.col("d")))
        salted = at.join(F.broadcast(cells), "cell").select(ring.alias("ring"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "id", "v", "d")
        self.blocks = saved(salted.groupBy("ring", "salt").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vectors"), F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")))
        stats = self.blocks.groupBy("ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), (F.max("salt") + 1).alias("salts")).orderBy("ring").toPandas()
        self.rings = stats.astype({"ring": np.int64, "low": float, "high": float, "n": np.int64, "salts": np.int32})

    def _wanted(self, queries: DataFrame, k: int, rest: bool) -> DataFrame:
        """Blocks of queries (id, v and, for the rest, ``top``) by ring and salt: those of the first rings, or of all others that may hold a nearer vector."""
        pivots, width, rings = self.pivots, self.width, self.rings
        cell, low, high, n = (rings["ring"].to_numpy() // RINGS, rings["low"].to_numpy(), rings["high"].to_numpy(), rings["n"].to_numpy())

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                q, ids = _matrix(batch["v"], width), batch["id"].to_numpy(np.int64)
                d = _distances(q, pivots)[:, cell]
                least = np.maximum(0, np.maximum(d - high, low - d) - SLACK * (1 + d + high))
                order = np.lexsort((d + high, least), axis=1)
                first = np.zeros(d.shape, bool)
                np.put_along_axis(first, order, np.cumsum(n[order], 1) - n[order] < k, 1)
                take = ~first & (least <= batch["top"].to_numpy()[:, None]) if rest else first
                for r in np.flatnonzero(take.any(0)):
                    mine = np.flatnonzero(take[:, r])
                    for a in range(0, len(mine), QUERIES):
                        part = mine[a : a + QUERIES]
                        yield pd.DataFrame({"ring": [int(rings["ring"][r])], "salts": [int(rings["salts"][r])], "queries": [ids[part]], "q": [list(q[part])]})

        dealt = queries.mapInPandas(deal, "ring int, salts int, queries array<long>, q array<array<double>>")
        return dealt.select("ring", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "queries", "q")

    def _measured(self, wanted: DataFrame, k: int) -> DataFrame:
        width = self.width

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for own, q, ids, v in zip(batch["queries"], batch["q"], batch["ids"], batch["vectors"], strict=True):
                    found = list(nearest_in_block(np.stack(q).astype(np.float64).reshape(-1, width), np.stack(v).astype(np.float64), np.asarray(ids), k))
                    yield pd.DataFrame({"query_id": np.repeat(np.asarray(own), [len(x) for x, _ in found]), "vec_id": np.concatenate([x for x, _ in found]), "distance": np.concatenate([x for _, x in found])})

        met = wanted.join(self.blocks.select("ring", "salt", "ids", "vectors"), ["ring", "salt"]).select("queries", "q", "ids", "vectors")
        return _first(met.mapInPandas(measure, "query_id long, vec_id long, distance double"), k)

    def search(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, vec_id, distance, rank) of the k nearest vectors of each query; ties go to smaller ids. Query ids are unique.

        A query is first measured against the rings nearest to it that hold k vectors. The k-th distance found there rules
        out every ring that can't come as near; the others are measured too.
        """
        from lattica.operators.graph import saved

        q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(f"id IS NOT NULL AND size(v) = {self.width} AND size(v) > 0")
        first = saved(self._measured(self._wanted(q, k, False), k))
        top = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("top"))
        return _first(first.drop("rank").unionAll(self._measured(self._wanted(q.join(top, "id"), k, True), k).drop("rank")), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
