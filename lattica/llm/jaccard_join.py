"""N-gram Jaccard self-join with Bayesian candidate pruning and exact verification."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Rolling, WordHashes, connected_components, cut, hash_words, heavy_join, map_arrow, pairs_of, tuned, words_of

SHINGLE, THRESHOLD = 5, 0.8

#: MinHash values of a document; the first BANDS * ROWS make the bands of the candidate search.
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**24, below 4e-6.
HASHES, BANDS, ROWS = 128, 24, 4

#: Values compared at a time, and the posterior probability of reaching the threshold below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6

#: Sets of a bucket that are compared with one another; in larger buckets all count as candidates of their smallest set.
BUCKET = 16_384

#: Sets, and bytes of sets, on one side of a verification cell; larger groups are dealt into pairs of such blocks.
BLOCK, BLOCK_BYTES = 1_024, 4_000_000

#: Bytes of candidate groups, or rows of buckets, that are packed into one task's call.
PACK_BYTES, PACK_ROWS = 2_000_000, 8_192

_SEED = np.random.default_rng(20_240_601)
_MULT = _SEED.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64)


class Shingler:
    def __init__(self, k: int) -> None:
        self.k, self.memo, self.rolling = k, WordHashes(), Rolling()

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the k-word shingles; fewer than k words are one shingle, none are none."""
        words = hash_words(words_of(text), self.memo)
        return np.unique(self.rolling.windows(words, min(self.k, len(words)))) if len(words) else np.empty(0, np.uint64)


_SHINGLERS: dict[int, Shingler] = {}


def _shingler(k: int) -> Shingler:
    return _SHINGLERS.setdefault(k, Shingler(k))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits; of long texts 4,096 shingles at a time."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4_096):
        part = shingles[a : a + 4_096]
        out = np.minimum(out, (part[None, :] * _MULT[:, None] + _ADD[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> list[int]:
    raw = values[: BANDS * ROWS].tobytes()
    size = 4 * ROWS
    return [xxhash.xxh3_64_intdigest(raw[i * size : (i + 1) * size], seed=i) - 2**63 for i in range(BANDS)]


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """[(n compared, least matches to go on)].

    With a uniform prior the posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1),
    so the probability of threshold or more is that of at most m successes in n + 1 trials at the threshold.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out.append((n, m))
                break
    return out


def fragments(values: np.ndarray) -> bytes:
    """The low byte of each value. Bytes agree with probability J + (1 - J) / 256, never less than J, so pruning on them is no stricter."""
    return values.astype(np.uint8).tobytes()


def matrix_of(fragments: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fragments), np.uint8).reshape(len(fragments), HASHES)


def surviving(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], needs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two matrices of fragments that no step drops. Values outside the bands come first."""
    i, j = pairs
    matches = np.zeros(len(i), np.int32)
    for n, need in needs:
        stop = HASHES - n
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            matches[part] += (a[i[part], stop : stop + STEP] == b[j[part], stop : stop + STEP]).sum(axis=1, dtype=np.int32)
        live = matches >= need
        i, j, matches = i[live], j[live], matches[live]
    return i, j


def candidate_groups(rows: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """For each row of a matrix of fragments the first row of its group: groups join pairs that no step drops.

    A row is compared with those outside its own group, so a bucket of near copies costs one pass.
    """
    n = len(rows)
    up = np.arange(n)
    for x in range(n - 1):
        rest = np.flatnonzero(up[x + 1 :] != up[x]) + x + 1
        if len(rest):
            near = surviving(rows, rows, (np.full(len(rest), x), rest), needs)[1]
            if len(near):
                joined = np.unique(np.append(up[near], up[x]))
                up[np.isin(up, joined)] = joined[0]
        elif (up == up[x]).all():
            break
    return up


def intersections(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of sets a[i] and b[j].

    Few pairs are merged one by one. Many share most shingles: those in both sides become columns of
    0/1 matrices, 4,096 at a time, whose product counts them (below 2**24, so exact in float32).
    """
    if len(i) <= 4 * (len(a) + len(b)):
        return np.array([np.intersect1d(a[x], b[y], assume_unique=True).size for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    columns = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    product = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(columns), 4_096):
        part = columns[at : at + 4_096]

        def matrix(sets: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            out = np.zeros((len(sets), len(part)), np.float32)
            for row, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                own = own[np.isin(own, part, assume_unique=True)]
                out[row, np.searchsorted(part, own)] = 1
            return out

        product += matrix(a) @ matrix(b).T
    return product[i, j].astype(np.int64)


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    up = np.arange(n)
    while len(i):
        a, b = up[i], up[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(up, a, low)
        np.minimum.at(up, b, low)
        while not np.array_equal(up, over := up[up]):
            up = over
    return up


def links(sets: list[np.ndarray], rows: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], threshold: float, needs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with similarity >= threshold: pruned by steps, the rest verified exactly."""
    i, j = surviving(rows, rows, pairs, needs)
    if not len(i):
        return i, j
    left, at_i = np.unique(i, return_inverse=True)
    right, at_j = np.unique(j, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    common = intersections([sets[x] for x in left.tolist()], [sets[x] for x in right.tolist()], at_i, at_j)
    near = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
    return i[near], j[near]


_SUMS = "_id long, key binary, size long, sig binary, bands array<long>"
_CELL = "key binary, n_links long, root binary, whole boolean"


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(id, class_id, n_links, n_copies) for each row.

    Words are [^\\x20\\x09-\\x0D]+, sets are distinct k-word shingles of whole texts, however long. Rows with
    equal sets are copies; ``n_copies`` counts their ids. ``n_links`` counts the other sets with Jaccard
    similarity >= threshold; ``class_id`` is the smallest id that links and copies lead to. Wordless rows
    link with nothing. A row with a null id is a class of its own (null class_id, 0 links, 1 copy). Rows that
    share an id are told by their own texts; ties don't arise, as every pair at the threshold or above links.
    Other columns are ignored; an empty table gives an empty table.

    Sets, not rows, are compared, so copies cost one row each. Sets that share a MinHash band meet in its
    bucket, where pairs are pruned step by step; each bucket keeps one edge for each set at most. Edges join into
    groups; all pairs of a group are met in cells of two blocks in memory: values by steps with Bayesian
    pruning, the rest exactly. Only counts and forests leave a cell, so rows grow with sets, not pairs.
    """
    spark = tuned(docs.sparkSession)
    source = pairs_of(docs, id_col, text_col)
    needs = least_matches(threshold, tolerance)

    def summarise(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingler, rows = _shingler(k), []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingler.shingles(text) if i is not None else ()
            if not len(s):
                rows.append((i, None, None, None, None))
                continue
            values = minhash(s)
            rows.append((i, xxhash.xxh3_128_digest(s.tobytes()), len(s), fragments(values), band_keys(values)))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_id", "key", "size", "sig", "bands"])

    sums = cut(map_arrow(source, summarise, _SUMS), "sums")
    total = sums.count()
    keyed = sums.filter("key IS NOT NULL")
    copies = cut(keyed.select("key", "_id").distinct().groupBy("key").agg(F.min("_id").alias("first"), F.count("*").alias("n_copies")), "copies")
    sets = cut(keyed.groupBy("key").agg(F.any_value("size").alias("size"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")), "sets")

    # buckets of two sets at least; the large ones give stars, the others are compared
    bands = sets.select("key", F.explode("bands").alias("h"))
    shared = cut(bands.groupBy("h").agg(F.count("*").alias("n"), F.min("key").alias("hub")).filter("n > 1"), "buckets")
    member = cut(heavy_join(bands, shared, "h", "n", BANDS * total), "members")
    stars = member.filter((F.col("n") > bucket) & (F.col("key") != F.col("hub"))).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    met = member.filter(F.col("n") <= bucket).select("h", "key").join(sets.select("key", "sig"), "key")
    packs = max(1, member.count() // PACK_ROWS)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        h, keys = table["h"].to_numpy(), table["key"].to_pylist()
        rows, order, a, b = matrix_of(table["sig"].to_pylist()), np.argsort(h, kind="stable"), [], []
        for own in np.split(order, np.flatnonzero(np.diff(h[order])) + 1):
            for x, first in enumerate(candidate_groups(rows[own], needs).tolist()):
                if x != first:
                    a.append(keys[own[x]])
                    b.append(keys[own[first]])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    edges = met.withColumn("pack", F.pmod(F.xxhash64("h"), F.lit(packs))).groupBy("pack").applyInArrow(compare, "a binary, b binary")
    groups = connected_components(cut(edges.unionAll(stars).distinct(), "edges"), "groups")

    # cells: small groups are packed, large ones dealt into pairs of blocks
    weighed = cut(groups.withColumnRenamed("node", "key").join(sets.select("key", "size", "sig"), "key"), "grouped")
    cost = F.col("size") * 8 + 200
    sizes = cut(weighed.groupBy("root").agg(F.count("*").alias("members"), F.sum(cost).alias("bytes")), "sizes")
    light = sizes.agg(F.sum(F.when(F.col("bytes") <= PACK_BYTES // 4, F.col("bytes")))).first()[0] or 0
    packs_of_groups = max(1, light // PACK_BYTES)
    shapes = sizes.withColumn("blocks", F.expr(f"CASE WHEN bytes <= {PACK_BYTES // 4} AND members <= {block} THEN 1 ELSE cast(greatest(ceil(members / {block}), ceil(bytes / {BLOCK_BYTES})) as int) END"))
    placed = cut(heavy_join(weighed, shapes, "root", "members", total).withColumn("own", F.expr("cast(pmod(xxhash64(key), blocks) as int)")), "placed")
    cells = placed.withColumn("other", F.expr("explode(sequence(0, blocks - 1))")).select(
        "key", "sig", F.col("root").alias("grp"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), (F.col("blocks") == 1).alias("whole"),
        F.expr(f"CASE WHEN bytes <= {PACK_BYTES // 4} AND blocks = 1 THEN pmod(xxhash64(root), {packs_of_groups}) ELSE xxhash64(root, 1) END").alias("pack"),
    )

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [_shingler(k).shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())], names=["key", "s"])

    wanted = copies.join(placed.select("key"), "key", "left_semi").select(F.col("first").alias("_id")).distinct()
    # shuffled at every size: a broadcast of the ids would only last as long as they are few
    full = map_arrow(source.join(wanted.hint("merge"), "_id", "left_semi"), shingles, "key binary, s binary").groupBy("key").agg(F.any_value("s").alias("s"))

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        keys, side = table["key"].to_pylist(), table["side"].to_numpy()
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["s"]]
        rows, same = matrix_of(table["sig"].to_pylist()), key[1].as_py() == key[2].as_py()
        grp = np.unique(np.array(table["grp"].to_pylist(), dtype=object), return_inverse=True)[1]
        order, n = np.argsort(grp, kind="stable"), np.zeros(len(keys), np.int64)
        up = np.arange(len(keys))
        for own in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
            if same:
                one = two = own
            else:
                one, two = own[side[own] == key[1].as_py()], own[side[own] == key[2].as_py()]
            found = [(np.empty(0, np.int64),) * 2]
            for x in range(0, len(one), 256):  # pairs of 256 rows at a time
                part = one[x : x + 256]
                pairs = np.repeat(part, len(two)), np.tile(two, len(part))
                if same:
                    place = np.repeat(np.arange(x, x + len(part)), len(two)) < np.tile(np.arange(len(two)), len(part))
                    pairs = pairs[0][place], pairs[1][place]
                found.append(links(held, rows, pairs, threshold, needs))
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            n += np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
            if len(i):
                own_up = components(len(keys), i, j)
                up[own] = own_up[own]
        out = [pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array([keys[x] for x in up.tolist()], pa.binary()), table["whole"]]
        return pa.table(out, names=["key", "n_links", "root", "whole"])

    found = cut(cells.join(full, "key").groupBy("pack", "i", "j").applyInArrow(cell, _CELL), "links")
    counts = found.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    spread = cut(found.filter("NOT whole AND key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), "spread")
    roots = found.filter("whole").select("key", "root").unionAll(connected_components(spread, "classes").select(F.col("node").alias("key"), "root"))
    linked = cut(counts.join(roots, "key", "left").select("key", "n_links", F.coalesce("root", "key").alias("root")).join(copies, "key"), "linked")
    least = cut(linked.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("members")), "least")
    classed = heavy_join(linked, least, "root", "members", total).select("key", "n_links", "class_id")
    info = cut(copies.join(classed, "key", "left").select("key", "n_copies", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    told = heavy_join(keyed.select("_id", "key"), info, "key", "n_copies", total).select("_id", "class_id", "n_links", "n_copies")
    alone = sums.filter("key IS NULL").select("_id", F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return told.unionAll(alone).withColumnRenamed("_id", id_col)
