"""Substring deduplication: window hashes only at the positions of a difference cover, then extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import Rolling, WordHashes, cut, hash_words, map_arrow, pairs_of, tuned, words_of

WINDOW = 50

#: A perfect difference set: for any two places some shift below 31 brings both onto the cover.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

#: Documents of the sample in which hot hashes are looked for, those of them that must have one, hashes at most, and
#: parts that a hot one is dealt into. The sample decides where rows go, never what comes out.
SAMPLE_DOCS, HOT_DOCS, HOT_HASHES, PARTS = 4_096, 16, 10_000, 256

#: A window's key: 64 bits, and 32 of a second hash. At 10**13 windows fewer than one pair in a thousand runs agrees by chance.
KEY = ("h", "g")
_ROWS = "h long, g int, doc long, others array<long>"
_SECOND = 0xD1342543DE82EF95


def anchor_places(n_words: int, length: int) -> np.ndarray:
    """Starts of the anchor windows of a text, those with start modulo PERIOD in COVER."""
    places = np.arange(max(n_words - length + 1, 0))
    return places[np.isin(places % PERIOD, COVER)]


class Hasher:
    """Word and window hashes, with the memos of one worker."""

    def __init__(self, window: int) -> None:
        self.window, self.anchor = window, window - PERIOD + 1
        if self.anchor < 1:
            raise ValueError(f"a window has {PERIOD} words at least")
        self.memo, self.rolling, self.second = WordHashes(), Rolling(), Rolling(_SECOND)

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the window at each start."""
        return self.rolling.windows(words, self.window), (self.second.windows(words, self.window) >> np.uint64(32)).astype(np.uint32)

    def words(self, text: str | None) -> np.ndarray:
        return hash_words(words_of(text), self.memo)

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes); texts below one window can't match and have none."""
        if len(words) < self.window:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        places = anchor_places(len(words), self.anchor)
        return places, self.rolling.windows(words, self.anchor)[places]


def summed(hashes: list[tuple[np.ndarray, np.ndarray]], docs: list[int]) -> pa.RecordBatch:
    """One row (h, g, smallest doc, other docs) for each key of a batch: the sum that comes before the shuffle."""
    h, g = (np.concatenate([x[k] for x in hashes]) for k in (0, 1))
    d = np.repeat(np.array(docs, np.int64), [len(x) for x, _ in hashes])
    order = np.lexsort((d, g, h))
    h, g, d = h[order], g[order], d[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    fresh = head.copy()
    fresh[1:] |= d[1:] != d[:-1]
    h, g, d, head = h[fresh], g[fresh], d[fresh], head[fresh]
    heads = np.flatnonzero(head)
    sizes = np.diff(np.append(heads, len(h))) - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(d[~head]))
    return pa.RecordBatch.from_arrays([pa.array(h[heads].view(np.int64)), pa.array(g[heads].view(np.int32)), pa.array(d[heads]), others], names=["h", "g", "doc", "others"])


def hot_keys(rows: DataFrame) -> DataFrame:
    """Keys that many documents of the sample have, HOT_HASHES at most: those with the most documents."""
    uses = rows.groupBy(*KEY).agg(F.sum(F.size("others") + 1).alias("n")).filter(F.col("n") >= HOT_DOCS)
    return cut(uses.orderBy(F.desc("n"), *KEY).limit(HOT_HASHES).select(*KEY), "hot")


def shared(rows: DataFrame, hot: DataFrame, later_only: bool) -> DataFrame:
    """(_id, hashes) of the documents whose keys other documents have; later_only: documents with a smaller id.

    One shuffle of keys, of which each batch of texts sends one row. Hot keys are dealt into PARTS,
    and what their parts have in common is summed up and broadcast (HOT_HASHES rows at most).
    """
    dealt = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), list(KEY), "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(PARTS))).otherwise(0))
    by = Window.partitionBy(*KEY, "part")
    told = dealt.withColumn("least", F.min("doc").over(by)).withColumn("most", F.max(F.greatest("doc", F.coalesce(F.array_max("others"), "doc"))).over(by))
    # a cold key is settled here, so only its hash and the documents it concerns are written
    docs = F.concat(F.array("doc"), "others")
    held = (F.when(F.col("hot"), docs).otherwise(F.filter(docs, lambda x: x > F.col("least"))) if later_only else docs).alias("docs")
    told = told.filter("hot OR least < most").select("h", "g", "hot", "least", "most", held)
    seen = told.select("h", "hot", *[F.when(F.col("hot"), F.col(c)).alias(c) for c in ("g", "least", "most")], "docs")
    seen = cut(seen.filter("size(docs) > 0"), "seen")
    of_parts = seen.filter("hot").groupBy(*KEY).agg(F.min("least").alias("first"), F.max("most").alias("last")).filter("first < last").drop("last")
    hot_rows = seen.filter("hot").join(F.broadcast(of_parts), list(KEY)).select("h", "first", F.explode("docs").alias("_id"))
    each = seen.filter("hot IS NULL").select("h", F.explode("docs").alias("_id")).unionByName((hot_rows.filter("_id > first") if later_only else hot_rows).select("h", "_id"))
    return each.groupBy("_id").agg(F.collect_list("h").alias("hashes"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text, removed): each document without the words that repeat.

    A word goes if a window of ``window`` words covers it whose word sequence also starts in a
    document with a smaller id, judged on the input. ``removed`` lists [start, end) word ranges.
    A null text has no words; null ids neither remove nor are removed from; rows that share an id
    are parts of one document; short texts stay whole; whole texts are read, however long; ties can't arise, as
    the smallest id keeps a passage; other columns are ignored; an empty table gives an empty table.
    """
    source = pairs_of(docs, id_col, text_col)
    keyed, lost = source.filter("_id IS NOT NULL"), source.filter("_id IS NULL")

    def find_anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher = _hasher(window)
        hashes = [hasher.anchors(hasher.words(t))[1] for t in batch.column(1).to_pylist()]
        return summed([(h, np.zeros(len(h), np.uint32)) for h in hashes], batch.column(0).to_pylist())

    def find_windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher = _hasher(window)
        return summed([hasher.windows(hasher.words(t)) for t in batch.column(1).to_pylist()], batch.column(0).to_pylist())

    def extend(batch: pa.RecordBatch) -> pa.RecordBatch:
        hasher, out = _hasher(window), []
        for text, hashes in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = hasher.words(text)
            places, anchors = hasher.anchors(words)
            hit = places[np.isin(anchors, hashes.values.to_numpy().view(np.uint64))]
            n = max(len(words) - window + 1, 0)
            # window p holds the anchors that start in p .. p + PERIOD - 1
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, np.clip(hit - PERIOD + 1, 0, n), 1)
            np.add.at(steps, np.clip(hit + 1, 0, n), -1)
            live = np.cumsum(steps[:n]) > 0
            h, g = hasher.windows(words)
            out.append((h[live], g[live]))
        return summed(out, batch.column(0).to_pylist())

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, hashes in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words, ranges = words_of(text), []
                if hashes.is_valid:
                    hasher = _hasher(window)
                    own = hasher.rolling.windows(hash_words(words, hasher.memo), window)
                    for p in np.flatnonzero(np.isin(own, hashes.values.to_numpy().view(np.uint64))).tolist():
                        if ranges and p <= ranges[-1][1]:
                            ranges[-1][1] = p + window
                        else:
                            ranges.append([p, p + window])
                n = len(words)
                for a, b in reversed(ranges):
                    del words[a:b]
                rows.append((n, n - len(words), b" ".join(words), ranges))
            n, gone, kept, ranges = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(ranges, pa.list_(pa.list_(pa.int64())))],
                names=["_id", "n_words", "n_removed", "kept_text", "removed"],
            )

    tuned(docs.sparkSession)
    n = keyed.count()
    sample = keyed.sample(min(1.0, SAMPLE_DOCS / n) if n else 1.0, seed=9)
    near = shared(map_arrow(keyed, find_anchors, _ROWS), hot_keys(map_arrow(sample, find_anchors, _ROWS)), later_only=False)
    again = shared(map_arrow(keyed.join(near, "_id").select("_id", "_text", "hashes"), extend, _ROWS), hot_keys(map_arrow(sample, find_windows, _ROWS)), later_only=True)
    # the same shuffle of the texts serves both joins
    marked = keyed.join(again, "_id", "left").select("_id", "_text", "hashes").unionAll(lost.withColumn("hashes", F.lit(None).cast("array<long>")))
    out = marked.mapInArrow(remove, "_id long, n_words long, n_removed long, kept_text string, removed array<array<long>>")
    return out.withColumnRenamed("_id", id_col)


_HASHERS: dict[int, Hasher] = {}


def _hasher(window: int) -> Hasher:
    """One for each worker process."""
    if window not in _HASHERS:
        _HASHERS[window] = Hasher(window)
    return _HASHERS[window]


def kept_digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's digest columns of ``substring_dedup``."""
    return result.select(id_col, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def long_matches_share_an_anchor(window: int = WINDOW) -> bool:
    """That COVER is a difference cover: every shift between two places is met."""
    return {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD)) and window >= PERIOD
