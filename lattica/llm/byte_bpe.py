"""Byte-level BPE: ranked merges of distinct words, folded by Spark's higher-order functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import cut, give_back, pairs_of, shared_dir, tuned

#: White space as tiktoken's regex engine has it.
_WS = "\\x09-\\x0D \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Bytes of split texts in one block, about twice the text; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000

#: Texts and their characters in the sample whose words are folded once, and those words, at most (documented bounds).
COMMON_ROWS, COMMON_CHARS, COMMON_WORDS = 16_000, 20_000, 500_000

#: A fold takes n steps over n bytes; longer words are merged with a heap instead, n log n.
FOLD_BYTES = 96

#: Ids are below MOST_IDS, so three of them fit into a long. A pair without a rank has _NONE.
MOST_IDS = 1 << 21

#: Rows of tokens made at a time.
ROWS_OUT = 256
_NONE = 2_147_483_647


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    """The pattern with white space spelled out, as engines differ on it."""
    return pattern.replace("[^\\s", f"[^{_WS}").replace("\\S", f"[^{_WS}]").replace("\\s", f"[{_WS}]")


def perfect_hash(table: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """(shifts, keys, values): a key is found at (key + shifts[key % len(shifts)]) % len(keys), if anywhere."""
    n = len(table) // 3 + 1
    groups: list[list[int]] = [[] for _ in range(n)]
    for key in table:
        groups[key % n].append(key)
    groups.sort(key=len, reverse=True)
    size, shifts = 8 * len(table) // 5 + 3, None
    while shifts is None:
        shifts, size = _placed(groups, n, size), size + 2
    size -= 2
    keys, values = [-1] * size, [0] * size
    for key, value in table.items():
        at = (key + shifts[key % n]) % size
        keys[at], values[at] = key, value
    return shifts, keys, values


def _placed(groups: list[list[int]], n: int, size: int) -> list[int] | None:
    """A shift for each group that sends its keys to free places; None if a group finds none."""
    shifts, taken = [0] * n, bytearray(size)
    for group in groups:
        if not group:
            break
        places = [k % size for k in group]
        if len(set(places)) < len(places):
            return None
        shift = next((s for s in range(size) if not any(taken[(p + s) % size] for p in places)), None)
        if shift is None:
            return None
        shifts[group[0] % n] = shift
        for p in places:
            taken[(p + shift) % size] = 1
    return shifts


@dataclass(frozen=True)
class RankMap:
    """The ranks as one literal, and the lengths of its arrays.

    ``single``: ids of the 256 bytes. ``double``: ranks of the 65,536 pairs of bytes, at 256 a + b.
    ``shifts``, ``entries``: a perfect hash from a pair of ids, a * base + b, to that number times
    ``base`` plus the rank of the joined bytes; a lookup in a map literal would be a scan. The rank of a
    byte string is its id.

    The literal is a scalar subquery on a table of one row: Spark puts its value into the expression as a
    literal when the query runs. Written into the query's text, it would stand in every plan's description
    (3 MB a copy, which the driver keeps for each query).
    """

    literal: Column
    base: int
    shifts: int
    entries: int


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> RankMap:
    if not 0 <= min(ranks.values()) <= max(ranks.values()) < MOST_IDS:
        raise ValueError(f"ids must lie in 0 .. {MOST_IDS - 1}")
    base = (max(ranks.values()) + 1) | 1
    pairs: dict[int, int] = {}
    for piece, rank in ranks.items():
        for cut_at in range(1, len(piece)):
            a, b = ranks.get(piece[:cut_at]), ranks.get(piece[cut_at:])
            if a is not None and b is not None:
                pairs[a * base + b] = rank
    shifts, keys, values = perfect_hash(pairs)
    tables = {
        "single": [ranks[bytes([b])] for b in range(256)],
        "double": [ranks.get(bytes([a, b]), _NONE) for a in range(256) for b in range(256)],
        "shifts": shifts,
        "entries": [k * base + v for k, v in zip(keys, values, strict=True)],
    }
    kind = pa.list_(pa.int64())
    row = pa.struct([(k, kind) for k in tables])
    path = shared_dir(spark, "ranks")
    spark.createDataFrame(pa.table({"tables": pa.array([tables], row)})).coalesce(1).write.parquet(path)
    return RankMap(spark.read.schema("tables struct<" + ", ".join(f"{k}: array<bigint>" for k in tables) + ">").parquet(path).scalar(), base, len(shifts), len(keys))


def fold_merges(df: DataFrame, words: str, ranks: RankMap, ids: str) -> DataFrame:
    """``df`` with a column ``ids``: the ids of each word of ``words``, an array of byte arrays.

    The state of a word is its ids and the ranks of its adjacent pairs. A step joins the leftmost
    pair of the lowest rank and looks up its two new neighbours; the fold has a step for each byte
    but one, and those after the last merge do nothing.
    """
    # the literal stands once in the plan; all else refers to it by name
    folded = _let(F.col("_tables"), lambda tables: F.transform(words, _encoder(tables, ranks)))
    return df.withColumn("_tables", ranks.literal).withColumn(ids, folded).drop("_tables")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _encoder(tables: Column, sizes: RankMap) -> Callable[[Column], Column]:
    none, empty = F.lit(_NONE).cast("long"), F.array().cast("array<bigint>")

    def rank(a: Column, b: Column) -> Column:
        """Rank of a pair, or a number from ``base`` on: an entry of another pair leaves a rest below 0, made large without its sign, or from base on."""

        def found(key: Column) -> Column:
            entry = F.get(tables["entries"], ((key + F.get(tables["shifts"], (key % sizes.shifts).cast("int"))) % sizes.entries).cast("int"))
            return (entry - key * sizes.base).bitwiseAND(F.lit((1 << 63) - 1))

        return _let(a * sizes.base + b, found)

    def step(state: Column, _: Column) -> Column:
        p, r, joined = state["p"], state["r"], state["m"]

        def join(at: Column) -> Column:  # at: place of the pair, from 1
            left = F.when(at > 1, F.array(rank(F.get(p, at - 2), joined))).otherwise(empty)
            right = F.when(at < F.size(r), F.array(rank(joined, F.get(p, at + 1)))).otherwise(empty)
            new = F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r)))
            ids = F.concat(F.slice(p, F.lit(1), at - 1), F.array(joined), F.slice(p, at + 2, F.size(p)))
            return _let(new, lambda x: F.struct(ids.alias("p"), x.alias("r"), F.coalesce(F.array_min(x), none).alias("m")))

        return F.when(joined >= sizes.base, state).otherwise(_let(F.array_position(r, joined).cast("int"), join))

    def encode(word: Column) -> Column:
        byte = lambda b: F.pmod(b.cast("int"), F.lit(256))
        ids = F.transform(word, lambda b: F.get(tables["single"], byte(b)))
        pairs = F.zip_with(F.slice(word, F.lit(1), F.size(word) - 1), F.slice(word, F.lit(2), F.size(word)), lambda a, b: F.get(tables["double"], byte(a) * 256 + byte(b)))
        start = _let(pairs, lambda r: F.struct(ids.alias("p"), r.alias("r"), F.array_min(r).alias("m")))
        folded = F.aggregate(F.sequence(F.lit(2), F.size(word)), start, step, lambda s: s["p"])
        return F.when(F.size(word) < 2, ids).otherwise(folded)

    return encode


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: lowest rank first, leftmost first, in n log n."""
    n = len(word)
    part: list[bytes] = [word[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if not part[i] or j < 0 or len(part[i]) + len(part[j]) != size:
            continue
        part[i], part[j] = part[i] + part[j], b""
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
        h = left[i]
        if h >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
            heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
    return [ranks[p] for p in part if p]


def _byte_lists(words: pa.Array) -> pa.ListArray:
    """Binary strings as lists of bytes, without a copy of their data."""
    data = words.buffers()
    offsets = np.frombuffer(data[1], np.int32, len(words) + 1, words.offset * 4)
    flat = np.frombuffer(data[2], np.int8, offsets[-1]) if data[2] is not None else np.empty(0, np.int8)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([x.flatten() for x in column.chunks])


@dataclass(frozen=True)
class Common:
    """Words of a bounded sample, with their ids: what a block needn't fold again. Results don't depend on it."""

    words: pa.Array
    starts: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray


def common_words(texts: DataFrame, pattern: str, ranks: RankMap, rows: int = COMMON_ROWS, most: int = COMMON_WORDS) -> Common:
    """Distinct words of ``rows`` texts on average, ``most`` at most, folded once."""
    n = texts.count()
    part = texts.filter(F.length("_text") <= COMMON_CHARS).sample(min(1.0, rows / n) if n else 1.0, seed=3)
    words = part.select(F.explode(F.regexp_extract_all("_text", F.lit(java_pattern(pattern)), F.lit(0))).alias("w")).distinct().filter(F.octet_length("w") <= FOLD_BYTES).limit(most)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_one_list(_byte_lists(batch.column(0).cast(pa.binary())))], names=["words"])

    spark = tuned(texts.sparkSession)
    dealt = words.repartition(2 * spark.sparkContext.defaultParallelism, "w").mapInArrow(lists, "words array<array<tinyint>>")
    found = fold_merges(dealt, "words", ranks, "ids").toArrow()
    raw = [_flat(found[c]) if found.num_rows else None for c in ("words", "ids")]
    if raw[0] is None:
        return Common(pa.array([], pa.binary()), *(np.empty(0, np.int32) for _ in range(2)), np.empty(0, "<u4"))
    lists_of, ids = raw
    offsets = lists_of.offsets.to_numpy()
    data = lists_of.values.to_numpy()[offsets[0] : offsets[-1]].tobytes()
    packed = pa.Array.from_buffers(pa.binary(), len(lists_of), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(data)])
    at = ids.offsets.to_numpy()
    return Common(packed, at[:-1] - at[0], np.diff(at), ids.flatten().to_numpy().astype("<u4"))


def blocks(texts: DataFrame, pattern: str, common: Broadcast, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of (ids, words, long, texts): documents of a block as indexes into common and own distinct words.

    Spark splits the texts; Arrow's dictionary encoding finds the distinct words. A block is bounded
    in characters, whatever the table's size, and made where the texts are read: no shuffle, no
    vocabulary of the whole corpus on any machine. Long words are empty in ``words`` and follow in ``long``.
    """

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([x.column(0) for x in parts])
        lists = pa.concat_arrays([x.column(1) for x in parts])
        ends = lists.offsets.to_numpy()
        coded = lists.values.cast(pa.binary()).dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=common.value.words)
        own = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        place = known.fill_null(0).to_numpy().astype(np.uint32)
        place[own] = len(common.value.words) + np.arange(len(own))
        index = place[coded.indices.to_numpy()] if len(place) else np.empty(0, np.uint32)
        words = coded.dictionary.take(pa.array(own))
        over = np.flatnonzero(pc.binary_length(words).to_numpy() > FOLD_BYTES)
        longs = words.take(pa.array(over))
        if len(over):
            raw = words.to_pylist()
            for k in over.tolist():
                raw[k] = b""
            words = pa.array(raw, pa.binary())
        raw_index = index.tobytes()
        seqs = pa.array([raw_index[4 * x : 4 * y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([_one_list(ids), _one_list(_byte_lists(words)), _one_list(longs), _one_list(seqs)], names=["ids", "words", "long", "texts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(batch)
            size += batch.nbytes
            if size >= block_chars:
                yield done(parts)
                parts, size = [], 0
        if parts:
            yield done(parts)

    found = F.regexp_extract_all(F.coalesce("_text", F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))
    return texts.select("_id", found.alias("_w")).mapInArrow(gather, "ids array<long>, words array<array<tinyint>>, long array<binary>, texts array<binary>")


_TOKENS = "_id long, tokens binary"
_DIGESTS = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, digests: bool = False, tokens: bool = True) -> DataFrame:
    """(_id, tokens binary): ids of each whole text as little-endian unsigned 32-bit integers. No shuffle of texts.

    digests: the columns of ``token_digests`` too, made by the same worker; tokens: whether the ids are returned.
    Blocks of split texts are written to the shared folder between splitting and folding, so an
    executor runs one Python worker a task at a time, and a lost one repeats one half.

    A null or empty text has no tokens. Rows repeat as they come, null ids stay null, other
    columns are ignored; very long texts are encoded whole; equal texts have equal ids, as nothing is left to
    ties (a vocabulary's ranks differ; of equal pairs the leftmost is joined). An empty table gives an empty table.
    """
    spark, texts, table = tuned(docs.sparkSession), pairs_of(docs, id_col, text_col), rank_map(docs.sparkSession, ranks)
    common = spark.sparkContext.broadcast(common_words(texts, pattern, table))
    give_back()
    folded = fold_merges(cut(blocks(texts, pattern, common, block_chars), "blocks"), "words", table, "words")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(1)[k].values
                at = words.offsets.to_numpy()
                lengths = np.concatenate([known.lengths, np.diff(at)])
                longs = [np.array(heap_merges(w, ranks), "<u4") for w in batch.column(2)[k].as_py()]
                starts = np.concatenate([known.starts, at[:-1] - at[0] + len(known.ids)])
                flat = np.concatenate([known.ids, words.flatten().to_numpy(zero_copy_only=False).astype("<u4")])
                end = len(flat)
                for place, x in zip(np.flatnonzero(lengths == 0), longs, strict=True):
                    starts[place], lengths[place] = end, len(x)
                    end += len(x)
                flat = np.concatenate([flat, *longs]) if longs else flat
                ids, rows = batch.column(0)[k].values, batch.column(3)[k].values
                for part in range(0, len(rows), ROWS_OUT):
                    out = []
                    for seq in rows[part : part + ROWS_OUT]:
                        index = np.frombuffer(seq.as_buffer(), np.uint32)
                        n = lengths[index]
                        shift = np.repeat(starts[index] - np.cumsum(n, dtype=np.int64) + n, n)
                        out.append(flat[shift + np.arange(len(shift))].tobytes())
                    yield pa.RecordBatch.from_arrays([ids[part : part + ROWS_OUT].cast(pa.int64()), pa.array(out, pa.binary())], names=["_id", "tokens"])

    if not digests:
        return folded.mapInArrow(join, _TOKENS)
    digest = _digester(ranks, tokens)
    return folded.mapInArrow(lambda batches: digest(join(batches)), _DIGESTS + (", tokens binary" if tokens else ""))


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def _digester(ranks: dict[bytes, int], tokens: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(ranks)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                x = value.as_py()
                rows.append((len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(_decoded(x, pieces)).hexdigest()))
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * tokens, names=names + ["tokens"] * tokens)

    return digest


def _decoded(tokens: bytes, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(tokens, "<u4").tolist()))


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(_id, bytes binary): the byte strings of the ids, joined. Null tokens give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else _decoded(x, pieces) for x in batch.column(1).to_pylist()], pa.binary())], names=["_id", "bytes"])

    return tokens.select("_id", "tokens").mapInArrow(run, "_id long, bytes binary")


def token_digests(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(_id, n_tokens, ids_sha256, decoded_sha256): ids are decoded by joining their byte strings."""
    return tokens.mapInArrow(_digester(ranks), _DIGESTS)
