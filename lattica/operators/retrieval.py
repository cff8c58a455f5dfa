"""Exact vector search, embeddings and keyword search with context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.text import chunk_of_lines, col, lines, similarity
from lattica.operators import neighbours

#: Results fetched and shown on a page (fixed values).
TOP, PAGE = 30, 15


def l2_distance(vector: Column | str, query: Column | str) -> Column:
    pairs = F.zip_with(vector, query, lambda a, b: (a - b).cast("double") * (a - b))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int = TOP, threshold: float = 0.0, project_id: int | None = None) -> DataFrame:
    """The k nearest rows by L2 distance; then those of the similarity ``threshold`` at least.

    The query is a literal; limit after order is TakeOrderedAndProject, so a task sends k rows at most.
    """
    held = vectors if project_id is None else vectors.filter(F.col("project_id") == project_id)
    near = held.withColumn("distance", F.round(l2_distance("embedding", F.lit([float(x) for x in query])), 6)).orderBy("distance", "node_id", "vec_id").limit(k)
    return near.withColumn("similarity", similarity("distance")).filter(F.col("similarity") >= threshold)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, vec_id, distance, rank) of the k nearest vectors of each query, exactly; null vectors and those of another width are no rows."""
    return neighbours.Index(vectors).search(queries, k)


#: Lines up to which a hit is shown whole (fixed value).
WHOLE_LINES = 50


def best_per_node(results: DataFrame) -> DataFrame:
    """Blocks keep their most similar chunk (the first of equals), files all chunks."""
    by = Window.partitionBy("node_id").orderBy(F.desc("similarity"), "vec_id")
    ranked = results.withColumn("_k", F.row_number().over(by))
    return ranked.filter(F.col("node_id").startswith("file_") | (F.col("_k") == 1)).drop("_k")


def with_pages(results: DataFrame, *order: Column | str, size: int = PAGE) -> DataFrame:
    """Rank and page of a small ranked result."""
    n = F.row_number().over(Window.orderBy(*order))
    return results.withColumn("node_index", n).withColumn("page", F.floor((n - 1) / size).cast("long"))


def semantic_search(vectors: DataFrame, blocks: DataFrame, files: DataFrame, projects: DataFrame, query: list[float], k: int = TOP, threshold: float = 0.0, project_id: int | None = None) -> DataFrame:
    """k nearest (of one project, if given), best chunk of each block, placed in file and project, ranked and paged.

    ``code`` is what a hit shows: the whole of a short block or file, of a long one the lines of its chunk, or the
    whole if the chunk lies outside. ``parent_name`` and ``n_children`` place a block in its tree.
    """
    hits = best_per_node(nearest(vectors, query, k, threshold, project_id)).withColumn("key", F.split_part("node_id", F.lit("_"), F.lit(2)).cast("long"))
    is_file = F.col("node_id").startswith("file_")
    kids = blocks.filter("parent_block_id IS NOT NULL").groupBy(F.col("parent_block_id").alias("key")).agg(F.count("*").alias("n_children"))
    up = blocks.select(F.col("id").alias("up"), F.col("name").alias("parent_name"))
    b = blocks.select(F.col("id").alias("key"), F.col("name").alias("block_name"), F.col("file_id").alias("block_file"), F.col("content").alias("block_text"), F.col("start_line").alias("block_start"), F.col("parent_block_id").alias("up"))
    placed = hits.join(b, (hits["key"] == b["key"]) & ~is_file, "left").drop(b["key"]).join(up, "up", "left").join(kids, "key", "left")
    named = placed.withColumn("file_id", F.when(is_file, F.col("key")).otherwise(F.col("block_file")))
    f = files.select(F.col("id").alias("file_id"), "file_path", F.col("project_id").alias("owner"), F.col("content").alias("file_text"))
    p = projects.select(F.col("id").alias("owner"), F.col("name").alias("project_name"))
    shown = named.join(f, "file_id", "left").join(p, "owner", "left").withColumn("whole", F.when(is_file, F.col("file_text")).otherwise(F.col("block_text")))
    first = F.when(is_file, F.lit(1)).otherwise(F.col("block_start"))
    chunk = chunk_of_lines("whole", F.col("chunk_start_line") - first + 1, F.col("chunk_end_line") - first + 1)
    code = F.when(F.size(lines("whole")) > WHOLE_LINES, chunk).otherwise(F.col("whole"))
    out = shown.select(
        "node_id", "vec_id", "block_name", "parent_name", F.when(~is_file, F.coalesce("n_children", F.lit(0))).alias("n_children"), "file_path", "project_name",
        "chunk_start_line", "chunk_end_line", "distance", F.round("similarity", 6).alias("similarity"), code.alias("code"),
    )
    return with_pages(out, "distance", "node_id", "vec_id")


# --- tokens, chunks, embeddings


def count_tokens(text: str, cap: int | None = 256) -> int:
    """White-space tokens, cut off at ``cap`` as a truncating tokenizer does."""
    n = len(text.split())
    return n if cap is None else min(n, cap)


def trim_tokens(text: str, budget: int) -> str:
    """The longest beginning within a budget."""
    if count_tokens(text, None) <= budget:
        return text
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count_tokens(text[:mid], None) <= budget else (low, mid - 1)
    return text[:low]


def overlap_tail(text: str, budget: int) -> str:
    """The last words within a budget, joined by blanks."""
    words = text.split()
    return " ".join(words[-budget:]) if budget > 0 else ""


def chunk_text(text: str | None, max_tokens: int = 240, overlap: int = 30, metadata: str = "") -> list[dict]:
    """Chunks of whole lines within a token budget; each but the first begins with the last words of the one before.

    The first chunk carries ``metadata`` and two line ends. A line above the budget is a chunk of its own.
    """
    if not text or not text.strip():
        return []
    rows, head = text.splitlines(keepends=True), f"{metadata}\n\n" if metadata else ""
    if len(rows) == 1:
        return [{"text": head + text, "start": 0, "end": len(text), "start_line": 1, "end_line": 1, "token_count": count_tokens(head + text)}]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).tolist()
    out, at, carried = [], 0, ""
    while at < len(rows):
        prefix = carried if out else head + carried
        budget = max_tokens - count_tokens(head) if head and not out else max_tokens
        first, body = at, prefix
        while at < len(rows) and (at == first or count_tokens(body + rows[at]) <= budget):
            body += rows[at]
            at += 1
        out.append({"text": body, "start": offsets[first] - (len(carried.rstrip("\n")) if carried and body.startswith(carried) else 0), "end": offsets[at], "start_line": first + 1, "end_line": at, "token_count": count_tokens(body)})
        tail = overlap_tail(text[offsets[first] : offsets[at]], overlap) if at < len(rows) else ""
        carried = tail + "\n" if tail else ""
    return out


CHUNKS = "array<struct<text:string,start:int,end:int,start_line:int,end_line:int,token_count:int>>"


def chunks(max_tokens: int = 240, overlap: int = 30):
    """Pandas UDF: text -> chunks."""

    @F.pandas_udf(CHUNKS)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: chunk_text(t, max_tokens, overlap))

    return run


class Places(dict):
    """Memo from a word to its place among 2 * size signed ones; it starts anew when it is full."""

    def __init__(self, size: int, most: int = 200_000) -> None:
        self.size, self.most = size, most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        place = self[word] = h % self.size + (self.size if h >> 63 else 0)
        return place


_places: dict[int, Places] = {}


def embed_texts(texts: list[str | None], size: int = 64) -> np.ndarray:
    """Deterministic stand-in for a model: mean of signed hash vectors of the tokens; blank texts are zero."""
    words = [(text or "").lower().split() for text in texts]
    n = np.fromiter(map(len, words), np.int64, len(texts))
    known = _places.setdefault(size, Places(size))
    at = np.fromiter((known[w] for own in words for w in own), np.int64, int(n.sum()))
    counts = np.bincount(np.repeat(np.arange(len(texts)) * (2 * size), n) + at, minlength=len(texts) * 2 * size).reshape(len(texts), 2, size)
    return ((counts[:, 1] - counts[:, 0]).astype(np.float32) / np.maximum(n, 1)[:, None].astype(np.float32)).astype(np.float32)


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors that the mask keeps."""
    m = mask[..., None].astype(np.float32)
    return (tokens * m).sum(-2) / np.maximum(m.sum(-2), 1e-9)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(text: pd.Series) -> pd.Series:
    return pd.Series(list(embed_texts(text.tolist())))


def embed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each chunk: node, place and vector."""
    cut = embedded_chunks(docs.select(F.col(id_col).cast("string").alias("id"), F.lit(None).cast("string").alias("head"), F.col(text_col).alias("text")))
    return cut.select(F.concat(F.lit("file_"), F.col("id")).alias("node_id"), "start_line", "end_line", "token_count", "embedding")


#: Chunks whose vectors are made and sent on at once (fixed value).
CHUNK_ROWS = 1024

_CHUNK = "chunk_index int, start_line int, end_line int, token_count int, embedding array<float>"


def embedded_chunks(docs: DataFrame, max_tokens: int = 240, overlap: int = 30) -> DataFrame:
    """The chunks of ``text`` with their vectors: chunk_index, start_line, end_line, token_count, embedding and every column besides
    ``head`` and ``text``. A vector is that of head, an empty line and chunk; a null head is left out.

    Chunking and embedding are one pass in one Python worker, which sends chunks on as they are made and holds no text twice.
    """
    carried = [c for c in docs.columns if c not in ("head", "text")]
    schema = T.StructType([docs.schema[c] for c in carried] + T._parse_datatype_string(_CHUNK).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch, found: list[tuple], texts: list[str]) -> pa.RecordBatch:
            row, index, start, end, tokens = (np.fromiter(c, np.int32, len(found)) for c in zip(*found, strict=True))
            vectors = embed_texts(texts)
            lists = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, vectors.shape[1], dtype=np.int32), vectors.ravel())
            own = [batch.column(c).take(pa.array(row)) for c in carried]
            return pa.RecordBatch.from_arrays([*own, *map(pa.array, (index, start, end, tokens)), lists], [*carried, "chunk_index", "start_line", "end_line", "token_count", "embedding"])

        for batch in batches:
            found: list[tuple] = []
            texts: list[str] = []
            for row, (head, text) in enumerate(zip(batch.column("head").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                for k, c in enumerate(chunk_text(text, max_tokens, overlap)):
                    found.append((row, k, c["start_line"], c["end_line"], c["token_count"]))
                    texts.append(c["text"] if head is None else f"{head}\n\n{c['text']}")
                    if len(found) == CHUNK_ROWS:
                        yield made(batch, found, texts)
                        found, texts = [], []
            if found:
                yield made(batch, found, texts)

    return docs.mapInArrow(run, schema)


# --- keyword search


def grep(docs: DataFrame, id_col: str, text_col: str, keyword: str, regex: bool = False, ignore_case: bool = True, before: int = 0, after: int = 5) -> DataFrame:
    """(id, line_no, line, is_match, grp): matching lines with context, in groups like grep's.

    Texts without the keyword are left out before their lines are made; neighbours are looked up
    within a text by frames over (id, line).
    """
    test = lambda c: c.rlike(("(?i)" if ignore_case else "") + keyword) if regex else (F.contains(F.lower(c), F.lit(keyword.lower())) if ignore_case else F.contains(c, F.lit(keyword)))
    held = docs.filter(test(F.col(text_col))) if not regex else docs
    rows = held.select(F.col(id_col).alias("id"), F.posexplode(lines(text_col)).alias("p", "line")).withColumn("line_no", F.col("p") + 1).withColumn("is_match", test(F.col("line")))
    by = Window.partitionBy("id").orderBy("line_no")
    shown = rows.withColumn("near", F.max("is_match").over(by.rowsBetween(-after, before))).filter("near")
    fresh = F.when(F.col("line_no") - F.lag("line_no").over(by) == 1, 0).otherwise(1)
    return shown.withColumn("fresh", fresh).withColumn("grp", F.sum("fresh").over(by)).select("id", "line_no", "line", "is_match", "grp")


def grouped_by_text(hits: DataFrame) -> DataFrame:
    """(id, matches, text): the lines of a text as one block, groups apart by '--'."""
    groups = hits.groupBy("id", "grp").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"), F.count_if("is_match").alias("n"))
    body = F.array_join(F.transform("l", lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), x["line"])), "\n")
    joined = groups.select("id", "n", F.struct("grp", body.alias("b")).alias("g")).groupBy("id").agg(F.sum("n").alias("matches"), F.array_sort(F.collect_list("g")).alias("gs"))
    return joined.select("id", "matches", F.array_join(F.transform("gs", lambda g: g["b"]), "\n--\n").alias("text"))


def name_pattern(name: str, kind: str = "function") -> str:
    """Regular expression for definitions whose name contains ``name``."""
    import re

    heads = {"function": r"(?:def|function|async function)\s+", "class": r"class\s+", "variable": r"(?:const|let|var)?\s*"}
    return heads.get(kind, r"") + r"\w*" + re.escape(name) + r"\w*"


def run_counters(vectors: DataFrame) -> DataFrame:
    """(project_id, files, blocks, chunks): what an embedding run made for each project."""
    node = lambda kind: F.count_distinct(F.when(F.col("node_id").startswith(kind), F.col("node_id")))
    return vectors.groupBy("project_id").agg(node("file_").alias("files"), node("block_").alias("blocks"), F.count("*").alias("chunks"))


def fallback_tokens(text: Column | str) -> Column:
    """Token numbers below 30,000 of white-space words, for want of a tokenizer: the same on every machine."""
    words = F.filter(F.split(F.trim(col(text)), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(30_000)).cast("int"))
