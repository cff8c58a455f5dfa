"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import byte_bpe, centroids, decontamination, jaccard_join, license_scan, line_dedup, personal_data, quality_rules, substring_dedup, token_counts, toxicity, warc, whitening
from lattica.llm.common import read


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.capture_histories(read(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    table = byte_bpe.load_ranks(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(read(spark, sf_dir, "documents"), table, public_tokenizers.PATTERN, digests=True, tokens=False).withColumnRenamed("_id", "doc_id")


def op4_license_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents")).drop("spans")


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digest(substring_dedup.substring_dedup(read(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(read(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_index_merge, op2_quality_cascade, op3_byte_bpe, op4_license_fuzzy, op5_toxicity_crf, op6_jaccard_join,
        op7_decontamination, op8_token_counts, op9_substring_dedup, op10_line_dedup, op11_centroid_clusters,
        op12_personal_data, op13_embedding_whitening, pipeline,
    )
}

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""

_QUALITY = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             coalesce(l.n_lines, 0) AS n_lines, length(regexp_replace(text, '[^\pL]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS uppers
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)
            OR 2 * letters < word_chars OR 10 * uppers > 7 * word_chars) AS kept
FROM f
"""

_DECONTAMINATION = r"""
WITH q AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
qk AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM q WHERE len(ws) > 0),
qs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + k - 1], ' ') AS s FROM (SELECT item_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM qk)),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM qk) WHERE len(ws) >= k)),
n AS (SELECT item_id, count(*) AS n_shingles FROM qs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_found FROM qs JOIN ds USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM m JOIN n USING (item_id) WHERE n_found >= n_shingles * 0.8 - 1e-9
"""

_SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM r),
k AS (SELECT x.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN x.word END, ' ' ORDER BY x.p) AS kept
      FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w) x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

_LINES = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, ls[i:i + 2] AS win FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls) - 2)) AS i FROM l WHERE len(ls) >= 3)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM g WHERE regexp_matches(array_to_string(win, ''), '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 2)) AS p FROM n WHERE k > 1),
k AS (SELECT x.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN x.line END, chr(10) ORDER BY x.p) AS kept
      FROM (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS p FROM l) x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""



def _clusters() -> str:
    """Three rounds and a last assignment, each over the one row that holds all centroids in order."""
    far = "list_transform(cs, lambda c: list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        "c0 AS MATERIALIZED (SELECT list(x ORDER BY h) AS cs FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16))",
    ]
    for r in range(4):
        steps.append(f"d{r} AS MATERIALIZED (SELECT vec_id, x, {far} AS ds FROM v, c{r})")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster, CAST(list_min(ds) AS BIGINT) AS distance FROM d{r})")
        if r < 3:
            steps.append(f"s{r} AS (SELECT cluster, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT cluster, x, unnest(generate_series(1, 64)) AS i FROM a{r}) GROUP BY cluster, i)")
            steps.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY cluster)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT list(coalesce(m, cs[k + 1]) ORDER BY k) AS cs FROM (SELECT cs, unnest(generate_series(0, len(cs) - 1)) AS k FROM c{r}) LEFT JOIN m{r} ON cluster = k)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, a3.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a3.cluster) AS BIGINT) AS cluster_inertia,"
        " CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(cs[a3.cluster + 1], ',')) AS centroid_sha256 FROM a3, c3"
    )


#: The others are tested against the tokenizers' libraries, brute force and held-out labels.
ORACLES: dict[str, str] = {
    "op1_warc_index_merge": _WARC,
    "op2_quality_cascade": _QUALITY,
    "op7_decontamination": _DECONTAMINATION,
    "op9_substring_dedup": _SUBSTRINGS,
    "op10_line_dedup": _LINES,
    "op11_centroid_clusters": _clusters(),
}
