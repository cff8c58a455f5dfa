"""Every query of the engine by name, with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import paths as P
from lattica.functions import text as X
from lattica.operators import changes, delivery, diffs, graph, intervals, maintenance, memory, packing, retrieval, store
from lattica.plans.named import NAMED, run
from lattica.plans.views import Store, oracle
from lattica.sources import extract, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of a store under its name, with its SQL if there is any."""

    def register(f: Callable[[Store], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Store(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def _named(name: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Store(spark, sf_dir), name)
    ORACLES[name] = oracle(NAMED[name])


for _name in NAMED:
    _named(_name)

#: The vector that searches start from: any fixed one of the table's length.
PROBE = [((i * 37) % 64) / 64 - 0.5 for i in range(64)]
_PROBE = "[" + ", ".join(f"{x!r}::DOUBLE" for x in PROBE) + "]"


# --- graph


@query(
    """WITH e AS (SELECT DISTINCT source_id, target_id FROM {relationships}),
    c AS (SELECT id AS anchor_id, id AS file_id, file_path AS path, 0 AS depth, [id] AS seen, '' AS file_path FROM {files}
          UNION ALL SELECT c.anchor_id, f.id, c.path || ' -> ' || f.file_path, c.depth + 1, list_append(c.seen, f.id), f.file_path
          FROM c JOIN e ON e.source_id = c.file_id JOIN {files} f ON f.id = e.target_id WHERE c.depth < 5 AND NOT list_contains(c.seen, f.id))
    SELECT anchor_id, depth, file_id, file_path, path FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY depth, file_path, path) AS k FROM c WHERE depth > 0) x WHERE k <= 25"""
)
def r1_dependency_chain(s: Store) -> DataFrame:
    return graph.dependency_chain(s["relationships"], s["files"])


@query(
    """WITH t AS (SELECT id, CAST(id AS VARCHAR) AS ids, '' AS path, name FROM {code_blocks} WHERE parent_block_id IS NULL
    UNION ALL SELECT b.id, t.ids || ',' || CAST(b.id AS VARCHAR), CASE WHEN t.path = '' THEN t.name ELSE t.path || ' > ' || t.name END, b.name FROM t JOIN {code_blocks} b ON b.parent_block_id = t.id)
    SELECT id, ids, path FROM t"""
)
def r2_block_paths(s: Store) -> DataFrame:
    return graph.block_paths(s["code_blocks"]).select("id", F.array_join("ids", ",").alias("ids"), "path")


@query(
    """WITH t AS (SELECT id, CAST(1 AS BIGINT) AS depth FROM {code_blocks} WHERE parent_block_id IS NULL
          UNION ALL SELECT b.id, t.depth + 1 FROM t JOIN {code_blocks} b ON b.parent_block_id = t.id),
    p AS (SELECT id, file_id, parent_block_id, row_number() OVER (PARTITION BY parent_block_id, CASE WHEN parent_block_id IS NULL THEN file_id END ORDER BY start_line, id) AS position FROM {code_blocks})
    SELECT p.id, p.file_id, p.parent_block_id, t.depth, p.position FROM p JOIN t ON t.id = p.id"""
)
def j19_block_tree(s: Store) -> DataFrame:
    return graph.block_tree(s["code_blocks"])


@query("SELECT id FROM {code_blocks} WHERE trim(content) <> ''")
def r4_blocks_to_embed(s: Store) -> DataFrame:
    return graph.blocks_to_embed(s["code_blocks"]).select("id")


@query(
    """WITH e AS (SELECT DISTINCT source_id, target_id FROM {relationships}),
    fw AS (SELECT id AS anchor_id, id AS file_id, file_path AS path, 0 AS depth, [id] AS seen, '' AS file_path FROM {files}
           UNION ALL SELECT c.anchor_id, f.id, c.path || ' -> ' || f.file_path, c.depth + 1, list_append(c.seen, f.id), f.file_path
           FROM fw c JOIN e ON e.source_id = c.file_id JOIN {files} f ON f.id = e.target_id WHERE c.depth < 2 AND NOT list_contains(c.seen, f.id)),
    bw AS (SELECT id AS anchor_id, id AS file_id, 0 AS depth, [id] AS seen, '' AS file_path FROM {files}
           UNION ALL SELECT c.anchor_id, f.id, c.depth + 1, list_append(c.seen, f.id), f.file_path
           FROM bw c JOIN e ON e.target_id = c.file_id JOIN {files} f ON f.id = e.source_id WHERE c.depth < 2 AND NOT list_contains(c.seen, f.id)),
    m AS (SELECT x.id, o.file_id AS o_file, i.file_id AS i_file, coalesce(o.technology_name, i.technology_name, 'Unknown') AS technology, x.match_confidence
          FROM {connection_mappings} x LEFT JOIN {outgoing_connections} o ON o.id = x.sender_id LEFT JOIN {incoming_connections} i ON i.id = x.receiver_id WHERE x.match_confidence > 0.5),
    b AS (SELECT i_file AS anchor_id, o_file AS file_id, id AS mapping_id, 'receives_from' AS impact_type, technology, match_confidence FROM m
          UNION ALL SELECT o_file, i_file, id, 'sends_to', technology, match_confidence FROM m WHERE o_file IS DISTINCT FROM i_file)
    SELECT 'connection_impacts' AS section, b.anchor_id, b.file_id, f.file_path, b.mapping_id, b.impact_type, b.technology, b.match_confidence FROM b JOIN {files} a ON a.id = b.anchor_id LEFT JOIN {files} f ON f.id = b.file_id
    UNION ALL SELECT DISTINCT 'imports', r.source_id, r.target_id, f.file_path, NULL, NULL, NULL, NULL FROM {relationships} r JOIN {files} f ON f.id = r.target_id
    UNION ALL SELECT DISTINCT 'importers', r.target_id, r.source_id, f.file_path, NULL, NULL, NULL, NULL FROM {relationships} r JOIN {files} f ON f.id = r.source_id
    UNION ALL SELECT DISTINCT 'dependency_chain', anchor_id, file_id, file_path, NULL, NULL, NULL, NULL
              FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY depth, file_path, path) AS k FROM fw WHERE depth > 0) x WHERE k <= 25
    UNION ALL SELECT DISTINCT 'impact', anchor_id, file_id, file_path, NULL, NULL, NULL, NULL FROM bw WHERE depth > 0"""
)
def r5_search_scope(s: Store) -> DataFrame:
    return graph.search_scope(s["relationships"], s["files"], s["outgoing_connections"], s["incoming_connections"], s["connection_mappings"])


@query(
    """SELECT b.id, b.name, p.name AS parent_name, coalesce(k.n, 0) AS children, CASE WHEN b.parent_block_id IS NULL THEN 0 ELSE q.n - 1 END AS siblings, f.file_path, pr.name AS project_name
    FROM {code_blocks} b JOIN {files} f ON b.file_id = f.id JOIN {projects} pr ON f.project_id = pr.id LEFT JOIN {code_blocks} p ON p.id = b.parent_block_id
    LEFT JOIN (SELECT parent_block_id, count(*) AS n FROM {code_blocks} GROUP BY parent_block_id) k ON k.parent_block_id = b.id
    LEFT JOIN (SELECT parent_block_id, count(*) AS n FROM {code_blocks} GROUP BY parent_block_id) q ON q.parent_block_id = b.parent_block_id"""
)
def r8_block_details(s: Store) -> DataFrame:
    c = graph.block_context(s["code_blocks"], s["files"], s["projects"])
    return c.select("id", "name", F.col("parent.name").alias("parent_name"), F.size("children").alias("children"), F.size("siblings").alias("siblings"), "file_path", "project_name")


@query(
    """SELECT f.id AS file_id, f.file_path, p.name AS project_name, coalesce(b.n, 0) AS block_count, coalesce(i.n, 0) AS n_imports, coalesce(o.n, 0) AS n_importers
    FROM {files} f JOIN {projects} p ON p.id = f.project_id LEFT JOIN (SELECT file_id, count(*) AS n FROM {code_blocks} GROUP BY file_id) b ON b.file_id = f.id
    LEFT JOIN (SELECT source_id, count(DISTINCT target_id) AS n FROM {relationships} GROUP BY source_id) i ON i.source_id = f.id
    LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS n FROM {relationships} GROUP BY target_id) o ON o.target_id = f.id"""
)
def r7_file_context(s: Store) -> DataFrame:
    c = graph.file_context(s["files"], s["projects"], s["code_blocks"], s["relationships"])
    return c.select("file_id", "file_path", "project_name", "block_count", F.size("imports").alias("n_imports"), F.size("importers").alias("n_importers"))


@query(
    """SELECT c.id, count(m.id) AS n_mapped, min(m.sender_id) AS first_other FROM {incoming_connections} c LEFT JOIN {connection_mappings} m ON m.receiver_id = c.id GROUP BY c.id"""
)
def j14_mapped_counterparts(s: Store) -> DataFrame:
    c = graph.with_mapped(s["incoming_connections"], s["connection_mappings"], s["outgoing_connections"], incoming=True)
    return c.select("id", F.coalesce(F.size("mapped"), F.lit(0)).alias("n_mapped"), F.array_min(F.transform("mapped", lambda x: x["other_id"])).alias("first_other")).withColumn("n_mapped", F.greatest("n_mapped", F.lit(0)))


@query(
    """WITH w AS (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN file_path ELSE regexp_extract(file_path, '[^/]*$') END AS path FROM {files}),
    h AS (SELECT w.path, f.id, f.file_path, row_number() OVER (PARTITION BY w.path ORDER BY CASE WHEN f.file_path = w.path THEN 0 ELSE 1 END, f.file_path, f.id) AS k
          FROM w JOIN {files} f ON regexp_extract(f.file_path, '[^/]*$') = regexp_extract(w.path, '[^/]*$') AND (f.file_path = w.path OR ends_with(f.file_path, '/' || ltrim(w.path, '/'))))
    SELECT w.path, h.id AS file_id FROM w LEFT JOIN h ON h.path = w.path AND h.k = 1"""
)
def j16_path_resolution(s: Store) -> DataFrame:
    wanted = s["files"].select(F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise(P.basename("file_path")).alias("path"))
    return graph.resolve_paths(wanted, s["files"])


@query("SELECT f.file_path AS path, p.name AS project FROM {files} f LEFT JOIN {projects} p ON starts_with(f.file_path, p.path || '/')")
def j25_project_of_path(s: Store) -> DataFrame:
    return graph.longest_prefix(s["files"].select(F.col("file_path").alias("path")), s["projects"])


@query("SELECT DISTINCT f.file_path AS path, p.name AS project FROM {files} f LEFT JOIN {projects} p ON p.id = f.project_id")
def j26_parent_project(s: Store) -> DataFrame:
    return graph.parent_project(s["files"].select(F.col("file_path").alias("path")), s["files"], s["projects"])


@query("SELECT DISTINCT path FROM (SELECT file_path AS path FROM {files} UNION ALL SELECT '/repo/' UNION ALL SELECT regexp_extract(file_path, '^/repo/[^/]*/') FROM {files}) x")
def s12_listing(s: Store) -> DataFrame:
    return graph.list_paths(s["files"])


@query("SELECT regexp_extract(file_path, '^/(repo/[^/]*/)', 1) AS folder, count(*) AS files FROM {files} GROUP BY 1 UNION ALL SELECT 'repo/', count(*) FROM {files}")
def a21_folder_counts(s: Store) -> DataFrame:
    return graph.folder_counts(s["files"], 2)


@query("SELECT project_id, '/repo/p' || CAST(project_id AS VARCHAR) AS directory FROM {files} GROUP BY project_id")
def a13_common_directory(s: Store) -> DataFrame:
    return graph.common_path(s["files"], "project_id")


# --- retrieval


@query(
    f"""SELECT vec_id, node_id, round(list_distance(embedding::DOUBLE[], {_PROBE}), 6) AS distance FROM {{vectors}} ORDER BY distance, node_id, vec_id LIMIT 30"""
)
def v1_nearest_vectors(s: Store) -> DataFrame:
    return retrieval.nearest(s["vectors"], PROBE).select("vec_id", "node_id", "distance")


@query(
    """WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS distance FROM {embeddings} q JOIN {embeddings} v ON true WHERE q.vec_id % 50 = 0)
    SELECT query_id, k AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS k FROM d) x WHERE k <= 30"""
)
def v1_nearest_of_each(s: Store) -> DataFrame:
    q = s["embeddings"].filter("vec_id % 50 = 0")
    return retrieval.nearest_many(s["embeddings"], q).select("query_id", "rank", F.round("distance", 4).alias("distance"))


@query(
    f"""WITH n AS (SELECT *, round(list_distance(embedding::DOUBLE[], {_PROBE}), 6) AS distance FROM {{vectors}} ORDER BY distance, node_id, vec_id LIMIT 30),
    h AS (SELECT *, CAST(split_part(node_id, '_', 2) AS BIGINT) AS key FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY distance, vec_id) AS k FROM n) x WHERE node_id LIKE 'file%' OR k = 1),
    p AS (SELECT h.*, b.name AS block_name, q.name AS parent_name, c.n AS kids, coalesce(CASE WHEN h.node_id LIKE 'file%' THEN h.key END, b.file_id) AS file_id, b.content AS block_text
          FROM h LEFT JOIN {{code_blocks}} b ON b.id = h.key AND h.node_id NOT LIKE 'file%' LEFT JOIN {{code_blocks}} q ON q.id = b.parent_block_id
          LEFT JOIN (SELECT parent_block_id, count(*) AS n FROM {{code_blocks}} GROUP BY parent_block_id) c ON c.parent_block_id = h.key),
    r AS (SELECT p.*, f.file_path, f.content AS file_text, j.name AS project_name, row_number() OVER (ORDER BY distance, node_id, vec_id) AS node_index FROM p LEFT JOIN {{files}} f ON f.id = p.file_id LEFT JOIN {{projects}} j ON j.id = f.project_id)
    SELECT node_id, vec_id, block_name, parent_name, CASE WHEN node_id NOT LIKE 'file%' THEN coalesce(kids, 0) END AS n_children, file_path, project_name, chunk_start_line, chunk_end_line, distance,
           round(1 / (1 + distance), 6) AS similarity, CASE WHEN node_id LIKE 'file%' THEN file_text ELSE block_text END AS code, node_index, CAST(floor((node_index - 1) / 15.0) AS BIGINT) AS page FROM r"""
)
def v12_semantic_search(s: Store) -> DataFrame:
    return retrieval.semantic_search(s["vectors"], s["code_blocks"], s["files"], s["projects"], PROBE)


@query()
def v3_chunked_documents(s: Store) -> DataFrame:
    docs = s["documents"].select("doc_id", F.explode(retrieval.chunks()("text")).alias("c"))
    return docs.select("doc_id", "c.start_line", "c.end_line", "c.start", "c.end", "c.token_count")


@query()
def v9_chunk_embeddings(s: Store) -> DataFrame:
    return retrieval.embed_documents(s["documents"], "doc_id", "text").select("node_id", "start_line", "end_line", "token_count", F.size("embedding").alias("size"))


_GREP = r"""
WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents),
m AS (SELECT *, contains(lower(line), 'license') AS is_match FROM l),
n AS (SELECT *, max(is_match) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 FOLLOWING) AS near FROM m)
SELECT id, line_no, line, is_match FROM n WHERE near
"""


@query(_GREP)
def v13_keyword_search(s: Store) -> DataFrame:
    return retrieval.grep(s["documents"], "doc_id", "text", "license", before=1, after=5).drop("grp")


@query("SELECT doc_id AS id, count(*) AS matches FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l WHERE regexp_matches(lower(line), '\\b(?:mit|apache) license') GROUP BY doc_id")
def a19_hits_by_document(s: Store) -> DataFrame:
    hits = retrieval.grep(s["documents"], "doc_id", "text", r"\b(?:mit|apache) license", regex=True, after=0)
    return retrieval.grouped_by_text(hits).select("id", "matches")


# --- text functions over all documents


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, string_split(text, chr(10))[1] AS first_line FROM documents")
def f8_lines(s: Store) -> DataFrame:
    return s["documents"].select("doc_id", F.size(X.lines("text")).alias("n_lines"), F.element_at(X.lines("text"), 1).alias("first_line"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents")
def f10_line_slice(s: Store) -> DataFrame:
    return s["documents"].select("doc_id", X.line_slice("text", F.lit(2), F.lit(4)).alias("part"))


@query("SELECT doc_id, string_agg(printf('%4d | %s', i, line), chr(10) ORDER BY i) AS numbered FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) x GROUP BY doc_id")
def f11_numbered_lines(s: Store) -> DataFrame:
    return s["documents"].select("doc_id", X.number_lines("text").alias("numbered"))


@query()
def f15_line_chunks(s: Store) -> DataFrame:
    c = s["documents"].select("doc_id", F.posexplode(X.chunk_lines("text", size=20, threshold=30)).alias("k", "c"))
    return c.select("doc_id", "k", "c.start_line", "c.end_line", "c.total_lines", F.length("c.content").alias("chars"))


@query("SELECT doc_id, i + 1 AS start_line, least(i + 20, n) AS end_line FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(generate_series(0, len(string_split(text, chr(10))) - 1, 20)) AS i FROM documents) x")
def f16_fixed_chunks(s: Store) -> DataFrame:
    return s["documents"].select("doc_id", F.explode(X.fixed_chunks("text", 20)).alias("c")).select("doc_id", "c.start_line", "c.end_line")


@query("SELECT id, sha256(content) AS digest, md5(content) AS md5, 'elem_' || substr(md5(file_path || ':1-9:file:' || language), 1, 6) AS element FROM {files}")
def f6_digests(s: Store) -> DataFrame:
    e = X.element_id(F.col("file_path"), F.lit(1), F.lit(9), F.lit("file"), F.col("language"))
    return s["files"].select("id", F.sha2("content", 256).alias("digest"), F.md5("content").alias("md5"), e.alias("element"))


@query()
def f5_file_ids(s: Store) -> DataFrame:
    return s["files"].select("file_path", P.file_id("file_path").alias("id"), P.language("file_path").alias("language"), P.path_signature("file_path").alias("signature"))


@query("SELECT id, regexp_extract(file_path, '[^/]*$') AS base, regexp_extract(file_path, '^(.*)/', 1) AS parent, replace(file_path, '.py', '.ts') AS renamed FROM {files}")
def f32_path_parts(s: Store) -> DataFrame:
    return s["files"].select("id", P.basename("file_path").alias("base"), P.parent("file_path").alias("parent"), P.with_suffix("file_path", ".ts").alias("renamed"))


@query()
def f39_page_text(s: Store) -> DataFrame:
    return s["pages"].select("page_id", files.page_forms("html").alias("f")).select("page_id", "f.text", F.length("f.markdown").alias("markdown_chars"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/]+') AS valid FROM pages")
def f40_valid_urls(s: Store) -> DataFrame:
    return s["pages"].select("page_id", P.valid_url("url").alias("valid"))


@query("SELECT node_id, vec_id, round(1 / (1 + list_distance(embedding::DOUBLE[], " + _PROBE + ")), 5) AS similarity FROM {vectors}")
def f35_similarities(s: Store) -> DataFrame:
    return s["vectors"].select("node_id", "vec_id", F.round(X.similarity(retrieval.l2_distance("embedding", F.lit(PROBE))), 5).alias("similarity"))


# --- changes and maintenance


def _snapshots(s: Store) -> tuple[DataFrame, DataFrame]:
    docs = s["documents"]
    old = docs.filter("doc_id % 10 <> 3").select("doc_id", "text")
    new = docs.filter("doc_id % 10 <> 7").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return old, new


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 10 <> 7")
def t3_patched_snapshot(s: Store) -> DataFrame:
    old, new = (x.withColumn("digest", F.sha2("text", 256)).drop("text") for x in _snapshots(s))
    return changes.patch(old, new, changes.snapshot_changes(new, old, "doc_id", "digest"), "doc_id")


@query(NAMED["t6_compacted_changes"])
def t6_compacted_by_group(s: Store) -> DataFrame:
    return changes.compact(s["changes"])


@query("SELECT file_id % 5 AS project_id, count(CASE WHEN op = 'added' THEN 1 END) AS added, count(CASE WHEN op = 'modified' THEN 1 END) AS modified, count(CASE WHEN op = 'deleted' THEN 1 END) AS deleted FROM {changes} GROUP BY 1")
def t7_changes_by_type(s: Store) -> DataFrame:
    return changes.by_type(s["changes"].select((F.col("file_id") % 5).alias("project_id"), F.col("op").alias("change_type")))


@query(NAMED["a14_merged_ranges"])
def a14_merged_by_window(s: Store) -> DataFrame:
    return changes.merged_ranges(s["code_blocks"], "file_id")


@query(
    """WITH r AS (SELECT file_id AS k, start_line, id, end_line - start_line + 1 AS n, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS rn FROM {code_blocks}),
    g AS (SELECT k, rn, n AS used, 0 AS batch FROM r WHERE rn = 1
          UNION ALL SELECT r.k, r.rn, CASE WHEN g.used + r.n > 120 AND g.used > 0 THEN r.n ELSE g.used + r.n END, g.batch + CASE WHEN g.used + r.n > 120 AND g.used > 0 THEN 1 ELSE 0 END
          FROM g JOIN r ON r.k = g.k AND r.rn = g.rn + 1)
    SELECT r.k AS file_id, r.start_line, r.id, r.n, g.batch FROM g JOIN r ON r.k = g.k AND r.rn = g.rn"""
)
def n4_line_batches(s: Store) -> DataFrame:
    rows = s["code_blocks"].withColumn("n", F.col("end_line") - F.col("start_line") + 1)
    return packing.packed(rows, "file_id", ["start_line", "id"], "n", 120)


@query()
def n5_overlap_batches(s: Store) -> DataFrame:
    return packing.packed_with_overlap(s["code_blocks"].join(s["files"].select(F.col("id").alias("file_id"), "project_id"), "file_id"))


def _edited(s: Store) -> DataFrame:
    docs = s["documents"].select(F.col("doc_id").alias("file_id"), F.col("text").alias("old"))
    changed = F.array_join(F.transform(X.lines("old"), lambda l, i: F.when(i % 7 == 3, F.concat(l, F.lit(" edited"))).when(i % 11 == 5, F.concat(F.lit("new\n"), l)).otherwise(l)), "\n")
    return docs.withColumn("new", changed)


@query()
def f20_line_diffs(s: Store) -> DataFrame:
    d = _edited(s).select("file_id", diffs.diff("old", "new").alias("d"))
    return d.select("file_id", F.size("d.added").alias("added"), F.size("d.removed").alias("removed"), F.size("d.replaced").alias("replaced"))


@query()
def a16_diff_summary(s: Store) -> DataFrame:
    return diffs.diff_summary(_edited(s), "old", "new")


@query()
def t9_rebased_annotations(s: Store) -> DataFrame:
    return diffs.rebase_annotations(s["incoming_connections"].select("id", "file_id", "start_line", "end_line"), _edited(s))


@query(
    """SELECT l.file_id, l.line FROM (SELECT file_id, start_line + 2 AS line FROM {code_blocks}) l WHERE NOT EXISTS (SELECT 1 FROM {incoming_connections} c WHERE c.file_id = l.file_id AND l.line BETWEEN c.start_line AND c.end_line)"""
)
def j30_lines_outside_ranges(s: Store) -> DataFrame:
    lines = s["code_blocks"].select("file_id", (F.col("start_line") + 2).alias("line"))
    return intervals.lines_outside(lines, s["incoming_connections"])


@query(
    """SELECT b.id, c.id AS connection_id FROM {code_blocks} b JOIN {incoming_connections} c ON c.file_id = b.file_id AND b.start_line <= c.end_line AND c.start_line <= b.end_line"""
)
def p10_overlapping_ranges(s: Store) -> DataFrame:
    c = s["incoming_connections"].select("file_id", F.col("id").alias("connection_id"), F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
    return intervals.overlapping(s["code_blocks"], c).select("id", "connection_id")


_MOVES = "SELECT file_id, line, CASE WHEN line % 3 = 0 THEN 'delete' ELSE 'insert' END AS kind FROM (SELECT DISTINCT file_id, start_line + id % 7 AS line FROM {incoming_connections})"


@query(
    f"""WITH v AS ({_MOVES}), s AS (SELECT b.id, b.file_id, b.start_line, b.end_line, coalesce(sum(CASE WHEN v.line < b.start_line THEN CASE v.kind WHEN 'insert' THEN 1 ELSE -1 END END), 0) AS a,
    coalesce(sum(CASE v.kind WHEN 'insert' THEN 1 WHEN 'delete' THEN -1 END), 0) AS z
    FROM {{code_blocks}} b LEFT JOIN v ON v.file_id = b.file_id AND v.line <= b.end_line GROUP BY b.id, b.file_id, b.start_line, b.end_line)
    SELECT id, CAST(start_line + a AS BIGINT) AS new_start, CAST(end_line + z AS BIGINT) AS new_end FROM s"""
)
def f22_shifted_ranges(s: Store) -> DataFrame:
    return intervals.shift_ranges(s["code_blocks"], s.sql(_MOVES)).select("id", "new_start", "new_end")


@query(NAMED["p21_unmapped_connections"])
def p21_unmapped_connections(s: Store) -> DataFrame:
    o = s["outgoing_connections"].select(F.col("id").alias("sender_id"), F.col("file_id").alias("sender_file"))
    i = s["incoming_connections"].select(F.col("id").alias("receiver_id"), F.col("file_id").alias("receiver_file"))
    m = s["connection_mappings"].join(o, "sender_id", "left").join(i, "receiver_id", "left")
    side = lambda d, own, key, file, other: own.select(F.lit(d).alias("direction"), F.col(key).alias("id"), F.col(file).alias("file_id")).join(m.select(F.col(key).alias("id"), F.col(other).alias("other_file_id")), "id", "left").distinct()
    ends = side("incoming", i, "receiver_id", "receiver_file", "sender_file").unionByName(side("outgoing", o, "sender_id", "sender_file", "receiver_file"))
    return graph.unmapped(ends, m.filter("match_confidence > 0.5")).select("direction", "id", "file_id", "other_file_id")


_TEXT_FILES = "SELECT doc_id AS id, '/repo/' || lang || '/' || source || '/' || CAST(doc_id AS [[STRING|VARCHAR]]) || '.txt' AS file_path, text AS content FROM {documents}"
_WANTED = """SELECT CASE WHEN id % 3 = 0 THEN file_path WHEN id % 3 = 1 THEN regexp_extract(file_path, '[^/]*/[^/]*$', 0) ELSE 'x/' || CAST(id AS [[STRING|VARCHAR]]) || '.txt' END AS path,
    CASE WHEN id % 4 < 2 THEN id % 9 END AS start_line, CASE WHEN id % 4 < 3 AND id % 4 > 0 THEN id % 40 END AS end_line FROM {f}"""


@query(
    f"""WITH f AS ({_TEXT_FILES}), w AS ({_WANTED.replace("{f}", "f")}),
    h AS (SELECT w.*, f.id AS file_id, f.file_path, f.content, string_split(f.content, chr(10)) AS l FROM w JOIN f ON f.file_path = w.path OR ends_with(f.file_path, '/' || ltrim(w.path, '/'))),
    c AS (SELECT *, len(l) AS n, start_line IS NOT NULL OR end_line IS NOT NULL AS bounded, greatest(0, least(coalesce(start_line - 1, 0), len(l) - 1)) AS a FROM h),
    d AS (SELECT *, greatest(a + 1, least(coalesce(end_line, n), n)) AS z FROM c),
    e AS (SELECT path, file_id, file_path, CASE WHEN bounded AND content <> '' THEN array_to_string(l[a + 1:z], chr(10)) ELSE content END AS content, CAST(CASE WHEN bounded THEN coalesce(start_line, 1) END AS BIGINT) AS start_line,
          CAST(CASE WHEN bounded THEN coalesce(end_line, n) END AS BIGINT) AS end_line FROM d),
    p AS (SELECT x.id, o.file_id, o.start_line AS a, o.end_line AS z FROM {{connection_mappings}} x JOIN {{outgoing_connections}} o ON o.id = x.sender_id
          UNION ALL SELECT x.id, i.file_id, i.start_line, i.end_line FROM {{connection_mappings}} x JOIN {{incoming_connections}} i ON i.id = x.receiver_id)
    SELECT e.path, e.file_id, e.file_path, e.content, coalesce(e.start_line, 0) AS start_line, coalesce(e.end_line, 0) AS end_line, coalesce((SELECT string_agg(DISTINCT CAST(p.id AS VARCHAR), ',' ORDER BY CAST(p.id AS VARCHAR)) FROM p WHERE p.file_id = e.file_id AND (e.start_line IS NULL OR (p.a <= e.end_line AND e.start_line <= p.z))), '') AS mappings FROM e"""
)
def get_file_by_path(s: Store) -> DataFrame:
    f = s.sql(_TEXT_FILES)
    out = graph.file_windows(s.sql(_WANTED, f=f), f, s["outgoing_connections"], s["incoming_connections"], s["connection_mappings"])
    ids = F.array_join(F.array_sort(F.transform("mappings", lambda x: x.cast("string"))), ",")
    bound = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return out.select("path", "file_id", "file_path", "content", bound("start_line"), bound("end_line"), ids.alias("mappings"))


_ASKED = "SELECT CASE WHEN id % 2 = 0 THEN file_path ELSE regexp_extract(file_path, '[^/]*/[^/]*$', 0) END AS path FROM {files}"


@query(
    f"""WITH w AS (SELECT DISTINCT path FROM ({_ASKED})), h AS (SELECT w.path, f.id AS file_id FROM w JOIN {{files}} f ON ends_with('/' || f.file_path, '/' || ltrim(w.path, '/'))),
    t AS (SELECT id, '' AS above, name FROM {{code_blocks}} WHERE parent_block_id IS NULL
          UNION ALL SELECT b.id, CASE WHEN t.above = '' THEN t.name ELSE t.above || ' > ' || t.name END, b.name FROM t JOIN {{code_blocks}} b ON b.parent_block_id = t.id)
    SELECT h.path, h.file_id, b.id AS block_id, b.type, b.name, b.start_line, b.end_line, coalesce(u.above, '') AS above, b.position
    FROM h JOIN (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS position FROM {{code_blocks}}) b ON b.file_id = h.file_id
    LEFT JOIN t u ON u.id = b.id"""
)
def get_file_block_summary(s: Store) -> DataFrame:
    return graph.block_summary(s.sql(_ASKED), s["files"], s["code_blocks"])


@query("SELECT 'code_blocks' AS t, count(*) AS n FROM {code_blocks} b JOIN {files} f ON f.id = b.file_id WHERE f.project_id <> 2 UNION ALL SELECT 'files', count(*) FROM {files} WHERE project_id <> 2 UNION ALL SELECT 'vectors', count(*) FROM {vectors} WHERE project_id <> 2")
def w12_cascade_counts(s: Store) -> DataFrame:
    names = ("projects", "files", "code_blocks", "relationships", "incoming_connections", "outgoing_connections", "connection_mappings", "vectors")
    out = store.delete_project({t: s[t] for t in names}, "ASIA")
    count = lambda t: out[t].agg(F.lit(t).alias("t"), F.count("*").alias("n"))
    return count("code_blocks").unionAll(count("files")).unionAll(count("vectors"))


@query(
    """WITH r AS (SELECT file_id AS k, start_line, id, CAST(len(string_split(code_snippet, chr(10))) AS BIGINT) AS n, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS rn FROM {outgoing_connections}),
    g AS (SELECT k, rn, n AS used, 0 AS batch FROM r WHERE rn = 1
          UNION ALL SELECT r.k, r.rn, CASE WHEN g.used + r.n > 50 AND g.used > 0 THEN r.n ELSE g.used + r.n END, g.batch + CASE WHEN g.used + r.n > 50 AND g.used > 0 THEN 1 ELSE 0 END
          FROM g JOIN r ON r.k = g.k AND r.rn = g.rn + 1)
    SELECT r.k AS file_id, r.start_line, r.id, r.n AS n_lines, g.batch FROM g JOIN r ON r.k = g.k AND r.rn = g.rn"""
)
def t15_delivery_pages(s: Store) -> DataFrame:
    return delivery.by_lines(s["outgoing_connections"], "file_id", ["start_line", "id"], "code_snippet", 50)


@query(
    """WITH n AS (SELECT file_id AS session, CAST(ceil(count(*) / 30.0) AS BIGINT) AS total FROM {code_blocks} GROUP BY file_id),
    r AS (SELECT session, total, CASE WHEN session % 2 = 0 THEN 'blocks' ELSE 'names' END AS signature, CASE WHEN session % 2 = 0 AND total > 1 THEN 1 ELSE 0 END AS page FROM n)
    SELECT session, signature, page, page + 1 AS position, total, page + 1 >= total AS complete FROM r"""
)
def t15_delivery_cursor(s: Store) -> DataFrame:
    pages = delivery.by_count(s["code_blocks"], 30, "start_line", "id", within=["file_id"])
    queues = pages.groupBy(F.col("file_id").alias("session")).agg(F.max("pages").alias("total"))
    opened = delivery.register(queues.select("session", F.lit(None).cast("string").alias("signature"), F.lit(0).alias("position"), "total", F.lit(False).alias("complete")), queues.withColumn("signature", F.lit("blocks")))
    asked = queues.withColumn("signature", F.when(F.col("session") % 2 == 0, "blocks").otherwise("names"))
    return delivery.advance(delivery.register(delivery.advance(opened).drop("page"), asked))


@query("SELECT file_id, CAST(ceil(count(*) / 30.0) AS BIGINT) AS total, least(1, CAST(ceil(count(*) / 30.0) AS BIGINT)) AS delivered FROM {code_blocks} GROUP BY file_id")
def t16_delivery_status(s: Store) -> DataFrame:
    pages = delivery.by_count(s["code_blocks"], 30, "start_line", "id", within=["file_id"])
    return delivery.status(pages, "file_id", 1).select("file_id", "total", "delivered")


@query("SELECT min(id) AS id, description FROM (SELECT id, regexp_replace(lower(trim(description)), '\\s+', ' ', 'g') AS description FROM {outgoing_connections}) x GROUP BY description")
def z39_distinct_tasks(s: Store) -> DataFrame:
    t = memory.deduplicated(s["outgoing_connections"].select("id", "description"))
    return t.select("id", F.regexp_replace(F.lower(F.trim("description")), r"\s+", " ").alias("description"))


@query(
    """WITH p AS (SELECT id, file_path, string_split(regexp_replace(regexp_replace(ltrim(file_path, '/'), '\\.pyi?$', ''), '/__init__$', ''), '/') AS parts FROM {files}),
    e AS (SELECT id, file_path, array_to_string(parts[i:], '.') AS module FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM p))
    SELECT module, arg_max(id, ROW(file_path, id)) AS file_id FROM e GROUP BY module"""
)
def x15_registry_of_paths(s: Store) -> DataFrame:
    return extract.module_registry(s["files"].select("id", "file_path", F.lit("python").alias("language")))


@query(
    r"""WITH o AS (SELECT id, technology_name AS t, list_distinct(regexp_extract_all(lower(code_snippet), '[\pL\pN]+')) AS w FROM {outgoing_connections}),
    i AS (SELECT id, technology_name AS t, list_distinct(regexp_extract_all(lower(code_snippet), '[\pL\pN]+')) AS w FROM {incoming_connections})
    SELECT o.id AS sender_id, i.id AS receiver_id FROM o JOIN i ON ((o.t = i.t) OR o.t IS NULL OR i.t IS NULL) WHERE len(o.w) > 0 AND 2 * len(list_intersect(o.w, i.w)) >= len(o.w)"""
)
def j27_connection_matches(s: Store) -> DataFrame:
    return maintenance.content_matches(s["outgoing_connections"], s["incoming_connections"]).select("sender_id", "receiver_id")


@query(
    """WITH p AS (SELECT string_split(ltrim(file_path, '/'), '/') AS parts FROM {files}),
    f AS (SELECT folder, depth, count(*) AS files FROM (SELECT array_to_string(parts[1:depth], '/') || '/' AS folder, depth FROM (SELECT parts, unnest(generate_series(1, least(4, len(parts) - 1))) AS depth FROM p)) x GROUP BY folder, depth),
    c AS (SELECT a.depth, count(*) AS n FROM (SELECT DISTINCT depth FROM f) a JOIN f ON f.depth <= a.depth GROUP BY a.depth)
    SELECT folder, depth, files FROM f WHERE depth <= (SELECT coalesce(max(depth), 1) FROM c WHERE n <= 100)"""
)
def s13_workspace_tree(s: Store) -> DataFrame:
    return maintenance.workspace_tree(s["files"])


#: Names that a connection may have, and what others are corrected to: two of them to one name (fixed values of these queries).
VALID = ("HTTP/HTTPS", "WebSockets", "MessageQueue", "Unknown")
CORRECTED = {"gRPC": "HTTP/HTTPS", "GraphQL": "HTTP/HTTPS", "Unknown": "MessageQueue"}


@query("SELECT DISTINCT coalesce(technology_name, 'Unknown') AS technology FROM {outgoing_connections} WHERE coalesce(technology_name, 'Unknown') NOT IN ('HTTP/HTTPS', 'WebSockets', 'MessageQueue', 'Unknown')")
def p19_names_to_correct(s: Store) -> DataFrame:
    return maintenance.unmatched_technologies(s["outgoing_connections"], VALID)


@query("SELECT id, CASE coalesce(technology_name, 'Unknown') WHEN 'gRPC' THEN 'HTTP/HTTPS' WHEN 'GraphQL' THEN 'HTTP/HTTPS' WHEN 'Unknown' THEN 'MessageQueue' ELSE technology_name END AS technology_name FROM {outgoing_connections}")
def f29_corrected_names(s: Store) -> DataFrame:
    return maintenance.with_corrected_technologies(s["outgoing_connections"], CORRECTED).select("id", "technology_name")


@query(
    """WITH f AS (SELECT id, lower(regexp_extract(file_path, '[^/](\\.[^./]*)$', 1)) AS x FROM {files})
    SELECT s.x AS source_extension, t.x AS target_extension, count(*) AS n FROM {relationships} r JOIN f s ON r.source_id = s.id JOIN f t ON r.target_id = t.id GROUP BY s.x, t.x"""
)
def a20_edges_by_extension(s: Store) -> DataFrame:
    return maintenance.edges_by_extension(s["relationships"], s["files"])


@query(
    """SELECT b.id AS block_id, 'outgoing' AS direction, m.id AS mapping_id FROM {connection_mappings} m JOIN {outgoing_connections} o ON o.id = m.sender_id JOIN {code_blocks} b ON b.file_id = o.file_id AND b.start_line <= o.end_line AND o.start_line <= b.end_line
    UNION ALL SELECT b.id, 'incoming', m.id FROM {connection_mappings} m JOIN {incoming_connections} i ON i.id = m.receiver_id JOIN {code_blocks} b ON b.file_id = i.file_id AND b.start_line <= i.end_line AND i.start_line <= b.end_line"""
)
def r6_block_mappings(s: Store) -> DataFrame:
    return maintenance.block_mappings(s["code_blocks"], s["outgoing_connections"], s["incoming_connections"], s["connection_mappings"])


@query(
    r"""WITH RECURSIVE l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE contains(lower(text), 'license')),
    m AS (SELECT id, line_no, max(contains(lower(line), 'license')) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS near FROM l),
    k AS (SELECT id, line_no, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY id ORDER BY line_no) = 1 THEN 0 ELSE 1 END AS fresh FROM m WHERE near),
    r AS (SELECT id, count(*) + sum(fresh) - 1 AS n_lines, row_number() OVER (ORDER BY id) AS rn FROM k GROUP BY id),
    g AS (SELECT rn, n_lines AS used, 0 AS chunk FROM r WHERE rn = 1
          UNION ALL SELECT r.rn, CASE WHEN g.used > 0 AND g.used + r.n_lines > 40 THEN r.n_lines ELSE g.used + r.n_lines END, g.chunk + CASE WHEN g.used > 0 AND g.used + r.n_lines > 40 THEN 1 ELSE 0 END
          FROM g JOIN r ON r.rn = g.rn + 1)
    SELECT r.id, CAST(r.n_lines AS BIGINT) AS n_lines, g.chunk FROM g JOIN r ON r.rn = g.rn"""
)
def f17_grouped_chunks(s: Store) -> DataFrame:
    hits = retrieval.grouped_by_text(retrieval.grep(s["documents"], "doc_id", "text", "license"))
    return maintenance.grouped_chunks(hits, 40)


@query()
def t10_modified_files(s: Store) -> DataFrame:
    return maintenance.modified_files(s["incoming_connections"].select("id", "file_id", "start_line", "end_line"), _edited(s))[1]


@query()
def v10_block_vectors(s: Store) -> DataFrame:
    v = maintenance.embed_blocks(s["code_blocks"], s["files"])
    return v.select("node_id", "chunk_index", "chunk_start_line", "chunk_end_line", F.size("embedding").alias("size"))


@query(
    "SELECT m.id, sf.file_path || ' -> ' || rf.file_path || ' [' || coalesce(o.technology_name, 'Unknown') || ', ' || CAST(CAST(round(100 * m.match_confidence) AS INTEGER) AS VARCHAR) || '%]' AS line "
    "FROM {connection_mappings} m JOIN {outgoing_connections} o ON o.id = m.sender_id JOIN {incoming_connections} i ON i.id = m.receiver_id JOIN {files} sf ON sf.id = o.file_id JOIN {files} rf ON rf.id = i.file_id"
)
def f38_mapping_lines(s: Store) -> DataFrame:
    o = s["outgoing_connections"].select(F.col("id").alias("sender_id"), F.col("file_id").alias("a"), "technology_name")
    i = s["incoming_connections"].select(F.col("id").alias("receiver_id"), F.col("file_id").alias("b"))
    f = s["files"]
    met = s["connection_mappings"].join(o, "sender_id").join(i, "receiver_id").join(f.select(F.col("id").alias("a"), F.col("file_path").alias("x")), "a").join(f.select(F.col("id").alias("b"), F.col("file_path").alias("y")), "b")
    return met.select("id", maintenance.shown_mapping(F.col("x"), F.col("y"), F.col("technology_name"), F.col("match_confidence")).alias("line"))


# --- queries that run an operator against the SQL of the same name


@query(f"""SELECT node_id, vec_id, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(list_distance(embedding::DOUBLE[], {_PROBE}), 6), vec_id) AS k FROM {{vectors}}) x WHERE k = 1 OR node_id LIKE 'file%'""")
def a10_best_chunk_of_node(s: Store) -> DataFrame:
    near = s["vectors"].withColumn("similarity", -F.round(retrieval.l2_distance("embedding", F.lit(PROBE)), 6))
    return retrieval.best_per_node(near).select("node_id", "vec_id", "chunk_index")


@query(NAMED["j2_implementation_context"])
def j2_implementation_context(s: Store) -> DataFrame:
    return graph.implementation_context(s["code_blocks"], s["files"])


@query(NAMED["j11_external_connections"])
def j11_external_connections(s: Store) -> DataFrame:
    return graph.external_connections(s["files"], s["incoming_connections"], s["outgoing_connections"])


@query(NAMED["w3_keep_last_file"])
def w3_keep_last_file(s: Store) -> DataFrame:
    return store.keep_last(s["changes"], ["file_id"], "ts", "event_id").select("file_id", "code")


@query(NAMED["w5_keep_first_relationship"])
def w5_keep_first_relationship(s: Store) -> DataFrame:
    return store.keep_first(s["relationships"], ["source_id", "target_id", "type"], "import_content").select("source_id", "target_id", "type", "import_content")


@query(NAMED["w14_restored_connections"])
def w14_restored_connections(s: Store) -> DataFrame:
    return store.restore_connections(s["incoming_connections"], s["files"].filter("project_id <> 2")).select("id")


@query(
    """SELECT p.id, CASE WHEN p.id % 2 = 1 THEN 'seen ' || p.name ELSE p.description END AS description, p.cross_indexing_done OR p.id = 1 AS cross_indexing_done FROM {projects} p"""
)
def w19_updated_descriptions(s: Store) -> DataFrame:
    news = s["projects"].filter("id % 2 = 1").select("id", F.concat(F.lit("seen "), "name").alias("description"), F.when(F.col("id") == 1, True).alias("cross_indexing_done"))
    return store.update(s["projects"], news, "id", ["description", "cross_indexing_done"]).select("id", "description", "cross_indexing_done")


@query(NAMED["a15_consecutive_lines"])
def a15_consecutive_lines(s: Store) -> DataFrame:
    return changes.consecutive(s["code_blocks"].select("file_id", (F.col("start_line") + F.col("id") % 3).alias("line")), "file_id")


@query(NAMED["t6_compacted_changes"])
def t6_compacted_changes(s: Store) -> DataFrame:
    return changes.compact(s["changes"])


@query(NAMED["j28_snapshot_compare"])
def j28_snapshot_compare(s: Store) -> DataFrame:
    old, new = (s[t].select("doc_id", F.sha2("text", 256).alias("content_hash")) for t in ("old_documents", "new_documents"))
    return changes.snapshot_changes(new, old, "doc_id").withColumn("change", F.col("change"))


@query("SELECT file_id, op, code FROM {changes}")
def z5_changes_newest_first(s: Store) -> DataFrame:
    return changes.newest_first(s["changes"], "ts", "event_id").select("file_id", "op", "code")


@query("SELECT DISTINCT technology_name AS technology FROM {outgoing_connections} WHERE technology_name IS NOT NULL")
def z19_technology_keys(s: Store) -> DataFrame:
    named = s["outgoing_connections"].filter("technology_name IS NOT NULL").select("file_id", "technology_name").distinct()
    return store.technologies_of(named.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("technology_name", "file_id"))).alias("m")), "m")


@query("SELECT file_id, string_agg(code_snippet, chr(10) || chr(10) ORDER BY id) AS context FROM {outgoing_connections} WHERE code_snippet IS NOT NULL GROUP BY file_id")
def z15_snippet_context(s: Store) -> DataFrame:
    return memory.snippet_context(s["outgoing_connections"], "file_id")


@query(
    """SELECT coalesce(c.technology_name, 'Unknown') AS technology, count(*) AS n,
    string_agg('- ' || coalesce(f.file_path, '?') || ':' || CAST(c.start_line AS VARCHAR) || '-' || CAST(c.end_line AS VARCHAR), chr(10) ORDER BY f.file_path NULLS FIRST, c.start_line, c.id) AS shown
    FROM {incoming_connections} c LEFT JOIN {files} f ON f.id = c.file_id WHERE NOT EXISTS (SELECT 1 FROM {connection_mappings} m WHERE m.receiver_id = c.id) GROUP BY 1"""
)
def z37_unmapped_connections(s: Store) -> DataFrame:
    free = s["incoming_connections"].join(s["connection_mappings"].select(F.col("receiver_id").alias("id")), "id", "left_anti")
    return maintenance.grouped_connections(free, s["files"])


@query(
    """WITH t AS (SELECT id AS root, id FROM {code_blocks} WHERE parent_block_id IS NULL UNION ALL SELECT t.root, b.id FROM t JOIN {code_blocks} b ON b.parent_block_id = t.id)
    SELECT root AS id, count(*) AS n_blocks FROM t GROUP BY root"""
)
def a23_blocks_of_trees(s: Store) -> DataFrame:
    return graph.block_counts(s["code_blocks"])


@query(
    """SELECT project_id, count(DISTINCT CASE WHEN node_id LIKE 'file%' THEN node_id END) AS files, count(DISTINCT CASE WHEN node_id LIKE 'block%' THEN node_id END) AS blocks, count(*) AS chunks
    FROM {vectors} GROUP BY project_id"""
)
def a25_embedding_counters(s: Store) -> DataFrame:
    return retrieval.run_counters(s["vectors"])


@query("SELECT file_id AS project_id, id AS old_id, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS id FROM {outgoing_connections}")
def t14_reassigned_ids(s: Store) -> DataFrame:
    t = s["outgoing_connections"].select(F.col("file_id").alias("project_id"), F.col("id").alias("old_id"), "id", "start_line")
    return memory.reassigned(t, "start_line", "old_id", within=["project_id"]).drop("start_line")


@query("SELECT file_id, op FROM {changes} WHERE file_id % 2 = 0 UNION ALL SELECT user_id, event_type FROM {events} WHERE event_type IN ('added', 'modified', 'deleted') UNION ALL SELECT file_id, op FROM {changes}")
def z24_appended_changes(s: Store) -> DataFrame:
    log = s["changes"].filter("file_id % 2 = 0").select("file_id", "op")
    raw = s["events"].select(F.col("user_id").alias("file_id"), F.col("event_type").alias("op"))
    return memory.append_changes(log, raw.unionByName(s["changes"].select("file_id", "op")))
