"""Named relational queries: SQL for Catalyst, over whole tables. A key filter on the result is pushed to the scans.

Where the original semantics has LIMIT for one key, the limit holds for each key, by a window with a tiebreaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.views import Store

_CONNECTION = """
    SELECT c.id, c.description, c.technology_name, c.code_snippet, c.start_line, c.end_line, f.file_path AS file_path, f.language, p.name AS project_name, c.file_id,
           m.match_confidence, o.file_path AS other_path, op.name AS other_project
    FROM {{{own}}} c JOIN {{files}} f ON c.file_id = f.id JOIN {{projects}} p ON f.project_id = p.id
    LEFT JOIN {{connection_mappings}} m ON m.{key} = c.id LEFT JOIN {{{other}}} x ON m.{far} = x.id LEFT JOIN {{files}} o ON x.file_id = o.id LEFT JOIN {{projects}} op ON o.project_id = op.id"""

NAMED: dict[str, str] = {
    # --- block and file lookups
    "j1_block_lookup": """
        SELECT cb.id AS block_id, cb.type, cb.name, cb.content, cb.start_line, cb.end_line, cb.parent_block_id, f.file_path, f.language, p.name AS project_name
        FROM {code_blocks} cb JOIN {files} f ON cb.file_id = f.id JOIN {projects} p ON f.project_id = p.id""",
    "j2_implementation_context": """
        SELECT cb.id AS block_id, cb.file_id, cb.type, cb.name, cb.start_line, cb.end_line, parent.name AS parent_name, parent.type AS parent_type, f.file_path
        FROM {code_blocks} cb LEFT JOIN {code_blocks} parent ON cb.parent_block_id = parent.id JOIN {files} f ON cb.file_id = f.id""",
    "j3_file_lookup": """
        SELECT f.id AS file_id, f.file_path, f.language, f.content, p.name AS project_name, coalesce(b.n, 0) AS block_count
        FROM {files} f JOIN {projects} p ON f.project_id = p.id LEFT JOIN (SELECT file_id, count(*) AS n FROM {code_blocks} GROUP BY file_id) b ON b.file_id = f.id""",
    "j4_file_block_summary": """
        SELECT cb.file_id, cb.id AS block_id, cb.type, cb.name, cb.start_line, cb.end_line, cb.parent_block_id, f.file_path, p.name AS project_name,
               row_number() OVER (PARTITION BY cb.file_id ORDER BY cb.start_line, cb.id) AS position
        FROM {code_blocks} cb JOIN {files} f ON cb.file_id = f.id JOIN {projects} p ON f.project_id = p.id""",
    "j5_child_blocks": """
        SELECT parent_block_id, id AS block_id, type, name, start_line, end_line FROM {code_blocks} WHERE parent_block_id IS NOT NULL""",
    "j6_parent_block": """
        SELECT c.id AS child_id, p.id AS block_id, p.type, p.name, p.start_line, p.end_line FROM {code_blocks} c JOIN {code_blocks} p ON p.id = c.parent_block_id""",
    "j7_imports": """
        SELECT r.source_id, f.id AS target_id, f.file_path, f.language, r.import_content, p.name AS project_name
        FROM {relationships} r JOIN {files} f ON r.target_id = f.id JOIN {projects} p ON f.project_id = p.id""",
    "j8_impact_scope": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY relationship_type, file_path, file_id) AS position FROM (
                SELECT r.target_id AS anchor_id, 'importer' AS relationship_type, f.id AS file_id, f.file_path, f.language, r.import_content FROM {relationships} r JOIN {files} f ON r.source_id = f.id
                UNION ALL
                SELECT r.source_id, 'dependency', f.id, f.file_path, f.language, r.import_content FROM {relationships} r JOIN {files} f ON r.target_id = f.id) u) v
        WHERE position <= 25""",
    "j8_importers": """
        SELECT r.target_id AS file_id, f.id AS importer_id, f.file_path, f.language, r.import_content FROM {relationships} r JOIN {files} f ON r.source_id = f.id""",
    # --- connections
    "j9_incoming": _CONNECTION.format(own="incoming_connections", other="outgoing_connections", key="receiver_id", far="sender_id"),
    "j10_outgoing": _CONNECTION.format(own="outgoing_connections", other="incoming_connections", key="sender_id", far="receiver_id"),
    "j11_external_connections": """
        SELECT f.project_id, f.file_path, f.language, coalesce(ic.technology_name, oc.technology_name) AS technology, coalesce(ic.description, oc.description) AS description,
               CASE WHEN ic.id IS NOT NULL THEN 'incoming' ELSE 'outgoing' END AS direction, ic.id AS incoming_id, oc.id AS outgoing_id
        FROM {files} f LEFT JOIN {incoming_connections} ic ON f.id = ic.file_id LEFT JOIN {outgoing_connections} oc ON f.id = oc.file_id
        WHERE ic.id IS NOT NULL OR oc.id IS NOT NULL""",
    "j11_external_connections_union": """
        SELECT f.project_id, f.file_path, c.direction, c.id, c.technology_name, c.description
        FROM (SELECT 'incoming' AS direction, id, file_id, technology_name, description FROM {incoming_connections}
              UNION ALL SELECT 'outgoing', id, file_id, technology_name, description FROM {outgoing_connections}) c JOIN {files} f ON f.id = c.file_id""",
    "j12_connection_impact": """
        SELECT m.id AS mapping_id, oc.file_id AS sender_file_id, ic.file_id AS receiver_file_id, m.description, m.match_confidence, coalesce(oc.technology_name, ic.technology_name, 'Unknown') AS technology,
               sf.file_path AS sender_path, rf.file_path AS receiver_path, sp.name AS sender_project, rp.name AS receiver_project,
               CASE WHEN sf.project_id = rf.project_id THEN 'internal' ELSE 'external' END AS scope
        FROM {connection_mappings} m LEFT JOIN {outgoing_connections} oc ON m.sender_id = oc.id LEFT JOIN {incoming_connections} ic ON m.receiver_id = ic.id
        LEFT JOIN {files} sf ON oc.file_id = sf.id LEFT JOIN {files} rf ON ic.file_id = rf.id LEFT JOIN {projects} sp ON sf.project_id = sp.id LEFT JOIN {projects} rp ON rf.project_id = rp.id
        WHERE m.match_confidence > 0.5""",
    "j13_mappings_for_display": """
        SELECT m.id, oc.file_id AS sender_file_id, ic.file_id AS receiver_file_id, m.match_confidence, oc.start_line AS sender_start, oc.end_line AS sender_end, ic.start_line AS receiver_start,
               ic.end_line AS receiver_end, oc.code_snippet AS sender_code_snippet, ic.code_snippet AS receiver_code_snippet, sf.file_path AS sender_path, rf.file_path AS receiver_path, coalesce(sp.name, 'Unknown') AS sender_project
        FROM {connection_mappings} m JOIN {outgoing_connections} oc ON m.sender_id = oc.id JOIN {incoming_connections} ic ON m.receiver_id = ic.id
        LEFT JOIN {files} sf ON oc.file_id = sf.id LEFT JOIN {files} rf ON ic.file_id = rf.id LEFT JOIN {projects} sp ON sf.project_id = sp.id
        WHERE coalesce(oc.start_line <= 40 AND 15 <= oc.end_line, false) OR coalesce(ic.start_line <= 40 AND 15 <= ic.end_line, false)""",
    "j15_existing_connections": """
        SELECT c.direction, c.id, c.description, c.technology_name, f.file_path, p.name AS project_name
        FROM (SELECT 'incoming' AS direction, * FROM {incoming_connections} UNION ALL SELECT 'outgoing', * FROM {outgoing_connections}) c
        LEFT JOIN {files} f ON c.file_id = f.id LEFT JOIN {projects} p ON f.project_id = p.id""",
    "j17_connections_of_files": """
        SELECT c.direction, c.id, c.file_id, f.file_path, c.start_line, c.end_line, c.technology_name
        FROM (SELECT 'incoming' AS direction, * FROM {incoming_connections} UNION ALL SELECT 'outgoing', * FROM {outgoing_connections}) c LEFT JOIN {files} f ON c.file_id = f.id""",
    "j18_connections_by_technology": """
        SELECT coalesce(c.technology_name, 'Unknown') AS technology, c.direction, c.id, c.description, f.file_path
        FROM (SELECT 'incoming' AS direction, * FROM {incoming_connections} UNION ALL SELECT 'outgoing', * FROM {outgoing_connections}) c LEFT JOIN {files} f ON c.file_id = f.id""",
    "j19_file_blocks": """
        SELECT f.file_path, p.name AS project_name, cb.id, cb.parent_block_id, cb.type, cb.name, cb.start_line, cb.end_line
        FROM {code_blocks} cb JOIN {files} f ON f.id = cb.file_id LEFT JOIN {projects} p ON p.id = f.project_id""",
    "j20_project_file_paths": "SELECT DISTINCT file_path FROM {files} WHERE project_id IN (SELECT id FROM {projects} WHERE name = 'ASIA')",
    "j21_embedding_nodes": """
        WITH n AS (SELECT DISTINCT node_id, [[split_part(node_id, '_', 1)|split_part(node_id, '_', 1)]] AS kind, CAST(split_part(node_id, '_', 2) AS BIGINT) AS key FROM {vectors})
        SELECT n.node_id, n.kind, coalesce(f.file_path, bf.file_path) AS file_path, b.name AS block_name
        FROM n LEFT JOIN {files} f ON n.kind = 'file' AND f.id = n.key LEFT JOIN {code_blocks} b ON n.kind = 'block' AND b.id = n.key LEFT JOIN {files} bf ON bf.id = b.file_id""",
    "j27_match_candidates": """
        WITH o AS (SELECT coalesce(technology_name, 'Unknown') AS t, count(*) AS n, min(id) AS first FROM {outgoing_connections} GROUP BY coalesce(technology_name, 'Unknown')),
             i AS (SELECT coalesce(technology_name, 'Unknown') AS t, count(*) AS n, min(id) AS first FROM {incoming_connections} GROUP BY coalesce(technology_name, 'Unknown')),
             k AS (SELECT t FROM o WHERE t <> 'Unknown' UNION SELECT t FROM i WHERE t <> 'Unknown')
        SELECT k.t AS technology, coalesce(o.n, 0) + coalesce(ou.n, 0) AS outgoing, coalesce(i.n, 0) + coalesce(iu.n, 0) AS incoming, least(o.first, ou.first) AS first_outgoing, least(i.first, iu.first) AS first_incoming
        FROM k LEFT JOIN o ON o.t = k.t LEFT JOIN i ON i.t = k.t LEFT JOIN o ou ON ou.t = 'Unknown' LEFT JOIN i iu ON iu.t = 'Unknown'
        WHERE coalesce(o.n, ou.n) IS NOT NULL AND coalesce(i.n, iu.n) IS NOT NULL""",
    "j28_snapshot_compare": """
        WITH a AS (SELECT doc_id, [[sha2(text, 256)|sha256(text)]] AS h FROM {old_documents}), b AS (SELECT doc_id, [[sha2(text, 256)|sha256(text)]] AS h FROM {new_documents})
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' ELSE 'unchanged' END AS change
        FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""",
    "j29_project_block_count": """
        SELECT p.name, count(cb.id) AS blocks FROM {projects} p LEFT JOIN {files} f ON f.project_id = p.id LEFT JOIN {code_blocks} cb ON cb.file_id = f.id GROUP BY p.name""",
    # --- predicates
    "p4_connections_by_ids": "SELECT id, description, file_id FROM {incoming_connections} WHERE id IN (SELECT receiver_id FROM {connection_mappings} WHERE match_confidence >= 0.7)",
    # a file as sender or as receiver: one row for each file of a mapping, so that file_id is a key
    "p5_disjunctive_filter": """
        WITH e AS (SELECT m.id, ic.file_id AS in_file, oc.file_id AS out_file FROM {connection_mappings} m
                   LEFT JOIN {incoming_connections} ic ON m.receiver_id = ic.id LEFT JOIN {outgoing_connections} oc ON m.sender_id = oc.id WHERE m.match_confidence > 0.5)
        SELECT in_file AS file_id, id, in_file, out_file FROM e WHERE in_file IS NOT NULL
        UNION ALL SELECT out_file, id, in_file, out_file FROM e WHERE out_file IS NOT NULL AND out_file IS DISTINCT FROM in_file""",
    "p6_unknown_technology": "SELECT id, file_id FROM {outgoing_connections} WHERE coalesce(technology_name, 'Unknown') = 'Unknown'",
    # every run of last components of a path, in lower case, so that a suffix is a key of an equi-join or a filter
    "p8_suffix_path": """
        WITH p AS (SELECT id, file_path, [[split|string_split]](lower(file_path), '/') AS parts FROM {files}),
             e AS (SELECT id, file_path, parts, [[explode(sequence(1, size(parts)))|unnest(generate_series(1, len(parts)))]] AS i FROM p)
        SELECT [[array_join(slice(parts, i, size(parts)), '/')|array_to_string(parts[i:], '/')]] AS suffix, id, file_path FROM e""",
    "p11_overlap_or_null": "SELECT id, start_line, end_line FROM {incoming_connections} WHERE start_line IS NULL OR end_line IS NULL OR (start_line <= 30 AND 12 <= end_line)",
    "p15_blocks_with_content": "SELECT id, name FROM {code_blocks} WHERE trim(content) <> ''",
    "p16_blocks_by_type": "SELECT id, name FROM {code_blocks} WHERE type = 'function'",
    "p19_unmatched_technologies": """
        SELECT DISTINCT e.event_type AS technology FROM {events} e WHERE NOT EXISTS (SELECT 1 FROM {outgoing_connections} o WHERE o.technology_name = e.event_type)""",
    "p20_valid_matches": """
        SELECT m.id FROM {connection_mappings} m WHERE EXISTS (SELECT 1 FROM {outgoing_connections} o WHERE o.id = m.sender_id) AND EXISTS (SELECT 1 FROM {incoming_connections} i WHERE i.id = m.receiver_id)""",
    # an end with each file that any mapping leads it to (or none); pairs of files that a mapping above 0.5 holds in that direction go
    "p21_unmapped_connections": """
        WITH m AS (SELECT x.sender_id, x.receiver_id, x.match_confidence, o.file_id AS sender_file, i.file_id AS receiver_file
                   FROM {connection_mappings} x LEFT JOIN {outgoing_connections} o ON o.id = x.sender_id LEFT JOIN {incoming_connections} i ON i.id = x.receiver_id),
             c AS (SELECT DISTINCT 'incoming' AS direction, i.id, i.file_id, m.sender_file AS other_file_id FROM {incoming_connections} i LEFT JOIN m ON m.receiver_id = i.id
                   UNION ALL SELECT DISTINCT 'outgoing', o.id, o.file_id, m.receiver_file FROM {outgoing_connections} o LEFT JOIN m ON m.sender_id = o.id)
        SELECT direction, id, file_id, other_file_id FROM c
        WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.match_confidence > 0.5 AND ((c.direction = 'incoming' AND m.receiver_file = c.file_id AND m.sender_file = c.other_file_id)
                          OR (c.direction = 'outgoing' AND m.sender_file = c.file_id AND m.receiver_file = c.other_file_id AND m.sender_file <> m.receiver_file)))""",
    # --- aggregates
    "a1_global_counts": "SELECT (SELECT count(*) FROM {files}) AS files, (SELECT count(*) FROM {code_blocks}) AS blocks, (SELECT count(*) FROM {relationships}) AS relationships",
    "a6_extraction_stats": """
        SELECT 'blocks_by_type' AS section, type AS key, count(*) AS n FROM {code_blocks} GROUP BY type
        UNION ALL SELECT 'relationships_by_type', type, count(*) FROM {relationships} GROUP BY type
        UNION ALL SELECT 'files_by_language', language, count(*) FROM {files} GROUP BY language
        UNION ALL SELECT 'files_by_project', p.name, count(f.id) FROM {projects} p LEFT JOIN {files} f ON f.project_id = p.id GROUP BY p.name""",
    "a8_vector_stats": """
        SELECT count(*) AS total, count(DISTINCT node_id) AS nodes, CASE WHEN count(DISTINCT node_id) = 0 THEN 0.0 ELSE round(CAST(count(*) AS DOUBLE) / count(DISTINCT node_id), 2) END AS avg_chunks FROM {vectors}""",
    "a12_relationships_touching": """
        SELECT file_id, count(*) AS n FROM (SELECT source_id AS file_id FROM {relationships} UNION ALL SELECT target_id FROM {relationships} WHERE target_id <> source_id) u GROUP BY file_id""",
    "a17_connections_by_technology": """
        SELECT direction, coalesce(technology_name, 'Unknown') AS technology, count(*) AS n, min(id) AS first_id, max(id) AS last_id
        FROM (SELECT 'incoming' AS direction, id, technology_name FROM {incoming_connections} UNION ALL SELECT 'outgoing', id, technology_name FROM {outgoing_connections}) c GROUP BY direction, coalesce(technology_name, 'Unknown')""",
    "a18_changes_by_project": """
        SELECT file_id % 5 AS project_id, count(CASE WHEN op = 'added' THEN 1 END) AS added, count(CASE WHEN op = 'modified' THEN 1 END) AS modified, count(CASE WHEN op = 'deleted' THEN 1 END) AS deleted
        FROM {changes} GROUP BY file_id % 5""",
    "a20_edges_by_language_pair": """
        SELECT s.language AS source_language, t.language AS target_language, count(*) AS n FROM {relationships} r JOIN {files} s ON r.source_id = s.id JOIN {files} t ON r.target_id = t.id GROUP BY s.language, t.language""",
    "a10_best_chunk_of_node": """
        SELECT node_id, vec_id, chunk_index FROM (SELECT node_id, vec_id, chunk_index, row_number() OVER (PARTITION BY node_id ORDER BY (CAST(vec_id AS BIGINT) * 37) % 101 DESC, vec_id) AS k FROM {vectors} WHERE node_id LIKE 'block%') x WHERE k = 1
        UNION ALL SELECT node_id, vec_id, chunk_index FROM {vectors} WHERE node_id LIKE 'file%'""",
    # --- sets
    "u2_all_technologies": "SELECT DISTINCT coalesce(technology_name, 'Unknown') AS technology FROM (SELECT technology_name FROM {incoming_connections} UNION ALL SELECT technology_name FROM {outgoing_connections}) u",
    "u3_available_technologies": "SELECT DISTINCT technology_name AS technology FROM (SELECT technology_name FROM {incoming_connections} UNION ALL SELECT technology_name FROM {outgoing_connections}) u WHERE technology_name <> 'Unknown'",
    "u4_deleted_files": "SELECT doc_id FROM {old_documents} EXCEPT SELECT doc_id FROM {new_documents}",
    "u5_changed_or_new": """
        WITH a AS (SELECT doc_id, [[sha2(text, 256)|sha256(text)]] AS h FROM {old_documents}), b AS (SELECT doc_id, [[sha2(text, 256)|sha256(text)]] AS h FROM {new_documents})
        SELECT DISTINCT b.doc_id FROM b LEFT JOIN a ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR a.h IS DISTINCT FROM b.h""",
    # --- windows and order
    "n1_block_ordinals": "SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS ordinal FROM {code_blocks}",
    "n7_pages_of_30": """
        SELECT file_id, id, CAST(floor((row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) - 1) / 30) AS BIGINT) AS page FROM {code_blocks}""",
    "n8_latest_value": "SELECT file_id, op, event_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) AS k FROM {changes}) x WHERE k = 1",
    "n9_last_30_history": "SELECT file_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) AS k FROM {changes}) x WHERE k <= 30",
    "n10_rate_window": "SELECT event_id, count(*) OVER (PARTITION BY file_id ORDER BY ts RANGE BETWEEN INTERVAL '59' SECOND PRECEDING AND CURRENT ROW) AS n FROM {changes}",
    "n2_result_rank": "SELECT node_id, vec_id, row_number() OVER (PARTITION BY project_id ORDER BY vec_id) AS node_index FROM {vectors}",
    "o3_top_documents": "SELECT doc_id, n_chars FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 25",
    "o5_languages_by_count": "SELECT language, count(*) AS n FROM {files} GROUP BY language ORDER BY n DESC, language",
    "o7_projects_by_name": "SELECT id, name, path FROM {projects} ORDER BY name",
    "a14_merged_ranges": """
        WITH f AS (SELECT file_id, start_line, end_line, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh, id FROM {code_blocks}),
             g AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY start_line, end_line, id ROWS UNBOUNDED PRECEDING) AS island FROM f)
        SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line FROM g GROUP BY file_id, island""",
    "a15_consecutive_lines": """
        WITH d AS (SELECT DISTINCT file_id, start_line + id % 3 AS line FROM {code_blocks}), k AS (SELECT file_id, line, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS island FROM d)
        SELECT file_id, min(line) AS start_line, max(line) AS end_line FROM k GROUP BY file_id, island""",
    "t6_compacted_changes": """
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, event_id) AS first, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) AS last, count(*) OVER (PARTITION BY file_id) AS n FROM {changes})
        SELECT a.file_id, CASE WHEN b.op = 'deleted' THEN 'deleted' WHEN a.n = 1 THEN a.op ELSE 'modified' END AS change_type, a.code AS old_code, b.code AS new_code
        FROM o a JOIN o b ON a.file_id = b.file_id WHERE a.first = 1 AND b.last = 1""",
    # --- store maintenance as queries
    "w3_keep_last_file": "SELECT file_id, code FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) AS k FROM {changes}) x WHERE k = 1",
    "w5_keep_first_relationship": """
        SELECT source_id, target_id, type, import_content FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, type ORDER BY import_content) AS k FROM {relationships}) x WHERE k = 1""",
    "w12_delete_project_cascade": """
        SELECT cb.id FROM {code_blocks} cb WHERE NOT EXISTS (SELECT 1 FROM {files} f JOIN {projects} p ON f.project_id = p.id WHERE f.id = cb.file_id AND p.name = 'ASIA')""",
    "w14_restored_connections": "SELECT c.id FROM {incoming_connections} c WHERE EXISTS (SELECT 1 FROM {files} f WHERE f.id = c.file_id AND f.project_id <> 2)",
    "w19_updated_descriptions": "SELECT p.id, coalesce(nullif(p.description, ''), 'none') AS description FROM {projects} p",
    "z1_project_lookup": "SELECT id, name, path, description FROM {projects}",
    "z3_file_hashes": "SELECT project_id, file_path, content_hash FROM {files}",
    "z4_descriptions": "SELECT id, nullif(description, '') AS description, cross_indexing_done FROM {projects}",
    "z31_missing_paths": "SELECT DISTINCT r.target_id FROM {relationships} r WHERE NOT EXISTS (SELECT 1 FROM {files} f WHERE f.id = r.target_id)",
}


def run(store: Store, name: str, **keys: object) -> DataFrame:
    """A named query; ``keys`` filter its columns, and None leaves a column free (optional parameters)."""
    out = store.sql(NAMED[name])
    for column, value in keys.items():
        if value is not None:
            out = out.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    return out
