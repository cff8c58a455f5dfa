"""The store's tables, derived from the synthetic star schema: the same SQL core in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> SQL over raw tables in braces. [[spark|duckdb]] marks the few places where dialects differ.
VIEWS: dict[str, str] = {
    "projects": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, '/repo/p' || CAST(r_regionkey AS [[STRING|VARCHAR]]) AS path,
               CASE WHEN r_regionkey = 0 THEN '' ELSE 'region ' || r_name END AS description, r_regionkey % 2 = 0 AS cross_indexing_done
        FROM {region}""",
    "files": """
        SELECT p_partkey AS id, p_partkey % 5 AS project_id,
               '/repo/p' || CAST(p_partkey % 5 AS [[STRING|VARCHAR]]) || '/' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS [[STRING|VARCHAR]]) || '.py' AS file_path,
               p_brand AS language, p_name || ' ' || p_type AS content, [[sha2(p_name || ' ' || p_type, 256)|sha256(p_name || ' ' || p_type)]] AS content_hash
        FROM {part}""",
    "code_blocks": """
        SELECT l_orderkey * 100 + rn AS id, CASE l_returnflag WHEN 'A' THEN 'class' WHEN 'N' THEN 'function' ELSE 'variable' END AS type,
               'blk_' || CAST(l_orderkey AS [[STRING|VARCHAR]]) || '_' || CAST(rn AS [[STRING|VARCHAR]]) AS name,
               CASE WHEN l_linestatus = 'O' THEN 'body ' || l_returnflag ELSE '' END AS content,
               rn * 10 AS start_line, rn * 10 + CAST(l_quantity AS BIGINT) AS end_line, 0 AS start_col, 80 AS end_col, l_partkey AS file_id,
               CASE WHEN rn = 1 THEN NULL ELSE l_orderkey * 100 + 1 END AS parent_block_id
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM {lineitem}) x""",
    "relationships": """
        SELECT p_partkey AS source_id, (p_partkey * 7 + 3) % n AS target_id, 'import ' || p_name AS import_content, 'import' AS type FROM {part}, (SELECT count(*) AS n FROM {part}) c
        UNION ALL
        SELECT p_partkey, (p_partkey * 11 + 5) % n, 'from ' || p_name, 'import' FROM {part}, (SELECT count(*) AS n FROM {part}) c WHERE p_size > 25""",
    "outgoing_connections": """
        SELECT conv_id * 100 + turn AS id, text AS description, conv_id % 50 AS file_id, turn * 10 + 1 AS start_line, turn * 10 + 8 AS end_line,
               CASE conv_id % 6 WHEN 0 THEN 'HTTP/HTTPS' WHEN 1 THEN 'WebSockets' WHEN 2 THEN 'gRPC' WHEN 3 THEN 'GraphQL' WHEN 4 THEN 'MessageQueue' END AS technology_name, text AS code_snippet
        FROM {conversations} WHERE role = 'user'""",
    "incoming_connections": """
        SELECT conv_id * 100 + turn AS id, text AS description, (conv_id + 7) % 50 AS file_id, turn * 10 + 1 AS start_line, turn * 10 + 8 AS end_line,
               CASE conv_id % 6 WHEN 0 THEN 'HTTP/HTTPS' WHEN 1 THEN 'WebSockets' WHEN 2 THEN 'gRPC' WHEN 3 THEN 'GraphQL' WHEN 4 THEN 'MessageQueue' END AS technology_name, text AS code_snippet
        FROM {conversations} WHERE role = 'assistant'""",
    "connection_mappings": """
        SELECT o.id AS id, o.id AS sender_id, i.id AS receiver_id, 'maps ' || o.description AS description,
               CAST(CASE o.id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS match_confidence
        FROM {outgoing_connections} o JOIN {incoming_connections} i ON i.id = o.id + 1""",
    "vectors": """
        SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'file_' || CAST(vec_id AS [[STRING|VARCHAR]]) ELSE 'block_' || CAST(CAST(floor(vec_id / 4) AS BIGINT) AS [[STRING|VARCHAR]]) END AS node_id,
               label % 5 AS project_id, vec_id % 4 AS chunk_index, vec_id % 4 * 20 + 1 AS chunk_start_line, vec_id % 4 * 20 + 20 AS chunk_end_line, embedding
        FROM {embeddings}""",
    "changes": """
        SELECT user_id AS file_id, CASE event_type WHEN 'purchase' THEN 'deleted' WHEN 'signup' THEN 'added' ELSE 'modified' END AS op, ts, event_id, 'v' || CAST(event_id AS [[STRING|VARCHAR]]) AS code
        FROM {events}""",
    "old_documents": "SELECT doc_id, text FROM {documents} WHERE doc_id % 10 <> 3",
    "new_documents": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM {documents} WHERE doc_id % 10 <> 7",
}


def dialect(sql: str, duckdb: bool) -> str:
    return re.sub(r"\[\[(.*?)(?<!\|)\|(?!\|)(.*?)\]\]", lambda m: m[2 if duckdb else 1], sql, flags=re.S) if "[[" in sql else sql


def used(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


#: Rows and bytes of an Arrow batch: what a Python worker holds at once, whatever the texts' lengths.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20


class Store:
    """Tables by name: a view where one is defined, else a raw table. Each is made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.sql(VIEWS[name]) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        """Run SQL with tables in braces; ``more`` are tables of the caller."""
        text = dialect(text, duckdb=False)
        return self.spark.sql(text, **{t: more.get(t) if t in more else self[t] for t in used(text)})


def oracle(text: str) -> str:
    """The same SQL for DuckDB, with the views it needs in front."""
    needed: list[str] = []

    def need(sql: str) -> None:
        for t in used(sql):
            if t in VIEWS and t not in needed:
                need(VIEWS[t])
                needed.append(t)

    need(text)
    named = lambda sql: re.sub(r"\{(\w+)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], dialect(sql, duckdb=True))
    views = ", ".join(f"v_{t} AS ({named(VIEWS[t])})" for t in needed)
    body = named(text).strip()
    if not views:
        return body
    return f"WITH RECURSIVE {views}, {body[4:].lstrip()}" if body.upper().startswith("WITH") else f"WITH {views} {body}"
