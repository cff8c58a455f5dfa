"""Explicit schemas of the store. Nothing is inferred."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "projects": "id LONG, name STRING, path STRING, description STRING, cross_indexing_done BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "files": "id LONG, project_id LONG, file_path STRING, language STRING, content STRING, content_hash STRING",
    "code_blocks": "id LONG, type STRING, name STRING, content STRING, start_line INT, end_line INT, start_col INT, end_col INT, file_id LONG, parent_block_id LONG",
    "relationships": "source_id LONG, target_id LONG, import_content STRING, symbols ARRAY<STRING>, type STRING",
    "incoming_connections": "id LONG, description STRING, file_id LONG, start_line INT, end_line INT, technology_name STRING, code_snippet STRING, created_at TIMESTAMP",
    "outgoing_connections": "id LONG, description STRING, file_id LONG, start_line INT, end_line INT, technology_name STRING, code_snippet STRING, created_at TIMESTAMP",
    "connection_mappings": "id LONG, sender_id LONG, receiver_id LONG, description STRING, match_confidence DOUBLE, created_at TIMESTAMP",
    "checkpoints": "id LONG, project_id LONG, file_path STRING, change_type STRING, old_code STRING, new_code STRING, updated_at TIMESTAMP",
    "embeddings": "node_id STRING, project_id LONG, chunk_index INT, chunk_start_line INT, chunk_end_line INT, embedding ARRAY<FLOAT>",
}

#: The kinds of a block, of a change, and the known technologies.
BLOCK_TYPES = ("import", "export", "function", "class", "interface", "enum", "variable", "type")
CHANGE_TYPES = ("added", "modified", "deleted")
TECHNOLOGIES = ("HTTP/HTTPS", "WebSockets", "gRPC", "GraphQL", "MessageQueue", "Unknown")
