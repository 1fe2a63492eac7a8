"""Schemas of the engine's tables, as DDL."""

ELEMENTS = "document_id string, section_no int, page_number int, element_no int, kind string, level int, text string"
CHUNKS = (
    "chunk_id string, document_id string, file_name string, file_size long, uploaded_at timestamp, content_hash string, "
    "section_no int, parent_no int, child_no int, parent_id string, parent_text string, content string, context string, "
    "page_number int, entities array<string>, embedding array<float>"
)
INGEST_LOG = "task_id string, trigger string, file_no long, file_name string, document_id string, content_hash string, status string, chunk_count int, error string, event_ts timestamp"
UNKNOWN = "(未知)"
