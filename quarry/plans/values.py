"""Rows that queries are run over, derived from the test tables by SQL that both engines read.

The tables have no Han characters, page headers, stream lines or uploads of their own;
each input here makes such a column of all rows of a table.  ``{documents}``,
``{conversations}`` and ``{pages}`` stand for the tables; other braces are doubled.
"""

from __future__ import annotations

from ..functions.lexicon import ALIASES, CANONICAL


def pick(number: str, values: list[str]) -> str:
    """One of some strings (None: null) by a number."""
    literal = lambda x: "CAST(NULL AS STRING)" if x is None else "'" + x + "'"
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {literal(x)}" for i, x in enumerate(values)) + " END"


_PHRASES = [*CANONICAL, *[a for names in ALIASES.values() for a in names], "服用硝苯地平控释片", "及呋塞米注射液 ", "美托洛尔缓释片，", "CHF-2 用药 x_y", "hello", "", "Été naïve ", "a高b血 压"]
_PHRASE, _OTHER = pick("doc_id", _PHRASES), pick("(doc_id * 31 + 7)", _PHRASES)
_SAID = "substr(md5(text), 1, 12)"
_LINES = [
    """'data: {{"choices":[{{"delta":{{"content":"' || m || '"}},"finish_reason":null}}]}}'""",
    """'data: {{"choices":[{{"message":{{"content":"' || m || '"}},"finish_reason":"weird"}}]}}'""",
    """'data: [DONE]'""",
    """''""",
    """' DATA:{{"content":"' || m || '","output_text":"!"}} '""",
    """'data: {{"choices":[{{"delta":{{"reasoning_content":"' || m || '"}},"finish_reason":"stop"}}]}}'""",
    """'{{broken ' || m""",
    """'data: {{"choices":[{{"delta":{{"tool_calls":[{{"type":"","id":1}}]}},"finish_reason":"TOOL_CALLS"}}]}}'""",
    """'data: {{"choices":[{{"delta":{{"content":"","text":"' || m || '"}},"finish_reason": "abort"}}]}}'""",
    """'data: {{"choices":[{{"delta":{{"content":[{{"text":"' || m || '"}},"-",{{"content":"c"}},7,{{"text":["deep","er"]}}]}}}}]}}'""",
    """'{{"choices":[{{"message":{{"content":{{"text":"' || m || '"}},"reasoning":"r"}},"finish_reason":"length"}}]}}'""",
]

INPUTS = {
    "mixed_texts": f"SELECT doc_id AS id, {_PHRASE} || substr(text, 1, 60) || {_OTHER} AS txt FROM {{documents}}",
    "questions": f"SELECT doc_id AS id, {_PHRASE} || ' ' || substr(text, 1, 20) || {_OTHER} || CASE WHEN doc_id % 10 = 0 THEN ' {" ".join(_PHRASES)}' ELSE '' END AS txt FROM {{documents}}",  # so many names that limits are reached
    "page_elements": """SELECT source AS document_id, doc_id AS section_no, CASE WHEN source LIKE '%3' THEN NULL ELSE doc_id + 1 END AS page_number, 0 AS element_no, 'para' AS kind,
  'Header  of ' || upper(source) || chr(10) || substr(text, 1, 300) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Draft  copy' ELSE 'final copy' END || chr(10) || '本院患者治疗须知请在医生指导下使用本手册内容并遵守医嘱谢谢配合' || chr(10) || '第 ' || doc_id || ' 页' AS text FROM {documents}
  UNION ALL SELECT source, doc_id, CASE WHEN source LIKE '%3' THEN NULL ELSE doc_id + 1 END, 1, 'para', CASE WHEN doc_id % 2 = 0 THEN '   ' ELSE ' header OF ' || source END FROM {documents}""",
    "page_lines": "SELECT doc_id AS id, "
    + "CASE doc_id % 14 "
    + " ".join(
        f"WHEN {i} THEN {x}"
        for i, x in enumerate(
            [
                "'第 ' || doc_id || ' 页'", "'第' || doc_id || '页 共 9 页'", "'第3页/' || doc_id || '页'", "'-' || doc_id || '-'", "'— ' || doc_id || ' —'", "doc_id || '/20'", "'page ' || doc_id || ' of 9'", "'' || doc_id", "'[' || doc_id || ']'", "'〔' || doc_id || '〕'",
                "'20' || doc_id || '4'", "'第' || doc_id || '页，续'", "'  ' || doc_id || '  '", "'page ' || substr(text, 1, 9)",
            ]
        )
    )
    + " END AS line FROM {documents}",
    "blocks": "SELECT doc_id AS id, substr(text, 1, 500) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '  ' || chr(10) ELSE '' END || ' ' || lang || ' ' || chr(10) || chr(10) || chr(10) || source AS txt FROM {documents} UNION ALL SELECT -1, CAST(NULL AS STRING) FROM {documents} WHERE doc_id = 0",
    "ocr_texts": f"SELECT doc_id AS id, {_PHRASE} || ' ' || {_OTHER} || chr(10) || substr(text, 1, 50) || chr(10) || chr(10) || chr(10) || '用药 每日 不超过' || (10 + doc_id % 80) || '9' || CASE WHEN doc_id % 2 = 0 THEN '。' ELSE '' END AS txt, CAST(doc_id % 100 AS DOUBLE) / 128 AS confidence FROM {{documents}}",
    "log": """SELECT 't' || (doc_id % 40) AS task_id, 'upload' AS trigger, doc_id AS file_no, 'f' || doc_id AS file_name, 'pending' AS status, CAST(NULL AS STRING) AS error, '2024-01-01 00:00:00' AS event_ts FROM {documents}
  UNION ALL SELECT 't' || (doc_id % 40), 'upload', doc_id, 'f' || doc_id, CASE WHEN doc_id % 40 < 8 THEN 'imported' WHEN doc_id % 40 < 12 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'failed' WHEN doc_id % 3 = 1 THEN 'skipped' ELSE 'imported' END, 'bad', '2024-01-01 00:01:00' FROM {documents} WHERE doc_id % 40 < 38 OR (doc_id % 40 = 38 AND doc_id % 3 = 0)""",
    "uploads": "SELECT doc_id AS file_no, CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN '.hidden' ELSE CASE WHEN doc_id % 3 = 0 THEN 'in/side/' ELSE '' END || lang || doc_id END || "
    + pick("(doc_id * 7)", [".PDF", ".docx", ".md", ".txt", ".TIFF", "", ".doc", ".jpeg", ".tar.gz", ".bmp"])
    + " AS file_name FROM {documents}",
    "hits": "SELECT doc_id - doc_id % 20 AS query_id, doc_id % 20 + 1 AS rnk, doc_id % 7 AS doc, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 0.9 - 0.03 * (doc_id % 20) - 0.01 * (n_chars % 30) END AS vs, 0.7 AS s, n_chars % 5 AS page FROM {documents}",
    "answers": "SELECT conv_id * 1000 + turn AS id, " + pick("(conv_id + turn)", ["", "[知识库]", " [模型] ", "[知识", "", None]) + " || CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END || text AS raw, CAST(turn % 10 AS DOUBLE) / 10 AS best FROM {conversations}",
    "stream_lines": "SELECT conv_id * 1000 + turn AS id, CASE (conv_id * 3 + turn) % " + str(len(_LINES)) + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_LINES)) + f" END AS line FROM (SELECT conv_id, turn, {_SAID} AS m FROM {{conversations}}) AS t",
    "images": "SELECT conv_id * 1000 + turn AS id, " + pick("(conv_id + turn)", [" data:image/png;base64,", "HTTPS://x/", "iVBORw0KGgo", "/9j/", "  ", None, "http://"]) + f" || CASE WHEN (conv_id + turn) % 7 = 4 THEN '' ELSE {_SAID} END AS raw FROM {{conversations}}",
    "sizes": "SELECT DISTINCT CAST(doc_id % 130 - 5 AS INT) AS asked FROM {documents}",
    "fields": "SELECT conv_id * 1000 + turn AS id, "
    + pick("turn", [" Vector ", "", "foo", None, "hybrid", "RERANK"]) + " AS mode, "
    + pick("conv_id", ["HIGH", "low", "max", None, "medium"]) + " AS effort, CASE (conv_id + turn) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS thinking, "
    + pick("(conv_id + 2 * turn)", ["", "https://a/v1", "https://a/v1/", "https://a/v1/chat/completions", None, "https://b/V1/Chat/Completions/"]) + " AS base FROM {conversations}",
    "settings": "SELECT 'win-x64' AS platform, true AS enabled, '1.2.0' AS latest_version, '1.0.0' AS min_supported_version, '/updates/a.zip' AS package_url, 'AA' AS sha256, true AS force_update, 'n' AS release_notes UNION ALL SELECT 'win32-x64', true, '2.0.0', '1.0.0', '/updates/b.zip', 'BB', false, 'n'",
    "manifest_requests": "SELECT conv_id * 1000 + turn AS request_id, " + pick("(conv_id + turn)", ["", "WIN32-X64", "win-x64", None, "other"]) + " AS platform, " + pick("turn", ["", "beta", None]) + " AS channel, 'https://h' || conv_id AS origin FROM {conversations}",
    "builds": "SELECT url || CASE page_id % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.ZIP' ELSE '.txt' END AS path, page_id % 50 AS modificationTime FROM {pages}",
    "refusals": "SELECT conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 4 WHEN 0 THEN 429 WHEN 1 THEN 401 WHEN 2 THEN 500 ELSE 404 END AS status, CASE WHEN turn = 3 THEN NULL ELSE ' ' || text || ' ' || text || ' ' || text END AS body FROM {conversations}",
    "packages": "SELECT '/updates/a.zip' AS path UNION ALL SELECT '/updates/c.zip'",
    "cells": "SELECT doc_id AS id, 1 AS row_no, lang || ';' || source AS cells FROM {documents} UNION ALL SELECT doc_id, 2, source || ';' || n_chars || ';' || lang FROM {documents} WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 3, lang FROM {documents} WHERE doc_id % 3 > 1",
}


def duck_input(name: str) -> str:
    """An input as DuckDB reads it."""
    return INPUTS[name].format(documents="documents", conversations="conversations", pages="pages")
