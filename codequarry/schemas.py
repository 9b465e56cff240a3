"""Schemas of stored documents."""

LOCATION = "STRUCT<file_path: STRING, line_start: INT, line_end: INT, column_start: INT, column_end: INT>"

NODE = f"""id STRING, node_type STRING, name STRING, qualified_name STRING, location {LOCATION}, language STRING,
    content STRING, parameters ARRAY<STRING>, calls ARRAY<STRING>, complexity INT, is_async BOOLEAN, is_method BOOLEAN,
    methods ARRAY<STRING>, base_classes ARRAY<STRING>, module STRING, imports ARRAY<STRING>, import_type STRING,
    docstring STRING, github_url STRING, repo_url STRING, created_at BIGINT, purpose STRING, domain STRING,
    technologies ARRAY<STRING>, operations ARRAY<STRING>, embedding ARRAY<FLOAT>"""

METADATA = """repository_url STRING, repository_branch STRING, analysis_timestamp STRING, total_files BIGINT,
    total_nodes BIGINT, functions BIGINT, classes BIGINT, imports BIGINT, errors BIGINT"""


def _struct(columns: str) -> str:
    """The struct type with the given columns."""
    depth, parts, part = 0, [], ""
    for ch in columns:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += ch
    fields = [p.split(None, 1) for p in parts + [part]]
    return "STRUCT<" + ", ".join(f"{name}: {kind}" for name, kind in fields) + ">"


ANALYSIS = f"analysis_metadata {_struct(METADATA)}, nodes ARRAY<{_struct(NODE)}>"

MESSAGE = "id STRING, type STRING, content STRING, timestamp STRING"
SESSION_ROW = "id STRING, title STRING, created_at STRING, last_message_at STRING, attached_sources ARRAY<STRING>"
SESSION = f"""id STRING, title STRING, created_at STRING, last_message_at STRING, messages ARRAY<{_struct(MESSAGE)}>,
    attached_sources ARRAY<STRING>"""
MESSAGE_BLOCK = f"session_id STRING, block BIGINT, messages ARRAY<{_struct(MESSAGE)}>"

SITE = "title STRING, url STRING, description STRING"
URL = "url STRING, title STRING, source STRING, type STRING, priority INT, relevance STRING, extraction_method STRING"
ATTEMPT = """site_title STRING, site_url STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, duration_seconds DOUBLE,
    status STRING, urls_extracted INT, error_message STRING, process_terminated BOOLEAN"""
CRAWL = """url STRING, title STRING, success BOOLEAN, word_count INT, file_path STRING, error STRING, extraction_method STRING"""
CURATION_STATE = f"""session_id STRING, search_sites ARRAY<{_struct(SITE)}>, extracted_urls ARRAY<{_struct(URL)}>,
    approved_urls ARRAY<{_struct(URL)}>, crawled_content STRUCT<results: ARRAY<{_struct(CRAWL)}>>,
    extraction_attempts ARRAY<{_struct(ATTEMPT)}>, status STRING, created_at TIMESTAMP_NTZ, last_updated TIMESTAMP_NTZ"""

STATE_TABLES = {
    "sites": f"session_id STRING, place INT, {SITE}",
    "urls": f"session_id STRING, place INT, {URL}",
    "attempts": f"session_id STRING, place INT, {ATTEMPT}",
    "approved": f"session_id STRING, place INT, {URL}",
    "crawled": f"session_id STRING, place INT, {CRAWL}",
    "states": "session_id STRING, status STRING, created_at TIMESTAMP_NTZ, last_updated TIMESTAMP_NTZ",
}
