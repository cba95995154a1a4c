"""Explicit schemas; nothing is inferred from data."""

CHANGED_FILES = "ord INT, filename STRING, status STRING, patch STRING, additions INT, deletions INT"
CODE_CHANGES = (
    "ord INT, file STRING, diff_hunk STRING, change_type STRING, functions_changed ARRAY<STRING>, classes_changed ARRAY<STRING>, imports_changed ARRAY<STRING>, file_type STRING, "
    "is_test BOOLEAN, is_config BOOLEAN, architectural_patterns ARRAY<STRING>, business_domain STRING, code_complexity STRING, semantic_description STRING"
)
THEMES = (
    "ord INT, id STRING, name STRING, description STRING, level INT, affected_files ARRAY<STRING>, code_snippets ARRAY<STRING>, confidence DOUBLE, context STRING, "
    "key_changes ARRAY<STRING>, functions ARRAY<STRING>, classes ARRAY<STRING>"
)
AI_DECISIONS = "context STRING, key STRING, attempt INT, response STRING"
NODE_REVIEWS = "ord INT, node_id STRING, node_name STRING, node_type STRING, risk_level STRING, confidence DOUBLE, processing_ms DOUBLE"
LOCATION = "STRUCT<file_path: STRING, function_name: STRING, class_name: STRING, line_number: INT, code_snippet: STRING>"
ISSUES = f"node_id STRING, ord INT, severity STRING, category STRING, description STRING, suggested_fix STRING, location {LOCATION}"
PAGE = "array<struct<filename: string, status: string, patch: string, additions: int, deletions: int>>"
SAVED_THEME = "struct<id: string, name: string, description: string, level: int, affectedFiles: array<string>, codeSnippets: array<string>, confidence: double>"
SAVED = f"metadata STRUCT<timestamp: STRING, mode: STRING, totalFiles: INT, totalThemes: INT, processingTime: DOUBLE>, summary STRING, rawAnalysis STRUCT<themes: ARRAY<{SAVED_THEME}>>"
_SIDE = "STRUCT<ref: STRING, sha: STRING>"
PULL = f"number LONG, title STRING, body STRING, state STRING, base {_SIDE}, head {_SIDE}"
