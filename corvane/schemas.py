"""Schemas of the engine's tables and payloads, as DDL."""

from __future__ import annotations

REPOS = "repo_id STRING, url STRING, status STRING, last_commit_sha STRING, indexed_at TIMESTAMP, created_at TIMESTAMP"
FILES = "repo_id STRING, file_path STRING, language STRING, source STRING, digest STRING"
CHUNK_COLUMNS = ["file_path", "language", "chunk_type", "name", "start_line", "end_line", "content", "context_prefix"]
CHUNKS = "file_path STRING, language STRING, chunk_type STRING, name STRING, start_line INT, end_line INT, content STRING, context_prefix STRING"
VECTORS = "chunk_id STRING, vector ARRAY<FLOAT>"
RANKED = "qid BIGINT, list_no INT, rank INT, file_path STRING, start_line INT, end_line INT, content STRING, context_prefix STRING, relevance_score DOUBLE"
QUESTIONS = "qid BIGINT, question STRING"
HISTORY = "session_id STRING, turn BIGINT, role STRING, text STRING"
PROGRESS = "repo_id STRING, phase STRING, message STRING, current BIGINT, total BIGINT, percent INT, ts TIMESTAMP"
EXPANSION = "queries ARRAY<STRING>"
ANSWER = "answer STRING, citations ARRAY<STRUCT<file: STRING, line: INT, snippet: STRING>>"
EVALUATION = "scores ARRAY<STRUCT<faithfulness: DOUBLE, answer_relevancy: DOUBLE, context_recall: DOUBLE>>, average_scores STRUCT<faithfulness: DOUBLE, answer_relevancy: DOUBLE, context_recall: DOUBLE>, test_cases ARRAY<STRUCT<question: STRING, ground_truth: STRING, answer: STRING>>"
PUSH = "ref STRING, repository STRUCT<default_branch: STRING, clone_url: STRING>"
