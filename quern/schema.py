"""Schemas of the engine's tables."""

from __future__ import annotations

FILES = "codebase string, generation string, file_path string, rel_path string, last_modified double, file_hash string, language string, indexed_at timestamp, deleted boolean"
CHUNKS = (
    "codebase string, generation string, file_path string, chunk_index int, start_line int, end_line int, chunk_type string, symbol_name string, "
    "content string, language string, model string, embedding array<float>, norm double"
)
RUNS = "run_id long, directory string, started_at timestamp, finished_at timestamp, files_processed int, files_skipped int, errors int, error_details array<struct<file:string,error:string>>"
CODEBASES = (
    "root string, generation string, model string, dims int, files int, chunks int, last_indexed timestamp, status string, deprecated_at timestamp, deprecated_reason string"
)
