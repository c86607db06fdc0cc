"""Schemas of the engine's tables and of what travels between its stages."""

from __future__ import annotations

FILES = "file_md5 string, file_name string, file_path string, file_size long, file_type string, groups string, indexed_at timestamp_ntz, status string, tags string, total_chunks long, is_enabled boolean"
CHUNKS = "id string, text string, vector array<float>, type string, doc_id string, doc_name string, page_nums array<int>, chunk_index int, length int, chapter_title string, chapter_index string, keywords array<string>"
POSTINGS = "term string, id string, doc_id string, dl int, tf long, bucket int"
LENGTHS = "doc_id string, n long, words long"
AUDIT = "id long, op_type string, op_detail string, file_name string, file_md5 string, chunk_count long, op_result string, op_time timestamp_ntz"
SOURCE = "struct<doc_name:string,page_nums:array<int>,chunk_index:int,chapter_title:string,chapter_index:string,llm_score:int>"
TURNS = f"session_id string, turn_no int, query string, answer string, status string, sources array<{SOURCE}>, input_tokens long, output_tokens long, elapsed_ms long, created_at timestamp_ntz"
SESSIONS = "session_id string, title string, turn_count long, input_tokens long, output_tokens long, elapsed_ms long, created_at timestamp_ntz, updated_at timestamp_ntz"
WORDS = "doc_id string, page int, word_no int, value string, confidence int, x1 int, y1 int, x2 int, y2 int"
WORD = "struct<value:string,confidence:int,x1:int,y1:int,x2:int,y2:int>"
PAGES = "doc_id string, page int, text string"
PAGE_RESULT = "doc_id string, page int, text string, tables array<array<array<string>>>, avg_confidence double, corrections int, entity_corrections int, error string"
SEGMENT = "struct<page:int,line_range:array<int>>"
CHUNK_DEFINITION = f"struct<chunk_type:string,context_summary:string,header_source:struct<page:int,lines:array<int>>,segments:array<{SEGMENT}>>"
SCORES = "query_id long, chunk_id string, score int, reason string"
CANDIDATES = "query_id long, id string, doc_id string, chunk_index int, hybrid_score double, cross_encoder_score double, llm_score int, llm_reason string"
SEARCH_RESULT = f"status string, query string, answer string, sources array<{SOURCE}>, source_count int, pending_decision string, top_score int, error_message string, token_usage struct<input:long,output:long>"
INDEX_RESULT = "doc_id string, doc_name string, num_chunks int, success boolean, skipped boolean, error string"
