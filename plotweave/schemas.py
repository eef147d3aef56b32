"""Fixed schemas of the stored tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = {
    "users": "user_id long",
    "book": """book_id long, title string, author string, language string, is_default boolean, summary boolean,
        cover_url string, book_prompt string, normalization_status string, analysis_status string, rule_version string,
        locator_version string, run_id string, artifact_path string, uploaded_by long, updated_at timestamp_ntz""",
    "chapter": """chapter_id long, book_id long, idx int, title string, spine_href string, paragraph_count int,
        starts array<int>, lengths array<int>, total_code_points int, page_start int, page_end int, start_pos int,
        end_pos int, raw_text string, summary_text string, summary_url string, summarized boolean""",
    "book_character": """id long, character_id long, book_id long, name string, names string, is_main boolean,
        first_chapter_idx int, personality_text string, profile_text string, profile_image string, image_status string,
        embedding binary""",
    "book_event": """id long, book_id long, chapter_id long, chapter_idx int, idx int, event_id string, start_block int,
        start_offset int, end_block int, end_offset int, start_txt int, end_txt int, raw_text string""",
    "event_relationship_edge": """id long, event_id long, book_id long, from_char_id long, to_char_id long,
        explanation string, relation_tags string, interaction_count int, sentiment_score float""",
    "event_character_stat": "id long, event_id long, book_id long, char_id long, node_weight double",
    "chapter_character_stat": "id long, chapter_id long, char_id long, mention_count int",
    "character_pov_summary": "id long, book_id long, chapter_id long, char_id long, summary_text string",
    "chapter_relationship_edge": """book_id long, chapter_idx int, from_id long, to_id long,
        cumulative_interaction long, sentiment_weighted_sum double, edge_width float""",
    "favorite": "user_id long, book_id long",
    "user_read_state": "user_id long, book_id long, last_locator string, updated_at timestamp_ntz",
    "bookmark": """id long, user_id long, book_id long, start_locator string, end_locator string, start_txt int,
        end_txt int, locator_version string, color string, memo string, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "processing_job": """id long, book_id long, pipeline_type string, run_id string, source_version string,
        artifact_path string, status string, current_step string, failure_code string, failure_message string,
        triggered_by string, rule_version string, locator_version string, created_at timestamp_ntz,
        started_at timestamp_ntz, finished_at timestamp_ntz""",
    "processing_job_log": """id long, job_id long, seq int, level string, step string, message string,
        payload map<string,string>, created_at timestamp_ntz""",
    "character_image_asset": """id long, book_id long, char_id long, role string, mode string, source_asset_id long,
        reference_version int, status string, url string, model string, prompt_hash string, qa_result string,
        failure_code string, request_id string, attempt_no int, published_at timestamp_ntz, created_at timestamp_ntz""",
    "book_character_image_profile": """book_id long, active_asset_id long, reference_char_id long, reference_version int,
        reference_status string, model string, base_prompt_hash string, book_prompt_hash string,
        approved_at timestamp_ntz, approved_by string""",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
