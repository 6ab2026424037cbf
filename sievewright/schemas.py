"""Explicit schemas of the engine's tables, and the closed sets of values they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MODES = ["multiple_choice", "qa"]
DIFFICULTIES = ["easy", "medium", "hard"]
QUESTION_TYPES = ["analytical", "application-based", "clarification", "conceptual", "counterfactual", "edge-case", "factual", "false-premise", "open-ended", "true-false"]
ACTIONS = ["generate_questions", "finish_topic", "continue_generation", "expand_retrieval", "increase_multi_chunk", "hardening", "defer_topic", "backfill"]
TOPIC_STATUSES = ["pending", "active", "completed", "deferred"]

DOCUMENTS = "document_id string, run_id string, topic string, language string, title string, url string, summary string, content string, status string, error string"
CHUNKS = "chunk_id string, document_id string, chunk_index int, text string, title string, url string, topic string, language string"
UNITS = "unit_type string, unit_id string, document_id string, topic string, chunk_ids array<string>, texts array<string>, tags array<string>, mcq_score double, qa_score double, hard_score double, usage_count int"
QUESTIONS = "question_id string, question string, answer string, question_mode string, question_type string, estimated_difficulty string, choices array<string>, citations array<struct<chunk_id: string, text: string>>, chunk_ids array<string>"
PLAN_TARGETS = "mode string, count int, difficulty string, ratio double"
TOPIC_TARGETS = "topic string, mode string, difficulty string, target int"
BATCHES = "round_id int, topic string, target_mode string, target_difficulty string, unit_ids array<string>, requested_min int, requested_target int"
EVALUATIONS = "id string, question string, gold_answer string, test_answer string, reasons string, is_correct boolean, category string, difficulty string, wiki_entity string, additional_requirement string, iteration int"
CATEGORIES = "id string, category string, parent_category string, additional_requirement string, salience double"
RESPONSES = "call_id string, model string, prompt string, text string, input_tokens long, output_tokens long, error string"


def difficulty_band(number: Column) -> Column:
    """1-3 easy, 4-7 medium, above hard."""
    return F.when(number <= 3, "easy").when(number <= 7, "medium").when(number.isNotNull(), "hard")


def key_of(mode: Column, difficulty: Column) -> Column:
    return F.concat_ws(":", mode, difficulty)


def content_id(*parts: Column) -> Column:
    """An id from content, so that a repeated task makes the same one."""
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
