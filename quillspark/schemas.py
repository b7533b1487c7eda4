"""Table schemas of the learning-analytics model, and the rules that writes must hold."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


AUDIT_METADATA = (
    "struct<auditor:string,model:string,audited_at:timestamp,"
    "gate_criteria:struct<answer_correct:boolean,grammar_correct:boolean,no_hallucination:boolean,question_coherent:boolean,natural_french:boolean,register_appropriate:boolean>,"
    "soft_signals:struct<difficulty_appropriate:boolean,suggested_difficulty:string,variations_valid:boolean,missing_variations:array<string>,invalid_variations:array<string>,culturally_appropriate:boolean>,"
    "severity:string,notes:string>"
)

SPECS = {
    "study_codes": "id string, code string, display_name string, admin_label string, is_superuser boolean, created_at timestamp, last_active_at timestamp, total_quizzes int, total_questions int, correct_answers int, wrong_answer_countdown int",
    "quiz_history": "id string, study_code_id string, quiz_date timestamp, unit_id string, difficulty string, total_questions int, correct_answers int, score_percentage decimal(5,2), time_spent_seconds int",
    "question_results": "id string, quiz_history_id string, study_code_id string, question_id string, topic string, difficulty string, is_correct boolean, user_answer string, correct_answer string, score int, attempted_at timestamp",
    "questions": f"id string, question string, correct_answer string, explanation string, unit_id string, topic string, difficulty string, type string, options array<string>, acceptable_variations array<string>, writing_type string, hints array<string>, content_hash string, batch_id string, source_file string, generated_by string, quality_status string, audit_metadata {AUDIT_METADATA}, created_at timestamp",
    "batches": "id string, model string, unit_id string, difficulty string, type_filter string, question_count int, inserted_count int, duplicate_count int, error_count int, config string, quality_metrics string, prompt_hash string",
    "leitner_state": "study_code_id string, question_id string, box int, consecutive_correct int, last_reviewed timestamp",
    "units": "id string, title string, label string, description string, topics array<struct<name:string,headings:array<string>>>, sort_order int",
    "learning_resources": "id string, unit_id string, topic string, resource_type string, url string, title string, provider string, difficulty string, metadata string, content_hash string, batch_id string, quality_status string",
    "study_code_source_words": "id int, category string, word string, first_letter string",
    "experiments": "id string, unit_id string, hypothesis string, primary_metric string, cohorts array<struct<label:string,batch_ids:array<string>,batch_id:string>>, results string, conclusion string",
    "experiment_batches": "id string, experiment_id string, cohort string, model string, unit_id string, question_count int, inserted_count int, duplicate_count int, error_count int, quality_metrics string",
    "experiment_questions": f"id string, experiment_id string, cohort string, original_question_id string, question string, correct_answer string, unit_id string, topic string, difficulty string, type string, content_hash string, batch_id string, quality_status string, audit_metadata {AUDIT_METADATA}",
}


def schema(name: str) -> T.StructType:
    return _struct(SPECS[name])


#: What enumerated columns may hold.
ENUMS = {
    "difficulty": ["beginner", "intermediate", "advanced"],
    "type": ["multiple-choice", "fill-in-blank", "true-false", "writing"],
    "writing_type": ["translation", "conjugation", "open_ended", "question_formation", "sentence_building"],
    "quality_status": ["pending", "active", "flagged"],
    "resource_type": ["video", "article", "audio", "interactive"],
    "category": ["adjective", "animal"],
}

DEFAULT_STATUS = {"questions": "pending", "learning_resources": "active", "experiment_questions": "pending"}
