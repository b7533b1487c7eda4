"""Logical tables of the learning-analytics model over the star-schema tables, one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TYPE = "CASE p_partkey % 4 WHEN 0 THEN 'multiple-choice' WHEN 1 THEN 'true-false' WHEN 2 THEN 'fill-in-blank' ELSE 'writing' END"
_LEVEL = "CASE WHEN p_size <= 20 THEN 'beginner' WHEN p_size <= 40 THEN 'intermediate' ELSE 'advanced' END"

VIEWS = {
    "study_codes": "SELECT c_custkey AS id, lower(c_name) AS code, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS display_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE NULL END AS admin_label, (c_custkey % 50 = 0) AS is_superuser, CASE WHEN c_custkey % 40 = 0 THEN c_custkey % 30 ELSE NULL END AS wrong_answer_countdown FROM {customer}",
    "quiz_history": "SELECT o_orderkey AS id, o_custkey AS study_code_id, o_orderdate AS quiz_date, 'unit-' || CAST(o_orderkey % 6 AS STRING) AS unit_id, CASE o_orderstatus WHEN 'F' THEN 'beginner' WHEN 'O' THEN 'intermediate' ELSE 'advanced' END AS difficulty, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) AS score_percentage FROM {orders}",
    "questions": f"SELECT p_partkey AS id, p_name AS question, p_type AS correct_answer, 'unit-' || CAST(p_partkey % 6 AS STRING) AS unit_id, p_brand AS topic, {_LEVEL} AS difficulty, {_TYPE} AS type, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'gen-a' ELSE 'gen-b' END AS generated_by, 'batch_' || CAST(p_partkey % 25 AS STRING) AS batch_id, CASE WHEN p_partkey % 10 = 0 THEN 'flagged' WHEN p_partkey % 10 = 1 THEN 'pending' ELSE 'active' END AS quality_status, md5(lower(p_name || '|' || p_type || '|' || p_brand)) AS content_hash FROM {{part}}",
    "question_results": "SELECT l.l_orderkey AS quiz_history_id, o.o_custkey AS study_code_id, l.l_partkey AS question_id, p.p_brand AS topic, (l.l_returnflag <> 'R') AS is_correct, CAST(l.l_quantity * 2 AS BIGINT) AS score, l.l_shipdate AS attempted_at FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey",
    "units": "SELECT 'unit-' || CAST(r_regionkey AS STRING) AS id, r_name AS title, r_regionkey AS sort_order FROM {region}",
    "batches": "SELECT 'batch_' || CAST(s_suppkey AS STRING) AS id, s_name AS description FROM {supplier}",
    "attempt_events": "SELECT event_id, user_id AS study_code_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 AS question_id, (event_type IN ('purchase', 'click', 'view')) AS is_correct, ts AS attempted_at FROM {events}",
    "answers": f"SELECT p_partkey AS id, p_name AS correct_answer, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 1, length(p_name) - 1) WHEN 2 THEN p_name || 's' WHEN 3 THEN 'x' WHEN 4 THEN '  ' || p_name || ' ' ELSE p_type END AS user_answer, p_name || ' set' AS variation_0, lower(p_type) AS variation_1, {_LEVEL} AS difficulty FROM {{part}}",
    "audit_a": f"SELECT p_partkey AS id, p_brand AS topic, {_TYPE} AS type, (p_partkey % 11 <> 0) AS answer_correct, (p_partkey % 23 <> 0) AS grammar_correct, (p_partkey % 13 <> 0) AS no_hallucination, (p_partkey % 17 <> 0) AS question_coherent FROM {{part}} WHERE p_partkey % 19 <> 0",
    "audit_b": f"SELECT p_partkey AS id, p_brand AS topic, {_TYPE} AS type, (p_partkey % 22 <> 0) AS answer_correct, (p_partkey % 20 <> 0) AS grammar_correct, (p_partkey % 39 <> 0) AS no_hallucination, (p_partkey % 34 <> 0) AS question_coherent, (p_partkey % 21 <> 0) AS natural_french, (p_partkey % 37 <> 0) AS register_appropriate, (p_size % 5 > 1) AS difficulty_appropriate, CASE WHEN p_size % 5 > 1 THEN NULL WHEN p_size % 5 = 0 THEN 'beginner' ELSE 'intermediate' END AS suggested_difficulty, (p_partkey % 4 <> 2) AS variations_valid, CASE p_partkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'minor' ELSE 'suggestion' END AS severity, CASE WHEN p_partkey % 50 = 7 THEN 'PARSE_ERROR: x' ELSE 'OK' END AS notes FROM {{part}} WHERE p_partkey % 29 <> 0",
    "experiment_questions": "SELECT d.doc_id AS id, CASE d.doc_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'B' ELSE 'C' END AS cohort, d.lang AS type, d.source AS topic, md5(d.text) AS content_hash, (l.quality = 1) AS gate_answer_correct, (l.toxic = 0) AS gate_register_appropriate, (d.n_chars % 3 <> 0) AS difficulty_appropriate, CASE l.quality WHEN 0 THEN 'critical' WHEN 1 THEN 'suggestion' ELSE NULL END AS severity FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "learning_resources": "SELECT page_id AS id, 'unit-' || CAST(page_id % 6 AS STRING) AS unit_id, 'Brand#' || CAST(1 + page_id % 25 AS STRING) AS topic, url, 'page ' || CAST(page_id AS STRING) AS title, CASE WHEN page_id % 7 = 0 THEN 'flagged' ELSE 'active' END AS quality_status FROM {pages}",
    "source_words": "SELECT DISTINCT 'adjective' AS category, split_part(p_name, ' ', 1) AS word, substr(p_name, 1, 1) AS first_letter FROM {part} UNION ALL SELECT DISTINCT 'animal' AS category, split_part(p_name, ' ', 2) AS word, substr(split_part(p_name, ' ', 2), 1, 1) AS first_letter FROM {part}",
    "topic_names": "SELECT DISTINCT p_name || ' ' || lower(p_type) AS topic FROM {part}",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a DataFrame over the Parquet files of sf_dir."""
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(sql: str) -> str:
    """sql for the oracle: every fx_<name> it mentions becomes a common table expression."""
    names = sorted(set(re.findall(r"\bfx_(\w+)", sql)))
    views = ", ".join(f"fx_{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)
    if re.match(r"\s*WITH RECURSIVE\b", sql):
        return re.sub(r"^\s*WITH RECURSIVE\b", f"WITH RECURSIVE {views},", sql) if names else sql
    if re.match(r"\s*WITH\b", sql):
        return re.sub(r"^\s*WITH\b", f"WITH {views},", sql) if names else sql
    return f"WITH {views} {sql}" if names else sql
