"""More named queries: operators that no query of `registry` applies by itself, each with SQL written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, scoring, text, urls
from ..operators import audit, dedup, dml, evaluate, experiments, leitner, mastery, planning, resources, selection, topics, validation
from ..sources import readers
from . import pipelines
from .fixtures import frame
from .registry import _CANDIDATES, _K, _META, _METRICS, _RATE, _U, _VALIDATE, AS_OF, GATE2, MASTERY, query


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sql(spark, sf, sql, *tables):
    return spark.sql(sql, **{t: _table(spark, sf, t) for t in tables})


# sources and plain scans


@query("SELECT doc_id, lang FROM documents WHERE n_chars > 3000")
def s01_scan(spark, sf):
    return readers.scan(spark, f"{sf}/documents.parquet", ["doc_id", "lang"], F.col("n_chars") > 3000)


@query(f"SELECT doc_id, lang, source FROM documents WHERE NOT coalesce(regexp_matches(text, {_META}), false)")
def s03_active_without_meta(spark, sf):
    rows = _table(spark, sf, "documents").withColumns({"question": F.col("text"), "explanation": F.lit(None).cast("string"), "quality_status": F.lit("active"), "unit_id": F.lit("all")})
    return readers.active_questions(rows).select("doc_id", "lang", "source")


@query("SELECT id, title, sort_order::BIGINT AS sort_order FROM fx_units")
def s05_units(spark, sf):
    return readers.ordered_units(frame(spark, sf, "units")).withColumn("sort_order", F.col("sort_order").cast("bigint"))


@query("SELECT id, code FROM fx_study_codes WHERE id = 42")
def s07_single(spark, sf):
    return dml.single(frame(spark, sf, "study_codes"), "id", 42).select("id", "code")


@query("SELECT id, unit_id, score_percentage FROM fx_quiz_history WHERE score_percentage >= 90 ORDER BY score_percentage DESC, id LIMIT 100")
def s08_view(spark, sf):
    return readers.view(frame(spark, sf, "quiz_history"), F.col("score_percentage") >= 90, [F.desc("score_percentage"), "id"], 100).select("id", "unit_id", "score_percentage")


@query("SELECT doc_id, i::INTEGER AS line_no, string_split(text, chr(10))[i + 1] AS line FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)")
def s10_lines(spark, sf):
    return resources.lines_of(_table(spark, sf, "documents").where("text is not null"), "doc_id")


_PAGES = "list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')"


@query(f"WITH p AS (SELECT doc_id, text, {_PAGES} AS pages FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, CASE WHEN len(pages) = 0 THEN [text] ELSE list_transform(string_split(list_reduce(list_prepend('', pages), lambda a, x: CASE WHEN a = '' THEN x || chr(10) || chr(10) WHEN length(string_split(a, chr(1))[-1]) + length(x) > 2000 THEN a || chr(1) || x || chr(10) || chr(10) ELSE a || x || chr(10) || chr(10) END), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')) END AS chunks FROM p) SELECT doc_id, len(chunks)::INTEGER AS n, md5(array_to_string(chunks, '|')) AS digest FROM c")
def s11_page_chunks(spark, sf):
    docs = _table(spark, sf, "documents").where("text is not null")
    chunks = docs.select("doc_id", readers.chunk_pages(F.translate("text", "\n", "\f"), 2000).alias("c"))
    return chunks.select("doc_id", F.size("c").alias("n"), F.md5(F.array_join("c", "|").cast("binary")).alias("digest"))


@query("SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN 'introduction' ELSE 'unit-' || p_size END AS id FROM part WHERE p_partkey % 5 <> 0")
def s12_discovered_units(spark, sf):
    files = _sql(spark, sf, "SELECT CASE WHEN p_size % 7 = 0 THEN 'Course Introduction' ELSE 'Course UNIT_' || p_size END || CASE WHEN p_partkey % 5 = 0 THEN '.cohort-b' ELSE '' END || '.md' AS file FROM {part}", "part")
    return readers.discovered_units(files)


@query("SELECT 'type' AS kind, type AS value, count(*) AS n FROM fx_questions GROUP BY ALL UNION ALL SELECT 'difficulty', difficulty, count(*) FROM fx_questions GROUP BY ALL")
def s13_export_counts(spark, sf):
    return readers.export_counts(frame(spark, sf, "questions"))


@query("SELECT id, question, correct_answer, type, difficulty, topic, unit_id FROM fx_questions")
def s13_export_columns(spark, sf):
    rows = frame(spark, sf, "questions")
    return rows.select(*readers.export_columns(rows))


_CSV = "SELECT 'Study Code,Display Name,Admin Label,Total Quizzes,Total Questions,Correct Answers,Accuracy %,Last Active (PST),Created At (PST)' AS value UNION ALL SELECT '\"' || code || '\",\"' || coalesce(display_name, 'Anonymous') || '\",\"' || coalesce(admin_label, '') || '\",\"' || 3 || '\",\"' || 40 || '\",\"' || id % 41 || '\",\"' || printf('%.2f', round(100.0 * (id % 41) / 40, 2)::DOUBLE) || '\",\"\",\"Jan 1, 2024, 4:05 AM\"' FROM fx_study_codes"


@query(_CSV)
def s14_csv(spark, sf):
    rows = frame(spark, sf, "study_codes").withColumns({"total_quizzes": F.lit(3), "total_questions": F.lit(40), "correct_answers": F.col("id") % 41, "last_active_at": F.lit(None).cast("timestamp"), "created_at": F.to_utc_timestamp(F.lit("2024-01-01 04:05:00"), "America/Los_Angeles")})
    return readers.csv_lines(rows)


@query("SELECT '| topic | n |' AS value UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || topic || ' | ' || count(*) || ' |' FROM fx_questions GROUP BY topic")
def s15_markdown(spark, sf):
    return readers.markdown_lines(frame(spark, sf, "questions").groupBy("topic").agg(F.count("*").alias("n")))


_RESPONSE = """CASE p_partkey % 5 WHEN 0 THEN '[{"answer_correct": false, "severity": "minor"}]' WHEN 1 THEN '{"results": [{"grammar_correct": false, "severity": "odd", "notes": "see"}]}' WHEN 2 THEN '{"questions": [{"no_hallucination": false, "severity": "critical"}]}' WHEN 3 THEN '{"question_coherent": false}' ELSE 'no json' END"""


@query("SELECT p_partkey AS id, p_partkey % 5 <> 0 AS answer_correct, p_partkey % 5 <> 1 AS grammar_correct, p_partkey % 5 <> 2 AS no_hallucination, p_partkey % 5 <> 3 AS question_coherent, CASE p_partkey % 5 WHEN 0 THEN 'minor' WHEN 2 THEN 'critical' ELSE 'suggestion' END AS severity, CASE p_partkey % 5 WHEN 1 THEN 'see' WHEN 4 THEN 'PARSE_ERROR: no json' ELSE 'OK' END AS notes FROM part")
def s18_parsed_responses(spark, sf):
    return audit.parse_responses(_table(spark, sf, "part").selectExpr("p_partkey AS batch", "array(p_partkey) AS ids", f"{_RESPONSE} AS response")).select("id", *audit.CORE, "severity", "notes")


# predicates


@query("SELECT id FROM fx_questions WHERE difficulty = 'advanced' AND generated_by = 'gen-a' AND quality_status = 'pending'")
def p03_predicates(spark, sf):
    return selection.criteria_filter(frame(spark, sf, "questions"), difficulty="advanced", model="gen-a", status="pending").select("id")


@query("SELECT id, topic FROM fx_questions WHERE topic IN (SELECT topic FROM fx_learning_resources WHERE quality_status = 'flagged')")
def p05_in_list(spark, sf):
    flagged = frame(spark, sf, "learning_resources").where("quality_status = 'flagged'").select("topic")
    return readers.keyed_rows(frame(spark, sf, "questions"), "topic", flagged).select("id", "topic")


@query("SELECT id, display_name FROM fx_study_codes WHERE display_name IS NOT NULL AND admin_label IS NOT NULL")
def p06_present(spark, sf):
    return readers.present(frame(spark, sf, "study_codes"), "display_name", "admin_label").select("id", "display_name")


@query("SELECT id, type FROM fx_questions WHERE type IN ('writing', 'true-false') AND lower(topic) = 'brand#13' AND difficulty = 'intermediate'")
def p09_types_topic_level(spark, sf):
    return selection.criteria_filter(frame(spark, sf, "questions"), topic="BRAND#13", difficulty="intermediate", types=["writing", "true-false"]).select("id", "type")


_GEN_META = "'(?i)" + "|".join(f"(?:{p})" for p in validation.GENERATION_META).replace("'", "''") + "'"
_ASKED = "CASE p_partkey % 9 WHEN 0 THEN 'What is the best way to learn ' || p_name WHEN 1 THEN 'Madame Dupont likes ' || p_name WHEN 2 THEN 'Consistency is key: ' || p_name WHEN 3 THEN 'Study tip for ' || p_name ELSE p_name END"


@query(f"SELECT p_partkey AS id, regexp_matches({_ASKED} || ' ' || p_brand, {_GEN_META}) AS meta FROM part")
def p13_generation_meta(spark, sf):
    rows = _sql(spark, sf, f"SELECT p_partkey AS id, {_ASKED} AS question, p_brand AS explanation FROM {{part}}", "part")
    return rows.select("id", validation.is_meta_generated(F.col("question"), F.col("explanation")).alias("meta"))


@query("SELECT id, type <> 'writing' OR NOT regexp_matches(lower(question), 'translate|en français|in french|into french|tradui') AS drift FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'multiple-choice' ELSE 'writing' END AS type, CASE WHEN p_partkey % 3 = 0 THEN 'Translate ' || p_name ELSE p_name END AS question FROM part)")
def p16_drift(spark, sf):
    rows = _sql(spark, sf, "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'multiple-choice' ELSE 'writing' END AS type, CASE WHEN p_partkey % 3 = 0 THEN 'Translate ' || p_name ELSE p_name END AS question FROM {part}", "part")
    return validation.type_drift(rows, only="writing", writing_type="translation").select("id", "drift")


@query("SELECT quiz_history_id, question_id, attempted_at FROM fx_question_results WHERE NOT is_correct")
def p22_incorrect(spark, sf):
    return evaluate.incorrect_questions(frame(spark, sf, "question_results")).select("quiz_history_id", "question_id", "attempted_at")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN id % 8 = 0 ELSE is_superuser END AS superuser FROM fx_study_codes")
def p23_superuser(spark, sf):
    override = F.when(F.col("id") % 4 == 0, F.col("id") % 8 == 0)
    return frame(spark, sf, "study_codes").select("id", pipelines.is_superuser(override, F.col("is_superuser")).alias("superuser"))


# joins


@query(f"SELECT s.code, r.topic, r.mastery_percentage FROM fx_study_codes s JOIN ({MASTERY}) r ON s.id = r.study_code_id WHERE s.code LIKE '%7'")
def j02_code_to_rows(spark, sf):
    some = frame(spark, sf, "study_codes").where("code like '%7'").select(F.col("id").alias("study_code_id"), "code")
    rows = mastery.concept_mastery(frame(spark, sf, "question_results")).join(some, "study_code_id")
    return rows.select("code", "topic", F.col("mastery_percentage").cast("double").alias("mastery_percentage"))


@query("SELECT id FROM fx_study_codes WHERE EXISTS (SELECT 1 FROM fx_quiz_history q WHERE q.study_code_id = fx_study_codes.id)")
def j11_exists(spark, sf):
    return dml.exists(frame(spark, sf, "study_codes"), frame(spark, sf, "quiz_history").select(F.col("study_code_id").alias("id")), "id").select("id")


@query("SELECT topic, string_agg(title, ', ' ORDER BY sort_order) AS units FROM (SELECT DISTINCT r.topic, u.title, u.sort_order FROM fx_learning_resources r JOIN fx_units u ON r.unit_id = u.id) GROUP BY topic")
def j12_unit_titles(spark, sf):
    return resources.unit_titles(frame(spark, sf, "learning_resources"), frame(spark, sf, "units"))


@query("SELECT q.id, CASE WHEN q.id % 5 = 0 THEN q.id % 10 = 0 ELSE coalesce(a.user_answer = q.correct_answer, false) END AS is_correct, CASE WHEN q.id % 10 = 0 THEN 77 WHEN q.id % 5 <> 0 AND a.user_answer = q.correct_answer THEN 100 ELSE 0 END::INTEGER AS score, nullif(a.user_answer, '') AS user_answer FROM fx_questions q LEFT JOIN (SELECT id, CASE id % 3 WHEN 0 THEN correct_answer WHEN 1 THEN '' ELSE 'other' END AS user_answer FROM fx_questions WHERE id % 7 <> 0) a ON q.id = a.id")
def j14_saved_results(spark, sf):
    q = frame(spark, sf, "questions")
    answers = q.where("id % 7 <> 0").select("id", F.when(F.col("id") % 3 == 0, F.col("correct_answer")).when(F.col("id") % 3 == 1, "").otherwise("other").alias("user_answer"))
    judged = q.where("id % 5 = 0").select("id", (F.col("id") % 10 == 0).alias("is_correct"), F.when(F.col("id") % 10 == 0, 77).alias("score"))
    return evaluate.saved_results(q, answers, judged).select("id", "is_correct", F.col("score").cast("int").alias("score"), "user_answer")


_NEWT = "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || lower(p_type) WHEN p_partkey % 3 = 1 THEN split_part(p_name, ' ', 1) || ' zzz' ELSE p_name || ' basics' END AS topic FROM {part}"
_OLDT = "SELECT DISTINCT p_name || ' ' || lower(p_type) AS topic FROM {part} WHERE p_partkey % 2 = 0"


@query(f"WITH n AS ({_NEWT.replace('{part}', 'part')}), o AS ({_OLDT.replace('{part}', 'part')}), r AS (SELECT n.topic, o.topic AS other FROM n JOIN o ON contains(n.topic, o.topic) OR contains(o.topic, n.topic) OR len(list_filter(list_intersect(list_distinct(string_split(n.topic, ' ')), list_distinct(string_split(o.topic, ' '))), lambda w: length(w) > 3)) >= 2 WHERE n.topic NOT IN (SELECT topic FROM o)), g AS (SELECT topic, count(*) AS k FROM r GROUP BY 1) SELECT n.topic, CASE WHEN n.topic IN (SELECT topic FROM o) THEN 'reuse' WHEN k > 1 THEN 'review' ELSE 'new' END AS action, CASE WHEN n.topic IN (SELECT topic FROM o) OR coalesce(k, 1) = 1 THEN n.topic END AS target FROM n LEFT JOIN g ON n.topic = g.topic")
def j17_reconcile(spark, sf):
    return topics.reconcile(_sql(spark, sf, _NEWT, "part"), _sql(spark, sf, _OLDT, "part"))


_EXPERIMENTS = "SELECT r_regionkey AS id, array(named_struct('label', 'control', 'batch_ids', array('a'), 'batch_id', CAST(NULL AS STRING)), named_struct('label', 'B', 'batch_ids', CAST(NULL AS ARRAY<STRING>), 'batch_id', 'batch_' || r_regionkey)) AS cohorts FROM {region}"


@query("SELECT r_regionkey AS experiment_id, 'control' AS label, NULL::VARCHAR AS batch_id, NULL::VARCHAR AS quality_metrics FROM region UNION ALL SELECT r_regionkey, 'B', 'batch_' || r_regionkey, s_name FROM region LEFT JOIN supplier ON s_suppkey = r_regionkey")
def j18_cohort_batches(spark, sf):
    batches = frame(spark, sf, "batches").select("id", F.col("description").alias("quality_metrics"))
    return experiments.cohort_batches(_sql(spark, sf, _EXPERIMENTS, "region"), batches).select("experiment_id", "label", "batch_id", "quality_metrics")


# aggregates and windows


@query("SELECT coalesce(suggested_difficulty, 'unspecified') AS suggested, count(*) AS n FROM fx_audit_b WHERE NOT difficulty_appropriate GROUP BY 1")
def a23_suggested_levels(spark, sf):
    return audit.suggested_levels(frame(spark, sf, "audit_b"))


@query(f"SELECT 'auditor-' || (b.id % 3) AS auditor, q.quality_status, count(*) AS n, count(*) FILTER ({' AND '.join('b.' + c for c in audit.GATE)}) AS passed, sum(CASE WHEN b.id % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS invalid_variations FROM fx_questions q JOIN fx_audit_b b ON q.id = b.id GROUP BY 1, 2")
def a30_by_auditor_and_status(spark, sf):
    b = frame(spark, sf, "audit_b").select("id", F.struct(F.concat(F.lit("auditor-"), F.col("id") % 3).alias("auditor"), F.struct(*audit.GATE).alias("gate_criteria"), F.struct(F.when(F.col("id") % 4 == 0, F.array(F.lit("x"), F.lit("y"))).alias("invalid_variations")).alias("soft_signals")).alias("audit_metadata"))
    return pipelines.audit_breakdown(frame(spark, sf, "questions").join(b, "id", "left"))


@query("SELECT DISTINCT topic FROM fx_questions WHERE topic IS NOT NULL")
def a32_topics(spark, sf):
    return pipelines.distinct_topics(frame(spark, sf, "questions"))


@query("SELECT DISTINCT batch_id FROM fx_questions WHERE batch_id IS NOT NULL")
def a33_batches(spark, sf):
    return pipelines.distinct_batches(frame(spark, sf, "questions"))


@query("SELECT alliterates, count(*) AS n FROM (SELECT word, first_letter IN (SELECT first_letter FROM fx_source_words WHERE category = 'animal') AS alliterates FROM fx_source_words WHERE category = 'adjective') GROUP BY 1")
def a35_alliteration_coverage(spark, sf):
    return resources.alliteration(frame(spark, sf, "source_words"), "any").groupBy("alliterates").agg(F.count("*").alias("n"))


@query("SELECT topic, count(*) AS n, string_agg(url, '|' ORDER BY unit_id, title, id, url) AS urls FROM fx_learning_resources GROUP BY topic")
def w11_grouped(spark, sf):
    rows = resources.grouped(frame(spark, sf, "learning_resources"))
    return rows.select("topic", F.size("resources").cast("bigint").alias("n"), F.array_join(F.transform("resources", lambda r: r["url"]), "|").alias("urls"))


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY study_code_id ORDER BY attempted_at, event_id) AS n, epoch_us(attempted_at) AS us FROM fx_attempt_events), f AS (SELECT study_code_id, event_id, n, [us] AS held, true AS allowed, us FROM e WHERE n = 1 UNION ALL SELECT e.study_code_id, e.event_id, e.n, CASE WHEN len(list_filter(f.held, lambda t: e.us - t < 21600000000)) < 3 THEN list_append(list_filter(f.held, lambda t: e.us - t < 21600000000), e.us) ELSE list_filter(f.held, lambda t: e.us - t < 21600000000) END, len(list_filter(f.held, lambda t: e.us - t < 21600000000)) < 3, e.us FROM f JOIN e ON e.study_code_id = f.study_code_id AND e.n = f.n + 1) SELECT study_code_id, event_id, allowed, (3 - len(held))::INTEGER AS remaining, (CASE WHEN allowed THEN us ELSE held[1] END + 21600000000)::BIGINT AS reset_at FROM f".replace("WITH e AS", "WITH RECURSIVE e AS", 1))
def t02_rate_limit(spark, sf):
    return leitner.rate_limit(frame(spark, sf, "attempt_events"), "study_code_id", 6 * 3600, 3)


@query("SELECT event_id, 'login:' || CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE '10.0.0.' || user_id END AS key FROM events")
def t04_rate_key(spark, sf):
    forwarded = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit(" 10.0.0."), F.col("user_id"), F.lit(" , 1.2.3.4")))
    return _table(spark, sf, "events").select("event_id", pipelines.rate_key("login", forwarded).alias("key"))


# order and selection


@query(f"SELECT id FROM fx_questions ORDER BY {_K.format('id', 'u')}, id LIMIT 50")
def o07_uniform_sample(spark, sf):
    return selection.uniform_sample(frame(spark, sf, "questions"), 50, "u").select("id")


@query(f"WITH r AS (SELECT id, type, row_number() OVER (PARTITION BY type = 'writing' ORDER BY {_K.format('id', 'l')}, id) AS n FROM fx_questions) SELECT id, type FROM r WHERE (type = 'writing' AND n <= 6) OR (type <> 'writing' AND n <= 14)")
def o12_legacy_split(spark, sf):
    return selection.legacy_split(frame(spark, sf, "questions"), 20, "l").select("id", "type")


@query(f"SELECT cohort, total, gate_pass_count, row_number() OVER (ORDER BY cohort <> 'control', cohort)::INTEGER AS place FROM ({_METRICS})")
def o04_control_first(spark, sf):
    rows = pipelines.experiment_comparison(frame(spark, sf, "experiment_questions"), GATE2, "gate_pass_rate")["metrics"]
    placed = enumerate(rows.select("cohort", "total", "gate_pass_count").collect(), 1)  # one row a cohort
    return spark.createDataFrame([(*r, i) for i, r in placed], "cohort string, total bigint, gate_pass_count bigint, place int")


@query("SELECT 'unit ' || n || '.md' AS file FROM (VALUES (3)) t(n)")
def o06_canonical_file(spark, sf):
    files = _sql(spark, sf, "SELECT 'unit ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.md' ELSE ' old.md' END AS file FROM {part}", "part").distinct()
    return readers.find_unit_file(files, resources.unit_pattern("3"), "unit 3.md")


@query(f"SELECT id, position FROM (SELECT id, row_number() OVER (ORDER BY -ln({_U.format('id', 'w')}) / CASE id % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 3 END, id)::INTEGER AS position FROM fx_questions) WHERE position <= 200")
def o09_box_weighted(spark, sf):
    rows = frame(spark, sf, "questions").select("id").withColumn("weight", scoring.box_weight((F.col("id") % 5 + 1).cast("int")))
    return selection.weighted_shuffle(rows, "w").where("position <= 200").select("id", "position")


# sets


@query("SELECT type FROM fx_audit_a UNION SELECT type FROM fx_audit_b")
def u03_types_of_both(spark, sf):
    return audit.pass_rate_by_type(frame(spark, sf, "audit_a"), frame(spark, sf, "audit_b")).select("type")


@query(f"SELECT DISTINCT topic FROM ({_NEWT.replace('{part}', 'part')}) WHERE topic IN ({_OLDT.replace('{part}', 'part')})")
def u04_final_topics(spark, sf):
    new, old = _sql(spark, sf, _NEWT, "part"), _sql(spark, sf, _OLDT, "part")
    return topics.final_topics(topics.reconcile(new.join(old, "topic", "left_semi"), old))


@query("SELECT doc_id, array_to_string(list_filter(w, lambda x: x NOT IN ('the', 'and', 'de')), ' ') AS kept FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents WHERE text IS NOT NULL)")
def u05_subtract(spark, sf):
    rows = _table(spark, sf, "documents").where("text is not null")
    kept = dedup.subtract_keep(F.split(F.lower("text"), " "), F.array(F.lit("the"), F.lit("and"), F.lit("de")))
    return rows.select("doc_id", F.array_join(kept, " ").alias("kept"))


@query("SELECT a.p_partkey AS id, len(list_filter(list_intersect(list_distinct(string_split(a.p_name || ' ' || lower(a.p_type), ' ')), list_distinct(string_split(b.p_name || ' ' || lower(b.p_type), ' '))), lambda w: length(w) > 3))::INTEGER AS shared FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def u06_shared_words(spark, sf):
    rows = _sql(spark, sf, "SELECT p_partkey AS id, split(p_name || ' ' || lower(p_type), ' ') AS w FROM {part}", "part")
    other = rows.select((F.col("id") - 1).alias("id"), F.col("w").alias("v"))
    return rows.join(other, "id").select("id", F.size(dedup.shared_words(F.col("w"), F.col("v"))).alias("shared"))


@query("SELECT cohort, count(*) AS n FROM (SELECT 'control' AS cohort FROM fx_questions WHERE id % 2 = 0 UNION ALL SELECT 'B' FROM fx_questions WHERE id % 3 = 0) GROUP BY 1")
def u07_twin_union(spark, sf):
    q = frame(spark, sf, "questions")
    return dedup.twin_union(q.where("id % 2 = 0"), {"B": q.where("id % 3 = 0").drop("topic")}).groupBy("cohort").agg(F.count("*").alias("n"))


# functions

@query("SELECT id, regexp_replace(lower(regexp_replace(user_answer, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') = regexp_replace(lower(regexp_replace(correct_answer, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS same FROM fx_answers")
def f04_accents(spark, sf):
    return frame(spark, sf, "answers").select("id", text.has_correct_accents(F.col("user_answer"), F.col("correct_answer")).alias("same"))


@query("SELECT id, lower(trim(user_answer)) AS code FROM fx_answers")
def f06_code(spark, sf):
    return frame(spark, sf, "answers").select("id", text.normalize_code(F.col("user_answer")).alias("code"))


@query("SELECT p_partkey AS id, lower(p_name) || ' ''x'' ' || lower(p_brand) AS topic FROM part")
def f07_topic(spark, sf):
    rows = _sql(spark, sf, "SELECT p_partkey AS id, ' ' || upper(p_name) || '  ‘x’ (' || p_brand || ')' AS topic FROM {part}", "part")
    return rows.select("id", text.normalize_topic(F.col("topic")).alias("topic"))


@query("WITH h AS (SELECT topic, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(topic, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296) % 7 AS s FROM (SELECT DISTINCT topic FROM fx_questions)) SELECT topic, substr('abcdefgabcdefg', s::INTEGER + 1, 3) AS picks FROM h")
def f11_rotated_picks(spark, sf):
    pool = F.array(*(F.lit(c) for c in "abcdefg"))
    return frame(spark, sf, "questions").select("topic").distinct().select("topic", F.array_join(hashing.rotated_picks(F.col("topic"), pool), "").alias("picks"))


@query("SELECT id, '{\"a\": \"' || question || '\", \"b\": [1, 2]}' AS rescued FROM fx_questions")
def f14_rescued_json(spark, sf):
    reply = F.concat(F.lit('Here it is: {"a": "'), F.col("question"), F.lit('", "b": [1, 2,]} and so on'))
    return frame(spark, sf, "questions").select("id", text.rescue_json(reply).alias("rescued"))


@query("SELECT id, '{\"q\": \"' || question || '\"}' || chr(10) AS plain FROM fx_questions")
def f15_code_fence(spark, sf):
    reply = F.concat(F.lit('```json\n{"q": "'), F.col("question"), F.lit('"}\n```'))
    return frame(spark, sf, "questions").select("id", text.strip_code_fence(reply).alias("plain"))


@query("SELECT id, '# ' || question || chr(10) || 'text' || CASE WHEN id % 2 = 0 THEN chr(10) || '---' ELSE chr(10) || '---' || chr(10) || 'more' END AS plain FROM fx_questions")
def f16_conversion(spark, sf):
    end = F.when(F.col("id") % 2 == 0, "This markdown preserves all").otherwise("more")
    raw = F.concat(F.lit("```markdown\nHere's the file\n\n# "), F.col("question"), F.lit("\ntext\n---\n"), end, F.lit("\n```"))
    return frame(spark, sf, "questions").select("id", text.clean_conversion(raw).alias("plain"))


_URL = "CASE p_partkey % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=ab_' || p_partkey WHEN 1 THEN 'https://youtube.com/shorts/cd-' || p_partkey WHEN 2 THEN 'https://youtu.be/ef' || p_partkey ELSE 'https://example.org/' || p_partkey END"


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'ab_' || p_partkey WHEN 1 THEN 'cd-' || p_partkey WHEN 2 THEN 'ef' || p_partkey END AS video, p_partkey % 4 = 1 AS short FROM part")
def f18_video_ids(spark, sf):
    rows = _sql(spark, sf, f"SELECT p_partkey AS id, {_URL} AS url FROM {{part}}", "part")
    return rows.select("id", urls.youtube_id(F.col("url")).alias("video"), urls.is_short(F.col("url")).alias("short"))


_PAGE = "'# First of ' || s_name || chr(10) || 'see [the ' || s_suppkey || '](https://a.org/' || s_suppkey || ') and https://b.org/' || s_suppkey || '.' || chr(10) || '## Second' || chr(10) || 'https://a.org/' || s_suppkey || ' https://c.org/x, ok'"


@query("SELECT s_suppkey AS id, 'https://a.org/' || s_suppkey AS url, 'the ' || s_suppkey AS title FROM supplier UNION ALL SELECT s_suppkey, 'https://b.org/' || s_suppkey, 'First of ' || s_name FROM supplier UNION ALL SELECT s_suppkey, 'https://c.org/x', 'Second' FROM supplier")
def f20_urls(spark, sf):
    pages = _sql(spark, sf, f"SELECT s_suppkey AS id, {_PAGE} AS text FROM {{supplier}}", "supplier")
    return urls.extract_urls(resources.lines_of(pages, "id"), ["id"], F.lit("none")).select("id", "url", "title")


_UNIT = "'# Intro' || chr(10) || 'x' || chr(10) || '## Verbs of ' || s_name || repeat(chr(10) || 'line', CAST(6 + s_suppkey % 9 AS INT)) || chr(10) || '### Detail' || chr(10) || 'deep' || chr(10) || '## Next' || chr(10) || 'far'"


@query("SELECT 'u' || s_suppkey AS unit_id, (9 + s_suppkey % 9)::BIGINT AS n_lines FROM supplier WHERE 9 + s_suppkey % 9 > 10")
def f21_topic_sections(spark, sf):
    units = _sql(spark, sf, f"SELECT 'u' || s_suppkey AS unit_id, {_UNIT} AS text FROM {{supplier}}", "supplier")
    wanted = _sql(spark, sf, "SELECT 'u' || s_suppkey AS unit_id, 'Verbs of ' || s_name AS topic, CAST(NULL AS ARRAY<STRING>) AS aliases FROM {supplier}", "supplier")
    return resources.topic_sections(resources.lines_of(units), wanted).groupBy("unit_id").agg(F.count("*").alias("n_lines"))


@query("SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) || ',' || lower(split_part(p_name, ' ', 2)) || ',' || 'more' AS words FROM part WHERE length(split_part(p_name, ' ', 1)) > 2 AND length(split_part(p_name, ' ', 2)) > 2 AND split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def f22_keywords(spark, sf):
    rows = _sql(spark, sf, "SELECT p_partkey AS id, upper(split_part(p_name, ' ', 1)) || ' & the ' || split_part(p_name, ' ', 2) || ' – of more, ' || split_part(p_name, ' ', 1) AS heading FROM {part} WHERE length(split_part(p_name, ' ', 1)) > 2 AND length(split_part(p_name, ' ', 2)) > 2 AND split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)", "part")
    return rows.select("id", F.array_join(text.heading_keywords(F.col("heading")), ",").alias("words"))


@query("SELECT id, CASE WHEN type IN ('multiple-choice', 'true-false') THEN 'small' ELSE 'large' END AS model, CASE WHEN type IN ('multiple-choice', 'true-false') THEN 'anthropic' ELSE 'mistral' END AS provider FROM fx_questions")
def f24_models(spark, sf):
    rows = frame(spark, sf, "questions")
    provider = scoring.model_provider(scoring.model_by_type(F.col("type"), "other-small", "mistral-large"))
    return rows.select("id", scoring.model_by_type(F.col("type"), "small", "large").alias("model"), provider.alias("provider"))


@query("SELECT topic, printf('%.1f', round(100.0 * count(*) FILTER (NOT answer_correct) / count(*), 1)::DOUBLE) || '%' AS fail FROM fx_audit_a GROUP BY topic")
def f26_fail_rate_text(spark, sf):
    rows = frame(spark, sf, "audit_a").groupBy("topic").agg(F.count_if(~F.col("answer_correct")).alias("f"), F.count("*").alias("n"))
    return rows.select("topic", scoring.percent_text(F.col("f"), F.col("n")).alias("fail"))


@query("SELECT event_id, strftime(ts - INTERVAL 8 HOUR, '%b %-d, %Y, %-I:%M %p') AS shown FROM events WHERE month(ts) IN (1, 2, 12)")
def f27_pacific(spark, sf):
    rows = _table(spark, sf, "events").where("month(ts) in (1, 2, 12)")
    return rows.select("event_id", scoring.pacific_time(F.col("ts").cast("timestamp")).alias("shown"))


@query("SELECT id, unit_id || '_' || replace(question, ' ', '_') || '_' || difficulty || '_q' || id AS slug FROM fx_questions")
def f28_slug(spark, sf):
    return frame(spark, sf, "questions").select("id", text.slug(F.col("unit_id"), F.col("question"), F.col("difficulty"), F.col("id")).alias("slug"))


@query("SELECT id, 'A) ' || question || ' | B) ' || topic || ' | C) ' || correct_answer AS shown FROM fx_questions")
def f29_options(spark, sf):
    return frame(spark, sf, "questions").select("id", text.lettered_options(F.array("question", "topic", "correct_answer")).alias("shown"))


@query("SELECT word, lower(left(word, 1)) AS letter FROM fx_source_words")
def f34_first_letter(spark, sf):
    return frame(spark, sf, "source_words").select("word", text.first_letter(F.col("word")).alias("letter"))


@query("SELECT id, id % 3 = 0 AS stub FROM fx_questions")
def f36_stub(spark, sf):
    content = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Topic: "), F.col("topic"), F.lit("\nNo specific learning materials here"))).otherwise(F.col("question"))
    return frame(spark, sf, "questions").select("id", scoring.is_stub_content(content).alias("stub"))


@query("SELECT DISTINCT type, CASE type WHEN 'fill-in-blank' THEN 'Fill In Blank' WHEN 'multiple-choice' THEN 'Multiple Choice' WHEN 'true-false' THEN 'True False' ELSE 'Writing' END AS label FROM fx_questions")
def f37_type_label(spark, sf):
    return frame(spark, sf, "questions").select("type").distinct().select("type", text.unit_label(F.col("type")).alias("label"))


# evaluation


@query("SELECT id, user_answer = correct_answer AS is_correct, CASE WHEN user_answer = correct_answer THEN 100 ELSE 0 END::INTEGER AS score FROM fx_answers")
def e00_choice(spark, sf):
    return evaluate.choice_answers(frame(spark, sf, "answers")).select("id", "is_correct", F.col("score").cast("int").alias("score"))


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 AND p_partkey % 4 <> 0 AS is_correct, CASE WHEN p_partkey % 2 = 0 THEN 61 ELSE 50 END::INTEGER AS score FROM part WHERE p_partkey % 6 = 5 OR (p_partkey % 6 = 4 AND false)")
def e05_semantic(spark, sf):
    rows = frame(spark, sf, "answers").where("id % 6 = 5").withColumn("variations", F.array().cast("array<string>")).withColumn("correct_answer", F.lit(None).cast("string"))
    verdicts = rows.where("id % 2 = 0").select("id", (F.col("id") % 4 != 0).alias("verdict_correct"), F.lit(61).alias("verdict_score"))
    return evaluate.with_semantic_verdicts(evaluate.evaluate_answers(rows), verdicts).select("id", "is_correct", F.col("score").cast("int").alias("score"))


# writes


@query("SELECT id, CASE WHEN id IN ('unit-1', 'unit-3') THEN 'New ' || title ELSE title END AS title, sort_order::INTEGER AS sort_order FROM fx_units UNION ALL SELECT 'unit-7', 'New', (SELECT count(*) FROM fx_units)::INTEGER UNION ALL SELECT 'unit-8', 'New', (SELECT count(*) FROM fx_units)::INTEGER + 1")
def d02_upsert_unit(spark, sf):
    units = frame(spark, sf, "units").withColumn("sort_order", F.col("sort_order").cast("int"))
    more = units.where("id in ('unit-1', 'unit-3')").select("id", F.concat(F.lit("New "), "title").alias("title")).unionByName(spark.createDataFrame([("unit-7", "New"), ("unit-8", "New")], "id string, title string"))
    return dml.upsert_unit(units, more)


@query("SELECT DISTINCT category, word FROM fx_source_words")
def d03_insert_ignore(spark, sf):
    words = frame(spark, sf, "source_words").select("category", "word")
    return dml.insert_ignore(words.where("category = 'animal'"), words, ["category", "word"])


@query(f"SELECT id, CASE WHEN id % 6 = 0 THEN 'flagged' ELSE quality_status END AS quality_status, CASE WHEN id % 6 = 0 THEN NULL ELSE generated_by END AS generated_by, CASE WHEN id % 6 = 0 THEN TIMESTAMP '{AS_OF}' END AS updated_at FROM fx_questions")
def d04_patch(spark, sf):
    rows = frame(spark, sf, "questions").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    changes = rows.where("id % 6 = 0").select("id", F.lit("flagged").alias("quality_status"), F.lit(None).cast("string").alias("generated_by"))
    return dml.patch(rows, changes, "id", ["quality_status", "generated_by"], F.lit(AS_OF).cast("timestamp_ntz")).select("id", "quality_status", "generated_by", "updated_at")


@query("SELECT id, code FROM fx_study_codes WHERE id % 9 <> 0")
def d06_bulk_delete(spark, sf):
    rows = frame(spark, sf, "study_codes")
    codes = rows.where("id % 9 = 0").select("code").unionByName(spark.createDataFrame([("nobody",)], "code string"))
    return dml.bulk_delete(rows, codes)[0].select("id", "code")


@query("SELECT count(*) AS n FROM fx_source_words UNION ALL SELECT 0")
def d09_roles(spark, sf):
    words = frame(spark, sf, "source_words")
    return dml.as_role(words, "admin").agg(F.count("*").alias("n")).unionByName(dml.as_role(words, "anon").agg(F.count("*").alias("n")))


@query(f"SELECT q.id, CASE WHEN a.id IS NULL THEN q.quality_status WHEN {' AND '.join('a.' + c for c in audit.CORE)} THEN 'active' ELSE 'flagged' END AS quality_status FROM fx_questions q LEFT JOIN fx_audit_a a ON q.id = a.id")
def d12_four_gates(spark, sf):
    rows = frame(spark, sf, "audit_a").withColumn("notes", F.lit("OK"))
    return audit.apply_audit(frame(spark, sf, "questions"), rows, audit.CORE, remediate=False).select("id", "quality_status")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'wrong' END AS reject_reason, id % 5 <> 0 AND id % 3 = 0 AND difficulty <> 'advanced' AS relabeled, CASE WHEN id % 5 <> 0 AND id % 3 = 0 THEN 'advanced' ELSE difficulty END AS difficulty FROM fx_questions")
def d13_merge_validation(spark, sf):
    rows = frame(spark, sf, "questions").withColumns({"position": F.col("id"), "acceptable_variations": F.array().cast("array<string>")})
    verdicts = rows.where("id % 3 = 0 or id % 5 = 0").select("position", (F.col("id") % 5 != 0).alias("answer_valid"), F.lit(None).cast("array<string>").alias("acceptable_variations"), F.when(F.col("id") % 3 == 0, "advanced").alias("suggested_difficulty"), F.lit("wrong").alias("notes"))
    return validation.merge_validation(rows, verdicts).select("id", "reject_reason", "relabeled", "difficulty")


@query("SELECT id, type IN ('multiple-choice', 'true-false') AS has_options, CASE WHEN type = 'writing' THEN 'open_ended' END AS writing_type, 'pending' AS quality_status FROM fx_questions")
def d14_insert_projection(spark, sf):
    rows = frame(spark, sf, "questions").withColumns({"options": F.array("topic"), "acceptable_variations": F.lit(None).cast("array<string>")})
    return validation.insert_projection(rows).select("id", F.col("options").isNotNull().alias("has_options"), "writing_type", "quality_status")


@query("SELECT id, id AS original_question_id, 'control' AS cohort FROM fx_questions WHERE quality_status = 'active' AND unit_id = 'unit-4'")
def d15_control_snapshot(spark, sf):
    return experiments.control_snapshot(frame(spark, sf, "questions"), "unit-4").select("id", "original_question_id", "cohort")


@query("SELECT r_regionkey AS id, CASE WHEN r_regionkey = 2 THEN 'control,B,C' ELSE 'control,B' END AS labels FROM region")
def d16_add_cohort(spark, sf):
    rows = experiments.add_cohort(_sql(spark, sf, _EXPERIMENTS, "region"), 2, "C", "batch_9")
    return rows.select("id", F.array_join(F.transform("cohorts", lambda c: c["label"]), ",").alias("labels"))


@query("SELECT s_suppkey AS id, (s_suppkey % 9 - ceil((s_suppkey % 30) / 5.0))::BIGINT AS error_count FROM supplier")
def d17_batch_record(spark, sf):
    rows = _table(spark, sf, "supplier")
    errors = planning.batch_record(F.col("s_suppkey") % 30, F.col("s_suppkey") % 9, F.lit(5))
    return rows.select(F.col("s_suppkey").alias("id"), errors.cast("bigint").alias("error_count"))


# composite flows


@query("SELECT score FROM (SELECT round(100.0 * count(*) FILTER (id % 2 = 0) / count(*), 0)::DOUBLE AS score FROM fx_questions WHERE unit_id = 'unit-1' OR unit_id = 'unit-2')")
def r02_saved_quiz(spark, sf):
    q = frame(spark, sf, "questions").where("unit_id in ('unit-1', 'unit-2')")
    answers = q.select("id", F.when(F.col("id") % 2 == 0, F.col("correct_answer")).otherwise("wrong").alias("user_answer"))
    none = spark.createDataFrame([], "id bigint, is_correct boolean, score int")
    quiz = spark.createDataFrame([(1, 2)], "quiz_history_id int, study_code_id int")
    return pipelines.save_quiz(q, answers, none, quiz)["score"].select(F.col("score").cast("double").alias("score"))


@query(f"SELECT topic, mastery_percentage FROM ({MASTERY}) WHERE study_code_id = 4")
def r03_student_mastery(spark, sf):
    detail = pipelines.student_detail(4, frame(spark, sf, "quiz_history"), frame(spark, sf, "question_results"))
    return detail["mastery"].select("topic", F.col("mastery_percentage").cast("double").alias("mastery_percentage"))


@query(f"SELECT topic, count(*) AS n FROM fx_learning_resources WHERE quality_status = 'active' AND topic IN (SELECT topic FROM ({MASTERY}) WHERE study_code_id = 4 AND mastery_percentage < 70) GROUP BY 1")
def r04_progress_resources(spark, sf):
    page = pipelines.progress_page(4, frame(spark, sf, "quiz_history"), frame(spark, sf, "question_results"), frame(spark, sf, "learning_resources"))
    return page["resources"].select("topic", F.size("resources").cast("bigint").alias("n"))


@query(f"SELECT id FROM (SELECT *, contains(question, '_____ and _____') AS p3 FROM ({_CANDIDATES.replace('{part}', 'part')})) WHERE ({_VALIDATE}) IS NULL ORDER BY id LIMIT 300")
def r05_post_process(spark, sf):
    rows = _sql(spark, sf, _CANDIDATES, "part")
    options = F.when(~F.col("four"), F.array("o1")).when(F.col("type") == "true-false", F.array(F.lit("Vrai"), F.lit("Faux"))).otherwise(F.array("o1", "o2", "o3", F.lit("other")))
    rows = rows.withColumns({"options": options, "explanation": F.lit(None).cast("string"), "position": F.col("id"), "difficulty": F.lit("beginner"), "acceptable_variations": F.array().cast("array<string>")})
    return validation.post_process(rows, None, 300)[0].select("id")


@query("WITH p AS (SELECT DISTINCT topic, difficulty, 7::INTEGER AS n FROM fx_questions) SELECT topic, difficulty, 'all' AS pass, n AS count FROM p WHERE difficulty = 'advanced' UNION ALL SELECT topic, difficulty, unnest(['structured', 'typed']), 4::INTEGER FROM p WHERE difficulty <> 'advanced'")
def r06_hybrid(spark, sf):
    rows = frame(spark, sf, "questions").select("topic", "difficulty").distinct().withColumn("n", F.lit(7))
    return planning.hybrid_passes(rows)


@query(f"SELECT q.difficulty, {_RATE} FROM fx_audit_b b JOIN fx_questions q ON b.id = q.id WHERE NOT starts_with(notes, 'PARSE_ERROR:') GROUP BY 1")
def r07_audit_summary(spark, sf):
    out = pipelines.audit_summary(frame(spark, sf, "questions"), frame(spark, sf, "audit_b"))["by_difficulty"]
    return out.withColumn("pass_pct", F.col("pass_pct").cast("double"))


@query("SELECT a.id FROM fx_audit_a a JOIN fx_audit_b b ON a.id = b.id WHERE (a.answer_correct AND a.grammar_correct AND a.no_hallucination AND a.question_coherent) AND NOT (" + " AND ".join("b." + c for c in audit.ALL_EIGHT) + ")")
def r08_auditor_comparison(spark, sf):
    return pipelines.auditor_comparison(frame(spark, sf, "audit_a"), frame(spark, sf, "audit_b"))["b_only"].select("id")


@query("SELECT cohort, type, count(*) AS n FROM fx_experiment_questions GROUP BY ALL")
def r09_type_distribution(spark, sf):
    return pipelines.experiment_comparison(frame(spark, sf, "experiment_questions"), GATE2, "gate_pass_rate")["types"]


@query("SELECT 's' || s_suppkey AS unit_id, 'Verbs' AS topic, 'https://in.org/' || s_suppkey AS url, 'article' AS resource_type FROM supplier UNION ALL SELECT 's' || s_suppkey, 'General', 'https://out.org/' || s_suppkey, 'article' FROM supplier")
def r10_extract_resources(spark, sf):
    body = "'# Start' || chr(10) || 'https://out.org/' || s_suppkey || chr(10) || '## Verbs' || repeat(chr(10) || 'line', 12) || chr(10) || '[in](https://in.org/' || s_suppkey || ')'"
    units = _sql(spark, sf, f"SELECT 's' || s_suppkey AS unit_id, {body} AS text FROM {{supplier}}", "supplier")
    wanted = units.select("unit_id", F.lit("Verbs").alias("topic"), F.lit(None).cast("array<string>").alias("aliases"))
    titles = units.select(F.col("unit_id").alias("id"), F.lit("Unit").alias("title"))
    return resources.extract_resources(units, wanted, titles).select("unit_id", "topic", "url", "resource_type")


@query("SELECT DISTINCT p_brand AS final, 'first,second' AS keywords FROM part WHERE length(p_brand) = 8")
def r11_heading_mappings(spark, sf):
    rows = _sql(spark, sf, "SELECT DISTINCT upper(p_brand) AS topic, 'First and Second' AS heading_source, 1 AS position FROM {part} WHERE length(p_brand) = 8 UNION SELECT DISTINCT p_brand, 'second, the first', 2 FROM {part} WHERE length(p_brand) = 8", "part")
    finals = _sql(spark, sf, "SELECT DISTINCT p_brand AS topic FROM {part} WHERE length(p_brand) = 8", "part")
    return topics.heading_mappings(rows, finals).select("final", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT 'distinct' AS similarity, count(*) FILTER (\"left\" <= 'm') AS n FROM (SELECT a.topic AS \"left\" FROM fx_topic_names a) WHERE \"left\" <= 'm' UNION ALL SELECT 'identical', count(*) FROM fx_topic_names WHERE topic > 'm'")
def r14_consolidation(spark, sf):
    pairs = frame(spark, sf, "topic_names").select(F.col("topic").alias("left"), F.col("topic").alias("right"))
    verdicts = pairs.where("left > 'm'").withColumn("similarity", F.lit("identical"))
    return topics.consolidation_summary(pairs, verdicts)
