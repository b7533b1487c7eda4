"""Named queries over the logical tables, and the SQL that the oracle runs for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, scoring, text, urls
from ..operators import audit, dedup, dml, evaluate, experiments, leitner, mastery, milestones, planning, resources, selection, topics, validation
from ..sources import readers
from .fixtures import frame, oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "2000-01-01 00:00:00"
GATE2 = ["gate_answer_correct", "gate_register_appropriate"]


def query(sql: str | None = None):
    """Registers a query under its name with the oracle's SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


MASTERY = "SELECT study_code_id, topic, count(*) AS total_attempts, count(*) FILTER (is_correct) AS correct_attempts, CAST(round(100.0 * count(*) FILTER (is_correct) / count(*), 2) AS DOUBLE) AS mastery_percentage, max(attempted_at) AS last_attempted FROM fx_question_results GROUP BY study_code_id, topic"


def _mastery(df):
    return df.withColumn("mastery_percentage", F.col("mastery_percentage").cast("double"))


@query(MASTERY)
def a01_concept_mastery(spark, sf):
    return _mastery(mastery.concept_mastery(frame(spark, sf, "question_results")))


@query(f"SELECT * FROM ({MASTERY}) WHERE mastery_percentage < 70 AND total_attempts >= 1")
def a02_weak_topics(spark, sf):
    return _mastery(mastery.weak_topics(frame(spark, sf, "question_results")))


@query(f"SELECT * FROM ({MASTERY}) WHERE mastery_percentage >= 85 AND total_attempts >= 5")
def a03_strong_topics(spark, sf):
    return _mastery(mastery.strong_topics(frame(spark, sf, "question_results")))


@query("SELECT q.study_code_id, count(DISTINCT q.id) AS total_quizzes, count(r.is_correct) AS total_questions, count(*) FILTER (r.is_correct) AS correct_answers, CAST(round(100.0 * count(*) FILTER (r.is_correct) / nullif(count(r.is_correct), 0), 2) AS DOUBLE) AS overall_accuracy FROM fx_quiz_history q LEFT JOIN fx_question_results r ON q.id = r.quiz_history_id GROUP BY q.study_code_id")
def a04_overall_stats(spark, sf):
    out = mastery.overall_stats(frame(spark, sf, "quiz_history"), frame(spark, sf, "question_results"))
    return out.withColumn("overall_accuracy", F.col("overall_accuracy").cast("double"))


ROLLUP = "SELECT coalesce(q.study_code_id, r.study_code_id) AS study_code_id, coalesce(nq, 0) AS total_quizzes, coalesce(nr, 0) AS total_questions, coalesce(nc, 0) AS correct_answers FROM (SELECT study_code_id, count(*) AS nq FROM fx_quiz_history GROUP BY 1) q FULL JOIN (SELECT study_code_id, count(*) AS nr, count(*) FILTER (is_correct) AS nc FROM fx_question_results GROUP BY 1) r ON q.study_code_id = r.study_code_id"
PROGRESS = f"SELECT *, CASE WHEN total_questions > 0 THEN CAST(round(100.0 * correct_answers / total_questions, 2) AS DOUBLE) ELSE 0.0 END AS overall_accuracy FROM ({ROLLUP})"
ACTIVE = "SELECT study_code_id, max(quiz_date) AS last_active_at FROM fx_quiz_history GROUP BY 1"


@query(ROLLUP)
def a05_student_rollup(spark, sf):
    return mastery.student_rollup(frame(spark, sf, "quiz_history"), frame(spark, sf, "question_results"))


@query(PROGRESS.replace("ELSE 0.0 END", "ELSE 0.0::DOUBLE END"))
def a06_progress(spark, sf):
    out = mastery.progress(frame(spark, sf, "quiz_history"), frame(spark, sf, "question_results"))
    return out.withColumn("overall_accuracy", F.col("overall_accuracy").cast("double"))


@query(f"SELECT count(*) AS total_students, coalesce(sum(total_quizzes), 0)::BIGINT AS total_quizzes, coalesce(sum(total_questions), 0)::BIGINT AS total_questions, round(100.0 * sum(correct_answers) / sum(total_questions), 2)::DOUBLE AS average_accuracy, count(*) FILTER (last_active_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS active_7d, count(*) FILTER (last_active_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS active_30d FROM fx_study_codes s LEFT JOIN ({ROLLUP}) r ON s.id = r.study_code_id LEFT JOIN ({ACTIVE}) a ON s.id = a.study_code_id")
def a07_classwide_stats(spark, sf):
    quizzes = frame(spark, sf, "quiz_history")
    rollup = mastery.student_rollup(quizzes, frame(spark, sf, "question_results"))
    out = mastery.classwide_stats(frame(spark, sf, "study_codes"), rollup, mastery.last_active(quizzes), F.lit(AS_OF).cast("timestamp_ntz"))
    return out.withColumn("average_accuracy", F.col("average_accuracy").cast("double"))


@query(ACTIVE)
def t05_last_active(spark, sf):
    return mastery.last_active(frame(spark, sf, "quiz_history"))


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_code_id ORDER BY quiz_date DESC, id DESC)::INTEGER AS rank FROM fx_quiz_history) WHERE rank <= 5")
def w10_recent_history(spark, sf):
    return mastery.recent_history(frame(spark, sf, "quiz_history"), 5)


@query("WITH b AS (SELECT *, sum((NOT is_correct)::INTEGER) OVER (PARTITION BY study_code_id ORDER BY attempted_at, event_id) AS g FROM fx_attempt_events), s AS (SELECT *, (sum(is_correct::INTEGER) OVER (PARTITION BY study_code_id, g ORDER BY attempted_at, event_id))::BIGINT AS streak FROM b) SELECT event_id, study_code_id, streak, (is_correct AND streak IN (3, 5, 10)) AS milestone FROM s")
def w01_streaks(spark, sf):
    return milestones.streaks(frame(spark, sf, "attempt_events")).select("event_id", "study_code_id", "streak", "milestone")


_BEST = "max(score_percentage) OVER (PARTITION BY {0} ORDER BY quiz_date, id ROWS BETWEEN {1} PRECEDING AND 1 PRECEDING)"


@query(f"SELECT id, previous_best, (previous_best IS NULL OR score_percentage > previous_best) AS new_high, score_percentage = 100 AS perfect FROM (SELECT *, {_BEST.format('study_code_id, unit_id, difficulty', 'UNBOUNDED')} AS previous_best FROM fx_quiz_history)")
def w02_new_high(spark, sf):
    return milestones.new_highs(frame(spark, sf, "quiz_history")).select("id", "previous_best", "new_high", "perfect")


@query(f"SELECT id, previous_best, (previous_best IS NULL OR score_percentage > previous_best) AS overall_high FROM (SELECT *, {_BEST.format('study_code_id', '50')} AS previous_best FROM fx_quiz_history)")
def w03_overall_high_50(spark, sf):
    return milestones.overall_highs(frame(spark, sf, "quiz_history")).select("id", "previous_best", "overall_high")


@query("SELECT study_code_id, id, number FROM (SELECT *, row_number() OVER (PARTITION BY study_code_id ORDER BY quiz_date, id)::INTEGER AS number FROM fx_quiz_history) WHERE number IN (10, 25, 50, 100)")
def w04_quiz_count(spark, sf):
    return milestones.quiz_counts(frame(spark, sf, "quiz_history")).select("study_code_id", "id", "number")


_SCORED = "SELECT q.id, q.study_code_id, q.quiz_date, count(*) FILTER (r.is_correct) AS correct, count(r.is_correct) AS total FROM fx_quiz_history q JOIN fx_question_results r ON q.id = r.quiz_history_id GROUP BY 1, 2, 3"


@query(f"WITH s AS ({_SCORED}), w AS (SELECT *, sum(correct) OVER p AS oc, sum(total) OVER p AS ot, sum(correct) OVER n AS nc, sum(total) OVER n AS nt FROM s WINDOW p AS (PARTITION BY study_code_id ORDER BY quiz_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY study_code_id ORDER BY quiz_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), v AS (SELECT id, round(100.0 * oc / ot, 2) AS o, 100.0 * nc / nt AS n FROM w) SELECT id, CASE WHEN o < 90 AND n >= 90 THEN 90 WHEN o < 80 AND n >= 80 THEN 80 WHEN o < 70 AND n >= 70 THEN 70 END AS crossed FROM v")
def w05_accuracy_crossing(spark, sf):
    q, r = frame(spark, sf, "quiz_history").select("id", "study_code_id", "quiz_date"), frame(spark, sf, "question_results")
    sums = r.groupBy(F.col("quiz_history_id").alias("id")).agg(F.count_if("is_correct").alias("correct"), F.count("is_correct").alias("total"))
    return milestones.accuracy_crossings(q.join(sums, "id")).select("id", "crossed")


@query("SELECT quiz_history_id, count(*) FILTER (is_correct) AS correct, count(*) AS total, round(100.0 * count(*) FILTER (is_correct) / count(*), 0)::DOUBLE AS score FROM fx_question_results GROUP BY 1")
def a34_quiz_score(spark, sf):
    out = mastery.quiz_score(frame(spark, sf, "question_results"))
    return out.withColumn("score", F.col("score").cast("double"))


@query("SELECT id, unit_id, difficulty FROM fx_questions WHERE unit_id IN ('unit-2', 'all') AND difficulty = 'beginner'")
def p04_unit_or_all(spark, sf):
    return selection.criteria_filter(frame(spark, sf, "questions"), unit="unit-2", difficulty="beginner").select("id", "unit_id", "difficulty")


@query(f"SELECT study_code_id FROM ({ACTIVE}) WHERE last_active_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def p07_recent_active(spark, sf):
    active = mastery.last_active(frame(spark, sf, "quiz_history"))
    return active.where(F.col("last_active_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.make_interval(days=F.lit(30))).select("study_code_id")


@query("SELECT id, code FROM fx_study_codes WHERE code ILIKE '%00_7%' OR display_name ILIKE '%00_7%' OR admin_label ILIKE '%00_7%'")
def p08_search(spark, sf):
    return mastery.search_students(frame(spark, sf, "study_codes"), "00_7").select("id", "code")


@query("SELECT id, coalesce(wrong_answer_countdown, 15)::BIGINT AS seconds FROM fx_study_codes")
def p21_countdown(spark, sf):
    return frame(spark, sf, "study_codes").select("id", scoring.wrong_answer_pause(F.col("wrong_answer_countdown")).cast("bigint").alias("seconds"))


@query(f"SELECT p.study_code_id, p.overall_accuracy, row_number() OVER (ORDER BY p.overall_accuracy DESC, a.last_active_at DESC NULLS LAST, p.study_code_id)::INTEGER AS rank FROM ({PROGRESS.replace('ELSE 0.0 END', 'ELSE 0.0::DOUBLE END')}) p LEFT JOIN ({ACTIVE}) a ON p.study_code_id = a.study_code_id")
def o02_student_ranking(spark, sf):
    quizzes = frame(spark, sf, "quiz_history")
    rows = mastery.progress(quizzes, frame(spark, sf, "question_results")).withColumn("overall_accuracy", F.col("overall_accuracy").cast("double"))
    return mastery.student_ranking(rows, mastery.last_active(quizzes)).select("study_code_id", "overall_accuracy", "rank")


@query("SELECT severity, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM fx_audit_b), 2)::DOUBLE AS share_pct, CASE severity WHEN 'critical' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END::BIGINT AS rank FROM fx_audit_b GROUP BY severity")
def a21_severity(spark, sf):
    out = audit.severity_distribution(frame(spark, sf, "audit_b"))
    return out.withColumn("share_pct", F.col("share_pct").cast("double"))


_META = "'(?i)" + "|".join(f"(?:{p})" for p in validation.SERVING_META) + "'"


@query(f"SELECT conv_id, turn, coalesce(regexp_matches(text, {_META}), false) AS meta FROM conversations")
def p12_meta_filter(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    return df.select("conv_id", "turn", validation.is_meta_served(F.col("text"), F.lit(None).cast("string")).alias("meta"))


_CANDIDATES = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'multiple-choice' WHEN 1 THEN 'true-false' WHEN 2 THEN 'fill-in-blank' ELSE 'writing' END AS type, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' (answer: x)' WHEN p_partkey % 3 = 0 THEN p_name || ' _____ and _____' ELSE p_name END AS question, CASE WHEN p_partkey % 5 = 0 THEN substr(p_type, 1, 4) WHEN p_partkey % 8 = 1 THEN 'Vrai' ELSE p_type END AS correct_answer, p_type AS o1, p_brand AS o2, CASE WHEN p_partkey % 16 = 0 THEN p_brand ELSE p_name END AS o3, p_partkey % 8 < 7 AS four FROM {part}"
_VALIDATE = "CASE WHEN type = 'multiple-choice' AND NOT four THEN 'MCQ must have exactly 4 options' WHEN type = 'multiple-choice' AND correct_answer NOT IN (o1, o2, o3, 'other') THEN 'MCQ correctAnswer not in options' WHEN type = 'multiple-choice' AND o2 = o3 THEN 'MCQ has duplicate options' WHEN type = 'true-false' AND NOT four THEN 'T/F options must be [\"Vrai\", \"Faux\"]' WHEN type = 'true-false' AND correct_answer NOT IN ('Vrai', 'Faux') THEN 'T/F correctAnswer must be Vrai or Faux' WHEN type = 'fill-in-blank' AND NOT contains(question, '_____') THEN 'Fill-in-blank must contain _____' WHEN type = 'fill-in-blank' AND length(correct_answer) < 1 THEN 'Fill-in-blank answer is empty' WHEN type = 'fill-in-blank' AND p3 AND array_length(string_split(correct_answer, ',')) <> 2 THEN 'Fill-in-blank has 2 blanks but ' || array_length(string_split(correct_answer, ',')) || ' comma-separated answer groups' WHEN type = 'writing' AND length(correct_answer) < 5 THEN 'Writing answer too short (<5 chars)' WHEN contains(question, '(answer:') THEN 'Explicit answer label in question text' END"


@query(f"SELECT id, {_VALIDATE} AS reject_reason FROM (SELECT *, contains(question, '_____ and _____') AS p3 FROM ({_CANDIDATES.replace('{part}', 'part')}))")
def p14_structural_validation(spark, sf):
    rows = spark.sql(_CANDIDATES, part=spark.read.parquet(f"{sf}/part.parquet"))
    options = F.when(~F.col("four"), F.array("o1")).when(F.col("type") == "true-false", F.array(F.lit("Vrai"), F.lit("Faux"))).otherwise(F.array("o1", "o2", "o3", F.lit("other")))
    return validation.validate_structure(rows.withColumn("options", options)).select("id", "reject_reason")


_PROMPT = "CASE p_partkey % 6 WHEN 0 THEN 'Translate ' || p_name WHEN 1 THEN 'Conjugate ' || p_name WHEN 2 THEN 'Write a question about ' || p_name WHEN 3 THEN 'Write two sentences with ' || p_name WHEN 4 THEN 'Describe ' || p_name ELSE 'How do you say it in French: ' || p_name END"
_INFER = "CASE " + " ".join(f"WHEN regexp_matches(lower(prompt), '{p}') THEN '{n}'" for n, p in text.WRITING_TYPE_PATTERNS) + " ELSE 'open_ended' END"


@query(f"SELECT id, {_INFER} AS writing_type FROM (SELECT p_partkey AS id, {_PROMPT} AS prompt FROM part)")
def f12_writing_type(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", f"{_PROMPT} AS prompt")
    return rows.select("id", text.infer_writing_type(F.col("prompt")).alias("writing_type"))


@query("SELECT id, CASE WHEN score_percentage >= 80 THEN 'high' WHEN score_percentage >= 60 THEN 'medium' ELSE 'low' END AS accuracy_band, CASE WHEN score_percentage >= 85 THEN 'high' WHEN score_percentage >= 70 THEN 'medium' ELSE 'low' END AS mastery_band FROM fx_quiz_history")
def f25_bands(spark, sf):
    return frame(spark, sf, "quiz_history").select("id", scoring.accuracy_band(F.col("score_percentage")).alias("accuracy_band"), scoring.mastery_band(F.col("score_percentage")).alias("mastery_band"))


_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '\s+([?!;:])', '\1', 'g')"
_NORM = r"regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


@query(f"SELECT id, {_KEY.format('user_answer')} AS normalized FROM fx_answers")
def f01_normalize(spark, sf):
    return frame(spark, sf, "answers").select("id", text.match_key(F.col("user_answer")).alias("normalized"))


_SIM = "(1.0 - levenshtein({0}, {1})::DOUBLE / greatest(length({0}), length({1})))"


@query(f"SELECT id, round({_SIM.format('a', 'b')}, 6)::DOUBLE AS similarity FROM (SELECT id, {_NORM.format('user_answer')} AS a, {_NORM.format('correct_answer')} AS b FROM fx_answers)")
def f05_similarity(spark, sf):
    return frame(spark, sf, "answers").select("id", F.round(text.similarity(F.col("user_answer"), F.col("correct_answer")), 6).alias("similarity"))


_EVAL = f"""WITH n AS (SELECT *, {_NORM.format('user_answer')} AS u, {_NORM.format('correct_answer')} AS c, {_NORM.format('variation_0')} AS v0, {_NORM.format('variation_1')} AS v1, CASE difficulty WHEN 'beginner' THEN 0.70 WHEN 'intermediate' THEN 0.85 ELSE 0.95 END AS t FROM fx_answers),
s AS (SELECT *, {_SIM.format('u', 'c')} AS sc, {_SIM.format('u', 'v0')} AS s0, {_SIM.format('u', 'v1')} AS s1 FROM n),
k AS (SELECT *, CASE WHEN length(trim(user_answer)) < 2 THEN 'empty_check' WHEN u = c THEN 'exact_match' WHEN u = v0 OR s0 >= 0.95 OR u = v1 OR s1 >= 0.95 THEN 'variation' WHEN sc >= t THEN 'fuzzy' ELSE 'needs_semantic' END AS tier FROM s)
SELECT id, tier, CASE tier WHEN 'empty_check' THEN false WHEN 'exact_match' THEN true WHEN 'variation' THEN true WHEN 'fuzzy' THEN round(sc * 100) >= 95 OR (round(sc * 100) >= 85 AND difficulty = 'beginner') END AS is_correct,
CASE tier WHEN 'empty_check' THEN 0 WHEN 'exact_match' THEN 100 WHEN 'variation' THEN CASE WHEN u = v0 THEN 98 WHEN s0 >= 0.95 THEN round(s0 * 100) - 2 WHEN u = v1 THEN 98 ELSE round(s1 * 100) - 2 END WHEN 'fuzzy' THEN round(sc * 100) END::INTEGER AS score,
CASE WHEN tier = 'variation' THEN CASE WHEN u = v0 OR s0 >= 0.95 THEN 0 ELSE 1 END END::INTEGER AS matched_index FROM k"""


@query(_EVAL)
def e_evaluate_answers(spark, sf):
    rows = frame(spark, sf, "answers").withColumn("variations", F.array("variation_0", "variation_1"))
    return evaluate.evaluate_answers(rows).select("id", "tier", "is_correct", "score", "matched_index")


@query(r"SELECT id, md5(trim(regexp_replace(lower(question || '|' || correct_answer || '|' || topic || '|' || difficulty), '\s+', ' ', 'g'))) AS content_hash FROM fx_questions")
def f08_content_hash(spark, sf):
    return frame(spark, sf, "questions").select("id", hashing.question_hash(F.col("question"), F.col("correct_answer"), F.col("topic"), F.col("difficulty")).alias("content_hash"))


@query("SELECT id, left(sha256(question), 16) AS prompt_hash, 'study-' || left(md5(id::VARCHAR), 8) AS code FROM fx_questions")
def f10_hashes(spark, sf):
    return frame(spark, sf, "questions").select("id", hashing.prompt_hash(F.col("question")).alias("prompt_hash"), hashing.study_code(F.col("id")).alias("code"))


@query("SELECT topic, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(topic, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296) AS hash FROM (SELECT DISTINCT topic FROM fx_questions)")
def f11_djb2_exemplars(spark, sf):
    return frame(spark, sf, "questions").select("topic").distinct().select("topic", hashing.djb2(F.col("topic")).alias("hash"))


@query("SELECT id, content_hash FROM (SELECT id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS n FROM fx_questions WHERE id % 2 = 0 AND content_hash NOT IN (SELECT content_hash FROM fx_questions WHERE id % 2 = 1)) WHERE n = 1")
def j04_dedup_anti(spark, sf):
    rows = frame(spark, sf, "questions").select("id", "content_hash")
    return dedup.new_only(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), order=["id"])


_OVERLAP = "SELECT a.cohort AS group_a, b.cohort AS group_b, (SELECT count(*) FROM (SELECT DISTINCT content_hash FROM fx_experiment_questions x WHERE x.cohort = a.cohort INTERSECT SELECT DISTINCT content_hash FROM fx_experiment_questions y WHERE y.cohort = b.cohort)) AS shared FROM (SELECT DISTINCT cohort FROM fx_experiment_questions) a JOIN (SELECT DISTINCT cohort FROM fx_experiment_questions) b ON a.cohort < b.cohort"


@query(_OVERLAP)
def j07_pairwise_overlap(spark, sf):
    return dedup.pairwise_overlap(frame(spark, sf, "experiment_questions"))


@query(f"SELECT o.group_a, o.group_b, shared, na.n AS n_a, nb.n AS n_b, round(100.0 * shared / least(na.n, nb.n), 1)::DOUBLE AS pct_of_smaller FROM ({_OVERLAP}) o JOIN (SELECT cohort, count(*) AS n FROM fx_experiment_questions GROUP BY 1) na ON o.group_a = na.cohort JOIN (SELECT cohort, count(*) AS n FROM fx_experiment_questions GROUP BY 1) nb ON o.group_b = nb.cohort")
def a12_overlap_pct(spark, sf):
    out = dedup.overlap_share(frame(spark, sf, "experiment_questions"))
    return out.withColumn("pct_of_smaller", F.col("pct_of_smaller").cast("double"))


_FOLD = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY study_code_id, question_id ORDER BY attempted_at, event_id) AS n FROM fx_attempt_events),
f AS (SELECT study_code_id, question_id, n, attempted_at, CASE WHEN is_correct THEN 2 ELSE 1 END AS box, 0 AS streak FROM e WHERE n = 1
UNION ALL SELECT e.study_code_id, e.question_id, e.n, e.attempted_at,
CASE WHEN NOT e.is_correct THEN 1 WHEN (f.box = 1) OR (f.box IN (2, 3) AND f.streak + 1 >= 2) OR (f.box = 4 AND f.streak + 1 >= 3) THEN f.box + 1 ELSE f.box END,
CASE WHEN NOT e.is_correct THEN 0 WHEN (f.box = 1) OR (f.box IN (2, 3) AND f.streak + 1 >= 2) OR (f.box = 4 AND f.streak + 1 >= 3) THEN 0 ELSE f.streak + 1 END
FROM f JOIN e ON e.study_code_id = f.study_code_id AND e.question_id = f.question_id AND e.n = f.n + 1)
SELECT study_code_id, question_id, box::INTEGER AS box, streak::INTEGER AS consecutive_correct, attempted_at AS last_reviewed FROM f QUALIFY n = max(n) OVER (PARTITION BY study_code_id, question_id)"""


_WEIGHTS = _FOLD.replace("SELECT study_code_id, question_id, box::INTEGER AS box", "SELECT q.question_id AS id, t.box, CASE t.box WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 3 END AS weight FROM (SELECT DISTINCT question_id FROM fx_attempt_events) q LEFT JOIN (SELECT study_code_id, question_id, box::INTEGER AS box") + ") t ON q.question_id = t.question_id AND t.study_code_id = 7"


@query(_FOLD)
def t01_leitner_state(spark, sf):
    return leitner.leitner_state(frame(spark, sf, "attempt_events"))


@query(_WEIGHTS)
def f31_weights(spark, sf):
    events = frame(spark, sf, "attempt_events")
    questions = events.select(F.col("question_id").alias("id")).distinct()
    return leitner.question_weights(questions, leitner.leitner_state(events), 7)


_U = "(('0x' || substr(md5({0} || '|{1}'), 1, 8))::BIGINT + 0.5) / 4294967296.0"


@query(f"SELECT id, row_number() OVER (ORDER BY -ln({_U.format('id', 'draw')}) / (1 + id % 5), id)::INTEGER AS position FROM fx_questions")
def o09_weighted_order(spark, sf):
    rows = frame(spark, sf, "questions").select("id").withColumn("weight", 1 + F.col("id") % 5)
    return selection.weighted_shuffle(rows, "draw").select("id", "position")


@query("SELECT * FROM (VALUES ('multiple-choice', 4), ('true-false', 1), ('fill-in-blank', 2), ('writing', 3)) t(type, quota)")
def o10_quota(spark, sf):
    return selection.quota_frame(spark, selection.mode_shares("practice"), 10)


_K = "('0x' || substr(md5({0} || '|{1}'), 1, 8))::BIGINT"


@query(f"""WITH q(type, quota) AS (VALUES ('multiple-choice', 14), ('true-false', 6), ('fill-in-blank', 8), ('writing', 12)),
p AS (SELECT *, {_K.format('id', 's')} AS k FROM fx_questions WHERE quality_status = 'active' AND unit_id IN ('unit-1', 'all')),
c AS (SELECT id, p.type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY k, id) AS r FROM p) p JOIN q ON p.type = q.type WHERE r <= quota),
b AS (SELECT id, type FROM (SELECT *, row_number() OVER (ORDER BY {_K.format('id', 's-fill')}, id) AS r FROM p WHERE id NOT IN (SELECT id FROM c)) WHERE r <= 40 - (SELECT count(*) FROM c))
SELECT id, type, 'quota' AS how FROM c UNION ALL SELECT id, type, 'backfill' AS how FROM b""")
def o11_selection(spark, sf):
    return selection.assemble_quiz(frame(spark, sf, "questions"), 40, "s", unit="unit-1").select("id", "type", "how")


_WT = "CASE id % 3 WHEN 0 THEN 'translation' WHEN 1 THEN 'conjugation' END"


@query(f"SELECT 'type' AS kind, type AS value, count(*) AS n FROM fx_questions GROUP BY type UNION ALL SELECT 'writing_type', coalesce({_WT}, 'unspecified'), count(*) FROM fx_questions WHERE type = 'writing' GROUP BY 2")
def a08_distribution(spark, sf):
    return planning.distribution(frame(spark, sf, "questions").withColumn("writing_type", F.expr(_WT)))


_TT = ", ".join(f"('{k}', {v})" for k, v in planning.TYPE_TARGETS.items())


@query(f"WITH t(value, target) AS (VALUES {_TT}), c AS (SELECT type AS value, count(*) AS n FROM fx_questions GROUP BY 1), p AS (SELECT t.value, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT sum(n) FROM c), 1)::DOUBLE AS pct, target FROM t LEFT JOIN c ON t.value = c.value) SELECT value, n, pct, target, round(pct - target, 1) AS diff, CASE WHEN abs(round(pct - target, 1)) <= 3 THEN 'ok' WHEN pct > target THEN 'over' ELSE 'under' END AS status FROM p")
def a09_target_gap(spark, sf):
    counts = frame(spark, sf, "questions").groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n"))
    out = planning.target_gap(counts, planning.TYPE_TARGETS)
    return out.select("value", "n", F.col("pct").cast("double").alias("pct"), "target", F.col("diff").cast("double").alias("diff"), "status")


_PLAN = ", ".join(f"('{v}', {planning.WRITING_TARGETS[v]}, {t}, {d})" for v, (t, d) in planning.COMPATIBLE.items())


@query(f"WITH t(value, target, topics, drift) AS (VALUES {_PLAN}), c AS (SELECT coalesce({_WT}, 'unspecified') AS value, count(*) AS n FROM fx_questions WHERE type = 'writing' GROUP BY 1), p AS (SELECT t.*, coalesce(n, 0) AS n, ceil(round(target * (SELECT sum(n) FROM c)::DOUBLE / 100, 9))::BIGINT AS target_count FROM t LEFT JOIN c ON t.value = c.value), q AS (SELECT *, target_count - n AS needed, CASE WHEN topics > 0 THEN topics * 3 ELSE 120 END::BIGINT AS calls FROM p WHERE target_count > n) SELECT value, target_count, n AS current_count, needed, calls, least(CASE WHEN topics > 0 THEN ceil(round(calls * ceil(round(needed / (topics * 3 * (1 - drift::DOUBLE)), 9)) * (1 - drift::DOUBLE), 9))::BIGINT ELSE needed END, needed + 5) AS questions, round(calls * 0.008::DOUBLE, 3) AS cost FROM q")
def a10_plan(spark, sf):
    writing = frame(spark, sf, "questions").where("type = 'writing'").groupBy(F.coalesce(F.expr(_WT), F.lit("unspecified")).alias("value")).agg(F.count("*").alias("n"))
    return planning.generation_plan(writing, 40)


_GEN = "SELECT s_suppkey AS batch, CAST(s_suppkey % 30 AS BIGINT) AS generated, CAST(s_suppkey % 17 AS BIGINT) AS duplicates, CAST(s_suppkey % 3 AS BIGINT) AS structural_rejects, CAST(s_suppkey % 5 AS BIGINT) AS validation_rejects, CAST(s_suppkey % 2 AS BIGINT) AS meta_filtered, s_nationkey AS unit FROM {supplier}"


@query(f"SELECT unit, sum(generated)::BIGINT AS generated, sum(duplicates)::BIGINT AS duplicates, sum(structural_rejects)::BIGINT AS structural_rejects, sum(validation_rejects)::BIGINT AS validation_rejects, sum(meta_filtered)::BIGINT AS meta_filtered, CASE WHEN sum(generated + structural_rejects + validation_rejects) > 0 THEN round(100.0 * sum(generated) / sum(generated + structural_rejects + validation_rejects), 1) ELSE 100.0 END::DOUBLE AS pass_rate, CASE WHEN sum(generated) > 0 THEN round(100.0 * sum(duplicates) / sum(generated), 1) ELSE 0 END::DOUBLE AS collision_rate, CASE WHEN sum(generated) > 0 AND round(100.0 * sum(duplicates) / sum(generated), 1) >= 80 THEN 'very_high' WHEN sum(generated) > 0 AND round(100.0 * sum(duplicates) / sum(generated), 1) >= 50 THEN 'moderate' WHEN sum(generated) > 0 AND round(100.0 * sum(duplicates) / sum(generated), 1) >= 30 THEN 'some' ELSE 'none' END AS collision_band FROM ({_GEN.replace('{supplier}', 'supplier')}) GROUP BY unit")
def a29_generation_stats(spark, sf):
    rows = spark.sql(_GEN, supplier=spark.read.parquet(f"{sf}/supplier.parquet"))
    out = planning.generation_stats(rows, ["unit"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("pass_rate", "collision_rate")})


_METRICS = "SELECT cohort, count(*) AS total, count(*) FILTER (coalesce(gate_answer_correct, true) AND coalesce(gate_register_appropriate, true)) AS gate_pass_count, count(*) FILTER (coalesce(gate_answer_correct, true) AND coalesce(gate_register_appropriate, true)) / count(*)::DOUBLE AS gate_pass_rate, count(*) FILTER (NOT gate_answer_correct) AS fail_gate_answer_correct, count(*) FILTER (NOT gate_register_appropriate) AS fail_gate_register_appropriate, count(*) FILTER (NOT difficulty_appropriate) AS difficulty_mismatch_count, count(*) FILTER (NOT difficulty_appropriate) / count(*)::DOUBLE AS difficulty_mismatch_rate, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics, count(*) FILTER (severity = 'critical') AS severity_critical, count(*) FILTER (severity = 'minor') AS severity_minor, count(*) FILTER (severity = 'suggestion') AS severity_suggestion FROM fx_experiment_questions GROUP BY cohort"


@query(_METRICS)
def a11_cohort_metrics(spark, sf):
    return experiments.cohort_metrics(frame(spark, sf, "experiment_questions"), GATE2)


@query(f"WITH m AS ({_METRICS}) SELECT a.cohort AS base, b.cohort, round((b.gate_pass_rate - a.gate_pass_rate) * 100, 1) AS gate_pass_rate_pp, round((b.difficulty_mismatch_rate - a.difficulty_mismatch_rate) * 100, 1) AS difficulty_mismatch_rate_pp FROM m a JOIN m b ON b.cohort <> 'control' AND (a.cohort = 'control' OR a.cohort < b.cohort)")
def a26_deltas(spark, sf):
    metrics = experiments.cohort_metrics(frame(spark, sf, "experiment_questions"), GATE2)
    return experiments.impact_deltas(metrics, ["gate_pass_rate", "difficulty_mismatch_rate"])


@query(f"WITH m AS ({_METRICS}), c AS (SELECT difficulty_mismatch_rate AS v FROM m WHERE cohort = 'control'), t AS (SELECT cohort, difficulty_mismatch_rate AS v FROM m WHERE cohort <> 'control') SELECT t.cohort, CASE WHEN t.v > c.v THEN 'increase' WHEN t.v < c.v THEN 'decrease' ELSE 'no change' END AS direction, round((t.v - c.v) * 100, 1) AS delta_pp, (SELECT cohort FROM t ORDER BY v, cohort LIMIT 1) AS best_cohort, CASE WHEN (SELECT min(v) FROM t) < c.v THEN 'supported' ELSE 'refuted' END AS verdict FROM t, c")
def a27_conclusion(spark, sf):
    metrics = experiments.cohort_metrics(frame(spark, sf, "experiment_questions"), GATE2)
    return experiments.conclusions(metrics, "difficulty_mismatch_rate")


_AGREE = " UNION ALL ".join(f"SELECT '{c}' AS criterion, count(*) FILTER (a.{c} AND b.{c}) AS both_pass, count(*) FILTER (NOT a.{c} AND NOT b.{c}) AS both_fail, count(*) FILTER (NOT a.{c} AND b.{c}) AS a_only_fail, count(*) FILTER (a.{c} AND NOT b.{c}) AS b_only_fail, round(100.0 * count(*) FILTER (a.{c} = b.{c}) / count(*), 1)::DOUBLE AS agreement_pct FROM fx_audit_a a JOIN fx_audit_b b ON a.id = b.id" for c in audit.CORE)


@query(_AGREE)
def a13_agreement(spark, sf):
    out = audit.agreement(frame(spark, sf, "audit_a"), frame(spark, sf, "audit_b"))
    return out.withColumn("agreement_pct", F.col("agreement_pct").cast("double"))


def _fails(criteria):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in criteria) + "], lambda x: x IS NOT NULL), ',')"


_PASS_A, _PASS_B = " AND ".join(audit.CORE), " AND ".join(audit.ALL_EIGHT)


@query(f"SELECT id, severity, {_fails(audit.ALL_EIGHT)} AS failed FROM fx_audit_b WHERE NOT ({_PASS_B}) AND id IN (SELECT id FROM fx_audit_a WHERE {_PASS_A})")
def a14_b_only(spark, sf):
    return audit.one_sided(frame(spark, sf, "audit_a"), audit.CORE, frame(spark, sf, "audit_b"), audit.ALL_EIGHT).select("id", "severity", "failed")


@query(f"SELECT id, {_fails(audit.CORE)} AS failed FROM fx_audit_a WHERE NOT ({_PASS_A}) AND id IN (SELECT id FROM fx_audit_b WHERE {_PASS_B})")
def a15_a_only(spark, sf):
    return audit.one_sided(frame(spark, sf, "audit_b"), audit.ALL_EIGHT, frame(spark, sf, "audit_a"), audit.CORE).select("id", "failed")


@query(" UNION ALL ".join(f"SELECT '{c}' AS criterion, count(*) FILTER (NOT {c}) AS fails, round(100.0 * count(*) FILTER (NOT {c}) / count(*), 2)::DOUBLE AS fail_pct FROM fx_audit_b" for c in audit.ALL_EIGHT))
def a16_fail_rates(spark, sf):
    out = audit.fail_rates(frame(spark, sf, "audit_b"), audit.ALL_EIGHT)
    return out.withColumn("fail_pct", F.col("fail_pct").cast("double"))


@query(f"SELECT coalesce(a.type, b.type) AS type, a_pass_pct, b_pass_pct FROM (SELECT type, round(100.0 * count(*) FILTER ({_PASS_A}) / count(*), 2)::DOUBLE AS a_pass_pct FROM fx_audit_a GROUP BY 1) a FULL JOIN (SELECT type, round(100.0 * count(*) FILTER ({_PASS_B}) / count(*), 2)::DOUBLE AS b_pass_pct FROM fx_audit_b GROUP BY 1) b ON a.type = b.type")
def a17_by_type(spark, sf):
    out = audit.pass_rate_by_type(frame(spark, sf, "audit_a"), frame(spark, sf, "audit_b"))
    return out.withColumns({c: F.col(c).cast("double") for c in ("a_pass_pct", "b_pass_pct")})


def _rates(df, by, name):
    return audit.pass_rate_by(df, by, audit.GATE, name).withColumn("pass_pct", F.col("pass_pct").cast("double"))


_PASS_G = " AND ".join(audit.GATE)
_RATE = f"count(*) AS total, count(*) FILTER ({_PASS_G}) AS passed, round(100.0 * count(*) FILTER ({_PASS_G}) / count(*), 2)::DOUBLE AS pass_pct"


@query(f"SELECT topic, {_RATE} FROM fx_audit_b GROUP BY topic")
def a18_by_topic(spark, sf):
    return _rates(frame(spark, sf, "audit_b"), F.col("topic"), "topic")


@query(f"SELECT q.difficulty, {_RATE} FROM fx_audit_b b JOIN fx_questions q ON b.id = q.id GROUP BY 1")
def a19_by_difficulty(spark, sf):
    joined = frame(spark, sf, "audit_b").join(frame(spark, sf, "questions").select("id", "difficulty"), "id")
    return _rates(joined, F.col("difficulty"), "difficulty")


@query(f"SELECT coalesce(q.generated_by, 'unknown') AS generator, {_RATE} FROM fx_audit_b b JOIN fx_questions q ON b.id = q.id GROUP BY 1")
def a20_by_generator(spark, sf):
    joined = frame(spark, sf, "audit_b").join(frame(spark, sf, "questions").select("id", "generated_by"), "id")
    return _rates(joined, F.coalesce("generated_by", F.lit("unknown")), "generator")


@query("SELECT q.difficulty, " + ", ".join(f"count(*) FILTER (coalesce(b.suggested_difficulty, 'unspecified') = '{s}') AS {s}" for s in [*scoring.LEVELS, "unspecified"]) + " FROM fx_audit_b b JOIN fx_questions q ON b.id = q.id WHERE NOT b.difficulty_appropriate GROUP BY 1")
def a22_reclass_pivot(spark, sf):
    return audit.reclassification(frame(spark, sf, "questions"), frame(spark, sf, "audit_b"))


_VARS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN array(p_name) ELSE array() END AS missing_variations, CASE WHEN p_partkey % 4 = 0 THEN array(p_name, p_type) ELSE array() END AS invalid_variations FROM {part}"


@query("SELECT count(*) FILTER (p_partkey % 3 = 0) AS missing_total, count(*) FILTER (p_partkey % 3 = 0) AS missing_questions, 2 * count(*) FILTER (p_partkey % 4 = 0) AS invalid_total, count(*) FILTER (p_partkey % 4 = 0) AS invalid_questions FROM part")
def a24_variations(spark, sf):
    return audit.variation_totals(spark.sql(_VARS, part=spark.read.parquet(f"{sf}/part.parquet")))


_OK = f"(NOT starts_with(notes, 'PARSE_ERROR:')) AND {_PASS_G}"


@query(f"SELECT CASE WHEN b.suggested_difficulty IN ('beginner', 'intermediate', 'advanced') THEN b.suggested_difficulty ELSE q.difficulty END AS difficulty, count(*) AS n FROM fx_audit_b b JOIN fx_questions q ON b.id = q.id WHERE {_OK} GROUP BY 1")
def a25_served_difficulty(spark, sf):
    return audit.served_difficulty(frame(spark, sf, "questions"), frame(spark, sf, "audit_b"))


@query(f"SELECT q.id, CASE WHEN b.id IS NULL OR starts_with(notes, 'PARSE_ERROR:') THEN q.quality_status WHEN {_PASS_G} THEN 'active' ELSE 'flagged' END AS quality_status FROM fx_questions q LEFT JOIN fx_audit_b b ON q.id = b.id")
def d10_apply_audit(spark, sf):
    return audit.apply_audit(frame(spark, sf, "questions"), frame(spark, sf, "audit_b")).select("id", "quality_status")


@query(f"SELECT q.id, CASE WHEN {_OK} AND b.suggested_difficulty IS NOT NULL THEN b.suggested_difficulty ELSE q.difficulty END AS difficulty FROM fx_questions q LEFT JOIN fx_audit_b b ON q.id = b.id")
def d11_remediate(spark, sf):
    return audit.apply_audit(frame(spark, sf, "questions"), frame(spark, sf, "audit_b")).select("id", "difficulty")


@query("SELECT study_code_id, question_id, event_id, attempted_at FROM (SELECT *, row_number() OVER (PARTITION BY study_code_id, question_id ORDER BY (event_id % 2) DESC, event_id DESC) AS n FROM fx_attempt_events) WHERE n = 1")
def d01_upsert(spark, sf):
    rows = frame(spark, sf, "attempt_events").select("study_code_id", "question_id", "event_id", "attempted_at")
    keys = ["study_code_id", "question_id"]
    base = dml.upsert(rows.limit(0), rows.where("event_id % 2 = 0"), keys, "event_id")
    return dml.upsert(base, rows.where("event_id % 2 = 1"), keys, "event_id")


@query("WITH gone AS (SELECT id FROM fx_study_codes WHERE id % 10 = 3) SELECT 'quiz_history' AS tbl, count(*) AS n FROM fx_quiz_history WHERE study_code_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'question_results', count(*) FROM fx_question_results WHERE study_code_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'study_codes', count(*) FROM fx_study_codes WHERE id NOT IN (SELECT id FROM gone)")
def d05_cascade_delete(spark, sf):
    tables = {n: frame(spark, sf, n) for n in ("study_codes", "quiz_history", "question_results")}
    left = dml.cascade_delete(tables, "study_codes", tables["study_codes"].where("id % 10 = 3").select("id"))
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT 'questions.unit_id references' AS rule, count(*) AS n FROM fx_questions WHERE unit_id NOT IN (SELECT id FROM fx_units) UNION ALL SELECT 'questions.batch_id references', count(*) FROM fx_questions WHERE batch_id NOT IN (SELECT id FROM fx_batches) UNION ALL SELECT 'questions(content_hash) unique', count(*) FROM (SELECT content_hash FROM fx_questions GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'questions.difficulty in', count(*) FROM fx_questions WHERE difficulty NOT IN ('beginner', 'intermediate') UNION ALL SELECT 'questions.generated_by required', count(*) FROM fx_questions WHERE generated_by IS NULL")
def d08_constraint_report(spark, sf):
    q = frame(spark, sf, "questions")
    return (
        dml.orphans(q, frame(spark, sf, "units"), "questions", "unit_id")
        .unionByName(dml.orphans(q, frame(spark, sf, "batches"), "questions", "batch_id"))
        .unionByName(dml.duplicate_keys(q, "questions", ["content_hash"]))
        .unionByName(dml.violations(q, "questions", enums={"difficulty": ["beginner", "intermediate"]}, required=["generated_by"]))
    )


@query("WITH t AS (SELECT topic, string_split(topic, ' ') AS w FROM fx_topic_names) SELECT a.topic AS left, b.topic AS right FROM t a JOIN t b ON a.topic < b.topic WHERE contains(a.topic, b.topic) OR contains(b.topic, a.topic) OR len(list_filter(list_intersect(list_distinct(a.w), list_distinct(b.w)), lambda x: length(x) > 3)) >= 2".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def j08_topic_pairs(spark, sf):
    names = frame(spark, sf, "topic_names")
    return topics.candidate_pairs(names, names, same=True)


@query(f"SELECT m.study_code_id, r.id, r.url, r.topic FROM ({MASTERY}) m JOIN fx_learning_resources r ON r.topic = m.topic AND r.quality_status = 'active' WHERE m.mastery_percentage < 70")
def j09_weak_topic_resources(spark, sf):
    # said before the sort, since the join's own filter stops there and the two uses of the weak topics would be shuffled apart
    weak = mastery.weak_topics(frame(spark, sf, "question_results").where("topic is not null")).select("study_code_id", "topic")
    # topic by topic, a student's topic streams past its resources, so that equal runs stand together and files are small; Spark
    # drops a sort that only a join follows, not one whose rows are observed
    ordered = weak.sortWithinPartitions("topic", "study_code_id").observe("weak_topics", F.count("*").alias("n"))
    return ordered.join(resources.for_topics(frame(spark, sf, "learning_resources"), weak), "topic").select("study_code_id", "id", "url", "topic")


@query("WITH w AS (SELECT q.topic, q.unit_id FROM fx_questions q JOIN fx_question_results r ON q.id = r.question_id WHERE NOT r.is_correct) SELECT id, topic, unit_id FROM fx_learning_resources WHERE quality_status = 'active' AND topic IN (SELECT topic FROM w) AND unit_id IN (SELECT unit_id FROM w)")
def j10_in_by_in(spark, sf):
    wrong = frame(spark, sf, "question_results").where("not is_correct").select(F.col("question_id").alias("id")).distinct()
    items = frame(spark, sf, "questions").join(wrong, "id").select("topic", "unit_id")
    return resources.for_topics_and_units(frame(spark, sf, "learning_resources"), items).select("id", "topic", "unit_id")


@query(f"WITH k AS (SELECT word, first_letter, {_K.format('word', 'pair')} AS k FROM fx_source_words WHERE category = 'animal'), s AS (SELECT first_letter, arg_min(word, (k, word)) AS same FROM k GROUP BY 1) SELECT a.word AS adjective, coalesce(same, (SELECT word FROM k ORDER BY k, word LIMIT 1)) AS animal, same IS NOT NULL AS alliterates FROM fx_source_words a LEFT JOIN s ON a.first_letter = s.first_letter WHERE category = 'adjective'")
def j13_alliteration(spark, sf):
    return resources.alliteration(frame(spark, sf, "source_words"), "pair")


_MATERIAL = "'# Top' || chr(10) || 'https://left.org/' || s_suppkey || chr(10) || '## Nouns' || chr(10) || repeat('line' || chr(10), CAST(s_suppkey % 20 AS INT)) || 'https://noun.org/' || s_suppkey"


@query("SELECT 's' || s_suppkey AS unit_id, 'https://left.org/' || s_suppkey AS url FROM supplier UNION ALL SELECT 's' || s_suppkey, 'https://noun.org/' || s_suppkey FROM supplier WHERE s_suppkey % 20 + 2 <= 10")
def j16_leftover(spark, sf):
    units = spark.sql(f"SELECT 's' || s_suppkey AS unit_id, {_MATERIAL} AS text FROM {{s}}", s=spark.read.parquet(f"{sf}/supplier.parquet"))
    wanted = units.select("unit_id", F.lit("Nouns").alias("topic"), F.lit(None).cast("array<string>").alias("aliases"))
    found = resources.extract_resources(units, wanted, units.select(F.col("unit_id").alias("id"), F.lit("A unit").alias("title")))
    return found.where("topic = 'General'").select("unit_id", "url")


@query("SELECT topic, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY id)::INTEGER AS rank FROM fx_learning_resources WHERE quality_status = 'active') WHERE rank <= 3")
def w07_top_n_per_topic(spark, sf):
    rows = frame(spark, sf, "learning_resources").where("quality_status = 'active'")
    return selection.top_n(rows, ["topic"], [F.col("id")], 3).select("topic", "id", "rank")


@query("SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY topic, unit_id, title) AS n FROM fx_learning_resources) WHERE n = 1")
def w08_first_by_url(spark, sf):
    return dedup.keep_first(frame(spark, sf, "learning_resources"), ["url"], ["topic", "unit_id", "title"]).select("id", "url")


@query("WITH t AS (SELECT id, regexp_extract_all(user_answer, '\\s+|\\S+') AS u, regexp_extract_all(correct_answer, '\\s+|\\S+') AS c FROM fx_answers) SELECT id, len(list_filter(range(1, greatest(len(u), len(c)) + 1), lambda i: u[i] IS DISTINCT FROM c[i])) AS diffs FROM t")
def w12_word_diff(spark, sf):
    rows = frame(spark, sf, "answers").withColumn("d", text.word_diff(F.col("user_answer"), F.col("correct_answer")))
    return rows.select("id", F.size(F.filter("d", lambda x: x["is_diff"])).cast("bigint").alias("diffs"))


@query("WITH m AS (SELECT topic, count(*) AS incorrect FROM fx_question_results WHERE NOT is_correct GROUP BY 1 ORDER BY incorrect DESC, topic LIMIT 5), r AS (SELECT topic, id, url, row_number() OVER (PARTITION BY topic ORDER BY id)::INTEGER AS n FROM fx_learning_resources WHERE quality_status = 'active') SELECT m.topic, m.incorrect, r.id, r.url, r.n FROM m LEFT JOIN r ON m.topic = r.topic AND r.n <= 3")
def a28_study_guide(spark, sf):
    return mastery.study_guide(frame(spark, sf, "question_results"), frame(spark, sf, "learning_resources"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '')"


@query(f"SELECT page_id AS id, CASE WHEN h IN ('youtube.com', 'youtu.be', 'vimeo.com', 'dailymotion.com') OR ends_with(h, 'youtube.com') THEN 'video' ELSE 'article' END AS resource_type, CASE WHEN h = '' THEN 'unknown' ELSE h END AS provider, md5(lower(trim(url)) || '|u|t') AS content_hash FROM (SELECT *, {_HOST} AS h FROM pages)")
def f17_classify_url(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    return rows.select(F.col("page_id").alias("id"), urls.resource_type(F.col("url")).alias("resource_type"), urls.provider(F.col("url")).alias("provider"), hashing.resource_hash(F.col("url"), F.lit("u"), F.lit("t")).alias("content_hash"))


@query("SELECT topic, count(*) FILTER (h IN ('youtube.com', 'youtu.be', 'vimeo.com', 'dailymotion.com')) AS videos, count(*) FILTER (h NOT IN ('youtube.com', 'youtu.be', 'vimeo.com', 'dailymotion.com')) AS articles, 0::BIGINT AS shorts, count(*) AS total FROM (SELECT topic, " + _HOST + " AS h FROM fx_learning_resources) GROUP BY topic")
def a31_resource_counts(spark, sf):
    return resources.counts(resources.described(frame(spark, sf, "learning_resources")))


@query("SELECT count(*) AS n FROM fx_questions")
def s06_row_count(spark, sf):
    return readers.row_count(frame(spark, sf, "questions"))


@query("SELECT id, topic FROM fx_questions WHERE quality_status = 'active' AND unit_id IN ('unit-3', 'all')")
def s04_active_unit_questions(spark, sf):
    return readers.active_questions(frame(spark, sf, "questions"), "unit-3").select("id", "topic")


@query("SELECT id, initcap_label AS label FROM (SELECT id, 'Unit ' || substr(id, 6) AS initcap_label FROM fx_units)")
def f23_unit_label(spark, sf):
    return readers.ordered_units(frame(spark, sf, "units")).select("id", text.unit_label(F.col("id")).alias("label"))


def flagship(spark, sf):
    """Weakest topics over all students and what to study for them."""
    return a28_study_guide(spark, sf)


from . import coverage  # noqa: E402, F401 - registers its queries in the same tables
