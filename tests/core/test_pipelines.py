from pyspark.sql import functions as F

from quillspark.operators import audit
from quillspark.plans import pipelines as P
from quillspark.plans.fixtures import frame


def test_student_pages(spark, sf):
    quizzes, results = frame(spark, sf, "quiz_history"), frame(spark, sf, "question_results")
    student = results.groupBy("study_code_id").count().orderBy(F.desc("count"), "study_code_id").first().study_code_id
    page = P.progress_page(student, quizzes, results, frame(spark, sf, "learning_resources"))
    summary = page["summary"].first()
    assert summary.total_questions == results.where(F.col("study_code_id") == student).count() > 0
    assert [r.rank for r in page["history"].collect()] == list(range(1, min(10, summary.total_quizzes) + 1))
    weak = {r.topic for r in page["weak"].collect()}
    assert {r.topic for r in page["resources"].collect()} <= weak <= {r.topic for r in page["mastery"].collect()}


def test_quiz_and_save(spark, sf):
    made = P.assemble_quiz(frame(spark, sf, "questions"), 10, "seed", mode="practice")
    picked = made["questions"].collect()
    assert len(picked) == 10 == len({r.id for r in picked})
    answers = spark.createDataFrame([(r.id, r.correct_answer if i % 2 else "wrong") for i, r in enumerate(picked)], "id bigint, user_answer string")
    none = spark.createDataFrame([], "id bigint, is_correct boolean, score int")
    quiz = spark.createDataFrame([(1, 2)], "quiz_history_id int, study_code_id int")
    saved = P.save_quiz(spark.createDataFrame(picked, made["questions"].schema), answers, none, quiz)
    assert tuple(saved["score"].first()) [1:3] == (5, 10) and saved["incorrect"].count() == 5


def test_audits(spark, sf):
    questions, a, b = (frame(spark, sf, n) for n in ("questions", "audit_a", "audit_b"))
    out = P.audit_summary(questions, b)
    status = {r.quality_status: r["count"] for r in out["questions"].groupBy("quality_status").count().collect()}
    good = b.where(~audit.is_error())
    assert status["active"] >= good.where(audit.all_pass(audit.GATE)).count() and sum(status.values()) == questions.count()
    assert sum(r.n for r in out["severity"].collect()) == good.count()
    both = P.auditor_comparison(a, b)
    cells = both["agreement"].collect()
    shared = a.join(b, "id").count()
    assert all(r.both_pass + r.both_fail + r.a_only_fail + r.b_only_fail == shared for r in cells)
    assert {r.rule for r in both["recommendations"].collect()} == {"unnatural_language", "register", "difficulty_mismatch", "over_labelling", "blind_spots"}


def test_experiments(spark, sf):
    out = P.experiment_comparison(frame(spark, sf, "experiment_questions"), ["gate_answer_correct", "gate_register_appropriate"], "gate_pass_rate")
    assert [r.cohort for r in out["metrics"].collect()] == ["control", "B", "C"]
    assert out["conclusions"].count() == 2 and out["deltas"].count() == 3 and out["overlap"].count() == 3


def test_corpus_run(spark):
    rows = [(0, "Write about cats", "Le chat dort.", "h0"), (1, "Write about dogs", "Le chien dort.", "h1"), (2, "Write about dogs", "Le chien dort.", "h1"), (3, "What did we learn?", "Le chien.", "h3"), (4, "Write old", "Le vieux.", "h4")]
    df = spark.createDataFrame([(*r, "writing", None, None, "beginner", None, r[0]) for r in rows], "position int, question string, correct_answer string, content_hash string, type string, explanation string, options array<string>, difficulty string, acceptable_variations array<string>, id int")
    old = spark.createDataFrame([("h4",)], "content_hash string")
    fails = spark.createDataFrame([(1, *[False] * 6, None, [], "OK")], "id int, " + ", ".join(f"{c} boolean" for c in audit.GATE) + ", suggested_difficulty string, invalid_variations array<string>, notes string")
    out = P.corpus_run(df, old, fails, None, 10)
    assert {r.position: r.quality_status for r in out["questions"].collect()} == {0: "pending", 1: "flagged"}
    assert tuple(out["counts"].first()) == (4, 2, 2) and {r.outcome for r in out["outcomes"].collect()} == {"meta_filtered"}


def test_reconcile_and_outlook(spark, sf):
    new = spark.createDataFrame([("Weather", "Weather and seasons"), ("Numbers 1-20", "Numbers")], "topic string, heading_source string")
    out = P.reconcile_unit(new, spark.createDataFrame([("Numbers 1-20",)], "topic string"))
    assert [r.topic for r in out["topics"].collect()] == ["Numbers 1-20", "Weather"]
    assert {r.final: r.keywords for r in out["keywords"].collect()}["Weather"] == ["weather", "seasons"]
    plan = P.generation_outlook(frame(spark, sf, "questions").withColumn("writing_type", F.lit("translation")), 40)
    assert plan["plan"].count() == 4 and plan["totals"].first().calls == 3 * (4 + 5 + 40 + 40)


def test_small_rules(spark):
    row = spark.createDataFrame([("1.2.3.4, 5.6.7.8", None, True), (None, False, True)], "f string, o boolean, s boolean")
    got = row.select(P.rate_key("login", F.col("f")), P.is_superuser(F.col("o"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("login:1.2.3.4", True), ("login:unknown", False)]
    meta = spark.createDataFrame([("active", ("a", (True, True, None, True, True, True), (["x"],)))], "quality_status string, audit_metadata struct<auditor:string,gate_criteria:struct<answer_correct:boolean,grammar_correct:boolean,no_hallucination:boolean,question_coherent:boolean,natural_french:boolean,register_appropriate:boolean>,soft_signals:struct<invalid_variations:array<string>>>")
    assert tuple(P.audit_breakdown(meta).first()) == ("a", "active", 1, 1, 1)
