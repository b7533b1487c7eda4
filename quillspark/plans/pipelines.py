"""Composite flows (R01-R14): chains of operators that return the frames a caller shows or writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit, dedup, evaluate, experiments, mastery, planning, resources, selection, topics, validation

#: Requests a minute by route.
RATE_LIMITS = {"evaluate": 15, "generate_code": 10, "verify": 20, "login": 5}
RATE_WINDOW_SECONDS = 60


def rate_key(route: str, forwarded: Column) -> Column:
    """Route and the first forwarded address."""
    return F.concat(F.lit(f"{route}:"), F.coalesce(F.trim(F.element_at(F.split(forwarded, ","), 1)), F.lit("unknown")))


def is_superuser(override: Column, stored: Column) -> Column:
    """An explicit override wins over the stored flag."""
    return F.coalesce(override, stored, F.lit(False))


def distinct_topics(questions: DataFrame) -> DataFrame:
    """A32."""
    return questions.select("topic").where("topic is not null").distinct().orderBy("topic")


def distinct_batches(questions: DataFrame) -> DataFrame:
    """A33."""
    return questions.select("batch_id").where("batch_id is not null").distinct()


def audit_breakdown(questions: DataFrame) -> DataFrame:
    """A30 and F33 over questions with audit_metadata: rows and gate passes by auditor and status."""
    gate = F.col("audit_metadata.gate_criteria")
    passed = F.lit(True)
    for c in audit.GATE:
        passed = passed & F.coalesce(gate[c], F.lit(True))
    return questions.where("audit_metadata is not null").groupBy(F.col("audit_metadata.auditor").alias("auditor"), "quality_status").agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"), F.sum(F.size(F.coalesce("audit_metadata.soft_signals.invalid_variations", F.array().cast("array<string>")))).alias("invalid_variations"))


def assemble_quiz(questions: DataFrame, n: int, seed: str, **options) -> dict[str, DataFrame]:
    """The quiz and the shortages behind its warnings."""
    mode = options.get("mode", "practice")
    picked = selection.assemble_quiz(questions, n, seed, **options)
    criteria = {k: v for k, v in options.items() if k in ("unit", "topic", "difficulty", "types")}
    pool = selection.criteria_filter(questions.where("quality_status = 'active'"), **criteria)
    return {"questions": picked, "warnings": selection.shortages(pool, selection.mode_shares(mode), n)}


def save_quiz(questions: DataFrame, user_answers: DataFrame, evaluations: DataFrame, quiz: DataFrame) -> dict[str, DataFrame]:
    """R02 over one quiz (quiz_history_id, study_code_id): its results, its score, and the questions that were wrong."""
    results = evaluate.saved_results(questions, user_answers, evaluations).crossJoin(quiz.limit(1))
    return {"results": results, "score": mastery.quiz_score(results), "incorrect": evaluate.incorrect_questions(results)}


def student_detail(student, quizzes: DataFrame, results: DataFrame, last: int = 50) -> dict[str, DataFrame]:
    """One student's summary, history, mastery and weak topics."""
    q, r = quizzes.where(F.col("study_code_id") == F.lit(student)), results.where(F.col("study_code_id") == F.lit(student))
    return {
        "summary": mastery.progress(q, r),
        "history": mastery.recent_history(q, last).orderBy("rank"),
        "mastery": mastery.concept_mastery(r).orderBy(F.desc("mastery_percentage"), "topic"),
        "weak": mastery.weak_topics(r).orderBy("mastery_percentage", "topic"),
    }


def progress_page(student, quizzes: DataFrame, results: DataFrame, learning: DataFrame, last: int = 10) -> dict[str, DataFrame]:
    """The same with resources for the weak topics, grouped."""
    detail = student_detail(student, quizzes, results, last)
    return detail | {"resources": resources.grouped(resources.for_topics(learning, detail["weak"]))}


def audit_summary(questions: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The breakdowns of an audit and the questions as it leaves them; error rows count in none of the rates."""
    sound = results.where(~audit.is_error())
    leveled = sound.join(questions.select("id", "difficulty", "generated_by"), "id")
    return {
        "fail_rates": audit.fail_rates(sound, [c for c in audit.ALL_NINE if c in results.columns]),
        "by_type": audit.pass_rate_by(sound, F.col("type"), audit.GATE, "type"),
        "by_difficulty": audit.pass_rate_by(leveled, F.col("difficulty"), audit.GATE, "difficulty"),
        "by_generator": audit.pass_rate_by(leveled, F.coalesce("generated_by", F.lit("unknown")), audit.GATE, "generator"),
        "severity": audit.severity_distribution(sound),
        "reclassification": audit.reclassification(questions, sound),
        "suggested": audit.suggested_levels(sound),
        "variations": audit.variation_totals(sound) if "missing_variations" in results.columns else audit.variation_totals(sound.withColumns({c: F.array().cast("array<string>") for c in ("missing_variations", "invalid_variations")})),
        "served": audit.served_difficulty(questions, results),
        "questions": audit.apply_audit(questions, results),
    }


def auditor_comparison(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """R08."""
    return {
        "agreement": audit.agreement(a, b),
        "b_only": audit.one_sided(a, audit.CORE, b, audit.ALL_EIGHT),
        "a_only": audit.one_sided(b, audit.ALL_EIGHT, a, audit.CORE),
        "by_type": audit.pass_rate_by_type(a, b),
        "severity": audit.severity_distribution(b),
        "recommendations": audit.recommendations(a, b),
    }


def experiment_comparison(rows: DataFrame, criteria: list[str], metric: str) -> dict[str, DataFrame]:
    """Metrics with control first (O04), type distribution, overlaps, deltas and conclusions."""
    metrics = experiments.cohort_metrics(rows, criteria)
    return {
        "metrics": metrics.orderBy(F.col("cohort") != "control", "cohort"),
        "types": experiments.type_distribution(rows),
        "overlap": dedup.overlap_share(rows),
        "deltas": experiments.impact_deltas(metrics, ["gate_pass_rate", "difficulty_mismatch_rate"]),
        "conclusions": experiments.conclusions(metrics, metric),
    }


def reconcile_unit(extracted: DataFrame, existing: DataFrame, verdicts: DataFrame | None = None) -> dict[str, DataFrame]:
    """R11 over (topic, heading_source): the action for each topic, the unit's final topics and their keywords."""
    actions = topics.reconcile(extracted.select("topic").distinct(), existing, verdicts)
    finals = topics.final_topics(actions)
    return {"actions": actions, "topics": finals, "keywords": topics.heading_mappings(extracted, finals)}


def corpus_run(responses: DataFrame, existing: DataFrame, audits: DataFrame | None, verdicts: DataFrame | None, count: int, **drift) -> dict[str, DataFrame]:
    """R12 and R13 over generated questions (one response, with position): filtered, validated, deduplicated, projected, audited."""
    good, outcomes = validation.post_process(responses, verdicts, count, **drift)
    fresh = dedup.new_only(good, existing, order=["position"])
    ready = validation.insert_projection(fresh)
    done = audit.apply_audit(ready, audits) if audits is not None else ready
    made = good.agg(F.count("*").alias("generated")).crossJoin(fresh.agg(F.count("*").alias("inserted")))
    return {"questions": done, "outcomes": outcomes, "counts": made.withColumn("duplicates", F.col("generated") - F.col("inserted"))}


def generation_outlook(questions: DataFrame, total_topics: int) -> dict[str, DataFrame]:
    """How questions stand against their targets and what to generate."""
    counts = planning.distribution(questions).cache()
    types = counts.where("kind = 'type'").select("value", "n")
    writing = counts.where("kind = 'writing_type'").select("value", "n")
    plan = planning.generation_plan(writing, total_topics)
    return {"types": planning.target_gap(types, planning.TYPE_TARGETS), "writing": planning.target_gap(writing, planning.WRITING_TARGETS), "plan": plan.orderBy(F.desc("needed"), "value"), "totals": planning.plan_totals(plan)}
