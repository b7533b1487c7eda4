"""Mastery, progress and class-wide aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import percent
from .selection import ranked

WEAK_BELOW, STRONG_FROM, STRONG_ATTEMPTS = 70, 85, 5


def concept_mastery(results: DataFrame) -> DataFrame:
    """Attempts, correct answers, percentage and last attempt of each student and topic."""
    return results.groupBy("study_code_id", "topic").agg(
        F.count("*").alias("total_attempts"),
        F.count_if("is_correct").alias("correct_attempts"),
        F.round(100.0 * F.count_if("is_correct") / F.count("*"), 2).alias("mastery_percentage"),
        F.max("attempted_at").alias("last_attempted"),
    )


def weak_topics(results: DataFrame) -> DataFrame:
    """A02, weakest first when shown; the order is not part of the result."""
    return concept_mastery(results).where((F.col("mastery_percentage") < WEAK_BELOW) & (F.col("total_attempts") >= 1))


def strong_topics(results: DataFrame) -> DataFrame:
    """A03."""
    return concept_mastery(results).where((F.col("mastery_percentage") >= STRONG_FROM) & (F.col("total_attempts") >= STRONG_ATTEMPTS))


def overall_stats(quizzes: DataFrame, results: DataFrame) -> DataFrame:
    """A04 and J01 for every student: quizzes, questions, correct answers and accuracy; accuracy is null without questions."""
    kept = results.select(F.col("quiz_history_id").alias("id"), "is_correct")
    joined = quizzes.select("id", "study_code_id").join(kept, "id", "left")
    return joined.groupBy("study_code_id").agg(
        F.countDistinct("id").alias("total_quizzes"),
        F.count("is_correct").alias("total_questions"),
        F.count_if("is_correct").alias("correct_answers"),
        F.round(F.try_divide(100.0 * F.count_if("is_correct"), F.count("is_correct")), 2).alias("overall_accuracy"),
    )


def student_rollup(quizzes: DataFrame, results: DataFrame) -> DataFrame:
    """Each table summed by student on its own, then joined, so no row is counted twice."""
    q = quizzes.groupBy("study_code_id").agg(F.count("*").alias("total_quizzes"))
    r = results.groupBy("study_code_id").agg(F.count("*").alias("total_questions"), F.count_if("is_correct").alias("correct_answers"))
    zero = {c: 0 for c in ("total_quizzes", "total_questions", "correct_answers")}
    return q.join(r, "study_code_id", "full").fillna(zero)


def progress(quizzes: DataFrame, results: DataFrame) -> DataFrame:
    """The roll-up with accuracy, 0 without questions."""
    return student_rollup(quizzes, results).withColumn("overall_accuracy", percent(F.col("correct_answers"), F.col("total_questions")))


def classwide_stats(students: DataFrame, rollup: DataFrame, last_active: DataFrame, as_of: Column) -> DataFrame:
    """One row of counts, sums, ratio-of-sums accuracy, and students active in the last 7 and 30 days before as_of."""
    joined = students.select(F.col("id").alias("study_code_id")).join(rollup, "study_code_id", "left").join(last_active, "study_code_id", "left")
    since = lambda days: F.count_if(F.col("last_active_at") >= as_of - F.make_interval(days=F.lit(days)))
    return joined.agg(
        F.count("*").alias("total_students"),
        F.coalesce(F.sum("total_quizzes"), F.lit(0)).alias("total_quizzes"),
        F.coalesce(F.sum("total_questions"), F.lit(0)).alias("total_questions"),
        percent(F.coalesce(F.sum("correct_answers"), F.lit(0)), F.coalesce(F.sum("total_questions"), F.lit(0))).alias("average_accuracy"),
        since(7).alias("active_7d"),
        since(30).alias("active_30d"),
    )


def last_active(quizzes: DataFrame) -> DataFrame:
    """The last quiz of each student."""
    return quizzes.groupBy("study_code_id").agg(F.max("quiz_date").alias("last_active_at"))


def recent_history(quizzes: DataFrame, n: int = 50) -> DataFrame:
    """The n newest quizzes of each student, rank 1 the newest; ties by id."""
    order = Window.partitionBy("study_code_id").orderBy(F.desc("quiz_date"), F.desc("id"))
    return quizzes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def quiz_score(answers: DataFrame) -> DataFrame:
    """Correct, total and whole percent of each quiz."""
    return answers.groupBy("quiz_history_id").agg(F.count_if("is_correct").alias("correct"), F.count("*").alias("total"), F.round(100.0 * F.count_if("is_correct") / F.count("*"), 0).alias("score"))


def study_guide(results: DataFrame, resources: DataFrame, topics: int = 5, per_topic: int = 3) -> DataFrame:
    """The topics missed most (ties by name) with up to `per_topic` active resources each, by id."""
    missed = results.where("not is_correct").groupBy("topic").agg(F.count("*").alias("incorrect")).orderBy(F.desc("incorrect"), "topic").limit(topics)
    rank = F.row_number().over(Window.partitionBy("topic").orderBy("id"))
    picked = resources.where("quality_status = 'active'").select("topic", "id", "url", rank.alias("n")).where(F.col("n") <= per_topic)
    return F.broadcast(missed).join(picked, "topic", "left")


def search_students(students: DataFrame, query: str) -> DataFrame:
    """ILIKE over code, display name and label; % and _ in the query stay wildcards."""
    pattern = f"%{query}%"
    return students.where(F.ilike("code", F.lit(pattern)) | F.ilike("display_name", F.lit(pattern)) | F.ilike("admin_label", F.lit(pattern)))


def student_ranking(progress_rows: DataFrame, active: DataFrame, by: str = "overall_accuracy") -> DataFrame:
    """Rank by `by`, then by last activity, then by id."""
    joined = progress_rows.join(active, "study_code_id", "left")
    keyed = joined.withColumn("__by", -F.col(by).cast("double"))
    return ranked(keyed, "__by", [F.col("__by"), F.desc_nulls_last("last_active_at"), F.col("study_code_id")], "rank").drop("__by")
