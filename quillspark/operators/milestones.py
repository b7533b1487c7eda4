"""Streaks and milestones over ordered attempts and quizzes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STREAKS, QUIZ_COUNTS, THRESHOLDS = (3, 5, 10), (10, 25, 50, 100), (90, 80, 70)


def streaks(events: DataFrame) -> DataFrame:
    """The run of correct answers that each attempt stands in, and whether it reaches a milestone."""
    order = Window.partitionBy("study_code_id").orderBy("attempted_at", "event_id")
    island = events.withColumn("breaks", F.sum((~F.col("is_correct")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("study_code_id", "breaks").orderBy("attempted_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = island.withColumn("streak", F.sum(F.col("is_correct").cast("int")).over(run).cast("bigint"))
    return out.withColumn("milestone", F.col("is_correct") & F.col("streak").isin(*STREAKS)).drop("breaks")


def _quizzes(*keys: str):
    return Window.partitionBy(*keys).orderBy("quiz_date", "id")


def new_highs(quizzes: DataFrame) -> DataFrame:
    """Best score before each quiz of a student, unit and level; new_high for the first and for a strictly better one."""
    before = F.max("score_percentage").over(_quizzes("study_code_id", "unit_id", "difficulty").rowsBetween(Window.unboundedPreceding, -1))
    return quizzes.withColumn("previous_best", before).withColumn("new_high", before.isNull() | (F.col("score_percentage") > before)).withColumn("perfect", F.col("score_percentage") == 100)


def overall_highs(quizzes: DataFrame, last: int = 50) -> DataFrame:
    """The same over all of a student's last quizzes."""
    before = F.max("score_percentage").over(_quizzes("study_code_id").rowsBetween(-last, -1))
    return quizzes.withColumn("previous_best", before).withColumn("overall_high", before.isNull() | (F.col("score_percentage") > before))


def quiz_counts(quizzes: DataFrame) -> DataFrame:
    """The quizzes that are a student's tenth, twenty-fifth, fiftieth or hundredth."""
    return quizzes.withColumn("number", F.row_number().over(_quizzes("study_code_id"))).where(F.col("number").isin(*QUIZ_COUNTS))


def accuracy_crossings(quizzes: DataFrame) -> DataFrame:
    """W05 over (study_code_id, id, quiz_date, correct, total): the highest threshold that a quiz lifts a student's accuracy over.

    The accuracy before is rounded to two digits, as it is stored; the one after is not. Null where none is crossed or no
    question came before.
    """
    past = _quizzes("study_code_id").rowsBetween(Window.unboundedPreceding, -1)
    now = _quizzes("study_code_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = quizzes.withColumns({"old_c": F.sum("correct").over(past), "old_t": F.sum("total").over(past), "new_c": F.sum("correct").over(now), "new_t": F.sum("total").over(now)})
    old = F.round(F.try_divide(100.0 * F.col("old_c"), F.col("old_t")), 2)
    new = F.try_divide(100.0 * F.col("new_c"), F.col("new_t"))
    crossed = F.lit(None).cast("int")
    for t in reversed(THRESHOLDS):
        crossed = F.when((old < t) & (new >= t), t).otherwise(crossed)
    return sums.withColumn("crossed", crossed).drop("old_c", "old_t", "new_c", "new_t")
