"""Cohort experiments: metrics, deltas, conclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import SEVERITIES

LOWER_IS_BETTER = "difficulty_mismatch_rate"


def cohort_metrics(rows: DataFrame, criteria: list[str]) -> DataFrame:
    """A11 over rows with a boolean column for each criterion: missing metadata pass, only an explicit false fails."""
    fails = {c: F.count_if(~F.col(c)).alias(f"fail_{c}") for c in criteria}
    passed = F.lit(True)
    for c in criteria:
        passed = passed & F.coalesce(F.col(c), F.lit(True))
    return rows.groupBy("cohort").agg(
        F.count("*").alias("total"),
        F.count_if(passed).alias("gate_pass_count"),
        (F.count_if(passed) / F.count("*")).alias("gate_pass_rate"),
        *fails.values(),
        F.count_if(~F.col("difficulty_appropriate")).alias("difficulty_mismatch_count"),
        (F.count_if(~F.col("difficulty_appropriate")) / F.count("*")).alias("difficulty_mismatch_rate"),
        F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"),
        *(F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in SEVERITIES),
    )


def type_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cohort", "type").agg(F.count("*").alias("n"))


def impact_deltas(metrics: DataFrame, measures: list[str]) -> DataFrame:
    """Differences in percentage points, each treatment against control and against each later treatment."""
    a = metrics.select(F.col("cohort").alias("base"), *(F.col(m).alias(f"base_{m}") for m in measures))
    b = metrics.select(F.col("cohort").alias("cohort"), *measures)
    pairs = F.broadcast(a).join(b, (F.col("cohort") != "control") & ((F.col("base") == "control") | (F.col("base") < F.col("cohort"))))
    return pairs.select("base", "cohort", *(F.round((F.col(m) - F.col(f"base_{m}")) * 100, 1).alias(f"{m}_pp") for m in measures))


def conclusions(metrics: DataFrame, metric: str) -> DataFrame:
    """Direction and delta of each treatment, the best one, and the verdict: supported only if strictly better than control.

    An unknown metric falls back to the gate pass rate; for the mismatch rate lower is better; ties go to the first label.
    """
    measure = metric if metric == LOWER_IS_BETTER else "gate_pass_rate"
    sign = -1 if measure == LOWER_IS_BETTER else 1
    control = metrics.where("cohort = 'control'").select(F.col(measure).alias("control_value"))
    treat = metrics.where("cohort <> 'control'").select("cohort", F.col(measure).alias("value"))
    best = treat.agg(F.max(F.col("value") * sign).alias("best_value"), F.min_by("cohort", F.struct(F.col("value") * -sign, "cohort")).alias("best_cohort"))
    rows = treat.crossJoin(F.broadcast(control)).crossJoin(F.broadcast(best))
    direction = F.when(F.col("value") > F.col("control_value"), "increase").when(F.col("value") < F.col("control_value"), "decrease").otherwise("no change")
    verdict = F.when(F.col("best_value") > F.col("control_value") * sign, "supported").otherwise("refuted")
    return rows.select("cohort", direction.alias("direction"), F.round((F.col("value") - F.col("control_value")) * 100, 1).alias("delta_pp"), "best_cohort", verdict.alias("verdict"))


def control_snapshot(questions: DataFrame, unit: str) -> DataFrame:
    """A unit's active questions as the control cohort, with their original ids."""
    own = F.col("unit_id") == unit if unit != "all" else F.lit(True)
    return questions.where((F.col("quality_status") == "active") & own).withColumn("original_question_id", F.col("id")).withColumn("cohort", F.lit("control"))


def add_cohort(experiments: DataFrame, experiment_id, label: str, batch_id: str) -> DataFrame:
    """The cohort list of one experiment with one more entry."""
    entry = F.struct(F.lit(label).alias("label"), F.lit(None).cast("array<string>").alias("batch_ids"), F.lit(batch_id).alias("batch_id"))
    return experiments.withColumn("cohorts", F.when(F.col("id") == experiment_id, F.array_append("cohorts", entry)).otherwise(F.col("cohorts")))


def cohort_batches(experiments: DataFrame, batches: DataFrame) -> DataFrame:
    """Each cohort's batch metrics; control names a list of batches and so has none."""
    listed = experiments.select(F.col("id").alias("experiment_id"), F.explode("cohorts").alias("c")).select("experiment_id", "c.label", "c.batch_id")
    return listed.join(batches.select(F.col("id").alias("batch_id"), "quality_metrics"), "batch_id", "left")
