"""Distributions against targets and generation plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Target percentages of question types and of writing types.
TYPE_TARGETS = {"multiple-choice": 33, "fill-in-blank": 26, "true-false": 14, "writing": 27}
WRITING_TARGETS = {"translation": 35, "sentence_building": 25, "conjugation": 18, "question_formation": 12, "open_ended": 10}
#: Topics that suit a writing type (0: all) and the share of its questions that drift to another.
COMPATIBLE = {"question_formation": (4, 0.35), "open_ended": (0, 0.5), "sentence_building": (0, 0.2), "conjugation": (5, 0.3)}
LEVELS, COST_PER_CALL, TOLERANCE = 3, 0.008, 3


def distribution(questions: DataFrame) -> DataFrame:
    """Counts by type, and by writing type (`unspecified` for none) among writing questions, in one pass."""
    kinds = F.array(F.struct(F.lit("type").alias("kind"), F.col("type").alias("value")), F.when(F.col("type") == "writing", F.struct(F.lit("writing_type").alias("kind"), F.coalesce("writing_type", F.lit("unspecified")).alias("value"))))
    return questions.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def _targets(spark, targets: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(targets.items())], "pos int, value string, target int")


def target_gap(counts: DataFrame, targets: dict[str, int]) -> DataFrame:
    """A09 over (value, n): percentage to one digit, its difference from the target, and ok within three points."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = _targets(counts.sparkSession, targets).join(counts, "value", "left").fillna({"n": 0}).crossJoin(F.broadcast(total))
    pct = F.when(F.col("total") > 0, F.round(100.0 * F.col("n") / F.col("total"), 1)).otherwise(0.0)
    diff = F.round(pct - F.col("target"), 1)
    return rows.select("value", "n", pct.alias("pct"), "target", diff.alias("diff"), F.when(F.abs(diff) <= TOLERANCE, "ok").when(diff > 0, "over").otherwise("under").alias("status"))


def generation_plan(writing_counts: DataFrame, total_topics: int) -> DataFrame:
    """A10 over (value, n) of writing types: what is needed, calls, expected questions and cost, most needed first."""
    spark = writing_counts.sparkSession
    table = spark.createDataFrame([(v, WRITING_TARGETS[v], t, d) for v, (t, d) in COMPATIBLE.items()], "value string, target int, topics int, drift double")
    total = writing_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = table.join(writing_counts, "value", "left").fillna({"n": 0}).crossJoin(F.broadcast(total))
    rows = rows.withColumn("target_count", F.ceil(F.round(F.col("target") * F.col("total") / 100.0, 9)).cast("bigint")).withColumn("needed", F.col("target_count") - F.col("n")).where("needed > 0")
    calls = F.when(F.col("topics") > 0, F.col("topics") * LEVELS).otherwise(F.lit(total_topics * LEVELS)).cast("bigint")
    per_topic = F.ceil(F.round(F.col("needed") / (F.col("topics") * LEVELS * (1 - F.col("drift"))), 9))
    expected = F.when(F.col("topics") > 0, F.ceil(F.round(calls * per_topic * (1 - F.col("drift")), 9))).otherwise(F.col("needed")).cast("bigint")
    return rows.select("value", "target_count", F.col("n").alias("current_count"), "needed", calls.alias("calls"), F.least(expected, F.col("needed") + 5).alias("questions"), F.round(calls * COST_PER_CALL, 3).alias("cost"))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.sum("calls").alias("calls"), F.sum("questions").alias("questions"), F.round(F.sum("cost"), 3).alias("cost"))


def collision_band(rate: Column) -> Column:
    return F.when(rate >= 80, "very_high").when(rate >= 50, "moderate").when(rate >= 30, "some").otherwise("none")


def generation_stats(batches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A29 over (generated, duplicates, structural_rejects, validation_rejects, meta_filtered): sums, pass rate (100 without any), collisions."""
    cols = ["generated", "duplicates", "structural_rejects", "validation_rejects", "meta_filtered"]
    sums = batches.groupBy(*(by or [])).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols))
    tried = F.col("generated") + F.col("structural_rejects") + F.col("validation_rejects")
    rate = F.when(F.col("generated") > 0, F.round(100.0 * F.col("duplicates") / F.col("generated"), 1)).otherwise(0.0)
    return sums.withColumn("pass_rate", F.when(tried > 0, F.round(100.0 * F.col("generated") / tried, 1)).otherwise(100.0)).withColumn("collision_rate", rate).withColumn("collision_band", collision_band(rate))


def hybrid_passes(plan: DataFrame) -> DataFrame:
    """R06 over (topic, difficulty, n): below advanced two passes of half each, rounded up; advanced one."""
    two = F.array(F.struct(F.lit("structured").alias("pass"), F.ceil(F.col("n") / 2).cast("int").alias("count")), F.struct(F.lit("typed").alias("pass"), F.ceil(F.col("n") / 2).cast("int").alias("count")))
    one = F.array(F.struct(F.lit("all").alias("pass"), F.col("n").cast("int").alias("count")))
    return plan.select("topic", "difficulty", F.explode(F.when(F.col("difficulty") == "advanced", one).otherwise(two)).alias("p")).select("topic", "difficulty", "p.pass", "p.count")


def batch_record(generated: Column, attempted: Column, count: Column) -> Column:
    """Errors of a batch, attempts less the calls its questions fill; below 0 if calls gave more than asked."""
    return attempted - F.ceil(generated / count)
