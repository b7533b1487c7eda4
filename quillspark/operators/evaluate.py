"""Tiered answer evaluation (E00-E07): exact, variation, fuzzy, and what is left to a semantic verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import BEGINNER_PASS, MINOR_TYPO, fuzzy_threshold
from ..functions.text import has_correct_accents, match_key, normalize_punctuation_spacing, similarity, trim_ws

VARIATION_SIMILARITY = 0.95


def evaluate_answers(answers: DataFrame) -> DataFrame:
    """answers (user_answer, correct_answer, variations: array, difficulty) with tier, is_correct, score, accents_ok,
    matched_index (from 0), similarity_pct, threshold and band.

    Tiers in order: empty_check; exact_match; variation, by the first variation that is equal or 95 % alike; fuzzy, if the raw
    similarity reaches the level's threshold; else needs_semantic, whose verdict is null. Without a correct answer all but
    empty ones go to needs_semantic. Null answers count as empty.
    """
    user, correct = F.coalesce("user_answer", F.lit("")), F.col("correct_answer")
    df = answers.withColumn("__u", match_key(user)).withColumn("__c", match_key(correct)).withColumn("__sim", similarity(user, correct))
    tried = F.transform(
        F.coalesce("variations", F.array().cast("array<string>")),
        lambda v, i: F.struct(i.alias("index"), (match_key(v) == F.col("__u")).alias("exact"), similarity(user, v).alias("sim"), has_correct_accents(user, v).alias("accents")),
    )
    df = df.withColumn("__hit", F.try_element_at(F.filter(tried, lambda t: t["exact"] | (t["sim"] >= VARIATION_SIMILARITY)), F.lit(1)))
    pct = F.round(F.col("__sim") * 100).cast("int")
    known = correct.isNotNull() & (correct != "")
    tier = (
        F.when(F.length(trim_ws(user)) < 2, "empty_check")
        .when(known & (F.col("__u") == F.col("__c")), "exact_match")
        .when(known & F.col("__hit").isNotNull(), "variation")
        .when(known & (F.col("__sim") >= fuzzy_threshold(F.col("difficulty")) / 100.0), "fuzzy")
        .otherwise("needs_semantic")
    )
    plain = lambda c: normalize_punctuation_spacing(F.lower(trim_ws(c)))
    df = df.withColumn("tier", tier).withColumn("similarity_pct", F.when(known, pct)).withColumn("threshold", fuzzy_threshold(F.col("difficulty")))
    hit = F.col("__hit")
    accents = F.when(F.col("tier") == "exact_match", plain(user) == plain(correct)).when(F.col("tier") == "variation", hit["accents"]).when(F.col("tier") == "fuzzy", has_correct_accents(user, correct)).otherwise(False)
    df = df.withColumn("accents_ok", accents)
    band = F.when(pct >= MINOR_TYPO, "minor_typo").when(pct >= BEGINNER_PASS, "beginner_pass").otherwise("below")
    right = F.when(F.col("tier").isin("exact_match", "variation"), True).when(F.col("tier") == "empty_check", False).when(F.col("tier") == "fuzzy", (pct >= MINOR_TYPO) | ((pct >= BEGINNER_PASS) & (F.col("difficulty") == "beginner")))
    score = (
        F.when(F.col("tier") == "empty_check", 0)
        .when(F.col("tier") == "exact_match", F.when(F.col("accents_ok"), 100).otherwise(98))
        .when((F.col("tier") == "variation") & hit["exact"], F.when(F.col("accents_ok"), 98).otherwise(96))
        .when(F.col("tier") == "variation", F.round(hit["sim"] * 100).cast("int") - 2)
        .when(F.col("tier") == "fuzzy", pct)
    )
    out = df.withColumn("is_correct", right).withColumn("score", score.cast("int")).withColumn("matched_index", F.when(F.col("tier") == "variation", hit["index"]).cast("int")).withColumn("band", F.when(F.col("tier") == "fuzzy", band))
    return out.drop("__u", "__c", "__sim", "__hit")


def with_semantic_verdicts(evaluated: DataFrame, verdicts: DataFrame | None, key: str = "id") -> DataFrame:
    """Verdicts (key, verdict_correct, verdict_score) fill in needs_semantic rows; without one they are wrong, score 50."""
    if verdicts is None:
        joined = evaluated.withColumn("verdict_correct", F.lit(None).cast("boolean")).withColumn("verdict_score", F.lit(None).cast("int"))
    else:
        joined = evaluated.join(verdicts.select(key, "verdict_correct", "verdict_score"), key, "left")
    open_ = F.col("tier") == "needs_semantic"
    return joined.withColumn("is_correct", F.when(open_, F.coalesce("verdict_correct", F.lit(False))).otherwise(F.col("is_correct"))).withColumn("score", F.when(open_, F.coalesce("verdict_score", F.lit(50))).otherwise(F.col("score"))).drop("verdict_correct", "verdict_score")


def choice_answers(answers: DataFrame) -> DataFrame:
    """Choice questions by exact equality, 100 or 0."""
    same = F.coalesce(F.col("user_answer") == F.col("correct_answer"), F.lit(False))
    return answers.withColumn("is_correct", same).withColumn("score", F.when(same, 100).otherwise(0))


def saved_results(questions: DataFrame, user_answers: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row a question; an evaluation wins, else exact equality; a missing score is 100 or 0, '' is saved as null."""
    ev = evaluations.select("id", F.col("is_correct").alias("__right"), F.col("score").alias("__score"))
    joined = questions.join(user_answers.select("id", "user_answer"), "id", "left").join(ev, "id", "left")
    right = F.coalesce("__right", F.coalesce(F.col("user_answer") == F.col("correct_answer"), F.lit(False)))
    return joined.withColumn("is_correct", right).withColumn("score", F.coalesce("__score", F.when(right, 100).otherwise(0))).withColumn("user_answer", F.nullif(F.col("user_answer"), F.lit(""))).drop("__right", "__score")


def incorrect_questions(results: DataFrame) -> DataFrame:
    """P22."""
    return results.where(~F.col("is_correct"))
