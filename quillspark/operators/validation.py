"""Question filters, structural validation and insert projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import LEVELS
from ..functions.text import answer_groups, blank_count, infer_writing_type

#: Patterns of questions about learning itself, tested when questions are served.
SERVING_META = [
    r"making mistakes.*(discourage|should|part of learning)",
    r"language acquisition",
    r"growth mindset",
    r"willingness to learn",
    r"learning process",
    r"most important factor.*success",
    r"effort.*language.*success",
    r"learning.*language.*success",
    r"practice.*key.*success",
    r"consistency.*key",
    r"language learning.*emphasized",
]
#: Patterns tested when questions are generated.
GENERATION_META = [
    r"making mistakes.*(discourage|should|part of learning|important|essential)",
    r"language acquisition",
    r"growth mindset",
    r"willingness to learn",
    r"learning process",
    r"most important factor.*success",
    r"effort.*language.*success",
    r"learning.*language.*success",
    r"learning.*emphasized",
    r"practice.*key.*success",
    r"consistency.*key",
    r"\b(mr|mrs|mme|m)\.\s*[a-z]{2,}",
    r"\bmonsieur\s+[a-z]{2,}",
    r"\bmadame\s+[a-z]{2,}",
    r"teacher.*lived",
    r"teacher.*speaks.*languages",
    r"teacher.*interests",
    r"teacher.*hobbies",
    r"teacher.*books",
    r"teacher.*(favorite|favourite)",
    r"study\s*(tip|technique|strategy|method)",
    r"best way to (learn|study|memorize|practice)",
    r"tip.*for.*(pronounc|learn|study|memoriz)",
    r"how to study",
    r"did we.*learn",
    r"what.*we.*cover",
    r"what.*we.*study",
    r"what.*we.*learn.*in class",
    r"four key skills",
    r"course structure",
    r"class structure",
    r"mentioned in (the )?(vocabulary|materials|list)",
    r"\b(listed|included) in the (vocabulary|materials|list)",
    r"not.*mentioned",
    r"which.*not.*(classroom object|vocabulary item)",
]


def _any(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def is_meta_served(question: Column, explanation: Column) -> Column:
    """Question or explanation, each by itself."""
    return _any(question, SERVING_META) | _any(explanation, SERVING_META)


def is_meta_generated(question: Column, explanation: Column) -> Column:
    """Both, put together."""
    return _any(F.concat_ws(" ", question, F.coalesce(explanation, F.lit(""))), GENERATION_META)


def reject_reason() -> Column:
    """P14 and P15 over (type, question, correct_answer, options): the first rule that fails, null if none does."""
    kind, options, answer, question = F.col("type"), F.coalesce("options", F.array().cast("array<string>")), F.coalesce("correct_answer", F.lit("")), F.coalesce("question", F.lit(""))
    blanks = blank_count(question)
    choice = (
        F.when(F.size(options) != 4, "MCQ must have exactly 4 options")
        .when(~F.array_contains(options, answer), "MCQ correctAnswer not in options")
        .when(F.size(F.array_distinct(options)) != F.size(options), "MCQ has duplicate options")
    )
    binary = F.when(~(F.array_contains(options, "Vrai") & F.array_contains(options, "Faux")), 'T/F options must be ["Vrai", "Faux"]').when(~answer.isin("Vrai", "Faux"), "T/F correctAnswer must be Vrai or Faux")
    groups = answer_groups(answer)
    blank = (
        F.when(~question.contains("_____"), "Fill-in-blank must contain _____")
        .when(F.length(answer) < 1, "Fill-in-blank answer is empty")
        .when((blanks > 1) & (groups != blanks), F.concat(F.lit("Fill-in-blank has "), blanks.cast("string"), F.lit(" blanks but "), groups.cast("string"), F.lit(" comma-separated answer groups")))
    )
    writing = F.when(F.length(answer) < 5, "Writing answer too short (<5 chars)")
    by_type = F.when(kind == "multiple-choice", choice).when(kind == "true-false", binary).when(kind == "fill-in-blank", blank).when(kind == "writing", writing)
    leak = F.when(question.rlike(r"(?iu)\(\s*(answer|réponse|response)\s*:"), "Explicit answer label in question text")
    return F.coalesce(by_type, leak)


def validate_structure(questions: DataFrame) -> DataFrame:
    """Questions with reject_reason."""
    return questions.withColumn("reject_reason", reject_reason())


def type_drift(questions: DataFrame, only: str | None = None, allowed: list[str] | None = None, writing_type: str | None = None) -> DataFrame:
    """Questions with `drift`, true for those of a type that was not asked for."""
    drift = F.lit(False)
    if only:
        drift = drift | (F.col("type") != only)
    if allowed:
        drift = drift | ~F.col("type").isin(*allowed)
    if writing_type:
        drift = drift | (infer_writing_type(F.col("question")) != writing_type)
    return questions.withColumn("drift", drift)


def merge_validation(questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts (position, answer_valid, acceptable_variations, suggested_difficulty, notes) join by position.

    A missing verdict passes. Variations go to typed questions only; a valid, different level replaces the old one.
    """
    v = verdicts.select("position", "answer_valid", F.col("acceptable_variations").alias("__var"), "suggested_difficulty", "notes")
    joined = questions.join(v, "position", "left")
    valid = F.coalesce("answer_valid", F.lit(True))
    relabel = valid & F.coalesce(F.col("suggested_difficulty").isin(*LEVELS) & (F.col("suggested_difficulty") != F.col("difficulty")), F.lit(False))
    typed = F.col("type").isin("fill-in-blank", "writing") & (F.size(F.coalesce("__var", F.array().cast("array<string>"))) > 0) & valid
    out = joined.withColumn("reject_reason", F.when(~valid, F.coalesce(F.nullif("notes", F.lit("")), F.lit("Answer incorrect"))))
    out = out.withColumn("relabeled", relabel).withColumn("difficulty", F.when(relabel, F.col("suggested_difficulty")).otherwise(F.col("difficulty")))
    return out.withColumn("acceptable_variations", F.when(typed, F.col("__var")).otherwise(F.col("acceptable_variations"))).drop("__var", "answer_valid", "suggested_difficulty", "notes")


def insert_projection(questions: DataFrame) -> DataFrame:
    """Options for choice types, variations for typed ones, writing type for writing, status pending."""
    kind = F.col("type")
    none = F.array().cast("array<string>")
    return questions.withColumns(
        {
            "options": F.when(kind.isin("multiple-choice", "true-false"), F.col("options")),
            "acceptable_variations": F.when(kind.isin("fill-in-blank", "writing"), F.coalesce("acceptable_variations", none)).otherwise(none),
            "writing_type": F.when(kind == "writing", infer_writing_type(F.col("question"))),
            "hints": none,
            "quality_status": F.lit("pending"),
        }
    )


def post_process(questions: DataFrame, verdicts: DataFrame | None, count: int, **drift) -> tuple[DataFrame, DataFrame]:
    """R05 and P17 over one response (with position): the questions kept, at most count, and a table of counts by outcome."""
    judged = validate_structure(type_drift(questions.withColumn("meta", is_meta_generated(F.col("question"), F.col("explanation"))), **drift))
    outcome = F.when(F.col("meta"), "meta_filtered").when(F.col("drift"), "type_drift").when(F.col("reject_reason").isNotNull(), "structural_reject")
    judged = judged.withColumn("outcome", outcome).drop("meta", "drift", "reject_reason")
    passed = judged.where("outcome is null").drop("outcome")
    checked = merge_validation(passed, verdicts) if verdicts is not None else passed.withColumn("reject_reason", F.lit(None).cast("string"))
    good = checked.where("reject_reason is null").withColumn("__n", F.row_number().over(Window.orderBy("position"))).where(F.col("__n") <= count).drop("__n", "reject_reason")
    counts = judged.where("outcome is not null").groupBy("outcome").count().unionByName(checked.where("reject_reason is not null").groupBy(F.lit("validation_reject").alias("outcome")).count())
    return good, counts
