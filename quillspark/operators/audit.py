"""Audit results: parsing, gates, agreement, breakdowns, status writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import LEVELS
from .dedup import subtract_keep

CORE = ["answer_correct", "grammar_correct", "no_hallucination", "question_coherent"]
GATE = [*CORE, "natural_french", "register_appropriate"]
ALL_EIGHT = [*GATE, "difficulty_appropriate", "variations_valid"]
ALL_NINE = [*ALL_EIGHT, "culturally_appropriate"]
SEVERITIES = ["critical", "minor", "suggestion"]
_RESULT = "struct<" + ",".join(f"{c}:boolean" for c in ALL_NINE) + ",suggested_difficulty:string,missing_variations:array<string>,invalid_variations:array<string>,notes:string,severity:string>"


def all_pass(criteria: list[str]) -> Column:
    """Every criterion; one that is missing passes."""
    out = F.lit(True)
    for c in criteria:
        out = out & F.coalesce(F.col(c), F.lit(True))
    return out


def any_fail(criteria: list[str]) -> Column:
    return ~all_pass(criteria)


def is_error() -> Column:
    """P19."""
    return F.coalesce(F.col("notes").startswith("PARSE_ERROR:") | F.col("notes").startswith("API_ERROR:"), F.lit(False))


def suggested_levels(results: DataFrame) -> DataFrame:
    """How often each level is suggested for questions whose level doesn't fit; unspecified where none is named."""
    return results.where(~F.col("difficulty_appropriate")).groupBy(F.coalesce("suggested_difficulty", F.lit("unspecified")).alias("suggested")).agg(F.count("*").alias("n"))


def parse_responses(batches: DataFrame) -> DataFrame:
    """S18 over (batch, ids: array, response): one result a question id.

    The response is an array of results, {results}, {questions} or one result. A missing verdict passes, an unknown severity is
    suggestion, missing notes are OK; a response that is no JSON passes all with a PARSE_ERROR note.
    """
    text = F.trim("response")
    body = F.coalesce(
        F.when(text.startswith("["), F.from_json(text, f"array<{_RESULT}>")),
        F.from_json(text, f"struct<results:array<{_RESULT}>>")["results"],
        F.from_json(text, f"struct<questions:array<{_RESULT}>>")["questions"],
        F.array(F.from_json(text, _RESULT)),
    )
    broken = F.try_parse_json(text).isNull()
    rows = batches.withColumn("__broken", broken).withColumn("__body", body).select("*", F.posexplode("ids").alias("__i", "id"))
    r = F.when(~F.col("__broken"), F.get("__body", F.col("__i")))
    passed = {c: F.coalesce(r[c], F.lit(True)) for c in ALL_NINE}
    none = F.array().cast("array<string>")
    return rows.withColumns(
        passed
        | {
            "suggested_difficulty": r["suggested_difficulty"],
            "missing_variations": F.coalesce(r["missing_variations"], none),
            "invalid_variations": F.coalesce(r["invalid_variations"], none),
            "severity": F.when(r["severity"].isin(*SEVERITIES), r["severity"]).otherwise("suggestion"),
            "notes": F.when(F.col("__broken"), F.concat(F.lit("PARSE_ERROR: "), F.substring("response", 1, 200))).otherwise(F.coalesce(F.nullif(r["notes"], F.lit("")), F.lit("OK"))),
        }
    ).drop("__broken", "__body", "__i", "ids", "response")


def agreement(a: DataFrame, b: DataFrame, criteria: list[str] = CORE) -> DataFrame:
    """For each criterion, how often two auditors agree over the questions both saw."""
    both = a.select("id", *(F.col(c).alias(f"a_{c}") for c in criteria)).join(b.select("id", *(F.col(c).alias(f"b_{c}") for c in criteria)), "id")
    stacked = F.stack(F.lit(len(criteria)), *(x for c in criteria for x in (F.lit(c), F.col(f"a_{c}"), F.col(f"b_{c}"))))
    long = both.select(stacked.alias("criterion", "a", "b"))
    return long.groupBy("criterion").agg(
        F.count_if(F.col("a") & F.col("b")).alias("both_pass"),
        F.count_if(~F.col("a") & ~F.col("b")).alias("both_fail"),
        F.count_if(~F.col("a") & F.col("b")).alias("a_only_fail"),
        F.count_if(F.col("a") & ~F.col("b")).alias("b_only_fail"),
        F.round(100.0 * F.count_if(F.col("a") == F.col("b")) / F.count("*"), 1).alias("agreement_pct"),
    )


def failed_list(criteria: list[str]) -> Column:
    return F.array_join(F.filter(F.array(*(F.when(~F.coalesce(F.col(c), F.lit(True)), F.lit(c)) for c in criteria)), lambda c: c.isNotNull()), ",")


def one_sided(passing: DataFrame, passing_criteria: list[str], failing: DataFrame, failing_criteria: list[str]) -> DataFrame:
    """Questions that one auditor passes on all its criteria and the other fails, with the failed ones in order."""
    ok = passing.where(all_pass(passing_criteria)).select("id")
    return failing.where(any_fail(failing_criteria)).join(ok, "id", "left_semi").withColumn("failed", failed_list(failing_criteria))


def fail_rates(results: DataFrame, criteria: list[str]) -> DataFrame:
    """A16."""
    stacked = F.stack(F.lit(len(criteria)), *(x for c in criteria for x in (F.lit(c), F.coalesce(F.col(c), F.lit(True)))))
    long = results.select(stacked.alias("criterion", "ok"))
    return long.groupBy("criterion").agg(F.count_if(~F.col("ok")).alias("fails"), F.round(100.0 * F.count_if(~F.col("ok")) / F.count("*"), 2).alias("fail_pct"))


def pass_rate_by(results: DataFrame, by: Column, criteria: list[str], name: str = "grp") -> DataFrame:
    """Passes, total and percentage by group."""
    return results.groupBy(by.alias(name)).agg(F.count("*").alias("total"), F.count_if(all_pass(criteria)).alias("passed"), F.round(100.0 * F.count_if(all_pass(criteria)) / F.count("*"), 2).alias("pass_pct"))


def pass_rate_by_type(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both auditors' rates by type, types of either."""
    x = pass_rate_by(a, F.col("type"), CORE, "type").select("type", F.col("pass_pct").alias("a_pass_pct"))
    y = pass_rate_by(b, F.col("type"), ALL_EIGHT, "type").select("type", F.col("pass_pct").alias("b_pass_pct"))
    return x.join(y, "type", "full")


def severity_distribution(results: DataFrame) -> DataFrame:
    """Count and share of each severity, in rank order critical, minor, suggestion."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    counted = results.groupBy("severity").agg(F.count("*").alias("n"))
    total = F.broadcast(results.agg(F.count("*").alias("total")))
    return counted.crossJoin(total).select("severity", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("share_pct"), rank.cast("bigint").alias("rank"))


def reclassification(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Questions by their level and the level suggested for those that are mislabelled."""
    odd = results.where(~F.coalesce("difficulty_appropriate", F.lit(True))).select("id", F.coalesce("suggested_difficulty", F.lit("unspecified")).alias("suggested"))
    return questions.select("id", "difficulty").join(odd, "id").groupBy("difficulty").pivot("suggested", [*LEVELS, "unspecified"]).count().fillna(0)


def variation_totals(results: DataFrame) -> DataFrame:
    """Missing and invalid variations and the questions that have any."""
    n = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    return results.agg(
        F.coalesce(F.sum(n("missing_variations")), F.lit(0)).alias("missing_total"),
        F.count_if(n("missing_variations") > 0).alias("missing_questions"),
        F.coalesce(F.sum(n("invalid_variations")), F.lit(0)).alias("invalid_total"),
        F.count_if(n("invalid_variations") > 0).alias("invalid_questions"),
    )


def apply_audit(questions: DataFrame, results: DataFrame, gate: list[str] = GATE, remediate: bool = True) -> DataFrame:
    """Active or flagged by the gate, errors and unaudited questions unchanged; passing ones are remediated.

    Remediation: a valid, different suggested level replaces the old one; invalid variations go, the order and duplicates of
    the rest kept. The gate of four criteria takes no remediation (remediate=False).
    """
    r = results.where(~is_error()).select("id", all_pass(gate).alias("__pass"), *(F.col(c).alias(f"__{c}") for c in ("suggested_difficulty", "invalid_variations") if c in results.columns))
    joined = questions.join(r, "id", "left")
    out = joined.withColumn("quality_status", F.when(F.col("__pass"), "active").when(~F.col("__pass"), "flagged").otherwise(F.col("quality_status")))
    if remediate and "__suggested_difficulty" in joined.columns:
        new = F.col("__pass") & F.col("__suggested_difficulty").isin(*LEVELS)
        out = out.withColumn("difficulty", F.when(new, F.col("__suggested_difficulty")).otherwise(F.col("difficulty")))
    if remediate and "__invalid_variations" in joined.columns and "acceptable_variations" in questions.columns:
        clean = F.col("__pass") & (F.size("__invalid_variations") > 0) & (F.size("acceptable_variations") > 0)
        out = out.withColumn("acceptable_variations", F.when(clean, subtract_keep(F.col("acceptable_variations"), F.col("__invalid_variations"))).otherwise(F.col("acceptable_variations")))
    return out.select(*questions.columns)


def served_difficulty(questions: DataFrame, results: DataFrame, gate: list[str] = GATE) -> DataFrame:
    """Levels of the passing questions after relabelling."""
    passing = results.where(~is_error() & all_pass(gate)).select("id", F.when(F.col("suggested_difficulty").isin(*LEVELS), F.col("suggested_difficulty")).alias("new"))
    return questions.select("id", "difficulty").join(passing, "id").groupBy(F.coalesce("new", "difficulty").alias("difficulty")).agg(F.count("*").alias("n"))


def recommendations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Which of the report's threshold rules fire, one row a rule."""
    n = b.agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce("natural_french", F.lit(True))).alias("natural"),
        F.count_if(~F.coalesce("register_appropriate", F.lit(True))).alias("register"),
        F.count_if(~F.coalesce("difficulty_appropriate", F.lit(True))).alias("level"),
        F.count_if(~F.coalesce("difficulty_appropriate", F.lit(True)) & (F.col("suggested_difficulty") == "beginner")).alias("downgrade"),
    )
    shared = a.select("id").join(b.select("id"), "id").agg(F.count("*").alias("shared"))
    blind = one_sided(a, CORE, b, ALL_EIGHT).agg(F.count("*").alias("blind"))
    row = n.crossJoin(shared).crossJoin(blind)
    rules = [
        ("unnatural_language", F.col("natural"), F.col("natural") > F.col("n") * 0.05),
        ("register", F.col("register"), F.col("register") > 0),
        ("difficulty_mismatch", F.col("level"), F.col("level") > F.col("n") * 0.1),
        ("over_labelling", F.col("downgrade"), F.col("downgrade") > F.col("level") * 0.5),
        ("blind_spots", F.col("blind"), F.col("blind") > F.col("shared") * 0.05),
    ]
    return row.select(F.stack(F.lit(len(rules)), *(x for name, count, fires in rules for x in (F.lit(name), count, fires))).alias("rule", "count", "fires"))
