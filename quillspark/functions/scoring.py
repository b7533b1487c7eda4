"""Bands, thresholds and spaced-repetition rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ["beginner", "intermediate", "advanced"]
#: Similarity, in percent, from which a fuzzy match decides.
FUZZY_THRESHOLDS = {"beginner": 70, "intermediate": 85, "advanced": 95}
#: Percent for a minor typo, for a beginner's pass, and for a pass by semantic score.
MINOR_TYPO, BEGINNER_PASS, SEMANTIC_PASS = 95, 85, 70
#: Correct answers in a row that leave a box, and draw weights by box (unseen: 3).
PROMOTE_AFTER = {1: 1, 2: 2, 3: 2, 4: 3}
BOX_WEIGHTS = {1: 5, 2: 4, 3: 3, 4: 2, 5: 1}
UNSEEN_WEIGHT = 3
#: Seconds that a wrong answer waits, and the types that the cheaper model writes.
WRONG_ANSWER_COUNTDOWN = 15
STRUCTURED_TYPES = ["multiple-choice", "true-false"]


def _case(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def fuzzy_threshold(difficulty: Column) -> Column:
    """F32."""
    return _case(difficulty, FUZZY_THRESHOLDS, FUZZY_THRESHOLDS["intermediate"])


def box_weight(box: Column) -> Column:
    """F31."""
    return _case(box, BOX_WEIGHTS, UNSEEN_WEIGHT)


def next_box(box: Column, streak: Column, correct: Column) -> Column:
    """struct(box, streak) after an answer. A wrong one goes back to box 1; box 5 keeps counting."""
    more = streak + 1
    need = _case(box, PROMOTE_AFTER, 1 << 30)
    up = more >= need
    return F.struct(
        F.when(~correct, 1).when(up, box + 1).otherwise(box).cast("int").alias("box"),
        F.when(~correct, 0).when(up, 0).otherwise(more).cast("int").alias("streak"),
    )


def accuracy_band(percent: Column) -> Column:
    """high from 80, medium from 60."""
    return F.when(percent >= 80, "high").when(percent >= 60, "medium").otherwise("low")


def mastery_band(percent: Column) -> Column:
    """high from 85, medium from 70."""
    return F.when(percent >= 85, "high").when(percent >= 70, "medium").otherwise("low")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """A rounded percentage, 0 where the whole is 0."""
    return F.when(whole > 0, F.round(F.try_divide(100.0 * part, whole), digits)).otherwise(0.0)


def points(a: Column, b: Column) -> Column:
    """difference of two rates in percentage points."""
    return F.round((a - b) * 100, 1)


def model_provider(model: Column) -> Column:
    """provider by the model name's prefix."""
    return F.when(model.startswith("mistral-"), "mistral").otherwise("anthropic")


def model_by_type(kind: Column, structured: str, typed: str) -> Column:
    """the model that writes questions of a type."""
    return F.when(kind.isin(*STRUCTURED_TYPES), structured).otherwise(typed)


def percent_text(part: Column, whole: Column) -> Column:
    """a share as text with one digit, such as 12.5%."""
    return F.concat(F.format_string("%.1f", percent(part, whole, 1)), F.lit("%"))


def signed_points(a: Column, b: Column) -> Column:
    """a difference in percentage points as text with its sign, such as +1.5pp."""
    diff = points(a, b)
    return F.concat(F.when(diff >= 0, "+").otherwise(""), F.format_string("%.1f", diff), F.lit("pp"))


def pacific_time(ts: Column, pattern: str = "MMM d, yyyy, h:mm a") -> Column:
    """such as Jan 1, 2024, 4:00 AM."""
    return F.date_format(F.from_utc_timestamp(ts, "America/Los_Angeles"), pattern)


def is_stub_content(text: Column) -> Column:
    """the text that stands in where a topic has no material."""
    return text.startswith("Topic:") & text.contains("No specific learning materials")


def wrong_answer_pause(own: Column) -> Column:
    """A student's own countdown, else the common one."""
    return F.coalesce(own, F.lit(WRONG_ANSWER_COUNTDOWN))
