"""Text functions as Column expressions: normalisation, similarity, topic and prompt helpers.

Every white-space class is `WS`, the Unicode spaces that French typography and editors put in texts, not Java's ASCII `\\s`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\u000B   -     　﻿]"

#: Latin letters that a canonical decomposition splits, and their base letters; ligatures such as oe stay.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", " ")


def strip_accents(text: Column) -> Column:
    """Lower-cased text without diacritics, precomposed or combining."""
    return F.translate(F.regexp_replace(F.lower(text), r"[̀-ͯ]", ""), ACCENTED, PLAIN)


def normalize_text(text: Column) -> Column:
    """no diacritics, lower case, trimmed, inner white space collapsed."""
    return collapse_ws(trim_ws(strip_accents(text)))


def normalize_punctuation_spacing(text: Column) -> Column:
    """no white space before ? ! ; :"""
    return F.regexp_replace(text, f"{WS}+([?!;:])", "$1")


def match_key(text: Column) -> Column:
    return normalize_punctuation_spacing(normalize_text(text))


def edit_distance(a: Column, b: Column) -> Column:
    """F03, over code points."""
    return F.levenshtein(a, b)


def has_correct_accents(user: Column, correct: Column) -> Column:
    """equal but for case, outer and repeated white space and spaces before punctuation."""
    key = lambda c: normalize_punctuation_spacing(collapse_ws(F.lower(trim_ws(c))))
    return key(user) == key(correct)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length on normalised texts; 1 if both are empty."""
    x, y = normalize_text(a), normalize_text(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1.0 - edit_distance(x, y) / F.greatest(longest, F.lit(1)))


def normalize_code(code: Column) -> Column:
    """F06."""
    return F.lower(trim_ws(code))


def normalize_topic(topic: Column) -> Column:
    """lower case, straight quotes, collapsed white space, no parentheses, trimmed."""
    straight = F.translate(F.lower(topic), "‘’", "''")
    return trim_ws(F.regexp_replace(collapse_ws(straight), r"[()]", ""))


#: Prompt patterns of each writing type, in the order they are tried.
WRITING_TYPE_PATTERNS = [
    ("conjugation", r"conjugat|verb form|present tense form|all six.*forms"),
    ("question_formation", r"write a question|create a question|form a question|turn.+into.+question|using.+est-ce que"),
    ("sentence_building", r"write.+sentence|create.+sentence|complete.+sentence|combine.+sentence|using the (words|following|structure)|rewrite|write.+(two|three|four|five|six).+sentence"),
    ("translation", r"translate|en français|in french|into french|tradui"),
]


def infer_writing_type(prompt: Column) -> Column:
    """the first type whose pattern matches, else open_ended."""
    out = F.lit("open_ended")
    for name, pattern in reversed(WRITING_TYPE_PATTERNS):
        out = F.when(F.lower(prompt).rlike(pattern), name).otherwise(out)
    return out


def first_letter(word: Column) -> Column:
    """F34."""
    return F.lower(F.left(word, F.lit(1)))


def blank_count(question: Column) -> Column:
    """runs of three underscores or more."""
    return F.regexp_count(question, F.lit("_{3,}"))


def answer_groups(answer: Column) -> Column:
    """answers parted by commas, empty ones left out."""
    return F.size(F.filter(F.transform(F.split(answer, ","), trim_ws), lambda g: g != ""))


def rescue_json(response: Column) -> Column:
    """from the first { to the last }, without trailing commas; null if there is none."""
    inner = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return F.when(inner != "", F.regexp_replace(inner, rf",({WS}*[}}\]])", "$1"))


def strip_code_fence(response: Column) -> Column:
    """F15."""
    return F.regexp_replace(response, r"```(?:json)?\n?", "")


#: How a converter's opening remarks begin, and what its closing summaries hold.
INTRODUCTIONS = ["I'll convert this", "Here's the", "The PDF file", "Perfect!", "Now I'll"]
SUMMARIES = ["This markdown preserves", "Perfect for", "The content above"]


def clean_conversion(text: Column) -> Column:
    """F16: an outer code fence, opening remarks, and a summary after the last rule go; the rule stays."""
    out = F.regexp_replace(text, r"\A```(?:markdown)?\n?", "")
    out = F.regexp_replace(out, r"\n?```\z", "")
    for words in INTRODUCTIONS:
        out = F.regexp_replace(out, rf"(?i)\A{words}[^\n]*?\n+", "")
    head = F.regexp_extract(out, r"(?s)\A(.*\n---\n)(.*)\z", 1)
    tail = F.regexp_extract(out, r"(?s)\A(.*\n---\n)(.*)\z", 2)
    summary = F.lit(False)
    for words in SUMMARIES:
        summary = summary | tail.contains(words)
    return trim_ws(F.when(summary, head).otherwise(out))


#: Words that no keyword is made of.
KEYWORD_STOPS = ["the", "and", "for", "with"]


def heading_keywords(heading: Column) -> Column:
    """distinct words of a heading of more than two letters, in order."""
    parts = F.transform(F.split(F.lower(heading), rf"(?:[,\-–—&]|{WS})+"), trim_ws)
    return F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(*KEYWORD_STOPS)))


def unit_label(unit_id: Column) -> Column:
    """dashes to spaces, words capitalised."""
    return F.initcap(F.replace(unit_id, F.lit("-"), F.lit(" ")))


def slug(unit_id: Column, topic: Column, difficulty: Column, number: Column) -> Column:
    """F28."""
    return F.concat_ws("_", unit_id, F.regexp_replace(topic, f"{WS}+", "_"), difficulty, F.concat(F.lit("q"), number.cast("string")))


def lettered_options(options: Column) -> Column:
    """A) first | B) second ..."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(") "), x)), " | ")


def word_diff(user: Column, correct: Column) -> Column:
    """The user's tokens, white space among them, set against the correct ones at the same place."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit(f"{WS}+|(?:(?!{WS}).)+"), F.lit(0))
    pairs = F.arrays_zip(tokens(user).alias("user"), tokens(correct).alias("correct"))
    return F.transform(pairs, lambda p: F.struct(p["user"].alias("user"), p["correct"].alias("correct"), (~p["user"].eqNullSafe(p["correct"])).alias("is_diff")))
