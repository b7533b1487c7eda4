"""Content hashes and seeded keys as Column expressions; equal on every run and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_ws, trim_ws


def question_hash(question: Column, answer: Column, topic: Column, difficulty: Column) -> Column:
    """md5 of the four parts, lower-cased, white space collapsed, trimmed."""
    joined = F.concat_ws("|", question, answer, topic, difficulty)
    return F.md5(trim_ws(collapse_ws(F.lower(joined))).cast("binary"))


def resource_hash(url: Column, unit_id: Column, topic: Column) -> Column:
    """F09."""
    return F.md5(F.concat_ws("|", trim_ws(F.lower(url)), unit_id, topic).cast("binary"))


def prompt_hash(prompt: Column) -> Column:
    """the first 16 hex digits of sha256."""
    return F.left(F.sha2(prompt.cast("binary"), 256), F.lit(16))


def djb2(text: Column) -> Column:
    """h = h * 33 + code, modulo 2**32, from 5381."""
    codes = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + F.ascii(c)) % F.lit(1 << 32))


def rotated_picks(text: Column, pool: Column, n: int = 3) -> Column:
    """n entries of an array from the place that the text's hash points to, round the end."""
    start = djb2(text) % F.size(pool)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(pool, ((start + i) % F.size(pool) + 1).cast("int")))


def seeded_key(key: Column, seed: str) -> Column:
    """A whole number below 2**32 drawn from key and seed: md5's first eight digits."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("|" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def weighted_order(key: Column, weight: Column, seed: str) -> Column:
    """Ascending by this is a weighted draw without replacement (Efraimidis and Spirakis): -ln(u) / weight."""
    u = (seeded_key(key, seed) + 0.5) / math.pow(2, 32)
    return -F.log(u) / weight


def study_code(key: Column) -> Column:
    """a readable code from a key, the same each time."""
    return F.concat(F.lit("study-"), F.left(F.md5(key.cast("string").cast("binary")), F.lit(8)))
