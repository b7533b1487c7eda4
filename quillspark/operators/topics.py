"""Topic candidates and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import heading_keywords, normalize_topic


def _words(key: Column) -> Column:
    return F.array_distinct(F.split(key, " "))


def alike(a: Column, b: Column) -> Column:
    """J08's test on normalised topics: one holds the other, or they share two words of more than three letters."""
    shared = F.filter(F.array_intersect(_words(a), _words(b)), lambda w: F.length(w) > 3)
    return F.contains(a, b) | F.contains(b, a) | (F.size(shared) >= 2)


def candidate_pairs(left: DataFrame, right: DataFrame, same: bool = False) -> DataFrame:
    """(left, right) topics that are alike.

    The right side is a curated list whose size is counted first. Containment may cut words anywhere, so no equality carries it: the
    plan is a nested loop against the broadcast list, a longer list in slices of about `BROADCAST` names, one loop each. Work grows
    with left times right; the left side may be of any size, the right one is meant for some ten thousand names.
    """
    a = left.select(F.col("topic").alias("left"), normalize_topic(F.col("topic")).alias("l"))
    b = right.select(F.col("topic").alias("right"), normalize_topic(F.col("topic")).alias("r"))
    test = alike(F.col("l"), F.col("r"))
    if same:
        test = test & (F.col("left") < F.col("right"))
    n = b.count()
    out = None
    for k in range(max(1, -(-n // BROADCAST))):
        part = b if n <= BROADCAST else b.where(F.pmod(F.xxhash64("right"), F.lit(-(-n // BROADCAST))) == k)
        pairs = a.join(F.broadcast(part), test).select("left", "right")
        out = pairs if out is None else out.unionByName(pairs)
    return out


BROADCAST = 50_000


def reconcile(extracted: DataFrame, existing: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """For each extracted topic an action: reuse (exact, or one identical candidate), new, or review.

    verdicts: (left, right, similarity) of an external judge for topics with one candidate; without one the topic is new.
    """
    exact = extracted.join(existing.select("topic").distinct(), "topic", "left_semi").select("topic", F.lit("reuse").alias("action"), F.col("topic").alias("target"))
    rest = extracted.join(existing.select("topic"), "topic", "left_anti")
    found = candidate_pairs(rest, existing).groupBy("left").agg(F.count("*").alias("n"), F.min("right").alias("target"))
    judged = rest.select("topic").join(found, F.col("topic") == F.col("left"), "left").drop("left")
    if verdicts is not None:
        judged = judged.join(verdicts.select(F.col("left").alias("topic"), F.col("right").alias("target"), "similarity"), ["topic", "target"], "left")
    else:
        judged = judged.withColumn("similarity", F.lit(None).cast("string"))
    action = F.when(F.col("n").isNull(), "new").when(F.col("n") > 1, "review").when(F.col("similarity") == "identical", "reuse").when(F.col("similarity") == "overlapping", "review").otherwise("new")
    out = judged.withColumn("action", action)
    return exact.unionByName(out.select("topic", "action", F.when(F.col("action") == "reuse", F.col("target")).otherwise(F.when(F.col("action") == "new", F.col("topic"))).alias("target")))


def final_topics(reconciled: DataFrame) -> DataFrame:
    """The topics reused or new, each once, sorted."""
    return reconciled.where(F.col("action").isin("reuse", "new")).select(F.col("target").alias("topic")).distinct().orderBy("topic")


def heading_mappings(extracted: DataFrame, finals: DataFrame) -> DataFrame:
    """R11 over (topic, heading_source) and, if there, position: keywords of the headings of each final topic, in order of first sight.

    A topic maps to the first final one, by name, that equals it but for case, holds it or is held by it; else to itself.
    """
    holds = F.contains(F.lower("topic"), F.lower("final")) | F.contains(F.lower("final"), F.lower("topic"))
    at = F.col("position") if "position" in extracted.columns else F.lit(0)
    rows = extracted.select("topic", "heading_source", at.cast("bigint").alias("__at"))
    met = rows.join(finals.select(F.col("topic").alias("final")), holds, "left").groupBy("__at", "topic", "heading_source").agg(F.coalesce(F.min("final"), F.first("topic")).alias("final"))
    words = met.select("final", "__at", "topic", F.posexplode(heading_keywords(F.col("heading_source"))).alias("__n", "keyword"))
    seen = words.groupBy("final", "keyword").agg(F.min(F.struct("__at", "topic", "__n")).alias("__seen"))
    return seen.groupBy("final").agg(F.transform(F.array_sort(F.collect_list(F.struct("__seen", "keyword"))), lambda x: x["keyword"]).alias("keywords"))


def consolidation_summary(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidate pairs by the judge's verdict; unjudged ones are distinct."""
    return pairs.join(verdicts, ["left", "right"], "left").groupBy(F.coalesce("similarity", F.lit("distinct")).alias("similarity")).agg(F.count("*").alias("n"))
