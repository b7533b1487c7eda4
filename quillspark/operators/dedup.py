"""Content-hash dedup and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_only(incoming: DataFrame, existing: DataFrame, key: str = "content_hash", order: list[str] | None = None) -> DataFrame:
    """Rows whose hash is not yet there; with `order`, also the first of each hash within the batch."""
    fresh = incoming.join(existing.select(key), key, "left_anti")
    return keep_first(fresh, [key], order) if order else fresh


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def pairwise_overlap(rows: DataFrame, group: str = "cohort", key: str = "content_hash") -> DataFrame:
    """Shared hashes of each two groups, pairs without any included.

    Groups of a hash are gathered once (as many as there are groups), so no hash is joined with itself.
    """
    sets = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("gs"))
    pairs = sets.where(F.size("gs") > 1).select(F.explode(F.flatten(F.transform("gs", lambda a: F.transform(F.filter("gs", lambda b: b > a), lambda b: F.struct(a.alias("group_a"), b.alias("group_b")))))).alias("p")).groupBy("p.group_a", "p.group_b").agg(F.count("*").alias("shared"))
    names = rows.select(group).distinct()
    every = names.withColumnRenamed(group, "group_a").join(names.withColumnRenamed(group, "group_b"), F.col("group_a") < F.col("group_b"))
    return every.join(pairs, ["group_a", "group_b"], "left").fillna({"shared": 0})


def overlap_share(rows: DataFrame, group: str = "cohort", key: str = "content_hash") -> DataFrame:
    """Shared hashes as a percentage of the smaller group's rows."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    a, b = sizes.select(F.col(group).alias("group_a"), F.col("n").alias("n_a")), sizes.select(F.col(group).alias("group_b"), F.col("n").alias("n_b"))
    out = pairwise_overlap(rows, group, key).join(a, "group_a").join(b, "group_b")
    return out.withColumn("pct_of_smaller", F.round(F.try_divide(100.0 * F.col("shared"), F.least("n_a", "n_b")), 1))


def subtract_keep(values: Column, drop: Column) -> Column:
    """Values without those in drop, order and duplicates kept."""
    return F.filter(values, lambda v: ~F.array_contains(drop, v))


def shared_words(a: Column, b: Column, longer_than: int = 3) -> Column:
    """U06."""
    return F.filter(F.array_intersect(a, b), lambda w: F.length(w) > longer_than)


def twin_union(control: DataFrame, treatments: dict[str, DataFrame], label: str = "cohort") -> DataFrame:
    """The control rows and each treatment's, labelled."""
    out = control.withColumn(label, F.lit("control"))
    for name, rows in treatments.items():
        out = out.unionByName(rows.withColumn(label, F.lit(name)), allowMissingColumns=True)
    return out
