"""Question selection: seeded and weighted order, quotas, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_key, weighted_order

#: Share of each question type by quiz mode.
MODES = {
    "practice": {"multiple-choice": 0.35, "true-false": 0.15, "fill-in-blank": 0.20, "writing": 0.30},
    "assessment": {"fill-in-blank": 0.50, "writing": 0.50},
}
LEGACY_WRITING = 0.3


def mode_shares(mode: str) -> dict[str, float]:
    """An unknown mode counts as practice."""
    return MODES.get(mode, MODES["practice"])


def uniform_sample(df: DataFrame, n: int, seed: str, key: str = "id") -> DataFrame:
    """N rows without replacement, the same for a seed on every run."""
    return df.orderBy(seeded_key(F.col(key), seed), key).limit(n)


def ranked(df: DataFrame, first: str, order: list[Column], name: str, slices: int = 64) -> DataFrame:
    """df with its rows' place in an order whose first key is the numeric column `first`, ascending.

    The key's quantiles, `slices` numbers, cut the order in slices that are ranked apart; a slice's rows start after those of all
    slices before it. So no task has all rows, unless they all share one key.
    """
    bounds = df.agg(F.percentile_approx(first, [k / slices for k in range(1, slices)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*(F.lit(b) for b in sorted(set(bounds)))), lambda b: b < F.col(first))) if bounds else F.lit(0)
    dealt = df.withColumn("__part", F.when(F.col(first).isNull(), -1).otherwise(part))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__part"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return own.join(F.broadcast(before), "__part").withColumn(name, (F.col("__own") + F.col("__before")).cast("int")).drop("__part", "__own", "__before")


def weighted_shuffle(df: DataFrame, seed: str, key: str = "id", weight: str = "weight") -> DataFrame:
    """Position of each row in a weighted draw without replacement."""
    keyed = df.withColumn("__order", weighted_order(F.col(key), F.col(weight), seed))
    return ranked(keyed, "__order", [F.col("__order"), F.col(key)], "position").drop("__order")


def quotas(shares: dict[str, float], n: int) -> dict[str, int]:
    """Floors, then one more for the largest remainders; ties keep the order of shares."""
    live = {t: s for t, s in shares.items() if s > 0}
    out = {t: int(n * s + 1e-9) for t, s in live.items()}
    rest = sorted(live, key=lambda t: -round(n * live[t] - out[t], 9))
    for t in rest[: max(0, n - sum(out.values()))]:
        out[t] += 1
    return out


def quota_frame(spark, shares: dict[str, float], n: int) -> DataFrame:
    """O10 on a small table: (type, quota)."""
    rows = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(shares.items()) if s > 0], "pos int, type string, share double")
    exact = F.round(F.lit(n) * F.col("share"), 9)
    floors = rows.withColumn("base", F.floor(exact).cast("int")).withColumn("frac", F.round(exact - F.floor(exact), 9))
    every, order = Window.partitionBy(), Window.orderBy(F.desc("frac"), "pos")
    more = F.row_number().over(order) <= F.lit(n) - F.sum("base").over(every)
    return floors.select("type", (F.col("base") + more.cast("int")).alias("quota"))


def select_by_distribution(questions: DataFrame, shares: dict[str, float], n: int, seed: str, weight: str | None = None) -> DataFrame:
    """Each type's quota in seeded (or weighted) order, then backfill to n from what is left.

    Adds `how` (quota or backfill). Ranks use top-n windows by type, so only n rows a type are shuffled on.
    """
    spark = questions.sparkSession
    wanted = F.broadcast(quota_frame(spark, shares, n))
    order = weighted_order(F.col("id"), F.col(weight), seed) if weight else seeded_key(F.col("id"), seed)
    keyed = questions.withColumn("__key", order)
    rank = F.row_number().over(Window.partitionBy("type").orderBy("__key", "id"))
    chosen = keyed.withColumn("__rank", rank).where(F.col("__rank") <= n).join(wanted, "type").where(F.col("__rank") <= F.col("quota")).drop("__rank", "quota").withColumn("how", F.lit("quota"))
    left = keyed.join(chosen.select("id"), "id", "left_anti").withColumn("__fill", seeded_key(F.col("id"), seed + "-fill")).orderBy("__fill", "id").limit(n)
    filled = left.withColumn("__n", F.row_number().over(Window.orderBy("__fill", "id"))).crossJoin(F.broadcast(chosen.agg(F.count("*").alias("__have")))).where(F.col("__n") <= F.lit(n) - F.col("__have"))
    return chosen.unionByName(filled.drop("__fill", "__n", "__have").withColumn("how", F.lit("backfill"))).drop("__key")


def shortages(questions: DataFrame, shares: dict[str, float], n: int) -> DataFrame:
    """O11's warnings: types with fewer questions than their quota."""
    have = questions.groupBy("type").count()
    short = quota_frame(questions.sparkSession, shares, n).join(have, "type", "left").withColumn("available", F.coalesce("count", F.lit(0)))
    return short.where("available < quota").select("type", "quota", "available")


def legacy_split(questions: DataFrame, n: int, seed: str) -> DataFrame:
    """Up to 30 % writing (rounded up), the rest of other types."""
    writing = min(-(-3 * n // 10), n)
    order = Window.partitionBy(F.col("type") == "writing").orderBy(seeded_key(F.col("id"), seed), "id")
    ranked = questions.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n)
    typed = ranked.where((F.col("type") == "writing") & (F.col("__rank") <= writing)).drop("__rank")
    others = ranked.where(F.col("type") != "writing").orderBy("__rank").crossJoin(F.broadcast(typed.agg(F.count("*").alias("__w")))).where(F.col("__rank") <= F.lit(n) - F.col("__w")).drop("__rank", "__w")
    return typed.unionByName(others)


def criteria_filter(questions: DataFrame, unit: str | None = None, topic: str | None = None, difficulty: str | None = None, types: list[str] | None = None, model: str | None = None, batch: str | None = None, status: str | None = None) -> DataFrame:
    """`all` is a wildcard on either side for units; topics compare without case."""
    out = questions
    if types:
        out = out.where(F.col("type").isin(*types))
    if unit and unit != "all":
        out = out.where(F.col("unit_id").isin(unit, "all"))
    if topic:
        out = out.where(F.lower("topic") == topic.lower())
    if difficulty:
        out = out.where(F.col("difficulty") == difficulty)
    for column, value in (("generated_by", model), ("batch_id", batch), ("quality_status", status)):
        if value:
            out = out.where(F.col(column) == value)
    return out


def assemble_quiz(questions: DataFrame, n: int, seed: str, mode: str = "practice", state: DataFrame | None = None, student=None, **criteria) -> DataFrame:
    """Active questions that meet the criteria, drawn by the mode's shares, weighted by the student's boxes if given."""
    from .leitner import question_weights

    pool = criteria_filter(questions.where("quality_status = 'active'"), **criteria)
    weight = None
    if state is not None:
        pool, weight = question_weights(pool, state, student), "weight"
    return select_by_distribution(pool, mode_shares(mode), n, seed, weight)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
