"""Upserts, patches, cascades and constraint checks on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Child table, its foreign key and the parent whose deletion takes its rows along.
CASCADES = [
    ("quiz_history", "study_code_id", "study_codes"),
    ("question_results", "study_code_id", "study_codes"),
    ("leitner_state", "study_code_id", "study_codes"),
    ("questions", "batch_id", "batches"),
    ("learning_resources", "batch_id", "batches"),
    ("question_results", "quiz_history_id", "quiz_history"),
    ("question_results", "question_id", "questions"),
    ("leitner_state", "question_id", "questions"),
    ("experiment_batches", "experiment_id", "experiments"),
    ("experiment_questions", "experiment_id", "experiments"),
    ("experiment_questions", "batch_id", "experiment_batches"),
]


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Changes replace rows of the same keys; of several changes the one of the latest version wins."""
    if version:
        latest = Window.partitionBy(*keys).orderBy(F.desc(version))
        changes = changes.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def upsert_unit(units: DataFrame, changes: DataFrame) -> DataFrame:
    """Units by id; a new unit's sort_order is the number of units there, counted on for each further one."""
    known = units.join(changes.select("id", F.col("title").alias("__title")), "id", "left").withColumn("title", F.coalesce("__title", "title")).drop("__title")
    fresh = changes.join(units.select("id"), "id", "left_anti").dropDuplicates(["id"])
    placed = fresh.withColumn("__n", F.row_number().over(Window.orderBy("id")) - 1).crossJoin(F.broadcast(units.agg(F.count("*").alias("__have"))))
    return known.unionByName(placed.withColumn("sort_order", (F.col("__have") + F.col("__n")).cast(units.schema["sort_order"].dataType)).select(*units.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose keys are not there yet, each once."""
    first = Window.partitionBy(*keys).orderBy(*keys)
    fresh = rows.join(target.select(*keys), keys, "left_anti").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return target.unionByName(fresh, allowMissingColumns=True)


def patch(target: DataFrame, changes: DataFrame, key: str, columns: list[str], touched: Column | None = None) -> DataFrame:
    """Columns of rows that changes name are overwritten, with nulls too.

    Where the table has updated_at, these rows get `touched` there, by default the time of the query.
    """
    if touched is None and "updated_at" in target.columns:
        touched = F.current_timestamp().cast(target.schema["updated_at"].dataType)
    c = changes.select(key, F.lit(True).alias("__set"), *(F.col(x).alias(f"__{x}") for x in columns))
    out = target.join(c, key, "left")
    out = out.withColumns({x: F.when(F.col("__set"), F.col(f"__{x}")).otherwise(F.col(x)) for x in columns})
    if touched is not None:
        out = out.withColumn("updated_at", F.when(F.col("__set"), touched).otherwise(F.col("updated_at")))
    return out.select(*target.columns)


def cascade_delete(tables: dict[str, DataFrame], table: str, keys: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """The tables without the rows whose key is in `keys` and without all rows that hang on them."""
    out = dict(tables)
    gone = {table: out[table].join(keys.select(key), key, "left_semi").select(key)}
    out[table] = out[table].join(keys.select(key), key, "left_anti")
    for child, foreign, parent in CASCADES:
        if parent in gone and child in out:
            dead = gone[parent].select(F.col(key).alias(foreign)).distinct()
            lost = out[child].join(dead, foreign, "left_semi")
            if key in out[child].columns:
                gone[child] = gone[child].unionByName(lost.select(key)) if child in gone else lost.select(key)
            out[child] = out[child].join(dead, foreign, "left_anti")
    return out


def bulk_delete(target: DataFrame, codes: DataFrame, key: str = "code") -> tuple[DataFrame, DataFrame]:
    """The rows that stay and a tally; a code that isn't there counts as deleted."""
    return target.join(codes, key, "left_anti"), codes.agg(F.count("*").alias("deleted"), F.lit(0).cast("bigint").alias("failed"))


def violations(df: DataFrame, name: str, enums: dict[str, list[str]] | None = None, ranges: dict[str, tuple[float, float]] | None = None, required: list[str] | None = None) -> DataFrame:
    """(rule, n) of rows that break a CHECK, one row a rule, in one pass; null passes a CHECK."""
    rules: list[tuple[str, Column]] = [(f"{name}.{c} in", F.coalesce(~F.col(c).isin(*v), F.lit(False))) for c, v in (enums or {}).items()]
    rules += [(f"{name}.{c} range", F.coalesce((F.col(c) < a) | (F.col(c) > b), F.lit(False))) for c, (a, b) in (ranges or {}).items()]
    rules += [(f"{name}.{c} required", F.col(c).isNull()) for c in required or []]
    row = df.agg(*(F.count_if(broken).alias(f"r{i}") for i, (_, broken) in enumerate(rules)))
    return row.select(F.stack(F.lit(len(rules)), *(x for i, (rule, _) in enumerate(rules) for x in (F.lit(rule), F.col(f"r{i}")))).alias("rule", "n"))


def duplicate_keys(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(rule, n): how many keys occur more than once."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"{name}({','.join(keys)}) unique").alias("rule"), "n")


def orphans(child: DataFrame, parent: DataFrame, name: str, foreign: str, key: str = "id") -> DataFrame:
    """(rule, n): child rows whose parent isn't there; a null reference passes."""
    lost = child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")
    return lost.agg(F.count("*").alias("n")).select(F.lit(f"{name}.{foreign} references").alias("rule"), "n")


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that hold, rejected rows with reason)."""
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def as_role(df: DataFrame, role: str, hidden_from: tuple[str, ...] = ("anon",)) -> DataFrame:
    """The table as a role sees it; nothing where the role has no policy."""
    return df.where(F.lit(role not in hidden_from))


def single(df: DataFrame, key: str, value, optional: bool = False) -> DataFrame:
    """The one row of a key; an error if there are several, or none and it isn't optional."""
    found = df.where(F.col(key) == F.lit(value)).limit(2)
    n = found.count()
    if n > 1 or (n == 0 and not optional):
        raise LookupError(f"{n if n < 2 else 'several'} rows for {key} = {value!r}")
    return found


def exists(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """J11."""
    return df.join(other.select(key), key, "left_semi")
