"""Scans, text sources and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import pacific_time, percent
from ..functions.text import trim_ws
from ..operators.validation import is_meta_served
from ..schemas import schema

CHUNK = 15_000
#: Columns of the short and of the full export, and headers of the students' export.
MINIMAL = ["id", "question", "correct_answer", "type", "difficulty", "topic", "unit_id", "writing_type", "options", "acceptable_variations"]
FULL = ["id", "question", "correct_answer", "explanation", "type", "difficulty", "topic", "unit_id", "writing_type", "options", "acceptable_variations", "hints", "content_hash", "batch_id", "generated_by", "quality_status", "source_file", "created_at"]
CSV_HEADERS = ["Study Code", "Display Name", "Admin Label", "Total Quizzes", "Total Questions", "Correct Answers", "Accuracy %", "Last Active (PST)", "Created At (PST)"]


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Columns and predicate reach the Parquet scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def active_questions(questions: DataFrame, unit: str | None = None) -> DataFrame:
    """What may be served, newest first when shown."""
    out = questions.where("quality_status = 'active'")
    if unit:
        out = out.where(F.col("unit_id").isin(unit, "all"))
    return out.where(~is_meta_served(F.col("question"), F.col("explanation"))) if "explanation" in questions.columns else out


def ordered_units(units: DataFrame) -> DataFrame:
    """By sort_order; `introduction` first, then by number."""
    return units.orderBy("sort_order", F.col("id") != "introduction", F.try_to_number(F.nullif(F.regexp_extract("id", r"\d+", 0), F.lit("")), F.lit("999999")))


def row_count(df: DataFrame) -> DataFrame:
    """S06."""
    return df.agg(F.count("*").alias("n"))


def json_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A file that is one JSON array of rows of a table."""
    return spark.read.schema(schema(table)).json(path, multiLine=True)


def markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(file, text) of whole files whose names match."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


def find_unit_file(files: DataFrame, pattern: str, canonical: str | None = None) -> DataFrame:
    """The one file of a unit, the canonical name first; several others are an error."""
    found = files.where(F.col("file").rlike(pattern)).orderBy(F.col("file") != F.lit(canonical or ""), "file").limit(2).collect()
    if len(found) > 1 and found[0].file != canonical:
        raise LookupError(f"several files match: {', '.join(r.file for r in found)}")
    return files.where(F.col("file") == F.lit(found[0].file if found else None))


def discovered_units(files: DataFrame) -> DataFrame:
    """The unit ids that file names tell, `introduction` first, then by number; files of a cohort don't count."""
    number = F.regexp_extract("file", r"(?i)unit[_\s-]?(\d+)", 1)
    unit = F.when(F.col("file").rlike("(?i)introduction"), "introduction").when(number != "", F.concat(F.lit("unit-"), number))
    ids = files.where(~F.col("file").contains(".cohort-")).select(unit.alias("id")).where("id is not null").distinct()
    return ids.orderBy(F.col("id") != "introduction", F.regexp_extract("id", r"\d+", 0).try_cast("bigint"), "id")


def canonical_file(unit_id: Column, prefix: str, ending: str) -> Column:
    """The file name that goes before others of its unit."""
    return F.concat(F.lit(prefix), F.initcap(F.replace(unit_id, F.lit("-"), F.lit(" "))), F.lit(ending))


def keyed_rows(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is in a list that may be long: a semi join, not a literal list."""
    return df.join(values.select(F.col(values.columns[0]).alias(column)).distinct(), column, "left_semi")


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null."""
    return df.dropna(subset=list(columns))


def view(df: DataFrame, where: Column, order: list[Column | str], most: int | None = None) -> DataFrame:
    """Rows of a view that meet a predicate, in order."""
    out = df.where(where).orderBy(*order)
    return out.limit(most) if most is not None else out


def chunk_pages(text: Column, size: int = CHUNK) -> Column:
    """Pages between form feeds, blank ones dropped, packed in order into chunks of about `size` characters.

    Each page brings a blank line along, which counts; a page goes on to the next chunk if it would pass `size`. Chunks are trimmed;
    a text without pages is its own only chunk.
    """
    pages = F.filter(F.split(text, "\f"), lambda p: trim_ws(p) != "")
    start = F.array().cast("array<string>")

    def pack(done, page):
        last, own = F.try_element_at(done, F.lit(-1)), F.concat(page, F.lit("\n\n"))
        fits = F.coalesce(F.length(last) + F.length(page) <= size, F.lit(False))
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, own)))
        return F.when(fits, grown).otherwise(F.concat(done, F.array(own)))

    return F.when(F.size(pages) == 0, F.array(text)).otherwise(F.aggregate(pages, start, pack, lambda done: F.transform(done, trim_ws)))


def export_json(questions: DataFrame, path: str, full: bool = False) -> DataFrame:
    """Writes ten columns, or eighteen; returns counts (kind, value, n) by type and by difficulty.

    JSON lines, one object a row, rather than one array, so that the file is written and read in parallel; nulls are left out.
    """
    questions.select(*export_columns(questions, full)).write.mode("overwrite").json(path)
    return export_counts(questions)


def export_columns(questions: DataFrame, full: bool = False) -> list[str]:
    """The export's columns that the table has, in the export's order."""
    return [c for c in (FULL if full else MINIMAL) if c in questions.columns]


def export_counts(questions: DataFrame) -> DataFrame:
    """(kind, value, n): questions of each type, then of each difficulty, in one pass."""
    kinds = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("type", "difficulty")))
    return questions.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def csv_lines(students: DataFrame) -> DataFrame:
    """(value) lines of the students' export, in the students' order: headers plain, each cell quoted, accuracy to two
    digits, dates in Pacific time, an empty name Anonymous. Quotes inside a cell are not doubled, as readers of this export expect.
    """
    accuracy = F.format_string("%.2f", percent(F.col("correct_answers"), F.col("total_questions")))
    cells = ["code", F.coalesce(F.nullif("display_name", F.lit("")), F.lit("Anonymous")), F.coalesce("admin_label", F.lit("")), "total_quizzes", "total_questions", "correct_answers", accuracy, F.coalesce(pacific_time(F.col("last_active_at")), F.lit("")), F.coalesce(pacific_time(F.col("created_at")), F.lit(""))]
    quoted = [F.concat(F.lit('"'), (F.col(c) if isinstance(c, str) else c).cast("string"), F.lit('"')) for c in cells]
    header = students.sparkSession.createDataFrame([(-1, ",".join(CSV_HEADERS))], "at bigint, value string")
    body = students.select(F.monotonically_increasing_id().alias("at"), F.concat_ws(",", *quoted).alias("value"))
    return header.unionByName(body).orderBy("at").select("value")


def markdown_lines(df: DataFrame) -> DataFrame:
    """(value) lines of a markdown table of all rows, in df's order."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    head = df.sparkSession.createDataFrame([(-2, line(df.columns)), (-1, line(["---"] * len(df.columns)))], "at bigint, value string")
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns))
    body = df.select(F.monotonically_increasing_id().alias("at"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))
    return head.unionByName(body).orderBy("at").select("value")


def markdown_report(title: str, sections: dict[str, DataFrame]) -> str:
    """A report of aggregates, each under its heading; every row is printed."""
    tables = (f"## {name}\n\n" + "\n".join(r.value for r in markdown_lines(df).toLocalIterator()) for name, df in sections.items())
    return "\n\n".join([f"# {title}", *tables]) + "\n"


def append(df: DataFrame, path: str) -> None:
    """Rows are committed together, whatever their number."""
    df.write.mode("append").parquet(path)
