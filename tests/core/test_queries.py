import datetime as dt
import math

import duckdb
import pytest

from quillspark.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    result = duck.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    columns = sorted(kinds)
    at = {d[0]: i for i, d in enumerate(result.description)}
    want = sorted((tuple(plain(r[at[c]]) for c in columns) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_j09_writes_a_students_rows_together(spark, sf, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["j09_weak_topic_resources"](spark, sf).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    changes = rows = 0
    for file in (tmp_path / "out").glob("*.parquet"):
        con = duckdb.connect()
        got = [r[0] for r in con.execute(f"SELECT (study_code_id, topic) FROM read_parquet('{file}') ORDER BY file_row_number").fetchall()]
        rows, changes = rows + len(got), changes + sum(a != b for a, b in zip([None, *got[:-1]], got, strict=True))
    assert rows and changes == len({tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("study_code_id", "topic").distinct().collect()})


def test_j09_writes_topic_by_topic_and_sums_the_results_once(spark, sf, tmp_path):
    for n, threshold in enumerate(("10m", "16k", "-1")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            df = QUERIES["j09_weak_topic_resources"](spark, sf)
            df.write.parquet(str(tmp_path / str(n)))
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len([x for x in plan.splitlines() if "- Exchange hashpartitioning(study_code_id" in x]) == 1
        for file in (tmp_path / str(n)).glob("*.parquet"):
            got = [r[0] for r in duckdb.connect().execute(f"SELECT topic FROM read_parquet('{file}') ORDER BY file_row_number").fetchall()]
            assert sum(a != b for a, b in zip([None, *got[:-1]], got, strict=True)) == len(set(got))


def test_rate_limit_against_a_walk(spark, sf):
    from quillspark.plans.fixtures import frame

    held, want = {}, {}
    for r in sorted(frame(spark, sf, "attempt_events").collect(), key=lambda r: (r.attempted_at, r.event_id)):
        mine = [t for t in held.get(r.study_code_id, []) if (r.attempted_at - t).total_seconds() < 6 * 3600]
        want[r.event_id] = (len(mine) < 3, max(0, 2 - len(mine)), r.attempted_at if len(mine) < 3 else mine[0])
        held[r.study_code_id] = [*mine, r.attempted_at] if len(mine) < 3 else mine
    window = dt.timedelta(hours=6)
    got = {r.event_id: (r.allowed, r.remaining, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r.reset_at) - window) for r in QUERIES["t02_rate_limit"](spark, sf).collect()}
    assert got == want
