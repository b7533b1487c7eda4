import duckdb
import pytest

from quillspark.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf).collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)
