import duckdb
import pytest

from lakeloom.llm import registry


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    want = con.execute(registry.oracle_sql()[name]).to_arrow_table().select(got.columns).to_pylist()
    key = lambda r: str(sorted(r.items()))
    assert sorted((r.asDict() for r in got.collect()), key=key) == sorted(want, key=key)
