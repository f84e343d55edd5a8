import duckdb
import pytest

from lakeloom import platform_queries, queries, stored_queries  # noqa: F401  the others add their queries to those of the second


def key(row):
    return str(sorted(row.items()))


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    rows = [{k: plain(v) for k, v in r.asDict().items()} for r in got.collect()]
    assert sorted(rows, key=key) == sorted(({c: plain(r[c]) for c in got.columns} for r in want.to_pylist()), key=key)
