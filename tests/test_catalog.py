"""Each query equals its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from fathom.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    key = lambda df: sorted(str(tuple(None if v != v or v is None else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in r)) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)
