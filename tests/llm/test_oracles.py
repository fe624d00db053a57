"""Queries that have SQL equal it on a small table."""

from pathlib import Path

import duckdb
import pytest

from fathom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    want, got = (x[sorted(want.columns)].sort_values(["doc_id", *(c for c in ("item_id",) if c in want)]).reset_index(drop=True) for x in (want, got))
    for c in want.columns:
        a, b = want[c].astype(object).where(want[c].notna(), None).tolist(), got[c].astype(object).where(got[c].notna(), None).tolist()
        wrong = [(i, x, y) for i, x, y in zip(want["doc_id"], a, b) if x != y]
        assert not wrong, (c, len(wrong), wrong[:3])
