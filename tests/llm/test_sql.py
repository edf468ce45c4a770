"""Operators that SQL can express give the rows of their SQL."""

import duckdb
import pytest

from lamina.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toArrow(), con.execute(ORACLE_SQL[name])
    names, at = sorted(got.column_names), [c[0] for c in want.description]
    assert names == sorted(at)
    assert sorted(repr(list(r.values())) for r in got.select(names).to_pylist()) == sorted(repr([r[at.index(c)] for c in names]) for r in want.fetchall())
