"""Every query with a SQL twin gives the twin's rows on the small tables."""

import duckdb
import pytest

from lamina.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def twin(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, twin, name):
    df = catalog.QUERIES[name](spark, sf)
    if name not in catalog.ORACLE_SQL:
        assert df.count() > 0
        return
    got, want = df.toArrow(), twin.execute(catalog.ORACLE_SQL[name])
    names, at = sorted(got.column_names), [c[0] for c in want.description]
    assert names == sorted(at)
    plain = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    rows = sorted(repr([plain(v) for v in r.values()]) for r in got.select(names).to_pylist())
    assert rows == sorted(repr([r[at.index(c)] for c in names]) for r in want.fetchall())


def test_entry_survives_without_the_corpus_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "lamina.llm", None)
    with pytest.raises(ModuleNotFoundError):
        import lamina.llm  # noqa: F401
    assert __spark_entry__.queries() == catalog.QUERIES and set(__spark_entry__.oracle_sql()) == set(catalog.ORACLE_SQL)


def test_plans_have_no_products(spark, sf):
    for name in ("j8_radius", "j12_smallest_area", "qc_purity_recall", "x16_raster_adjacency"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
