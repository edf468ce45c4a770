"""Sums in table order, held against a loop over the rows, and rounding against SQL's."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lamina.functions.columns import rounded
from lamina.functions.ordered import aggregate, placed
from lamina.plans import catalog


def test_sums_follow_the_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i % 2 if i % 7 else None, None if i % 11 == 0 else round(rng.random() * 1000, 2)) for i in range(40_000)] + [("z", 1, None)]
    for f in range(2):
        part = rows[f * 25_000 : (f + 1) * 25_000]
        pq.write_table(pa.table({"k": [r[0] for r in part], "j": [r[1] for r in part], "v": [r[2] for r in part]}), tmp_path / f"part-{f}.parquet", row_group_size=3000)
    want = {}
    for k, j, v in rows:
        s = want.setdefault((k, j), [0.0, 0, 0])
        s[2] += 1
        if v is not None:
            s[0], s[1] = s[0] + v, s[1] + 1
    df = placed(spark.read.parquet(str(tmp_path)))
    got = aggregate(df, ["k", "j"], F.count("*").alias("n"), sums={"s": F.col("v")}, means={"m": F.col("v")}).collect()
    assert {(r.k, r.j): (r.s, r.m, r.n) for r in got} == {g: (s if c else None, s / c if c else None, n) for g, (s, c, n) in want.items()}
    assert len(got) == len(want)


def test_rounding_is_that_of_sql(spark):
    values = [0.7859375, 1.005, 2.675, 348486.915, 300573.115, -1.0000005, -1e-9, 123.4565, 0.5, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for p in (2, 3, 6):
        want = [r[0] for r in duckdb.sql("SELECT round(v, " + str(p) + ") FROM (VALUES " + ", ".join(f"({'NULL' if v is None else repr(v)}::DOUBLE)" for v in values) + ") t(v)").fetchall()]
        assert repr([r.v for r in df.select(rounded("v", p).alias("v")).collect()]) == repr(want)


@pytest.mark.parametrize("name", ["d12_classes", "d14_guard", "d1_verdict", "d6_quality", "d8_flags", "x33_overlap", "x43_backend", "w11_ids", "w1_rank"])
def test_rows_do_not_hang_on_splits(spark, sf, tmp_path, name):
    """Values in hundredths whose means meet the thresholds, read in many splits."""
    rng = random.Random(9)
    n = 24_000
    t = {
        "l_suppkey": [rng.randrange(400) for _ in range(n)], "l_linenumber": [1 + rng.randrange(7) for _ in range(n)], "l_quantity": [float(1 + rng.randrange(50)) for _ in range(n)],
        "l_extendedprice": [round(900 + rng.random() * 104_000, 2) for _ in range(n)], "l_discount": [rng.randrange(11) / 100 for _ in range(n)], "l_returnflag": [rng.choice("ANR") for _ in range(n)],
        "l_linestatus": [rng.choice("OF") for _ in range(n)],
    }
    pq.write_table(pa.table(t), tmp_path / "lineitem.parquet", row_group_size=400)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = catalog.QUERIES[name](spark, str(tmp_path)).toArrow()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    at = [c[0] for c in want.description]
    assert sorted(repr([r[c] for c in at]) for r in got.to_pylist()) == sorted(repr(list(r)) for r in want.fetchall())
