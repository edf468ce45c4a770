import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from lamina.operators import regions
from lamina.sources import formats
from lamina.streaming.windows import run_windows

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]


def test_points_by_suffix(spark, tmp_path):
    rows = "Cell_ID,X_Centroid,y_centroid,qv\na,1,2,30\nb,NaN,2,10\nc,x,2,10\nd,3,4,5\n"
    (tmp_path / "c.csv").write_text(rows)
    with gzip.open(tmp_path / "c.tsv.gz", "wt") as f:
        f.write(rows.replace(",", "\t"))
    for name in ("c.csv", "c.tsv.gz"):
        df = formats.read_points(spark, str(tmp_path / name), ["id", "x", "y"], ["quality", "z"])
        assert df.columns == ["id", "x", "y", "quality"] and sorted(r.id for r in df.collect()) == ["a", "d"]
    with pytest.raises(ValueError):
        formats.read_points(spark, str(tmp_path / "c.csv"), ["gene"])


def test_geojson_and_wkt(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"classification": {"name": "S1"}}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}},
        {"type": "Feature", "properties": {"assigned_structure": "S2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [[[9, 9], [10, 9], [10, 10]]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 1]}},
    ]
    (tmp_path / "r.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = formats.read_geojson(spark, str(tmp_path / "r.geojson"), "classification.name", 0.5)
    area = {(r.region, r.part): r.a for r in df.select("region", "part", F.abs(regions.signed_area(F.col("rings")[0])).alias("a")).collect()}
    assert area == {("S1", 0): 4.0, ("S2", 0): 4.0, ("S2", 1): 0.125}
    formats.write_features(df, ["region"], str(tmp_path / "out"))
    again = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["properties"]["region"] for x in again) == ["S1", "S2", "S2"] and all(x["geometry"]["coordinates"][0][0] == x["geometry"]["coordinates"][0][-1] for x in again)
    assert formats.vertices(df, "region").count() == 11
    (tmp_path / "c.csv").write_text('contour_id,group_label,geometry\n1, A ,"POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))"\n2,B,"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"\n3,C,nothing\n')
    rows = {(r.contour_id, r.region, r.part): [len(x) for x in r.rings] for r in formats.read_contours(spark, str(tmp_path / "c.csv")).collect()}
    assert rows == {("1", "A", 0): [4, 3], ("2", "B", 0): [3], ("2", "B", 1): [3]}


def test_matrix_and_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("l,a,b\na,0,2\nb,2,0\n")
    assert {(r.a, r.b): r.distance for r in formats.read_matrix(spark, str(tmp_path / "m.csv")).collect()} == {("a", "a"): 0, ("a", "b"): 2, ("b", "a"): 2, ("b", "b"): 0}
    (tmp_path / "bad.csv").write_text("l,a,b\na,0,2\nb,3,0\n")
    with pytest.raises(ValueError):
        formats.read_matrix(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "s.csv").write_text("order,sample,z,aligned_geojson\n1,s1,0,a\n2,s2,5,b\n")
    assert formats.read_manifest(spark, str(tmp_path / "s.csv")).count() == 2
    assert formats.slice_order(["run_10", "run_2", "b_2"]) == [(1, "b_2"), (2, "run_2"), (3, "run_10")]


def test_well_known_binary(spark, tmp_path):
    import struct

    rng = random.Random(1)
    rings = [[(rng.uniform(-1e6, 1e6), rng.choice([0.0, -0.0, 1e-310, 0.1, -3.5, 1e300])) for _ in range(5)] for _ in range(2)]
    closed = [[*r, r[0]] for r in rings]
    raw = struct.pack("<BII", 1, 3, 2) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in closed)
    (tmp_path / "w.csv").write_text(f"contour_id,group_label,geometry\n1,A,{raw.hex()}\n2,B,00ff\n")
    rows = formats.read_contours(spark, str(tmp_path / "w.csv")).collect()
    assert [r.contour_id for r in rows] == ["1"] and [[(p.x, p.y) for p in r] for r in rows[0].rings] == rings


def test_folders_bundles_and_sinks(spark, tmp_path):
    for name in ("run_10", "run_2"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "experiment.marker").write_text("{}")
    (tmp_path / "in" / "other").mkdir()
    found = formats.discover(spark, str(tmp_path / "in"), "experiment.marker").orderBy("order").collect()
    assert [(r.order, r.name) for r in found] == [(1, "run_2"), (2, "run_10")] and found[0].path.endswith("in/run_2")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    formats.write_table(df, str(tmp_path / "t.tsv"))
    formats.write_table(df, str(tmp_path / "t"))
    (tmp_path / "j.json").write_text('{"k": [1, 2]}')
    got = formats.read_bundle(spark, str(tmp_path), {"one": "t.tsv", "two": "t", "three": "j.json"})
    assert sorted(map(tuple, got["one"].collect())) == sorted(map(tuple, got["two"].collect())) == [(1, "a"), (2, "b")] and got["three"].first().k == [1, 2]
    bins = spark.range(600).select((F.col("id") % 600).cast("int").alias("ix"), (F.col("id") % 7).cast("int").alias("iy"), F.lit(1).alias("label"))
    formats.write_raster(bins, str(tmp_path / "raster"))
    back = spark.read.parquet(str(tmp_path / "raster"))
    assert back.count() == 600 and back.where("tile_x = 2").agg(F.min("ix")).first()[0] == 512
    ring = spark.createDataFrame([("s", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)]])], "key string, rings array<array<struct<x:double,y:double>>>")
    assert formats.selection_summary(ring, "key").first()[1:] == (2, 6)


def test_provenance():
    assert formats.provenance({"b": 1.00000000000001, "a": [1]}) == formats.provenance({"a": (1,), "b": 1.0})


def test_stream_equals_batch(spark, sf):
    got = {(r.gene, r.start): r.n for r in run_windows(spark, f"{sf}/events.parquet*").collect()}
    table = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).count()
    assert got == {(r.event_type, r.h): r["count"] for r in table.collect()}


def test_discover_keeps_folders_of_one_name(spark, tmp_path):
    for name in ("r1/s2", "r2/s2", "r1/s10", "plain"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "cells.parquet").write_text("x")
    rows = formats.discover(spark, str(tmp_path), "cells.parquet").collect()
    assert [(r.order, r.name) for r in rows] == [(1, "plain"), (2, "s2"), (3, "s2"), (4, "s10")] and len({r.path for r in rows}) == 4


def test_write_slices_prunes_by_folder(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(9)], "i int, sample_id string")
    formats.write_slices(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("i", "sample_id").collect())) == sorted(map(tuple, df.collect()))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["sample_id=s0", "sample_id=s1", "sample_id=s2"]


def test_streams_close_windows_and_drop_late_rows(spark, tmp_path):
    """Files come one by one: what is closed stays as it was, a row later than the watermark is dropped, an id counts once."""
    from datetime import datetime, timedelta

    from lamina.streaming import windows

    day = datetime(2024, 1, 1)
    files = [[(1, 0, 7, 1.0), (2, 5, 7, 1.0), (2, 6, 7, 1.0)], [(3, 200, 7, 1.0), (4, 201, 8, 1.0)], [(8, 202, 8, 1.0)], [(5, 10, 7, 9.0), (6, 210, 7, 1.0)], [(7, 500, 7, 1.0)]]
    for k, rows in enumerate(files):
        spark.createDataFrame([(i, day + timedelta(minutes=m), u, "g", v) for i, m, u, v in rows], windows.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for f in (tmp_path / f"in/{k}").glob("part-*"):
            f.rename(tmp_path / f"in/{k}.parquet")
            import os

            os.utime(tmp_path / f"in/{k}.parquet", (1_700_000_000 + k * 60,) * 2)
    path = str(tmp_path / "in/*.parquet")
    minutes = lambda t: int((t - day).total_seconds() // 60)
    got = sorted((minutes(r.start), r.n, r.total) for r in windows.run_windows(spark, path, files=1).collect())
    assert got == [(0, 3, 3.0), (180, 4, 4.0), (480, 1, 1.0)]  # the row at minute 10 came after its hour was closed
    got = sorted((r.cell, minutes(r.start), minutes(r.end), r.n) for r in windows.run_sessions(spark, path, files=1).collect())
    assert got == [(7, 0, 35, 2), (7, 200, 240, 2), (7, 500, 530, 1), (8, 201, 232, 2)]
