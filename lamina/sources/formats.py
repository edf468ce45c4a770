"""Readers and writers of the formats that tissue data comes in. Paths go to Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names by which a table's fields are known, in order of preference.
CANDIDATES = {
    "id": ("barcode", "cell_id", "id", "cell", "name"),
    "x": ("x", "x_centroid", "x_location", "x_um"),
    "y": ("y", "y_centroid", "y_location", "y_um"),
    "z": ("z", "z_location", "z_um"),
    "gene": ("gene", "feature_name", "feature", "target"),
    "quality": ("qv", "quality", "score"),
    "cluster": ("cluster", "Cluster", "label"),
}
SEPARATORS = {".csv": ",", ".csv.gz": ",", ".tsv": "\t", ".tsv.gz": "\t", ".txt": "\t"}


def resolve(df: DataFrame, fields: list[str], optional: list[str] = ()) -> DataFrame:
    """``df`` with its columns under their field names (P13); case is ignored. Raises ValueError for a field that is missing or given twice."""
    by = {c.lower(): c for c in df.columns}
    out = []
    for f in [*fields, *optional]:
        found = [by[n.lower()] for n in CANDIDATES.get(f, (f,)) if n.lower() in by]
        if not found and f in fields:
            raise ValueError(f"no column for {f!r} among {df.columns}")
        if found:
            out.append(F.col(f"`{found[0]}`").alias(f))
    return df.select(*out)


def read_points(spark: SparkSession, path: str, fields: list[str], optional: list[str] = ()) -> DataFrame:
    """Cells or molecules from Parquet or delimited text, by suffix (S1-S3), with finite coordinates only (P5)."""
    sep = next((s for end, s in sorted(SEPARATORS.items(), key=lambda kv: -len(kv[0])) if path.lower().endswith(end)), None)
    df = resolve(spark.read.csv(path, sep=sep, header=True) if sep else spark.read.parquet(path), fields, list(optional))
    for c in ("x", "y", "z", "quality"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).try_cast("double"))
    for c in ("x", "y", "z"):
        if c in df.columns:
            df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    return df


def molecules(df: DataFrame, genes: list[str], least_quality: float) -> DataFrame:
    """Molecules of some genes at or over a quality, in a cell (P4, S2). The filter reaches the scan."""
    out = df.where(F.col("gene").isin(*genes) & (F.col("quality") >= least_quality))
    return out.where(F.col("id") != "UNASSIGNED") if "id" in df.columns else out


def _ring(points: Column) -> Column:
    """Ring of [x, y] arrays as structs, without a repeated last vertex."""
    r = F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.when(F.element_at(r, 1) == F.element_at(r, -1), F.slice(r, 1, F.size(r) - 1)).otherwise(r)


_NUMBERS = "array<array<array<double>>>"


def _polygons(kind: Column, coordinates: Column) -> Column:
    """array<polygon>, a polygon being an array of rings, from GeoJSON coordinates."""
    one, many = F.array(F.from_json(coordinates, _NUMBERS)), F.from_json(coordinates, f"array<{_NUMBERS}>")
    return F.transform(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many), lambda p: F.transform(p, _ring))


def read_geojson(spark: SparkSession, path: str, group: str, scale: float = 1.0) -> DataFrame:
    """(feature, part, region, rings) of the polygons of a feature collection (S6); ``group`` is a dotted path into the properties.

    Empty geometries and other kinds are dropped; coordinates are multiplied by ``scale`` (P12).
    """
    schema = "features array<struct<id:string,properties:string,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("feature", "f"))
    region = F.coalesce(F.get_json_object("f.properties", f"$.{group}"), F.get_json_object("f.properties", f"$.{group}.name"), F.get_json_object("f.properties", "$.assigned_structure"))
    parts = f.select("feature", region.alias("region"), F.posexplode(_polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))).alias("part", "rings"))
    scaled = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] * scale).alias("x"), (p["y"] * scale).alias("y"))))
    return parts.select("feature", "part", "region", scaled.alias("rings")).where((F.size("rings") > 0) & (F.size(F.col("rings")[0]) >= 3))


def wkt_polygons(text: Column) -> Column:
    """array<polygon> from WKT ``POLYGON`` or ``MULTIPOLYGON`` (S7), null for anything else."""
    body = F.regexp_replace(F.upper(F.trim(text)), r"^(MULTI)?POLYGON\s*Z?\s*", "")
    js = F.regexp_replace(body, r"(-?[0-9.]+(?:E[-+]?\d+)?)\s+(-?[0-9.]+(?:E[-+]?\d+)?)", "[$1,$2]")
    js = F.translate(js, "()", "[]")
    kind = F.when(F.upper(F.trim(text)).startswith("MULTIPOLYGON"), "MultiPolygon").when(F.upper(F.trim(text)).startswith("POLYGON"), "Polygon")
    return _polygons(kind, js)


def read_contours(spark: SparkSession, path: str) -> DataFrame:
    """(contour_id, region, part, rings) from a CSV whose ``geometry`` is WKT, GeoJSON or hexadecimal WKB."""
    df = spark.read.csv(path, header=True, escape='"')
    parsed = F.coalesce(wkt_polygons(F.col("geometry")), _polygons(F.get_json_object("geometry", "$.type"), F.get_json_object("geometry", "$.coordinates")), wkb_polygons(F.col("geometry")))
    return df.select("contour_id", F.trim("group_label").alias("region"), F.posexplode(parsed).alias("part", "rings"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, distance) of a square CSV of labels (S11). Raises ValueError unless it has the same labels on both sides and is symmetric."""
    wide = spark.read.csv(path, header=True)
    first, *labels = wide.columns
    long = wide.unpivot(first, labels, "b", "distance").select(F.trim(F.col(first)).alias("a"), F.trim("b").alias("b"), F.col("distance").try_cast("double").alias("distance"))
    other = long.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("distance").alias("back"))
    bad = long.join(other, ["a", "b"], "full").agg(F.count_if(F.col("distance").isNull() | F.col("back").isNull()).alias("holes"), F.max(F.abs(F.col("distance") - F.col("back"))).alias("skew")).first()
    if bad.holes or (bad.skew or 0) > 1e-6:
        raise ValueError(f"matrix has {bad.holes} unmatched entries and differs from its transpose by {bad.skew}")
    return long


def wkb_polygons(text: Column) -> Column:
    """array<polygon> from the hexadecimal text of a little-endian WKB polygon without heights (S7), null for anything else.

    Numbers are read from the bytes by casts alone, ring after ring.
    """
    t = F.upper(F.trim(text))
    count = lambda at: _int(t.substr(at, F.lit(8)))

    def ring(acc: Column, _: Column) -> Column:
        n = count(acc["at"])
        point = lambda i: F.struct(_double(t.substr(acc["at"] + 8 + i * 32, F.lit(16))).alias("x"), _double(t.substr(acc["at"] + 24 + i * 32, F.lit(16))).alias("y"))
        points = F.transform(F.sequence(F.lit(0), n - 1), point)
        closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), F.slice(points, 1, n - 1)).otherwise(points)
        return F.struct((acc["at"] + 8 + n * 32).cast("int").alias("at"), F.array_append(acc["rings"], closed).alias("rings"))

    start = F.struct(F.lit(19).alias("at"), F.expr("cast(array() as array<array<struct<x:double,y:double>>>)").alias("rings"))
    rings = F.aggregate(F.sequence(F.lit(1), count(F.lit(11))), start, ring, lambda acc: acc["rings"])
    return F.when(t.startswith("0103000000"), F.array(rings))


def _int(hex_: Column) -> Column:
    """A little-endian unsigned 32-bit number from eight hexadecimal digits."""
    return sum(F.conv(F.substring(hex_, 2 * i + 1, 2), 16, 10).cast("int") * (1 << (8 * i)) for i in range(4))


def _double(hex_: Column) -> Column:
    """A little-endian double from sixteen hexadecimal digits: its sign, exponent and fraction."""
    byte = lambda i: F.conv(F.substring(hex_, 2 * i + 1, 2), 16, 10).cast("bigint")
    top, next_ = byte(7), byte(6)
    exponent = (top % 128) * 16 + F.floor(next_ / 16)
    fraction = (next_ % 16).cast("double") * float(1 << 48) + sum(byte(i).cast("double") * float(1 << (8 * i)) for i in range(6))
    sign = F.when(top >= 128, -1.0).otherwise(1.0)
    return sign * F.when(exponent == 0, fraction * 2.0**-1074).otherwise((1 + fraction / float(1 << 52)) * F.pow(F.lit(2.0), exponent - 1023))


def discover(spark: SparkSession, root: str, marker: str) -> DataFrame:
    """(order, name, path) of the folders under ``root`` that hold a file named ``marker``, in the order of :func:`slice_order`, those of one name by path.

    Files are listed by Spark's reader, so any store will do; only names are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", marker).load(root).select("path").distinct()
    folders = sorted(r.path.rsplit("/", 1)[0] for r in found.collect())  # as many as slices
    rows = sorted((last_number(n := f.rsplit("/", 1)[-1]), n, f) for f in folders)
    return spark.createDataFrame([(i, n, f) for i, (_, n, f) in enumerate(rows, 1)], "order int, name string, path string")


def read_bundle(spark: SparkSession, root: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of an artifact folder by name, each read by the suffix of its file: Parquet, CSV or TSV, JSON."""
    out = {}
    for name, file in tables.items():
        path, low = f"{root.rstrip('/')}/{file}", file.lower()
        sep = next((s for end, s in sorted(SEPARATORS.items(), key=lambda kv: -len(kv[0])) if low.endswith(end)), None)
        out[name] = spark.read.csv(path, sep=sep, header=True, inferSchema=True) if sep else spark.read.json(path, multiLine=True) if low.endswith(".json") else spark.read.parquet(path)
    return out


def write_table(df: DataFrame, path: str) -> None:
    """A table as Parquet, or as CSV or TSV with a header where the path says so; every task writes its own rows (K1)."""
    sep = next((s for end, s in SEPARATORS.items() if path.lower().endswith(end)), None)
    if sep:
        df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_raster(bins: DataFrame, path: str, tile: int = 256) -> None:
    """A raster (ix, iy and its values) as Parquet by square tiles, so that a window of it reads its tiles alone (K5)."""
    tiled = bins.withColumns({"tile_x": F.floor(F.col("ix") / tile).cast("int"), "tile_y": F.floor(F.col("iy") / tile).cast("int")})
    tiled.repartition("tile_x", "tile_y").write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(path)


def selection_summary(regions: DataFrame, key: str) -> DataFrame:
    """(key, n_rings, n_vertices) beside a table of :func:`vertices` (K4)."""
    v = vertices(regions, key)
    return v.groupBy(key).agg(F.countDistinct("ring").alias("n_rings"), F.count("*").alias("n_vertices"))


def last_number(name: str) -> int:
    """The last whole number in a name, -1 without one."""
    return int((re.findall(r"\d+", name) or ["-1"])[-1])


def slice_order(names: list[str]) -> list[tuple[int, str]]:
    """Folder names numbered from 1 by the last whole number in each, then by name."""
    return list(enumerate(sorted(names, key=lambda n: (last_number(n), n)), 1))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(order, sample_id, z_um, geojson) of a slice stack (S9). Raises ValueError for repeated orders or samples."""
    df = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in df.columns}
    pick = lambda *options: F.col(next(names[o] for o in options if o in names))
    out = df.select(pick("order", "slice_order").try_cast("int").alias("order"), F.trim(pick("sample_id", "sample")).alias("sample_id"), pick("z_um", "z").try_cast("double").alias("z_um"), pick("geojson", "aligned_geojson").alias("geojson"))
    n = out.agg(F.count("*").alias("n"), F.countDistinct("order").alias("o"), F.countDistinct("sample_id").alias("s")).first()
    if n.n != n.o or n.n != n.s:
        raise ValueError("orders and samples of a manifest are unique and present")
    return out


def feature(properties: list[str], rings: str = "rings") -> Column:
    """One GeoJSON feature as text (K3); rings are closed again."""
    closed = F.transform(rings, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def write_features(df: DataFrame, properties: list[str], path: str) -> None:
    """One feature a line, written by every task for its own rows, so the output may be of any size (K3)."""
    df.select(feature(properties)).write.mode("overwrite").text(path)


def vertices(df: DataFrame, key: str) -> DataFrame:
    """(key, ring, vertex, x, y): one row for each vertex (K4)."""
    rings = df.select(key, F.posexplode("rings").alias("ring", "r"))
    return rings.select(key, "ring", F.posexplode("r").alias("vertex", "p")).select(key, "ring", "vertex", "p.x", "p.y")


def write_slices(df: DataFrame, path: str, column: str = "sample_id") -> None:
    """Parquet with a folder for each slice, which later scans prune by (K2)."""
    df.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)


def canonical_json(value) -> str:
    """JSON with sorted keys, no blanks and numbers of 12 significant digits (K8)."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return float(f"{v:.12g}") if isinstance(v, float) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"))


def provenance(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


