"""Logical tissue tables bound to the driver's tables. Scans select what they need, so column pruning reaches Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import PLACE, placed


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a tissue: cell_id, x, y, cluster, slice, owner."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell_id"), (F.col("o_totalprice") / 100).alias("x"), day.cast("double").alias("y"),
        F.col("o_orderpriority").alias("cluster"), F.col("o_orderstatus").alias("slice"), F.col("o_custkey").alias("owner"),
    )


def spots(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """Dense measurements without a unique id: x, y, cluster, sample; with their place in the table if asked."""
    rows = read(spark, sf_dir, "lineitem")
    return (placed(rows) if place else rows).select(
        (F.col("l_extendedprice") / 100).alias("x"), F.col("l_quantity").alias("y"), F.concat("l_returnflag", "l_linestatus").alias("cluster"),
        F.col("l_linenumber").alias("sample"), F.col("l_discount").alias("weight"), F.col("l_suppkey").alias("region"), *(PLACE if place else ()),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a unique id: vec_id, x, y, z, cluster."""
    at = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")]
    return read(spark, sf_dir, "embeddings").select("vec_id", *at, F.col("label").cast("string").alias("cluster"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules: event_id, cell, gene, qv, k (from their properties), minute."""
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("cell"), F.col("event_type").alias("gene"), F.col("value").alias("qv"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.date_trunc("minute", "ts").alias("minute"),
    )


#: The same bindings in SQL.
SQL = {
    "cells": "(SELECT o_orderkey AS cell_id, o_totalprice / 100 AS x, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y, o_orderpriority AS cluster, o_orderstatus AS slice, o_custkey AS owner FROM orders)",
    "spots": "(SELECT l_extendedprice / 100 AS x, l_quantity AS y, l_returnflag || l_linestatus AS cluster, l_linenumber AS sample, l_discount AS weight, l_suppkey AS region FROM lineitem)",
    "points": "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS VARCHAR) AS cluster FROM embeddings)",
    "transcripts": "(SELECT event_id, user_id AS cell, event_type AS gene, value AS qv, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, date_trunc('minute', ts) AS minute FROM events)",
}
