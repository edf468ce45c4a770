"""Structured Streaming over a folder of molecules: event-time windows and sessions, closed by a watermark.

The stream appends a window or session once the watermark has passed it and forgets it then, so its state holds what is
still open, and rows later than that are dropped. What is open when the stream has caught up is counted from the rows
that no closed window holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_dir

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def windowed(events: DataFrame, window: str) -> DataFrame:
    """(gene, start, end, n, total) of a watermarked stream or a table of events."""
    w = F.window("ts", window)
    rows = events.groupBy(F.col("event_type").alias("gene"), w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("gene", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(cell, start, end, n, total) of runs of a cell's events with less than ``gap`` between two; ``end`` is ``gap`` after the last."""
    w = F.session_window("ts", gap)
    rows = events.groupBy(F.col("user_id").alias("cell"), w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("cell", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def once(events: DataFrame) -> DataFrame:
    """Each event once. A watermarked stream knows an id for as long as it waits for late rows, and forgets it after that."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def caught_up(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], late: str, key: str, source_key: str | None, schema: T.StructType = EVENTS, files: int | None = None) -> DataFrame:
    """What ``shape`` makes of all events the folder holds now: closed by the stream, which waits ``late`` for rows, and the open rest.

    Windows of all keys close together, so the rest starts at the last end; where ``source_key`` names the events' column
    of a key, each key's own rest does. ``files`` is how many files a micro-batch takes at most.
    """
    out = scratch_dir(spark)
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    query = shape(stream.withWatermark("ts", late)).writeStream.outputMode("append").format("parquet").option("path", f"{out}/closed").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    events = spark.read.schema(schema).parquet(path)
    closed = spark.read.schema(shape(events).schema).parquet(f"{out}/closed")
    if source_key is None:
        last = closed.agg(F.max("end").alias("_until"))  # one row
        rest = events.crossJoin(F.broadcast(last))
    else:
        rest = events.join(closed.groupBy(F.col(key).alias(source_key)).agg(F.max("end").alias("_until")), source_key, "left")
    return closed.unionByName(shape(rest.where(F.col("_until").isNull() | (F.col("ts") >= F.col("_until"))).drop("_until")))


def run_windows(spark: SparkSession, path: str, window: str = "1 hour", late: str = "10 minutes", schema: T.StructType = EVENTS, files: int | None = None) -> DataFrame:
    """(gene, start, n, total) over everything the folder holds now."""
    return caught_up(spark, path, lambda e: windowed(e, window), late, "gene", None, schema, files).drop("end")


def run_sessions(spark: SparkSession, path: str, gap: str = "30 minutes", late: str = "10 minutes", schema: T.StructType = EVENTS, files: int | None = None) -> DataFrame:
    """(cell, start, end, n, total) over everything the folder holds now, each event counted once."""
    return caught_up(spark, path, lambda e: sessions(once(e), gap), late, "cell", "user_id", schema, files)
