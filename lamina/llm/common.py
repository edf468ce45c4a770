"""Helpers shared by the corpus operators: scratch tables, Arrow batches, worker-side word splitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize, scratch_dir

__all__ = ["SPACES", "batch_of", "hot_lookup", "materialize", "read_table", "row_hash", "scratch_dir", "shuffle_partitions", "slices", "texts_of", "unused"]

#: The six bytes that end a word in every operator here: space and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(batch: pa.RecordBatch, max_bytes: int, column: str = "text"):
    """Parts of a batch holding about ``max_bytes`` of text each (one row at least), so that numpy work stays bounded."""
    if not batch.num_rows:
        return
    lengths = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)).astype(np.int64)
    part = np.cumsum(lengths) // max_bytes
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
    for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(s, e - s)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns. Maps have no order of their own and variants no hash, so columns that hold some are hashed as JSON, maps by their sorted keys."""

    def plain(kind: T.DataType) -> bool:
        inner = kind.fields if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
        return not isinstance(kind, T.MapType | T.VariantType) and all(plain(getattr(k, "dataType", k)) for k in inner)

    def hashed(f: T.StructField) -> Column:
        c = F.col(f"`{f.name.replace('`', '``')}`")
        if plain(f.dataType):
            return c
        return F.to_json(F.struct(F.array_sort(F.map_entries(c)).alias("v") if isinstance(f.dataType, T.MapType) and plain(f.dataType.valueType) else c.alias("v")))

    return F.xxhash64(*[hashed(f) for f in df.schema])


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with marks added until no column of ``frames`` is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key that more rows hold than this share of all is hot; so there are fewer hot keys than this number.
HOT_SHARE = 1000


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` left-joined to ``table`` (unique ``key``), whose column ``count`` says how many rows hold the key; it is dropped.

    Rows of a hot key are dealt over as many tasks as a shuffle has, by their other columns, and its table row is
    repeated for each. Only the keys themselves, under a thousand, are broadcast.
    """
    salts = shuffle_partitions(rows.sparkSession)
    total = table.agg(F.sum(count)).first()[0] or 0
    least = max(total // HOT_SHARE, 10_000)
    hot = table.where(F.col(count) > least).select(key)
    salt, mark = unused("_salt", rows, table), unused("_hot", rows, table)
    if hot.isEmpty():
        return rows.join(table.drop(count), key, "left")
    marked = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), key, "left")
    dealt = F.when(F.col(mark), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col(count) > least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn(salt, dealt).drop(mark).join(table.withColumn(salt, F.explode(every)).drop(count), [key, salt], "left").drop(salt)
