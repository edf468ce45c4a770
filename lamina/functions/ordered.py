"""Sums of doubles in the order of a table's rows, as SQL adds them in one thread: the same bits for any partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Columns of a row's file and of its place there.
PLACE = ("_file", "_row")


def placed(df: DataFrame) -> DataFrame:
    """A Parquet scan with the columns ``PLACE``."""
    file = F.col("_metadata.file_path") if len(df.inputFiles()) > 1 else F.lit("")
    return df.withColumns({PLACE[0]: file, PLACE[1]: F.col("_metadata.row_index")})


def aggregate(df: DataFrame, keys: list[str], *others: Column, sums: dict[str, Column] | None = None, means: dict[str, Column] | None = None) -> DataFrame:
    """``df`` by ``keys`` with ``others``, and with ``sums`` and ``means`` of doubles added in the order of ``PLACE``; nulls are left out.

    Rows are dealt by their keys and sorted, and a task adds them as they come, so it holds a batch and the sums of one group.
    """
    wanted = {**(sums or {}), **(means or {})}
    rows = df.select(*keys, *PLACE, *[c.cast("double").alias(n) for n, c in wanted.items()])
    schema = StructType([rows.schema[k] for k in keys] + [StructField(f"_s_{n}", DoubleType()) for n in wanted])

    names, fields = list(wanted), schema.fieldNames()

    def batch(own: pa.Table, total: np.ndarray) -> pa.RecordBatch:
        columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in own.columns]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(total[:, i]) for i in range(len(names))]], names=fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, added = None, np.zeros(len(names))
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            starts = np.concatenate([[True], np.zeros(b.num_rows - 1, dtype=bool)])
            for k in keys:
                c = b.column(k)
                before, after = c.slice(0, len(c) - 1), c.slice(1)
                other = pc.coalesce(pc.not_equal(before, after), pc.xor(before.is_null(), after.is_null()))
                starts[1:] |= other.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(starts)
            code = np.cumsum(starts) - 1
            head = t.select(keys).take(pa.array(first))
            goes_on = held is not None and held.equals(head.slice(0, 1))
            if held is not None and not goes_on:
                yield batch(held, added[None, :])
            total = np.empty((len(first), len(names)))
            for i, n in enumerate(names):
                v = t.column(n).fill_null(0.0).to_numpy()
                if goes_on:
                    total[:, i] = np.bincount(np.concatenate([[0], code]), np.concatenate([[added[i]], v]))
                else:
                    total[:, i] = np.bincount(code, v)
            if len(first) > 1:
                yield batch(head.slice(0, len(first) - 1), total[:-1])
            held, added = head.slice(len(first) - 1, 1), total[-1].copy()
        if held is not None:
            yield batch(held, added[None, :])

    added = rows.repartition(*keys).sortWithinPartitions(*keys, *PLACE).mapInArrow(fold, schema).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    rest = df.groupBy(*keys).agg(*others, *[F.count(c).alias(f"_n_{n}") for n, c in wanted.items()])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    out = rest.join(added.hint("merge"), on)
    some = lambda n, c: F.when(F.col(f"_n_{n}") > 0, c)
    out = out.withColumns({n: some(n, F.col(f"_s_{n}") / F.col(f"_n_{n}")) if n in (means or {}) else some(n, F.col(f"_s_{n}")) for n in wanted})
    return out.drop(*[f"_r_{k}" for k in keys], *[f"_{a}_{n}" for n in wanted for a in "sn"])
