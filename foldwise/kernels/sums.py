"""Sums of small arrays over all rows of a table, one array per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Arrays that reach the driver at once; those of more tasks are added in so many groups on the executors first.
GROUPS = 64
#: Bytes of arrays that reach the driver at once: of large arrays fewer, one at least.
MOST_BYTES = 64 << 20
SCHEMA = "part int, data binary"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of equally long lists of doubles as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _row(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "data"])


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of ``df`` of a vector of ``size`` doubles, added in the order of the partitions."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
                seen = True
        if seen:
            yield _row(TaskContext.get().partitionId(), total)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(size), None
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = n if first is None else first
                total += np.frombuffer(data)
        if first is not None:
            yield _row(first, total)

    parts = df.mapInArrow(one, SCHEMA)
    groups = max(1, min(GROUPS, MOST_BYTES // (8 * max(size, 1))))
    if df.rdd.getNumPartitions() > groups:
        parts = parts.repartition(groups, F.col("part") % groups).sortWithinPartitions("part").mapInArrow(grouped, SCHEMA)
    total = np.zeros(size)
    for row in sorted(parts.collect(), key=lambda r: r["part"]):
        total += np.frombuffer(row["data"])
    return total
