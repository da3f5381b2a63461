"""Predictions and a 0/1 label packed into blocks of rows, for searches that read the same columns many times.

A block is one row of a stored table: per column its distinct values and a two-byte code per row. A pass moves a few bytes per row
and evaluates a function of a column once per distinct value of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldwise.kernels.store import materialize

#: Rows of a block; codes have two bytes.
BLOCK_ROWS = 1 << 16
SCHEMA = "y binary, sizes binary, distinct binary, codes binary"


def _block(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    found = [np.unique(column, return_inverse=True) for column in x.T]
    sizes = np.array([len(v) for v, _ in found], np.int64)
    parts = [y.astype(np.uint8), sizes, np.concatenate([v for v, _ in found]), np.concatenate([c.astype(np.uint16) for _, c in found])]
    return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], ["y", "sizes", "distinct", "codes"])


def packed(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """The rows whose label is 0 or 1 as stored blocks; a NULL prediction is NaN there."""
    rows = df.filter(F.col(y).isin(0, 1)).select(*[F.col(c).cast("double") for c in columns], F.col(y).cast("int").alias("_label"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
            size += batch.num_rows
            while size >= BLOCK_ROWS:
                table = np.concatenate(held)
                yield _block(table[:BLOCK_ROWS, :-1], table[:BLOCK_ROWS, -1])
                held, size = [table[BLOCK_ROWS:]], size - BLOCK_ROWS
        if size:
            table = np.concatenate(held)
            yield _block(table[:, :-1], table[:, -1])

    return materialize(rows.mapInArrow(pack, SCHEMA))


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """``(label, distinct values of every column, codes of every column)`` of each block."""
    for row in zip(*[(v.as_buffer() for v in column) for column in batch.columns]):
        y, sizes, distinct, codes = (np.frombuffer(b, t) for b, t in zip(row, (np.uint8, np.int64, float, np.uint16)))
        yield y, np.split(distinct, np.cumsum(sizes)[:-1]), list(codes.reshape(len(sizes), -1).astype(np.intp))


def cell_counts(score: np.ndarray, y: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    """Rows per (cell of the range, label), laid out flat; NaN scores do not count."""
    scale = bins / (high - low) if high > low else 0.0
    cell = score - low
    cell *= scale
    if np.isnan(cell.sum()):
        known = ~np.isnan(cell)
        cell, y = cell[known], y[known]
    place = np.clip(cell, 0, bins, out=cell).astype(np.intp)
    place *= 2
    place += y
    return np.bincount(place, minlength=(bins + 1) * 2)
