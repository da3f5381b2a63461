"""Isotonic regression on pooled points, without all points in one place.

Pooling neighbours that are out of order gives the same fit in whatever order it is done. So the axis is cut into slices, every slice pools
its own points, and then the borders move to the middle of the slices, until nothing is out of order across a border.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from foldwise.kernels.scan import SLICE, add_slices, running_max, split_points
from foldwise.kernels.store import materialize

#: Points or blocks that one task pools.
BLOCKS_PER_SLICE = 100_000
BLOCK = "low double, high double, s double, w double"


def pool_neighbours(low: np.ndarray, high: np.ndarray, s: np.ndarray, w: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks with increasing mean ``s / w`` from blocks in the order of the axis."""
    kept: list[tuple[float, float, float, float]] = []
    for block in zip(low.tolist(), high.tolist(), s.tolist(), w.tolist()):
        while kept and kept[-1][2] * block[3] >= block[2] * kept[-1][3]:
            left = kept.pop()
            block = (left[0], block[1], left[2] + block[2], left[3] + block[3])
        kept.append(block)
    return kept


def pool_slice(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("low")
    kept = pool_neighbours(*[rows[c].to_numpy() for c in ("low", "high", "s", "w")])
    out = pd.DataFrame(kept, columns=["low", "high", "s", "w"])
    return out.assign(**{SLICE: key[0], "middle": (np.arange(len(kept)) == len(kept) // 2) & (len(kept) > 1)})


def isotonic_blocks(points: DataFrame, per_slice: int | None = None) -> DataFrame:
    """``(low, high, value)``: the increasing fit to points ``(x, s, w)`` that hold each ``x`` once, ``s`` the label sum and ``w`` the weight.

    A task pools about ``per_slice`` points; per slice three numbers reach the driver. A border where the order is violated lies inside
    a slice of the next round, so every round pools more. Calibrated scores need two or three rounds; scores whose
    order is wrong over the whole axis collapse to few blocks at once, a single far outlier at one end moves on about a slice a round.
    No points give no blocks.
    """
    per_slice = BLOCKS_PER_SLICE if per_slice is None else per_slice
    blocks = materialize(points.select(F.col("x").alias("low"), F.col("x").alias("high"), "s", "w"))
    cuts = split_points(blocks, F.col("low"), math.ceil(blocks.count() / per_slice))
    value = F.col("s") / F.col("w")
    while True:
        sliced = add_slices(blocks, F.col("low"), cuts)
        blocks = materialize(sliced.groupBy(SLICE).applyInPandas(pool_slice, f"{BLOCK}, {SLICE} int, middle boolean"))
        ends = blocks.groupBy(SLICE).agg(
            F.min_by(value, "low").alias("first"), F.max_by(value, "low").alias("last"),
            F.min(F.when(F.col("middle"), F.col("low"))).alias("cut"), F.count(F.lit(1)).alias("n"),
        ).collect() if cuts else []
        ends.sort(key=lambda r: r[SLICE])
        if all(a["last"] <= b["first"] for a, b in zip(ends, ends[1:])):
            return blocks.select("low", "high", value.alias("value"))
        cuts = [r["cut"] for r in ends if r["cut"] is not None] if sum(r["n"] for r in ends) > per_slice else []


def isotonic_values(xs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(x, value)`` for distinct ``x``: constant inside a block and outside of all, on a line between two blocks; NULL without blocks."""
    corners = blocks.select(F.explode(F.array("low", "high")).alias("x"), F.col("value").alias("corner"))
    whole = xs.select("x", F.lit(None).cast("double").alias("corner"), F.lit(1).alias("asked"))
    table = whole.unionByName(corners.withColumn("asked", F.lit(0))).groupBy("x").agg(F.max("corner").alias("corner"), F.max("asked").alias("asked"))
    table = materialize(table.withColumn("back", -F.col("x")))
    known = lambda place: F.when(F.col("corner").isNotNull(), F.struct(F.col(place).alias("at"), F.col("corner").alias("v")))
    below = materialize(running_max(table, "x", known("x"), "lower"))
    both = running_max(below, "back", known("back"), "upper").filter("asked = 1")
    gap = -F.col("upper.at") - F.col("lower.at")
    between = F.col("lower.v") + (F.col("upper.v") - F.col("lower.v")) * F.try_divide(F.col("x") - F.col("lower.at"), gap)
    inside = F.when(F.col("lower").isNotNull() & F.col("upper").isNotNull() & (gap > 0), between)
    return both.select("x", F.coalesce(inside, "lower.v", "upper.v").alias("value"))
