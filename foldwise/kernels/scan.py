"""Running sums over an order, without putting a whole group into one task.

The order is cut into slices of about equal row counts. Each slice is scanned on its own and then shifted by the
total of the slices before it, which comes from a tiny aggregate. Slice borders are plain literals, so both
passes agree on them whatever is recomputed.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.kernels.store import materialize

SLICE = "_slice"


def slice_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def split_points(df: DataFrame, lead: Column, parts: int) -> list[float]:
    """At most ``parts - 1`` increasing values that cut ``lead`` into ranges of about equal row counts."""
    if parts <= 1:
        return []
    probabilities = [i / parts for i in range(1, parts)]
    found = df.select(lead.cast("double").alias("v")).approxQuantile("v", probabilities, 0.1 / parts)
    return sorted({v for v in found if v is not None and math.isfinite(v)})


def add_slices(df: DataFrame, lead: Column, splits: list[float], name: str = SLICE) -> DataFrame:
    """Number of split points at or below ``lead``; the mapping is monotone, so slices keep the order."""
    if not splits:
        return df.withColumn(name, F.lit(0))
    probe = "_lead"
    cut = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=probe, outputCol="_cut", handleInvalid="keep")
    marked = cut.transform(df.withColumn(probe, lead.cast("double")))
    return marked.withColumn(name, F.col("_cut").cast("int")).drop(probe, "_cut")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """NULL-safe equality over ``keys``."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join with NULL-safe keys that keeps one copy (the left one) of each key."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def sums_before(
    df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], slice_col: str = SLICE
) -> DataFrame:
    """Add, per output name, the sum of an expression over the rows strictly before, inside ``by``.

    ``df`` carries a slice column that is non-decreasing in ``order``. The sum of all earlier slices enters each slice
    as one extra first row, so the rows are shuffled once and never joined.
    """
    cell = [*by, slice_col]
    totals = df.groupBy(*cell).agg(*[F.sum(e).alias(f"_m_{n}") for n, e in sums.items()])
    earlier = W.partitionBy(*by).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    heads = totals.select(*cell, F.lit(0).alias("_kind"), *[F.sum(f"_m_{n}").over(earlier).alias(f"_m_{n}") for n in sums])
    rows = df.select("*", F.lit(1).alias("_kind"), *[e.alias(f"_m_{n}") for n, e in sums.items()])
    within = W.partitionBy(*cell).orderBy("_kind", *order).rowsBetween(W.unboundedPreceding, -1)
    scanned = rows.unionByName(heads, allowMissingColumns=True).select(
        *df.columns, "_kind", *[F.coalesce(F.sum(f"_m_{n}").over(within), F.lit(0)).alias(n) for n in sums]
    )
    return scanned.filter(F.col("_kind") == 1).drop("_kind")


TEXT_SAMPLE_PER_SLICE = 32


def add_text_slices(df: DataFrame, text: str, parts: int, name: str = SLICE) -> DataFrame:
    """Slices for a text order: borders come from a hash-ordered sample of a fixed number of values."""
    sample = df.select(text).filter(F.col(text).isNotNull()).orderBy(F.xxhash64(text)).limit(TEXT_SAMPLE_PER_SLICE * parts)
    values = sorted({r[0] for r in sample.collect()}, key=lambda v: v.encode())
    borders = sorted({values[len(values) * i // parts] for i in range(1, parts)}, key=lambda v: v.encode()) if values else []
    if not borders:
        return df.withColumn(name, F.lit(0))
    literals = F.array(*[F.lit(b) for b in borders])
    return df.withColumn(name, F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(literals, lambda b: b <= F.col(text)))))


SMALL_TABLE = 500_000


def value_scan(
    counts: DataFrame, by: list[str], value: str, sums: dict[str, Column], stored: bool = False
) -> DataFrame:
    """``sums_before`` over a table that holds each ``(by, value)`` once, ordered by ``value`` (number or text).

    The table is stored first unless it already is, because several passes read it. Its row count is then known from
    the file footers; up to ``SMALL_TABLE`` rows one plain window does the scan.
    """
    table = counts if stored else materialize(counts)
    if table.count() <= SMALL_TABLE:
        earlier = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return table.select("*", *[F.coalesce(F.sum(e).over(earlier), F.lit(0)).alias(n) for n, e in sums.items()])
    parts = slice_count(table)
    if table.schema[value].dataType.typeName() == "string":
        sliced = add_text_slices(table, value, parts)
    else:
        sliced = add_slices(table, F.col(value), split_points(table, F.col(value), parts))
    return sums_before(sliced, by, [value], sums).drop(SLICE)


HOT_ROWS = 2_000_000


def slice_hot_groups(
    df: DataFrame, by: list[str], lead: Column, limit: int | None = None, source: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """Give every row a slice number: 0 in ordinary groups, order-preserving slices in groups above ``limit`` rows.

    Returns the frame and whether any group was cut. ``source`` is a cheaper frame with the same keys and order.
    """
    limit = HOT_ROWS if limit is None else limit
    source = df if source is None else source
    hot = materialize(source.groupBy(*by).count().filter(F.col("count") > limit).select(*by, F.lit(1).alias("_hot")))
    if hot.isEmpty():
        return df.withColumn(SLICE, F.lit(0)), False
    flagged = join_on(df, hot, by)
    splits = split_points(join_on(source, hot, by, "left_semi"), lead, max(2, slice_count(df)))
    cut = add_slices(flagged, F.when(F.col("_hot") == 1, lead.cast("double")).otherwise(F.lit(-math.inf)), splits)
    return cut.drop("_hot"), True


def row_numbers(df: DataFrame, by: list[str], order: list[str], slice_col: str, name: str) -> DataFrame:
    """1-based position inside ``by``; ``slice_col`` must be non-decreasing in ``order``."""
    numbered = sums_before(df, by, order, {name: F.lit(1)}, slice_col)
    return numbered.withColumn(name, F.col(name) + 1)


def running_max(table: DataFrame, value: str, best: Column, name: str) -> DataFrame:
    """Add the largest ``best`` (a number or struct) over the rows up to and including this one, ordered by ``value``.

    ``table`` is stored and holds each value once. As in ``value_scan`` a large table is cut into slices: each takes the largest of the
    slices before it from a tiny table and is scanned alone.
    """
    upto = lambda window: window.rowsBetween(W.unboundedPreceding, W.currentRow)
    if table.count() <= SMALL_TABLE:
        return table.withColumn(name, F.max(best).over(upto(W.orderBy(value))))
    sliced = add_slices(table, F.col(value), split_points(table, F.col(value), slice_count(table))).withColumn("_own", best)
    tops = sliced.groupBy(SLICE).agg(F.max("_own").alias("_top"))
    earlier = tops.select(SLICE, F.max("_top").over(W.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"))
    joined = join_on(sliced, materialize(earlier), [SLICE])
    own = F.max("_own").over(upto(W.partitionBy(SLICE).orderBy(value)))
    return joined.withColumn(name, F.greatest(own, "_earlier")).drop("_own", "_earlier", SLICE)
