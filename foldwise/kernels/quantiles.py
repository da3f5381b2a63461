"""Exact linear-interpolated quantiles as a distributed job.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here the values are counted,
ranked by a sliced scan, and only the two rows around each wanted rank survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldwise.kernels.scan import join_on, value_scan
from foldwise.kernels.store import materialize


def quantile_name(column: str, q: float) -> str:
    return f"{column}_q{round(q * 10000):05d}"


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float], by: list[str] | None = None) -> DataFrame:
    """One row per group of ``by`` with a double column ``quantile_name(c, q)`` for each pair."""
    by = by or []
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        by, columns, "_column", "_value"
    )
    counts = materialize(
        long.filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
        .groupBy(*by, "_column", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    keys = [*by, "_column"]
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    ranked = join_on(value_scan(counts, keys, "_value", {"_before": F.col("_n")}, stored=True), sizes, keys)
    wanted = F.array(*[F.lit(float(q)) for q in sorted(set(qs))])
    position = lambda q: q * (F.col("_size") - 1)
    covers = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    touched = F.filter(wanted, lambda q: covers(F.floor(position(q))) | covers(F.ceil(position(q))))
    hits = ranked.withColumn("_q", F.explode(touched)).withColumn("_at", position(F.col("_q")))
    ends = hits.groupBy(*keys, "_q", "_at").agg(
        F.max(F.when(covers(F.floor("_at")), F.col("_value"))).alias("_lo"),
        F.max(F.when(covers(F.ceil("_at")), F.col("_value"))).alias("_hi"),
    )
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))
    entry = F.struct(F.concat_ws("|", "_column", F.col("_q").cast("string")), value)
    table = ends.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_map"))
    pick = lambda c, q: F.try_element_at("_map", F.concat_ws("|", F.lit(c), F.lit(float(q)).cast("string")))
    return table.select(*by, *[pick(c, q).alias(quantile_name(c, q)) for c in columns for q in sorted(set(qs))])


def quantile_values(df: DataFrame, column: str, qs: list[float]) -> list[float]:
    """The quantiles of one column as Python numbers: ``len(qs)`` values, whatever the table size."""
    row = exact_quantiles(df, [column], qs).first()
    if row is None:
        return []
    return [row[quantile_name(column, q)] for q in qs]
