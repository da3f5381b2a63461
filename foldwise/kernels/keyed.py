"""Statistics per value of many columns at once: one unpivot, one aggregation, one stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.kernels.lookup import lookup
from foldwise.kernels.store import materialize

COLUMN, KEY = "_column", "_key"


def keyed(df: DataFrame, columns: list[str], carry: list[str] | None = None, nulls: bool = False) -> DataFrame:
    """Long form ``(carry..., _column, _key)``; NULL keys are dropped unless asked for."""
    carry = carry or []
    texts = [F.col(c).cast("string").alias(f"k_{c}") for c in columns]
    long = df.select(*carry, *texts).unpivot(carry, [f"k_{c}" for c in columns], COLUMN, KEY)
    long = long.withColumn(COLUMN, F.regexp_replace(COLUMN, "^k_", ""))
    return long if nulls else long.filter(F.col(KEY).isNotNull())


def keyed_stats(
    df: DataFrame,
    columns: list[str],
    aggregates: dict[str, Column],
    carry: list[str] | None = None,
    extra_by: list[str] | None = None,
    nulls: bool = False,
) -> DataFrame:
    """Aggregates per ``(_column, _key, extra_by...)``, stored and split by column."""
    extra_by = extra_by or []
    long = keyed(df, columns, list(dict.fromkeys([*(carry or []), *extra_by])), nulls)
    stats = long.groupBy(COLUMN, KEY, *extra_by).agg(*[e.alias(n) for n, e in aggregates.items()])
    return materialize(stats, partition_by=COLUMN)


def attach_keyed(
    df: DataFrame,
    table: DataFrame,
    columns: list[str],
    name: Callable[[str, str], str],
    measures: list[str],
    defaults: dict[str, object] | None = None,
    extra_on: list[str] | None = None,
) -> DataFrame:
    """Join the per-value measures of each column back; ``name(column, measure)`` gives the output names."""
    extra_on = extra_on or []
    out = df
    for c in columns:
        part = table.filter(F.col(COLUMN) == c).select(
            F.col(KEY).alias("_probe"), *extra_on, *[F.col(m).alias(name(c, m)) for m in measures]
        )
        fills = {name(c, m): v for m, v in (defaults or {}).items()}
        out = lookup(out.withColumn("_probe", F.col(c).cast("string")), part, ["_probe", *extra_on], fills)
        out = out.drop("_probe")
    return out
