"""Left joins against fitted tables, and one-row statistics attached to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.kernels.scan import join_on


def lookup(df: DataFrame, table: DataFrame, on: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Attach the non-key columns of ``table``; a miss takes the declared default.

    NULL keys match NULL keys. The planner broadcasts ``table`` only when its known size is under the session's
    threshold; otherwise it is a sort-merge join, whose hot keys adaptive execution splits.
    """
    joined = join_on(df, table, on)
    fills = {}
    for name, value in (defaults or {}).items():
        fills[name] = F.coalesce(F.col(name), value if isinstance(value, Column) else F.lit(value))
    return joined.withColumns(fills) if fills else joined


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, as a scalar subquery."""
    packed = row.select(F.struct(*row.columns).alias("_row")).scalar()
    names = row.columns
    return df.withColumn("_row", packed).select(*df.columns, *[F.col("_row")[n].alias(n) for n in names])
