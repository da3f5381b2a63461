"""Column handling shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pair(records: DataFrame, id: str, body: str) -> DataFrame:
    """``(entry_id, body)`` alone: further columns, whatever their names, cannot clash with working columns."""
    return records.select(quoted(id).alias("entry_id"), quoted(body).cast("string").alias("body"))


def id_type(df: DataFrame, column: str = "entry_id") -> str:
    return df.schema[column].dataType.simpleString()
