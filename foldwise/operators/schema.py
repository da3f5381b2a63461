"""Target mapping, casts, schema alignment and label counts."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from foldwise.kernels.lookup import attach_row
from foldwise.kernels.quantiles import exact_quantiles, quantile_name


def literal_map(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def map_target(df: DataFrame, column: str, mapping: dict[str, int], name: str = "y") -> DataFrame:
    """Class code of a label text, compared after trimming and case folding; unknown text gives NULL."""
    codes = literal_map({k.strip().lower(): v for k, v in mapping.items()})
    return df.withColumn(name, F.try_element_at(codes, F.lower(F.trim(F.col(column).cast("string")))))


def cast_numeric(df: DataFrame, column: str, fill: str | float | None = "median", name: str | None = None) -> DataFrame:
    """Double from text, failures become NULL; NULLs take the exact median, a constant, or stay."""
    name = name or column
    parsed = F.expr(f"try_cast(trim(`{column}`) as double)")
    out = df.withColumn(name, F.when(F.isnan(parsed), F.lit(None)).otherwise(parsed))
    if fill is None:
        return out
    if fill != "median":
        return out.fillna({name: float(fill)})
    middle = exact_quantiles(out.select(name), [name], [0.5]).select(F.col(quantile_name(name, 0.5)).alias("_median"))
    return attach_row(out, middle).withColumn(name, F.coalesce(name, "_median")).drop("_median")


def align_schema(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns, order and types of ``like``: extra columns are dropped, missing ones are NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Trimmed lower-case names with blanks, slashes and dashes turned into underscores."""
    names = [re.sub(r"[ /\-]", "_", c.strip().lower()) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("two columns get the same name")
    return df.toDF(*names)


def column_roles(df: DataFrame, skip: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Column names by kind: text columns are categorical, numbers numeric."""
    kept = [f for f in df.schema.fields if f.name not in skip]
    return {
        "categorical": [f.name for f in kept if isinstance(f.dataType, StringType)],
        "numeric": [f.name for f in kept if isinstance(f.dataType, NumericType)],
    }


def label_census(df: DataFrame, y: str) -> DataFrame:
    """Rows per class with their share of the labelled rows; the NULL class has no share."""
    counts = df.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(y).alias("_labelled"))
    share = F.when(F.col("label").isNotNull(), F.col("n") / F.col("_labelled"))
    return attach_row(counts, total).select("label", "n", share.alias("share"))
