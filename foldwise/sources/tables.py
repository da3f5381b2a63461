"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    columns: list[str] | None = None,
    format: str = "csv",
) -> DataFrame:
    """Typed scan of a CSV file with header, or of Parquet; only the named columns are read."""
    if format == "csv":
        if schema is None:
            raise ValueError("a CSV scan needs a schema: inference would read the whole table twice")
        df = spark.read.option("header", "true").schema(schema).csv(path)
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.format(format).load(path)
    return df.select(*columns) if columns else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column: missing values have one form from here on."""
    fixed = {
        f.name: F.when(F.isnan(f.name), F.lit(None)).otherwise(F.col(f.name))
        for f in df.schema.fields
        if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(fixed) if fixed else df


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", "true")
    writer.format(format).save(path)


def clipped_predictions(
    df: DataFrame, id: str, pred: str, name: str = "pred", clip: tuple[float, float] | None = (0.0, 1.0)
) -> DataFrame:
    """The two-column output table ``(id, name)``, clipped to a range."""
    value: Column = F.col(pred)
    if clip is not None:
        value = F.least(F.greatest(value, F.lit(float(clip[0]))), F.lit(float(clip[1])))
    return df.select(F.col(id), value.alias(name))


def write_predictions(
    df: DataFrame,
    path: str,
    id: str = "id",
    pred: str = "pred",
    name: str = "pred",
    clip: tuple[float, float] | None = (0.0, 1.0),
    format: str = "csv",
    mode: str = "errorifexists",
) -> None:
    """Sink of ``clipped_predictions``."""
    write_table(clipped_predictions(df, id, pred, name, clip), path, format, mode)


def read_archive(spark: SparkSession, folder: str, prefix: str = "oof_", format: str = "csv") -> DataFrame:
    """All prediction files ``<prefix><model>.csv`` of a folder as one long table ``(model, id, pred)``.

    A file may also be a folder of part files written by Spark.
    """
    pattern = f"{folder.rstrip('/')}/{prefix}*"
    schema = "id bigint, pred double"
    reader = spark.read.schema(schema)
    if format == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "true")
    scan = reader.format(format).load(pattern)
    name = F.regexp_extract(F.input_file_name(), rf"/{prefix}([^/]+?)\.{format}(?:/[^/]*)?$", 1)
    return scan.select(name.alias("model"), "id", "pred")


def align_archive(preds: DataFrame, base: DataFrame, id: str = "id") -> DataFrame:
    """Keep the ids of ``base``; drop models that miss one of them, repeat one or hold a NULL prediction."""
    wanted = base.select(id).distinct()
    inside = preds.join(wanted, id, "left_semi")
    sizes = inside.groupBy("model").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("pred").alias("_filled"), F.countDistinct(id).alias("_ids")
    )
    total = wanted.agg(F.count(F.lit(1)).alias("_total"))
    whole = sizes.join(total, (F.col("_ids") == F.col("_total")) & (F.col("_rows") == F.col("_ids")) & (F.col("_filled") == F.col("_rows")), "left_semi")
    return inside.join(whole.select("model"), "model", "left_semi").select("model", id, "pred")
