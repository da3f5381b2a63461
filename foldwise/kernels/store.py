"""Intermediate tables in the shared folder of the cluster.

A fitted statistic (counts per key, split points, running totals) is read by several later jobs. It is written
once as Parquet, so that a lost executor costs a re-read instead of a recomputation, and so that the planner knows
its true size on disk: a later join is broadcast only if that size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode an unset one is filled with a fresh folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    existing = context.getCheckpointDir()
    if existing:
        return existing
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    fresh = tempfile.mkdtemp(prefix="foldwise-")
    context.setCheckpointDir(fresh)
    return fresh


SCOPES: list[list[str]] = []


@contextmanager
def stored(spark: SparkSession) -> Iterator[None]:
    """Scope of stored tables: those written inside are removed at its end, when the results have been written elsewhere.

    One scope of a driver program is open at a time, or one inside another. Outside any scope tables stay until the folder is
    cleared.
    """
    paths: list[str] = []
    SCOPES.append(paths)
    try:
        yield
    finally:
        SCOPES.remove(paths)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back.

    ``partition_by`` names a text column of few values; a filter on it then prunes files, and the planner sees the
    size of the part that is left.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    for paths in SCOPES[-1:]:
        paths.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
