"""Independent driver calls side by side, so that short Spark jobs overlap."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

SIDE_BY_SIDE = 6


def in_parallel(session: SparkSession, calls: list[Callable]) -> list:
    """Results of the calls in order; each call submits its own Spark jobs."""
    if len(calls) == 1:
        return [calls[0]()]
    with ThreadPool(min(SIDE_BY_SIDE, len(calls))) as pool:
        return pool.map(lambda call: call(), [inheritable_thread_target(session)(c) for c in calls])
