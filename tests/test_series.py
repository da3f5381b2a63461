"""Rolling and expanding medians by counted ranks against percentile frames and numpy."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from foldwise.operators import series as S


def test_medians_equal_percentile_frames(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"who": rng.integers(0, 6, 400), "_day": rng.integers(0, 120, 400), "value": rng.integers(0, 9, 400) / 2}).drop_duplicates(["who", "_day"])
    df = spark.createDataFrame(pdf).withColumn("_day", F.col("_day").cast("int")).repartition(4)
    df = df.withColumn("value", F.when(F.col("_day") % 7 > 0, F.col("value"))).withColumn("_day", F.when(F.col("_day") != 50, F.col("_day")))
    df = df.withColumn("who", F.when(F.col("who") != 3, F.col("who")))
    out = S.rolling_features(df, ["who"], [3, 40])
    order = W.partitionBy("who").orderBy("_day")
    frames = {"last3": order.rangeBetween(-3, -1), "last40": order.rangeBetween(-40, -1), "before": order.rowsBetween(W.unboundedPreceding, -1)}
    expected = df.select("who", "_day", *[F.percentile("value", F.lit(0.5)).over(w).alias(f"{n}_median") for n, w in frames.items()])
    rows = lambda f: sorted(map(tuple, f.select(*expected.columns).collect()), key=str)
    assert rows(out) == rows(expected) and len(rows(out)) == len(pdf)
    assert out.schema["who"].dataType == df.schema["who"].dataType
    assert S.rolling_features(df.limit(0), ["who"], [3]).count() == 0


def test_plan_has_one_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 9).alias("who"), (F.col("id") % 300).cast("int").alias("day"), F.rand(1).alias("value"))
    plan = S.rolling_features(df.withColumnRenamed("day", "_day"), ["who"], [3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_an_entity_of_twenty_thousand_days():
    rng = np.random.default_rng(7)
    values = rng.random(20_000).tolist()
    began = time.process_time()
    got = S.medians_before(list(range(20_000)), values, None)
    assert time.process_time() - began < 10
    assert got[0] is None
    for i in (1, 2, 999, 12_345, 19_999):
        assert got[i] == pytest.approx(np.median(values[:i]))
    last = S.medians_before(list(range(0, 40_000, 2)), values, 101)
    for i in (1, 60, 19_999):
        assert last[i] == pytest.approx(np.median(values[max(0, i - 50) : i]))
