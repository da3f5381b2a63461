"""Isotonic fits in slices against one plain pass over all points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.kernels import scan
from foldwise.operators import isotonic as I, models


def plain(x, y):
    """Fitted value at every distinct ``x``: the largest over starts of the least mean over ends."""
    points = pd.DataFrame({"x": x, "y": y}).groupby("x").y.agg(["sum", "count"])
    s, w = np.cumsum([0, *points["sum"]]), np.cumsum([0, *points["count"]])
    n = len(points)
    means = np.full((n, n), np.inf)
    for j in range(n):
        means[j, j:] = (s[j + 1 :] - s[j]) / (w[j + 1 :] - w[j])
    least = np.minimum.accumulate(means[:, ::-1], axis=1)[:, ::-1]
    return points.index.to_numpy(), np.array([least[: k + 1, k].max() for k in range(n)])


def shapes():
    rng = np.random.default_rng(3)
    x = np.round(rng.random(1200), 3)
    up = (rng.random(1200) < x).astype(float)
    ordered = np.arange(600.0)
    return {
        "calibrated": (x, up), "falling": (x, 1 - up), "noise": (x, rng.integers(0, 2, 1200).astype(float)), "rising": (ordered, ordered**2),
        "straight down": (ordered, -ordered), "outlier first": (ordered, np.where(ordered == 0, 1e6, ordered)),
        "outlier last": (ordered, np.where(ordered == 599, -1e6, ordered)), "one value": (np.ones(20), np.arange(20.0)), "one row": (np.array([0.5]), np.array([1.0])),
    }


@pytest.mark.parametrize("shape", list(shapes()))
@pytest.mark.parametrize("per_slice", [70, 10_000])
def test_blocks_equal_one_pass(spark, shape, per_slice):
    x, y = shapes()[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(5)
    points = df.groupBy("x").agg(F.sum("y").alias("s"), F.count("y").cast("double").alias("w"))
    found = I.isotonic_blocks(points, per_slice).toPandas().sort_values("low")
    at, value = plain(x, y)
    assert (np.diff(found.value) > 0).all() or len(found) == 1
    assert found.value.to_numpy()[np.searchsorted(found.low.to_numpy(), at, "right") - 1] == pytest.approx(value, rel=1e-9, abs=1e-9)


def test_no_points(spark):
    none = spark.createDataFrame([], "x double, s double, w double")
    assert I.isotonic_blocks(none).count() == 0
    assert I.isotonic_values(spark.createDataFrame([(0.5,)], "x double"), I.isotonic_blocks(none)).first().value is None


@pytest.mark.parametrize("small", [500_000, 20])
def test_values_between_and_outside_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(scan, "SMALL_TABLE", small)
    blocks = spark.createDataFrame([(0.0, 1.0, 0.1), (2.0, 2.0, 0.5), (4.0, 6.0, 0.9)], "low double, high double, value double")
    xs = [float(v) for v in np.round(np.linspace(-2, 8, 101), 2)]
    got = I.isotonic_values(spark.createDataFrame([(v,) for v in xs], "x double").repartition(4), blocks).toPandas().sort_values("x")
    assert got.value.to_numpy() == pytest.approx(np.interp(xs, [0, 1, 2, 4, 6], [0.1, 0.1, 0.5, 0.9, 0.9]))


def test_cross_fitted_rows_and_test_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCKS_PER_SLICE", 60)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(900), "p": np.round(rng.random(900), 2), "fold": np.arange(900) % 3})
    pdf["y"] = (rng.random(900) < pdf.p**2).astype(int)
    df = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("id") > 5, F.col("y")))
    df = df.withColumn("p", F.when(F.col("id") == 7, None).when(F.col("id") == 8, float("nan")).otherwise(F.col("p")))
    test = spark.createDataFrame(pd.DataFrame({"p": [-1.0, 0.305, 0.5, 2.0, None]}))
    oof, tested = models.isotonic(df, "p", "y", "fold", 3, test=test)
    assert oof.columns == [*df.columns, "calibrated"] and oof.count() == 900
    got = oof.toPandas().set_index("id").calibrated
    fit = pdf[(pdf.id > 5) & ~pdf.id.isin([7, 8])]
    curves = [plain(*fit[fit.fold != f][["p", "y"]].to_numpy().T) for f in range(3)]
    assert np.isnan(got[7]) and np.isnan(got[8])
    for row in pdf[~pdf.id.isin([7, 8])].itertuples():
        assert got[row.id] == pytest.approx(np.interp(row.p, *curves[row.fold]), abs=1e-12)
    for row in tested.collect():
        assert row.calibrated is None if row.p is None or row.p != row.p else row.calibrated == pytest.approx(np.mean([np.interp(row.p, *c) for c in curves]))
    assert models.isotonic(df.limit(0), "p", "y").count() == 0
