"""Quasi-Newton temperatures and threshold sweeps against grids and exhaustive search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.kernels import scan
from foldwise.operators import blending, metrics, optimisers as S


@pytest.fixture(scope="module")
def probs():
    rng = np.random.default_rng(1)
    z = rng.standard_normal((500, 3))
    p = np.exp(z * 2) / np.exp(z * 2).sum(axis=1, keepdims=True)
    y = [rng.choice(3, p=np.exp(v) / np.exp(v).sum()) for v in z * [1.2, 0.6, 0.9]]
    return pd.DataFrame(p, columns=["p0", "p1", "p2"]).assign(y=y)


def loss(pdf, temperatures):
    z = np.log(np.clip(pdf[["p0", "p1", "p2"]].to_numpy(), 1e-10, 1)) / temperatures
    z -= z.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), pdf.y]))


def test_class_temperatures_beat_a_dense_grid(spark, probs):
    df = spark.createDataFrame(probs).repartition(3)
    found = S.fit_temperatures(df, "y", ["p0", "p1", "p2"])
    assert found.gradient < 1e-6 and found.log_loss == pytest.approx(loss(probs, found.values))
    grid = np.arange(0.5, 8, 0.5)
    assert found.log_loss <= min(loss(probs, [a, b, c]) for a in grid for b in grid for c in grid)
    assert min(loss(probs, np.array(found.values) * (1 + d * np.eye(3)[k])) for k in range(3) for d in (-0.01, 0.01)) > found.log_loss
    one = S.fit_temperatures(df, "y", ["p0", "p1", "p2"], shared=True)
    assert len(set(one.values)) == 1 and found.log_loss <= one.log_loss <= min(loss(probs, [t] * 3) for t in np.arange(0.2, 8, 0.01)) + 1e-12
    assert one.log_loss < loss(probs, [1, 1, 1])


def test_temperatures_of_no_rows(spark, probs):
    df = spark.createDataFrame(probs)
    assert S.fit_temperatures(df.limit(0), "y", ["p0", "p1", "p2"]).values == (1.0, 1.0, 1.0)
    gone = df.withColumn("p1", F.when(F.col("y") == 0, F.col("p1")))
    assert S.fit_temperatures(gone.withColumn("y", F.when(F.col("p1").isNull(), F.col("y"))), "y", ["p0", "p1", "p2"]).values == (1.0, 1.0, 1.0)


def test_lbfgs_on_a_narrow_valley():
    def valley(x):
        return 100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])

    point, value, gradient = S.lbfgs(valley, np.array([-1.2, 1.0]))
    assert np.allclose(point, 1) and value < 1e-12 and np.abs(gradient).max() <= 1e-8


@pytest.mark.parametrize("small", [500_000, 10])
def test_sweeps_equal_trying_every_pair(spark, monkeypatch, small):
    """On both sides of the size up to which one window does the scan."""
    monkeypatch.setattr(scan, "SMALL_TABLE", small)
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": np.round(rng.random(700) * 3, 2), "noise": rng.random(700)})
    pdf["y"] = np.clip(np.floor(pdf.s + pdf.noise - 0.5), 0, 2).astype(int)
    df = spark.createDataFrame(pdf[["s", "y"]]).repartition(4)
    s, y = pdf.s.to_numpy(), pdf.y.to_numpy()
    cuts = np.unique(s)
    recall = lambda guess: np.mean([(guess[y == c] == c).mean() for c in range(3)])
    best = max(round(recall(np.where(s >= h, 2, np.where(s < l, 0, 1))), 9) for i, l in enumerate(cuts) for h in cuts[i:])
    found = S.sweep_two_thresholds(df, "y", "s").first()
    assert found.low <= found.high and round(found.balanced_accuracy, 9) == best
    assert round(recall(np.where(s >= found.high, 2, np.where(s < found.low, 0, 1))), 9) == best
    two = df.withColumn("y", (F.col("y") > 0).cast("int"))
    one = S.sweep_threshold(two, "y", "s").first()
    value = lambda t: ((s[y == 0] < t).mean() + (s[y > 0] >= t).mean()) / 2
    assert one.balanced_accuracy == pytest.approx(max(map(value, cuts))) == pytest.approx(value(one.threshold))
    assert S.sweep_two_thresholds(df.limit(0), "y", "s").count() == 0


def test_many_drawn_weights_are_one_expression(spark, probs):
    df = spark.createDataFrame(probs)
    grid = blending.drawn_weights(200, 3, 0.5, 3.0, 5)
    found = {r.candidate: r.balanced_accuracy for r in blending.tune_class_weights(df, "y", ["p0", "p1", "p2"], grid).collect()}
    assert len(found) == 200
    for i in (0, 57, 199):
        guess = (probs[["p0", "p1", "p2"]].to_numpy() * grid[i]).argmax(axis=1)
        assert found[i] == pytest.approx(np.mean([(guess[probs.y == c] == c).mean() for c in range(3)]))


@pytest.fixture(scope="module")
def models():
    """Three models of one label: a good one, a curved one, and noise; one prediction is missing."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 1500)
    pdf = pd.DataFrame({m: 1 / (1 + np.exp(-(y - 0.5) * a - rng.standard_normal(1500))) for m, a in (("a", 1.5), ("b", 1.0), ("c", 0.1))})
    pdf["b"] = pdf.b**3
    return pdf.assign(y=y)


def area(y, s):
    s, y = np.asarray(s), np.asarray(y)
    gap = s[y == 1][:, None] - s[y == 0][None, :]
    return ((gap > 0).sum() + (gap == 0).sum() / 2) / gap.size


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_binned_areas_hold_the_exact_one(spark, models, bins):
    df = spark.createDataFrame(models).withColumn("b", F.when(F.col("a") < 0.9, F.col("b"))).repartition(3)
    kept = models[models.a < 0.9]
    tries = [F.col("a"), F.col("a") - 2 * F.col("c"), F.col("b"), F.lit(0.5), F.lit(None).cast("double")]
    exact = [area(models.y, models.a), area(models.y, models.a - 2 * models.c), area(kept.y, kept.b), 0.5]
    for ranges in ([(0.0, 1.0)] * 5, [(0.3, 0.4)] * 5, [(0.0, 0.0)] * 5):
        found = {r.candidate: r for r in metrics.auc_bounds(df, "y", tries, ranges, bins).collect()}
        assert all(found[i].low - 1e-12 <= e <= found[i].high + 1e-12 for i, e in enumerate(exact))
        assert found[4].low is None and found[4].high is None
        if bins == 4096 and ranges[0] == (0.0, 1.0):
            assert found[0].high - found[0].low < 1e-3
    assert metrics.auc_bounds(df.filter("y = 1"), "y", tries[:1], [(0.0, 1.0)]).first().low is None
    assert metrics.auc_bounds(df.limit(0), "y", tries[:1], [(0.0, 1.0)]).count() == 0


@pytest.mark.parametrize("negative", [False, True])
def test_hill_climb_by_bounds_equals_scoring_every_trial(spark, models, negative):
    weights, path = blending.hill_climb(spark.createDataFrame(models).repartition(3), "y", ["a", "b", "c"], step=0.25, negative=negative)
    names, grid = ["a", "b", "c"], [0.25, 0.5, 0.75, 1.0]
    grid = [-w for w in grid] + grid if negative else grid
    value = lambda w: area(models.y, models[names].to_numpy() @ np.array([w.get(m, 0.0) for m in names]))
    held = {"a": 1.0}
    best = value(held)
    while True:
        total, tries = sum(held.values()), []
        for m in names:
            for w in grid:
                trial = {k: v / total for k, v in held.items()}
                trial[m] = trial.get(m, 0.0) + w
                if sum(trial.values()) > 1e-9:
                    tries.append((value(trial), -names.index(m), -abs(w), trial))
        top = max(tries, key=lambda t: t[:3])
        if top[0] - best < 1e-6:
            break
        best, held = top[0], top[3]
    assert path[-1][2] == pytest.approx(best) and weights == pytest.approx({m: w / sum(held.values()) for m, w in held.items()})


def test_power_blend_is_no_worse_than_a_grid(spark, models):
    df = spark.createDataFrame(models).repartition(3)
    found = S.fit_power_blend(df, "y", ["a", "b", "c"])
    x = np.clip(models[["a", "b", "c"]].to_numpy(), S.PROB_EPS, 1 - S.PROB_EPS)
    w = np.array(list(found.weights.values()))
    assert found.auc == pytest.approx(area(models.y, np.sign(found.p) * (x**found.p @ w)), abs=1e-9)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    grid = [(i / 20, j / 20, 1 - i / 20 - j / 20) for i in range(21) for j in range(21 - i)]
    best = max(area(models.y, x**p @ np.array(g)) for g in grid for p in (1.0,))
    assert found.auc >= best
    again = S.fit_power_blend(df.repartition(7), "y", ["a", "b", "c"])
    assert again == found


def test_power_blend_edges(spark, models):
    df = spark.createDataFrame(models)
    for empty in (df.limit(0), df.filter("y = 1"), df.withColumn("a", F.lit(None).cast("double"))):
        found = S.fit_power_blend(empty, "y", ["a", "b"])
        assert found.weights == {"a": 0.5, "b": 0.5} and found.p == 1.0 and np.isnan(found.auc)
    one = S.fit_power_blend(df, "y", ["a"])
    assert one.weights == {"a": 1.0} and one.auc == pytest.approx(area(models.y, models.a))
    twice = S.fit_power_blend(df.withColumn("a2", F.col("a")), "y", ["a", "a2"])
    assert twice.auc == pytest.approx(one.auc)


def test_simplex_climbs_a_narrow_ridge():
    ridge = lambda q: -(100 * (q[1] - q[0] ** 2) ** 2 + (1 - q[0]) ** 2)
    start = [np.array(s) for s in ([-1.2, 1.0], [-1.0, 1.0], [-1.2, 1.3])]
    point, value, steps = S.simplex_climb(lambda qs: [ridge(q) for q in qs], start, [ridge(q) for q in start], 1e-14, 1e-9)
    assert np.allclose(point, 1, atol=1e-4) and value > -1e-8 and steps < 300


def test_score_orders_rows_as_the_power_mean(spark, models):
    df = spark.createDataFrame(models.head(200))
    for p in (-2.0, 0.0, 0.5, 3.0):
        x = np.clip(models.head(200)[["a", "c"]].to_numpy(), S.PROB_EPS, 1 - S.PROB_EPS)
        mean = np.exp(np.log(x) @ [0.3, 0.7]) if p == 0 else (x**p @ [0.3, 0.7]) ** (1 / p)
        got = df.select(S.power_score(["a", "c"], np.array([0.3, 0.7]), p).alias("s")).toPandas().s
        assert np.corrcoef(np.argsort(np.argsort(got)), np.argsort(np.argsort(mean)))[0, 1] == pytest.approx(1)
