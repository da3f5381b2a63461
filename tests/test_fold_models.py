"""Fits in common passes against direct solutions, and the number of passes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from foldwise.kernels import sums
from foldwise.operators import fold_models as fm, models

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 3)) * [1, 20, 0.1] + [5, -100, 0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 5 + 0.05 * (x[:, 1] + 100))))).astype(int)
    return pd.DataFrame(x, columns=NAMES).assign(id=range(400), y=y, level=(x[:, 0] > 5).astype(int) + y, fold=np.arange(400) % 4, w=rng.integers(1, 4, 400).astype(float))


@pytest.fixture(scope="module")
def frame(spark, rows):
    return VectorAssembler(inputCols=NAMES, outputCol="v").transform(spark.createDataFrame(rows).repartition(3)).cache()


def objective(model, rows, reg, weight):
    """Penalised mean log loss of a model, and its gradient."""
    x, y, w = rows[NAMES].to_numpy(), rows["y"].to_numpy(), rows["w"].to_numpy() if weight else np.ones(len(rows))
    b = np.array(model.coefficients[0])
    mean = (w @ x) / w.sum()
    variance = (w @ (x - mean) ** 2) / w.sum()
    mu = 1 / (1 + np.exp(-(model.intercepts[0] + x @ b)))
    return np.concatenate([[w @ (mu - y)], x.T @ (w * (mu - y))]) / w.sum() + np.concatenate([[0], reg * variance * b])


@pytest.mark.parametrize("reg,weight", [(0.0, None), (0.01, "w")])
def test_logistic_fits_are_optimal_for_their_rows(frame, rows, reg, weight):
    found = fm.fit_many(frame, "v", "y", fm.all_but(4), fm.FoldLearner("logistic", reg), "fold", 4, weight)
    for f, model in enumerate(found):
        assert np.abs(objective(model, rows[rows.fold != f], reg, weight)).max() < 1e-8


def test_softmax_of_two_classes_is_the_logistic_model(frame, rows):
    one = fm.fit_many(frame, "v", "y", [fm.Fit(frozenset({0}))], fm.FoldLearner())[0]
    two = fm.fit_many(frame, "v", "y", [fm.Fit(frozenset({0}))], fm.FoldLearner("softmax"))[0]
    assert np.allclose(np.subtract(two.coefficients[1], two.coefficients[0]), one.coefficients[0], rtol=1e-6)
    three = fm.fit_many(frame, "v", "level", [fm.Fit(frozenset({0}))], fm.FoldLearner("softmax", 0.1))[0]
    p = np.array(frame.select(*fm.responses([three], models.vector_to_array("v"))).collect())
    assert p.shape == (400, 3) and np.allclose(p.sum(axis=1), 1) and np.allclose(p.mean(axis=0), np.bincount(rows.level) / 400, atol=1e-8)


def test_ridge_by_subtraction(frame, rows):
    for f, model in enumerate(fm.fit_many(frame, "v", "y", fm.all_but(4, (0, 2)), fm.FoldLearner("ridge", 0.3), "fold", 4)):
        own = rows[rows.fold != f]
        x, y = own[["a", "c"]].to_numpy(), own["y"].to_numpy()
        c = x - x.mean(axis=0)
        b = np.linalg.solve(c.T @ c / len(c) + 0.3 * np.diag(c.var(axis=0)), c.T @ (y - y.mean()) / len(c))
        assert np.allclose([model.coefficients[0][0], model.coefficients[0][2]], b) and model.coefficients[0][1] == 0
        assert model.intercepts[0] == pytest.approx(y.mean() - x.mean(axis=0) @ b)


def test_passes_do_not_grow_with_folds_or_arms(frame, monkeypatch):
    calls = []
    summed = sums.summed
    monkeypatch.setattr(fm, "summed", lambda *a: calls.append(1) or summed(*a))
    counts = []
    for fits in (fm.all_but(2), [f for c in (None, (0,), (1, 2)) for f in fm.all_but(4, c)]):
        calls.clear()
        fm.fit_many(frame, "v", "y", fits, fm.FoldLearner(), "fold", 4)
        counts.append(len(calls))
    assert counts[1] <= counts[0] + 2 and counts[0] < 15


def test_arms_in_one_pass_equal_separate_runs(frame, rows):
    arms = {"all": NAMES, "some": ["b"]}
    wide = models.oof_arms(frame.drop("v"), "id", "y", arms, "fold", 4, models.logistic()).toPandas().sort_values("id")
    for n, features in arms.items():
        alone = models.oof_predict(frame.drop("v"), "id", "y", features, "fold", 4, models.logistic())[0].toPandas().sort_values("id")
        assert np.allclose(wide[n], alone.pred, atol=1e-9)
    found = models.forward_select(frame.drop("v"), "id", "y", ["c"], {"x": ["a", "b"]}, 3, models.logistic)
    assert set(found["selected"]) == {"a", "b"} and found["auc"] > found["start"]


def test_boosted_residuals_equal_refits(frame, rows):
    stages, errors = fm.boosted_residuals(frame, "v", "y", "fold", 4, fm.FoldLearner("ridge", 0.1), 0.5, 3)
    x, left = rows[NAMES].to_numpy(), rows["y"].to_numpy(float)
    for fits, error in zip(stages, errors):
        delta = np.empty(400)
        for f, model in enumerate(fits):
            own = rows.fold != f
            c = x[own] - x[own].mean(axis=0)
            b = np.linalg.solve(c.T @ c / len(c) + 0.1 * np.diag(c.var(axis=0)), c.T @ left[own] / len(c))
            assert np.allclose(model.coefficients[0], b)
            delta[~own] = left[own].mean() + (x[~own] - x[own].mean(axis=0)) @ b
        assert error == pytest.approx(np.sqrt(np.mean((left - delta) ** 2)))
        left = left - 0.5 * delta


def test_awkward_fits(spark, frame):
    none = fm.fit_many(frame.filter("fold = 1"), "v", "y", fm.all_but(2), fm.FoldLearner("logistic", 0.1), "fold", 2)
    assert none[1].intercepts is None and none[0].intercepts is not None
    assert frame.select(fm.responses(none, models.vector_to_array("v"), F.lit(1))[0].alias("p")).filter("p is not null").isEmpty()
    empty = fm.fit_many(frame.limit(0), "v", "y", fm.all_but(2), fm.FoldLearner(), "fold", 2)
    assert all(m.intercepts is None for m in empty)
    one_class = fm.fit_many(frame.withColumn("y", F.lit(1)), "v", "y", [fm.Fit(frozenset({0}))], fm.FoldLearner())[0]
    assert frame.select(fm.responses([one_class], models.vector_to_array("v"))[0].alias("p")).agg(F.min("p")).first()[0] > 1 - 1e-6
    twins = VectorAssembler(inputCols=["a", "a2", "k"], outputCol="t").transform(frame.withColumns({"a2": F.col("a") * 2, "k": F.lit(7.0)}))
    for kind in ("logistic", "ridge"):
        found = fm.fit_many(twins, "t", "y", [fm.Fit(frozenset({0}))], fm.FoldLearner(kind))[0]
        assert np.isfinite(found.coefs).all() and found.coefficients[0][2] == pytest.approx(0, abs=1e-6)
    with pytest.warns(UserWarning, match="ended after 1"):
        fm.fit_many(frame, "v", "y", [fm.Fit(frozenset({0}))], fm.FoldLearner(iterations=1))
