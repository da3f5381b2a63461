"""Bounds on fitted models: coverage of rows, ranges, and better-than-chance scores on the planted label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import binning, metrics, models
from foldwise.plans.cases import Tables
from foldwise.plans.model_runs import FEATURES, frame, rated

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def area(df, y, pred):
    return metrics.auc(df, y, [pred]).first()["auc"]


def test_teacher_never_fitted_on_the_scored_rows_still_ranks_them(t):
    out = models.teacher_column(frame(t.base("orig")), frame(t.base("test")), FEATURES, "y", models.boosted_trees(5, 3))
    assert out.count() == t.base("test").count() and area(out, "y", "teacher") > 0.8


def test_auxiliary_posteriors_are_distributions(t):
    df, cols = rated(t, "test")
    post = models.aux_posteriors(rated(t, "orig")[0], df, cols[:1], 6, cols[1:])
    total = post.select(sum((F.col(f"{cols[0]}_p{k}") for k in range(6)), F.lit(0.0)).alias("s")).toPandas().s
    assert np.allclose(total, 1.0) and len(total) == df.count()
    ev = models.aux_expected_value(rated(t, "orig")[0], df, cols[:2], 6, cols[2:]).toPandas()
    assert ev[f"{cols[0]}_ev"].between(0, 5).all() and ev[f"{cols[1]}_ev"].between(0, 5).all()


def test_two_stage_scores_every_row(t):
    train = frame(t.folded(3))
    out, tested = models.two_stage(train, "id", "y", FEATURES, "fold", 3, models.ridge(0.01), models.logistic(), frame(t.base("test")))
    assert out.count() == train.count() and tested.count() == t.base("test").count()
    assert area(out, "y", "pred") > 0.9


def test_backbone_margin_gives_each_row_one_margin_per_outer_fold(t):
    train = frame(t.folded(3))
    out = models.backbone_margin(train, "id", "y", FEATURES, "fold", 3, 2, 31, models.logistic(iterations=10))
    assert out.count() == 3 * train.count() == out.select("id", "outer").distinct().count()
    held = out.filter("role = 'hold'").join(train.select("id", "y", "fold"), "id")
    assert held.filter("outer <> fold").isEmpty() and area(held, "y", "margin") > 0.9


def test_full_refit_is_the_weighted_mean(t):
    out = models.full_refit(frame(t.folded(3)), frame(t.base("orig")), frame(t.base("test")), "id", "y", FEATURES, "fold", 3, models.logistic(), 0.25)
    pdf = out.toPandas()
    assert np.allclose(pdf.pred, 0.75 * pdf.fold_mean + 0.25 * pdf.refit) and len(pdf) == t.base("test").count()


def test_ablation_finds_the_useful_factor(t):
    arms = {"all": FEATURES, "no_price": FEATURES[2:], "same": FEATURES}
    found = {r.arm: r for r in models.ablate(frame(t.folded(3)), "id", "y", arms, "fold", 3, models.logistic(iterations=15)).collect()}
    assert found["no_price"].gain < -0.05 and found["no_price"].z < -3
    assert found["same"].gain == pytest.approx(0.0, abs=1e-12) and found["same"].z is None


def test_adversarial_weights_stay_in_range(t):
    train = frame(t.base("train"))
    scores = models.drift_scores(train, frame(t.base("test")), "id", FEATURES, 3, 41, models.logistic(iterations=10))
    pdf = models.adversarial_weights(train, scores, "id", 2.0, 2.0).select("weight").toPandas()
    assert len(pdf) == train.count() and pdf.weight.min() == pytest.approx(0.5) and pdf.weight.max() == pytest.approx(2.0, abs=1e-4)


def test_noise_scores_find_flipped_labels(t):
    df = frame(t.folded()).withColumn("flipped", (F.col("id") % 23 == 0).cast("int"))
    noisy = df.withColumn("y", F.when(F.col("flipped") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    out = models.noise_scores(noisy, "id", "y", FEATURES, "fold", 5, models.logistic(iterations=10)).join(df.select("id", "flipped"), "id")
    assert area(out, "flipped", "noise") > 0.85


@pytest.mark.parametrize("kind", ["logistic", "ridge"])
def test_stack_is_at_least_as_good_as_its_best_leg(t, kind):
    names = ["m0", "m1", "m2", "m3"]
    best = max(r["auc"] for r in metrics.auc(t.scores(), "y", names).collect())
    out, tested = models.stack(t.scores(), "id", "y", names, "fold", 5, kind, t.scores("test"))
    assert tested.count() == t.scores("test").count() and tested.filter("pred is null").isEmpty()
    assert out.count() == t.scores().count() and area(out, "y", "pred") > best - 0.01


def test_kmeans_distance_and_rate(t):
    pdf = models.kmeans_features(t.base(), t.base("orig"), ["price", "bal"], 4, "y").toPandas()
    assert len(pdf) == t.base().count() and pdf.cluster.nunique() == 4 and (pdf.cluster_distance >= 0).all()
    orig = pdf[pdf.split == "orig"]
    for c, rate in orig.groupby("cluster").y.mean().items():
        assert np.allclose(pdf[pdf.cluster == c].cluster_rate, rate)


def test_tree_bins_are_monotone_in_the_value(t):
    pdf = binning.tree_bins(t.base(), t.base("train"), "price", "y", 8).select("price", "price_tree").dropna().toPandas().sort_values("price")
    assert (np.diff(pdf.price_tree) >= 0).all() and 2 < pdf.price_tree.nunique() <= 9
