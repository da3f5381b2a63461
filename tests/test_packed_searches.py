"""Searches over packed blocks, and posteriors fitted on counted rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.kernels import blocks, sums
from foldwise.operators import blending, metrics, models
from foldwise.plans.cases import Tables
from foldwise.plans.model_runs import rated

MODELS = ["m0", "m1", "m2", "m3"]


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_blocks_hold_every_labelled_row(spark, monkeypatch):
    rows = [(float(i % 7), None if i % 5 == 0 else i / 3, None if i == 11 else i % 2) for i in range(100)]
    stored = blocks.packed(spark.createDataFrame(rows, "a double, b double, y int").coalesce(1), ["a", "b"], "y").toArrow()
    found = []
    for batch in stored.to_batches():
        for y, values, codes in blocks.unpacked(batch):
            assert len(values[0]) == 7
            found += zip(*[v[c].tolist() for v, c in zip(values, codes)], y.tolist())
    known = [(a, b, y) for a, b, y in rows if y is not None]
    assert [(a, None if np.isnan(b) else b, y) for a, b, y in found] == known


def test_bounds_of_mixes_hold_the_exact_area(t):
    df = t.scores()
    holed = df.withColumn("m0", F.when(F.col("id") % 3 > 0, F.col("m0")))
    trials = [{"m0": 1.0, "m3": 0.5}, {"m1": 0.3, "m2": 0.7}, {"m3": 1.0, "m2": -0.2}]
    ranges = blending.column_ranges(holed, MODELS)
    exact = {r.candidate: r.auc for r in blending.score_candidates(holed, "y", [blending.mix(w) for w in trials]).collect()}
    packed = blocks.packed(holed, MODELS, "y")
    for bins, gap in (64, 0.1), (1 << 16, 0.003):
        for i, (low, high) in enumerate(blending.mix_bounds(packed, MODELS, trials, ranges, bins)):
            assert low - 1e-12 <= exact[i] <= high + 1e-12 and high - low < gap
    assert blending.mix_bounds(blocks.packed(holed.filter("y = 1"), MODELS, "y"), MODELS, trials, ranges, 8) == [None] * 3


def test_hill_climb_scores_few_trials_exactly(t, monkeypatch):
    asked, score = [], blending.score_candidates
    monkeypatch.setattr(blending, "score_candidates", lambda df, y, c, by=None: asked.append(len(c)) or score(df, y, c, by))
    weights, path = blending.hill_climb(t.scores(), "y", MODELS, step=0.05)
    assert max(asked) <= 8 and abs(sum(weights.values()) - 1) < 1e-12
    assert [p[2] for p in path] == sorted(p[2] for p in path)
    area = metrics.auc(t.scores().withColumn("b", blending.mix(weights)), "y", ["b"]).first()["auc"]
    assert area == pytest.approx(path[-1][2], abs=1e-9)


def test_large_arrays_reach_the_driver_in_few_groups(spark, monkeypatch):
    monkeypatch.setattr(sums, "MOST_BYTES", 2000)
    df = spark.range(0, 40, 1, 20)
    found = sums.summed(df, lambda b: np.full(100, float(sum(b.column(0).to_pylist()))), 100)
    assert (found == 780).all()


def test_posteriors_are_fitted_on_distinct_rows(t, monkeypatch):
    sizes, fitted = [], models.fitted
    monkeypatch.setattr(models, "fitted", lambda e, df, y, weight=None: sizes.append((df.count(), df.agg(F.sum(weight)).first()[0])) or fitted(e, df, y, weight))
    df, cols = rated(t, "test")
    orig = rated(t, "orig")[0]
    post = models.aux_posteriors(orig, df, cols[:2], 6, cols[2:])
    distinct = orig.select(*cols).distinct().count()
    assert sizes == [(distinct, orig.count())] * 2 and distinct < orig.count()
    assert post.count() == df.count() and post.columns == [*df.columns, *[f"{c}_p{k}" for c in cols[:2] for k in range(6)]]


def test_greedy_legs_need_no_exact_areas_where_bounds_lie_apart(t, monkeypatch):
    df = t.scores().withColumns({"twin": F.col("m3"), "half": F.col("m3") * 0.5 + F.col("m0") * 0.25})
    preds = ["m0", "half", "m2", "twin", "m3"]
    z = df.select("y", *[blending.to_logit(p).alias(p) for p in preds])
    solo = blending.model_scores(z, "y", preds)
    strong = sorted(preds, key=lambda m: -solo[m])
    chosen = strong[:1]
    while len(chosen) < 4:
        trial = [m for m in strong if m not in chosen]
        rows = blending.score_candidates(z, "y", [blending.weighted([F.col(c) for c in [*chosen, m]]) for m in trial]).collect()
        chosen.append(trial[max(rows, key=lambda r: (r["auc"], -r["candidate"]))["candidate"]])
    assert blending.greedy_select(df, "y", preds, 4) == chosen
    monkeypatch.setattr(blending, "score_candidates", None)
    monkeypatch.setattr(blending, "model_scores", None)
    assert len(blending.greedy_select(t.scores(), "y", ["m0", "m3"], 2)) == 2
