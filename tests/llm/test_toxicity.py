import random

import numpy as np
import pytest

from foldwise.llm import toxicity


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    scores, grades, cuts = rng.normal(0, 2, 40), rng.integers(0, 4, 40), np.array([-1.0, 0.2, 1.5])
    _, by_score, by_cut = toxicity.likelihood(scores, grades, cuts)
    step = 1e-6
    for i in range(0, 40, 7):
        up, down = scores.copy(), scores.copy()
        up[i] += step
        down[i] -= step
        slope = (toxicity.likelihood(up, grades, cuts)[0] - toxicity.likelihood(down, grades, cuts)[0]) / (2 * step)
        assert by_score[i] == pytest.approx(slope, abs=1e-6)
    for k in range(3):
        up, down = cuts.copy(), cuts.copy()
        up[k] += step
        down[k] -= step
        slope = (toxicity.likelihood(scores, grades, up)[0] - toxicity.likelihood(scores, grades, down)[0]) / (2 * step)
        assert by_cut[k] == pytest.approx(slope, abs=1e-6)


def graded(n, seed, levels=4):
    """Texts whose grade is the number of harsh words, at most ``levels - 1``."""
    rng = random.Random(seed)
    plain = [f"term{i}" for i in range(200)]
    out = []
    for i in range(n):
        grade = rng.randrange(levels)
        words = rng.choices(plain, k=rng.randint(5, 60)) + rng.sample(["harsh", "nasty", "Vile,", "awful", "mean"], grade)
        rng.shuffle(words)
        out.append((i, " ".join(words), grade))
    return out


def test_held_out_grades(spark):
    train, test = graded(900, 1), graded(400, 2)
    frame = spark.createDataFrame(train, "entry_id bigint, body string, grade int")
    sample = toxicity.labelled_sample(frame, frame.select("entry_id", "grade"), "grade", rows=700).drop("grade")
    bounded = toxicity.labelled_sample(frame.drop("grade"), frame.select("entry_id", "grade"), "grade", rows=700)
    assert bounded.count() == 700 == sample.count()
    model = toxicity.fit_model(bounded)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    out = {r.entry_id: r for r in toxicity.severity(spark.createDataFrame(test, "entry_id bigint, body string, grade int"), model).collect()}
    assert np.mean([out[i].grade == g for i, _, g in test]) > 0.9
    assert np.mean([abs(out[i].severity - g) for i, _, g in test]) < 0.3
    for r in out.values():
        assert all(a >= b for a, b in zip(r.p_above, r.p_above[1:])) and r.severity == pytest.approx(sum(r.p_above))
        assert r.rejected == (r.p_above[0] >= 0.5 and r.score > 0)


def test_bare_marks_are_spread_over_grades(spark):
    rows = [(i, t, int(g > 0)) for i, t, g in graded(900, 3)]
    model = toxicity.fit_model(spark.createDataFrame(rows, "entry_id bigint, body string, grade int"), levels=3)
    assert len(model.thresholds) == 3
    out = {r.entry_id: r for r in toxicity.severity(spark.createDataFrame(graded(300, 4), "entry_id bigint, body string, grade int"), model).collect()}
    truth = {i: g for i, _, g in graded(300, 4)}
    assert np.mean([out[i].rejected == (g > 0) for i, g in truth.items()]) > 0.97
    means = [np.mean([out[i].severity for i, g in truth.items() if g == k]) for k in range(4)]
    assert means == sorted(means)


def test_awkward_rows_and_empty_sides(spark, writeups, awkward):
    model = toxicity.fit_model(spark.createDataFrame(graded(300, 5), "entry_id bigint, body string, grade int"))
    rows = [*enumerate(awkward), (None, "harsh nasty vile awful mean"), (2, "x"), (2, "x")]
    out = toxicity.severity(writeups(rows), model).collect()
    assert len(out) == len(rows) and all(r.score == 0.0 for r in out if r.entry_id in (0, 1))
    assert [r.rejected for r in out if r.entry_id is None] == [True]
    kept = toxicity.keep_clean(writeups(rows), model)
    assert kept.count() == len(rows) - sum(r.rejected for r in out) and kept.columns == writeups(rows).columns
    none = toxicity.fit_model(spark.createDataFrame([], "entry_id bigint, body string, grade int"))
    assert toxicity.severity(writeups([(1, "harsh")]), none).first().rejected is False
    assert toxicity.severity(writeups([]), model).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 0)], "entry_id bigint, grade int")
    assert [r.entry_id for r in toxicity.labelled_sample(writeups([(1, "a"), (7, "b"), (7, "b")]), labels, "grade").collect()] == [7, 7]


def test_fit_does_not_depend_on_row_order(spark):
    rows = graded(200, 6)
    a = toxicity.fit_model(spark.createDataFrame(rows, "entry_id bigint, body string, grade int"))
    b = toxicity.fit_model(spark.createDataFrame(rows[::-1], "entry_id bigint, body string, grade int").repartition(5))
    assert a.weights == b.weights and (a.thresholds == b.thresholds).all()
