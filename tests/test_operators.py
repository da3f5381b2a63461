"""What SQL does not say: leakage, invariance, numpy re-computation, planted signals, bounds on fitted models."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.functions.scalar import normal_quantile
from foldwise.kernels import scan
from foldwise.operators import blending, encodings, groups, keys, metrics, models, neighbours, ordered, reference, rows
from foldwise.plans.cases import Tables
from foldwise.plans.model_runs import FEATURES, frame
from foldwise.sources.tables import nan_to_null

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def rank_auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    y = np.asarray(y)
    m = y.sum()
    return (r[y == 1].sum() - m * (m + 1) / 2) / (m * (len(y) - m))


def by_id(df, columns):
    return df.select("id", *columns).toPandas().sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("kind", ["te", "js", "woe", "stats"])
def test_own_labels_never_reach_a_fold(t, kind):
    """Flipping the labels of fold 2 must leave the encodings of fold 2 as they are, and change others."""

    def encode(df):
        if kind == "te":
            return encodings.kfold_te(df, ["nat"], "y", "fold", ["auto", 10])[0], ["nat_te_auto", "nat_te_m10"]
        if kind == "js":
            return encodings.james_stein_te(df, ["nat"], "y", "fold")[0], ["nat_js"]
        if kind == "woe":
            return encodings.woe_crossfit(df, ["nat"], "y", "fold", 20)[0], ["nat_woe"]
        return encodings.kfold_target_stats(df, ["nat"], "y", "fold", 5, ("mean", "std"))[0], ["nat_y_mean", "nat_y_std"]

    df = t.folded()
    flipped = df.withColumn("y", F.when(F.col("fold") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    (a, cols), (b, _) = encode(df), encode(flipped)
    a, b = by_id(a, ["fold", *cols]), by_id(b, ["fold", *cols])
    inside = a.fold == 2
    for c in cols:
        assert np.allclose(a[c][inside].astype(float), b[c][inside].astype(float), atol=1e-9)
        assert not np.allclose(a[c][~inside].astype(float), b[c][~inside].astype(float), atol=1e-9)


def test_ordered_encoding_reads_only_earlier_rows(t):
    df = t.base("train")
    last = df.agg(F.max("id")).first()[0]
    flipped = df.withColumn("y", F.when(F.col("id") == last, 1 - F.col("y")).otherwise(F.col("y")))
    a, _ = encodings.ordered_te(df, ["seg"], "y", [1], "id")
    b, _ = encodings.ordered_te(flipped, ["seg"], "y", [1], "id")
    a, b = by_id(a, ["seg_ote_1"]), by_id(b, ["seg_ote_1"])
    n = len(a)
    # only the prior moved, by one label
    assert np.abs(a.seg_ote_1 - b.seg_ote_1).max() <= 1.0 / n + 1e-12


def test_planted_signal_and_noise_control(t):
    keyed = keys.ngram_keys(t.folded(), ["pri", "seg"], 2).withColumn("junk", F.pmod(F.xxhash64("id"), F.lit(20)))
    out, _ = encodings.kfold_te(keyed, ["pri__seg", "junk"], "y", "fold", 10)
    pdf = out.select("y", "pri__seg_te_m10", "junk_te_m10").toPandas()
    assert rank_auc(pdf.y, pdf.pri__seg_te_m10) > 0.65
    assert abs(rank_auc(pdf.y, pdf.junk_te_m10) - 0.5) < 0.08


def test_golden_external_pair_auc(t):
    keyed = keys.ngram_keys(t.base(), ["pri", "seg"], 2)
    out = encodings.external_target_mean(keyed.filter("split = 'train'"), keyed.filter("split = 'orig'"), ["pri__seg"], "y")
    assert metrics.auc(out, "y", ["pri__seg_ext"]).first()["auc"] == pytest.approx(0.682047, abs=5e-7)


def test_encoders_keep_rows_and_ids(t):
    base, orig = t.base(), t.base("orig")
    n = base.count()
    for out in (
        keys.freq_encode(base, base, ["pri", "price"]),
        keys.lift_encode(base, base, orig, ["nat"]),
        groups.group_profile(base, orig, "nat", ["bal"]),
        encodings.external_target_mean(base, orig, ["nat"], "y"),
        reference.pctrank_against(base, orig, "price", "y"),
        ordered.pct_rank(base, ["price"]),
    ):
        assert out.count() == n and out.select("id").distinct().count() == n


def test_result_does_not_depend_on_partitions(spark, t):
    first = by_id(encodings.kfold_te(t.folded(), ["nat"], "y", "fold", ["auto", 10])[0], ["nat_te_auto", "nat_te_m10"])
    folds = by_id(rows.stratified_kfold(t.base("train"), "id", "y", 5, 4), ["fold"])
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = by_id(encodings.kfold_te(t.folded().repartition(5), ["nat"], "y", "fold", ["auto", 10])[0], ["nat_te_auto", "nat_te_m10"])
        folds_again = by_id(rows.stratified_kfold(t.base("train").repartition(7), "id", "y", 5, 4), ["fold"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert first.equals(again) and folds.equals(folds_again)


def test_sliced_ranks_equal_plain_ranks(t, monkeypatch):
    plain = by_id(ordered.pct_rank(t.base(), ["price", "bal"]), ["price_rank", "bal_rank"])
    monkeypatch.setattr(scan, "SMALL_TABLE", 0)
    cut = by_id(ordered.pct_rank(t.base(), ["price", "bal"]), ["price_rank", "bal_rank"])
    pd.testing.assert_frame_equal(plain, cut)
    pdf = by_id(t.base(), ["price"])
    assert np.allclose(cut.price_rank.astype(float), pdf.price.astype(float).rank(pct=True), equal_nan=True)


def test_delong_against_numpy(t):
    pdf = t.scores().select("y", "m2", "m3").toPandas()
    pos, neg = pdf[pdf.y == 1], pdf[pdf.y == 0]

    def parts(c):
        wins = (pos[c].to_numpy()[:, None] > neg[c].to_numpy()[None, :]) + 0.5 * (pos[c].to_numpy()[:, None] == neg[c].to_numpy()[None, :])
        return wins.mean(axis=1), wins.mean(axis=0)

    (xa, ya), (xb, yb) = parts("m3"), parts("m2")
    s10, s01 = np.cov(xa, xb), np.cov(ya, yb)
    cov = s10 / len(pos) + s01 / len(neg)
    se = np.sqrt(cov[0, 0] + cov[1, 1] - 2 * cov[0, 1])
    row = metrics.delong(t.scores(), "y", "m3", "m2").first()
    assert row["auc_a"] == pytest.approx(xa.mean()) and row["auc_b"] == pytest.approx(xb.mean())
    assert row["se"] == pytest.approx(se) and row["z"] == pytest.approx((xa.mean() - xb.mean()) / se)
    boot = metrics.bootstrap_auc_diff(t.scores(), "id", "y", "m3", "m2", 200, 5).first()
    assert boot["sd"] == pytest.approx(se, rel=0.25)
    assert boot["mean"] == pytest.approx(xa.mean() - xb.mean(), abs=3 * se)


def test_kde_against_direct_sum(t):
    out = reference.kde_log_ratio(t.base("train"), t.base("orig"), "bal", "y").select("bal", "bal_kde_log_ratio").toPandas()
    orig = t.base("orig").select("bal", "y").toPandas()

    def density(x, ref):
        h = ref.std(ddof=1) * len(ref) ** -0.2
        return np.exp(-((x[:, None] - ref[None, :]) ** 2) / (2 * h * h)).sum(axis=1) / (len(ref) * h * np.sqrt(2 * np.pi))

    d = [density(out.bal.to_numpy(), orig[orig.y == c].bal.to_numpy()) + 1e-10 for c in (0, 1)]
    assert np.allclose(out.bal_kde_log_ratio, np.log(d[1] / d[0]), atol=1e-8)


@pytest.mark.parametrize("shipped", [None, 150])
def test_neighbours_against_brute_force_with_ties(spark, shipped):
    rng = np.random.default_rng(8)
    ref = pd.DataFrame({"id": np.arange(400), "a": np.where(rng.random(400) < 0.4, 1.0, rng.integers(0, 12, 400)), "b": rng.integers(0, 5, 400) * 1.0, "y": rng.integers(0, 2, 400)})
    query = pd.DataFrame({"id": np.arange(1000, 1080), "a": rng.integers(-3, 16, 80) * 1.0, "b": rng.integers(0, 6, 80) * 1.0})
    found = neighbours.knn_join(spark.createDataFrame(query), spark.createDataFrame(ref), ["a", "b"], 7, label="y", shipped=shipped).toPandas()
    assert len(found) == 80 * 7
    for q in query.itertuples():
        d = np.sqrt((ref.a - q.a) ** 2 + (ref.b - q.b) ** 2)
        best = sorted(zip(d, ref.id))[:7]
        mine = found[found.id == q.id].sort_values("rank")
        assert mine.ref_id.tolist() == [i for _, i in best]
        assert np.allclose(mine.distance, [v for v, _ in best])


def test_normal_quantile(spark):
    ps = [1e-7, 0.001, 0.02425, 0.3, 0.5, 0.7, 0.98, 0.999999]
    known = [-5.199337582, -3.090232306, -1.972961049, -0.524400513, 0.0, 0.524400513, 2.053748911, 4.753424309]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile("p")).collect()]
    assert np.allclose(got, known, atol=1e-7)


def test_hill_climb_improves_on_the_best_model(t):
    solo = blending.model_scores(t.scores(), "y", ["m0", "m1", "m2", "m3"])
    weights, path = blending.hill_climb(t.scores(), "y", ["m0", "m1", "m2", "m3"], step=0.25, rounds=3)
    assert sum(weights.values()) == pytest.approx(1.0)
    assert [p[2] for p in path] == sorted(p[2] for p in path) and path[-1][2] > max(solo.values())
    pdf = t.scores().select("y", "m0", "m1", "m2", "m3").toPandas()
    assert rank_auc(pdf.y, sum(pdf[m] * w for m, w in weights.items())) == pytest.approx(path[-1][2], abs=1e-6)


def test_rmse_hill_climb_reports_the_error_of_its_blend(t):
    names = ["m0", "m1", "m2", "m3"]
    weights, error = blending.hill_climb_rmse(t.scores(), "y", names)
    pdf = t.scores().select("y", *names).toPandas()
    rmse = lambda w: float(np.sqrt(((sum(pdf[m] * v for m, v in w.items()) - pdf.y) ** 2).mean()))
    assert rmse(weights) == pytest.approx(error, abs=1e-9)
    assert error < rmse(dict.fromkeys(names, 0.25)) and sum(weights.values()) == pytest.approx(1.0)


@pytest.mark.parametrize("holes", [False, True])
def test_wide_correlation(spark, holes):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(300, 18)), columns=[f"c{i}" for i in range(18)])
    pdf["c1"] += pdf["c0"]
    df = spark.createDataFrame(pdf)
    if holes:
        df = df.withColumn("c3", F.when(F.col("c2") > 1.0, None).otherwise(F.col("c3")))
        pdf.loc[pdf.c2 > 1.0, "c3"] = np.nan
    expected = pdf.corr()
    found = metrics.corr_matrix(df, list(pdf.columns)).collect()
    assert len(found) == 18 * 17 // 2
    assert all(r.r == pytest.approx(expected.loc[r.a, r.b], abs=1e-9) for r in found)


def test_nnls_matches_least_squares_when_all_positive(t):
    w = blending.nnls_weights(t.scores(), "y", ["m1", "m2", "m3"])
    pdf = t.scores().select("y", "m1", "m2", "m3").toPandas()
    best = min(
        ((np.sum((pdf[["m1", "m2", "m3"]].to_numpy() @ np.array(x) - pdf.y) ** 2), x) for x in [[w[m] * s for m in ("m1", "m2", "m3")] for s in np.linspace(0.2, 2, 40)])
    )
    assert all(v >= 0 for v in w.values()) and sum(w.values()) == pytest.approx(1.0) and np.isfinite(best[0])


def test_sealed_scores_do_not_exceed_insample_by_much(t):
    _, table = blending.sealed_score(t.scores(), "id", "y", ["m1", "m2", "m3"], "fold", 5, ["mean_logit", "nnls_logit", "stack_logit"])
    found = {r.combiner: r for r in table.collect()}
    assert set(found) == {"mean_logit", "nnls_logit", "stack_logit"}
    assert found["mean_logit"].optimism == pytest.approx(0.0, abs=1e-9)
    assert all(abs(r.optimism) < 0.02 and r.sealed > 0.75 for r in found.values())


def test_oof_model_learns_and_covers_every_row(t):
    train, test = frame(t.folded()), frame(t.base("test"))
    oof, tested, _ = models.oof_predict(train, "id", "y", FEATURES, "fold", 5, models.logistic(), test)
    assert oof.count() == train.count() and tested.count() == test.count()
    assert metrics.auc(oof, "y", ["pred"]).first()["auc"] > 0.9
    with pytest.raises(ValueError):
        models.oof_predict(train, "id", "y", FEATURES, "fold", 3, models.logistic())


def test_no_drift_between_hashed_roles(t):
    scores = models.drift_scores(frame(t.base("train")), frame(t.base("test")), "id", FEATURES, 3, 41, models.logistic(iterations=10))
    assert abs(models.drift_verdict(scores).first()["auc"] - 0.5) < 0.08


def test_isotonic_is_monotone_and_helps_brier(t):
    out = models.isotonic(t.scores(), "m3", "y").select("m3", "calibrated", "y").toPandas().sort_values("m3")
    assert (np.diff(out.calibrated) >= -1e-12).all()
    assert ((out.calibrated - out.y) ** 2).mean() < ((out.m3 - out.y) ** 2).mean()


def test_feature_screen_ranks_signal_above_noise(t):
    found = {r.feature: r for r in models.screen_features(frame(t.base("train")), "y", FEATURES, "id", 3, models.boosted_trees(5, 3)).collect()}
    assert found["price0"].above_noise == 1 and found["random_noise"].above_noise == 0
    assert found["price0"].abs_corr > found["random_noise"].abs_corr


def test_boosted_pseudo_labels_reduce_the_residual(t):
    train = frame(t.folded(3)).withColumn("oof", F.lit(0.3))
    test = frame(t.base("test")).withColumn("pred", F.lit(0.3))
    out, errors = models.boosted_pseudo(train, test, "id", "y", FEATURES, "fold", 3, models.ridge(0.01), "oof", "pred", 0.5, 3, 0.0, 1.0)
    pdf = out.select("y", "pseudo").toPandas()
    assert pdf.pseudo.between(0, 1).all() and rank_auc(pdf.y, pdf.pseudo) > 0.85 and len(errors) == 3


def test_forward_selection_takes_the_signal(t):
    found = models.forward_select(frame(t.base("train")), "id", "y", ["bal"], {"good": ["price0", "urgent"], "bad": ["price_missing"]}, 2, lambda: models.logistic(iterations=8))
    assert "price0" in found["selected"] and found["auc"] > found["start"] + 0.1


def test_coverage_cap_fails(t):
    with pytest.raises(ValueError):
        keys.filter_representable(t.base("orig"), t.base("train").filter("seg <> 'BUILDING'"), ["seg"], cap=0.01)


def test_level_limit_fails(t):
    with pytest.raises(ValueError):
        keys.level_list(t.base(), "id", limit=50)


def test_soft_targets_outside_the_range_stop_the_job(t):
    with pytest.raises(Exception, match="soft target"):
        rows.soft_targets(t.scores(), "y", "m3", 3.0).collect()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert [r.x for r in nan_to_null(df).orderBy("x").collect()] == [None, 1.0]


def test_disjoint_split_shares_nothing(t):
    parts = rows.stratified_split(t.base("orig"), "id", "y", 0.35, 5)
    a, r = parts.filter("part = 'A'"), parts.filter("part = 'R'")
    assert a.count() + r.count() == t.base("orig").count() and groups.shared_rows(a, r, ["id"]).count() == 0


def clustered(rng, n, d):
    centres = np.random.default_rng(77).random((30, d)) * 100
    return centres[rng.integers(0, 30, n)] + rng.standard_normal((n, d))


@pytest.mark.parametrize("d", [1, 3, 7])
def test_cells_find_the_nearest_rows_and_skip_most(monkeypatch, d):
    rng = np.random.default_rng(d)
    refs, queries = clustered(rng, 3000, d), clustered(rng, 500, d)
    queries[:20] = refs[:20]
    refs[100:160] = refs[7]
    compared, brute = [], neighbours._brute
    monkeypatch.setattr(neighbours, "_brute", lambda q, r, k: compared.append(len(q) * len(r)) or brute(q, r, k))
    found, place = neighbours.nearest(queries, refs, 6)
    exact = ((queries[:, None] - refs[None]) ** 2).sum(axis=2)
    order = np.argsort(exact, axis=1, kind="stable")[:, :6]
    assert (place == order).all() and np.allclose(found, np.take_along_axis(exact, order, axis=1))
    assert sum(compared) < 0.15 * len(queries) * len(refs)


def test_cells_in_reach_are_few_on_clustered_rows(spark):
    """Share of (row, reference row) pairs whose cells are visited, over both searches of the distributed way."""
    from foldwise.kernels.pivots import Cells, assigned

    rng = np.random.default_rng(5)
    refs, queries = clustered(rng, 6000, 7), clustered(rng, 800, 7)
    names = [f"_c{i}" for i in range(7)]
    frame = lambda x: spark.createDataFrame(pd.DataFrame(x, columns=names).assign(_id=range(len(x)))).select("_id", *names)
    known = frame(refs)
    pivots = neighbours.choose_pivots(known, names, 150, 6000)
    assert 80 <= len(pivots) <= 150
    cells = neighbours.summary(neighbours.into_cells(known, names, pivots), pivots)
    plain = Cells.around(pivots, *assigned(refs, pivots))
    assert (cells.sizes == plain.sizes).all() and np.allclose(cells.most[plain.sizes > 0], plain.most[plain.sizes > 0])
    bound = np.sqrt(neighbours.nearest(queries, refs, 5)[0][:, -1])
    asked = spark.createDataFrame(pd.DataFrame(queries, columns=names).assign(_id=range(800), _reach=bound * 1.5))
    visited = sum(int(cells.sizes[r[0]]) for part in (None, "_reach") for r in neighbours.visits(asked, names, cells, 5, part).select("_block").collect())
    assert visited < 0.06 * 6000 * 800


def test_group_slope_of_short_decimals_is_rounded_once_whatever_the_slices(spark):
    rng = np.random.default_rng(3)
    cents = {k: rng.integers(-60_000, 60_000, n).tolist() for k, n in enumerate([1, 2, 63, 64, 65, 700] + [64] * 60)}
    others = {100: [1 / 3, 2 / 3, 5.25, -7.0], 101: [2.5, None, 4.0, None, 9.0], 102: [1e300, 2e300, 3e300], 103: [1.0, float("nan"), 2.0]}
    data = [(k, i, c / 100) for k, values in cents.items() for i, c in enumerate(values)]
    data += [(k, i, v) for k, values in others.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "k int, t int, v double").repartition(5).cache()
    for hot_rows in (None, 10):
        got = {r.k: r for r in groups.group_slope(df, ["k"], ["t"], F.col("t"), "v", hot_rows).collect()}
        for k, values in cents.items():
            n = len(values)
            rise = sum((2 * i - n + 1) * c for i, c in enumerate(values))
            assert (got[k].slope, got[k].n) == (float(Fraction(rise * 6, max(1, n * (n * n - 1)) * 100)), n)
        for k in (100, 101):
            places = [i for i, v in enumerate(others[k]) if v is not None]
            plain = np.polyfit(places, [others[k][i] for i in places], 1)[0]
            assert got[k].n == len(others[k]) and np.isclose(got[k].slope, plain, rtol=1e-12)
        assert np.isclose(got[102].slope, 1e300) and np.isnan(got[103].slope)
