"""Seeds that differ, draws with replacement, columns that do not vary, and archives that repeat an id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions.hashing import MODULUS, hash_sql, key_hash
from foldwise.operators import binning, blending, groups, keys, metrics, models, reference, rows
from foldwise.plans.cases import Tables
from foldwise.sources.tables import align_archive

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def test_hash_agrees_with_sql_on_large_keys(spark):
    import duckdb

    ids = [0, 1, 2, MODULUS - 1, MODULUS + 5, 5_000_000_000, 5_000_000_001, 2**61 + 7]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id bigint").orderBy("id").select(key_hash("id", 9)).collect()]
    values = ", ".join(f"({i}::bigint)" for i in ids)
    want = duckdb.sql(f"select {hash_sql('id', 9)} from (values {values}) v(id) order by id").fetchall()
    assert got == [w[0] for w in want] and all(0 <= g < MODULUS for g in got) and len(set(got)) == len(ids)


@pytest.mark.parametrize("make", ["kfold", "hashed", "stratified"])
def test_folds_of_two_seeds_are_unrelated(spark, make):
    df = spark.range(20_000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    fold = {
        "kfold": lambda s, n: rows.kfold(df, "id", 5, s, n),
        "hashed": lambda s, n: rows.hashed_fold(df, "id", 5, s, n),
        "stratified": lambda s, n: rows.stratified_kfold(df, "id", "y", 5, s, n),
    }[make]
    for a, b in ((21, 22), (1, 31)):
        both = fold(a, "a").select("id", "a").join(fold(b, "b").select("id", "b"), "id")
        cells = both.groupBy("a", "b").count().toPandas()["count"]
        assert len(cells) == 25 and (abs(cells - 800) < 130).all()


def test_inner_folds_are_even_inside_outer_folds(spark):
    df = rows.hashed_fold(rows.hashed_fold(spark.range(50_000).toDF("id"), "id", 5, 1, "outer"), "id", 5, 31, "inner")
    sizes = df.filter("outer <> 0").groupBy("inner").count().toPandas()["count"]
    assert (abs(sizes / sizes.mean() - 1) < 0.05).all()


def test_oversampling_draws_with_replacement(spark):
    df = spark.range(9_000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    times = rows.oversample(df, "id", "y", 15).filter("y = 1").groupBy("id").count().toPandas()["count"]
    n, draws = 3_000, times.sum()
    assert draws == 6_000 and abs((n - len(times)) / n - np.exp(-2)) < 0.02
    assert abs(((times**2).sum() / n - 4) - 2) < 0.2


def test_noise_hits_columns_independently(spark):
    df = spark.range(20_000).select("id", (F.col("id") + 0.5).alias("a"), (F.col("id") * 1.5).alias("b"))
    out = rows.swap_noise(df, "id", ["a", "b"], 0.15, 30)
    changed = out.select((F.col("a") != F.col("id") + 0.5).alias("a"), (F.col("b") != F.col("id") * 1.5).alias("b")).toPandas()
    assert abs(changed.a.mean() - 0.15) < 0.01 and abs((changed.a & changed.b).mean() - 0.0225) < 0.005


@pytest.mark.parametrize("columns", [4, 17])
@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_constant_columns_have_no_correlation(spark, columns, method):
    names = [f"c{i}" for i in range(columns)]
    df = spark.range(60).select(F.lit(2.0).alias("c0"), *[F.sin(F.col("id") * i).alias(f"c{i}") for i in range(1, columns)])
    out = {(r.a, r.b): r.r for r in metrics.corr_matrix(df, names, method).collect()}
    assert all((r is None) == ("c0" in pair) for pair, r in out.items()) and len(out) == columns * (columns - 1) // 2


def test_undefined_statistics_are_null_not_errors(spark, t):
    df = t.scores().withColumn("flat", F.lit(0.4))
    out = blending.agreement_blend(df, ["m2", "m3", "flat"], "m3")
    assert out.filter("blend is null").isEmpty()
    kde = reference.kde_log_ratio(df, df, "flat", "y")
    assert kde.filter("flat_kde_log_ratio is not null").isEmpty() and kde.count() == df.count()
    one_class = binning.iv_table(df.filter("y = 1"), "bal", "y", 4)
    assert one_class.filter("iv is not null or woe <> 0").isEmpty() and one_class.agg(F.sum("n")).first()[0] == df.filter("y = 1").count()
    assert blending.agreement_blend(df, ["flat"], "flat").first()["blend"] == pytest.approx(0.4)


def test_archives_that_repeat_an_id_are_refused(spark, t):
    archive = t.archive(models=2)
    twice = archive.unionByName(archive.filter("model = 'm1'").limit(5))
    assert {r.model for r in align_archive(twice, t.scores()).select("model").distinct().collect()} == {"m0"}
    with pytest.raises(Exception, match="repeats an id"):
        blending.to_wide(twice, ["m0", "m1"]).collect()


def test_shares_of_an_open_vocabulary(spark):
    df = spark.range(5_000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 3).alias("level"))
    out = groups.group_share_table(df, "g", "level")
    assert out.select("level").distinct().count() == 1667 and out.groupBy("g").agg(F.sum("share").alias("s")).filter("abs(s - 1) > 1e-9").isEmpty()


def test_cross_products_of_many_models_in_one_pass(spark):
    names = [f"p{i}" for i in range(49)]
    df = spark.range(400).select(*[F.sin(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)], (F.col("id") % 2).alias("y"))
    g, b, yy = blending.gram(df, names, "y")
    x = df.toPandas()
    assert np.allclose(g, x[names].T @ x[names]) and np.allclose(b, x[names].T @ x.y) and yy == 200


def test_test_side_predictions_cover_every_row(spark, t):
    train, test = t.scores(), t.scores("test")
    n = test.count()
    oof, tested = models.sigmoid_calibration(train, "id", "m3", "y", "fold", 5, test)
    assert oof.count() == train.count() and tested.count() == n
    gap = oof.agg(F.avg("calibrated"), F.avg("y")).first()
    assert gap[0] == pytest.approx(gap[1], abs=0.01)
    assert models.isotonic(train, "m3", "y", "fold", 5, test=test)[1].filter("calibrated between 0 and 1").count() == n
    combined = blending.combined_test(train, test, "id", "y", ["m1", "m2", "m3"], list(blending.COMBINERS))
    assert combined.count() == n and combined.dropna().count() == n


def test_drawn_weights_are_chosen_by_score(spark):
    df = spark.createDataFrame([(0, 0.5, 0.5 + 1e-3, 0.0)] * 5 + [(1, 0.1, 0.9, 0.0)] * 5 + [(2, 0.3, 0.3, 0.28)] * 5, "y int, a double, b double, c double")
    grid = blending.drawn_weights(200, 3, 0.5, 3.0, 3)
    best, out = blending.weighted_argmax(df, "y", ["a", "b", "c"], grid)
    assert best in grid and out.filter("guess <> y").isEmpty()
    assert keys.level_name("y", 1) == "y_is_1"


def gini_thresholds(v, y, leaves):
    """Best-first tree on one feature by trying every cut."""
    cuts = []
    pure = lambda part: 0.0 if not len(part) else (part.sum() ** 2 + (len(part) - part.sum()) ** 2) / len(part)
    values = np.unique(v)
    while len(cuts) + 1 < leaves:
        leaf = sum((v > c).astype(int) for c in cuts) + np.zeros(len(v), int)
        trials = []
        for a, b in zip(values, values[1:]):
            own = leaf[v == a][0]
            if own == leaf[v == b][0]:
                inside = leaf == own
                left = inside & (v <= a)
                trials.append((pure(y[left]) + pure(y[inside & ~left]) - pure(y[inside]), -a, (a + b) / 2))
        top = max(trials, default=(0, 0, 0))
        if top[0] <= 1e-9:
            break
        cuts.append(top[2])
    return sorted(cuts)


def test_tree_thresholds_equal_every_cut_and_keep_the_leaf_limit(spark):
    rng = np.random.default_rng(8)
    v = rng.integers(0, 60, 800).astype(float)
    y = (rng.random(800) < 0.2 + 0.6 * ((v > 12) & (v < 31)) + 0.1 * (v > 47)).astype(int)
    df = spark.createDataFrame(list(zip(v.tolist(), y.tolist())), "v double, y int")
    for leaves in (3, 6):
        assert binning.tree_edges(df, "v", "y", leaves) == pytest.approx(gini_thresholds(v, y, leaves))


def test_stored_tables_go_at_the_end_of_their_scope(spark):
    from foldwise.kernels.store import materialize, stored

    kept = materialize(spark.range(3))
    with stored(spark):
        inner = materialize(spark.range(5))
        assert inner.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inner.inputFiles()[0]).count()
