"""Model-driven operators: who is fitted on whom, and which rows get which prediction.

Linear learners (``logistic``, ``ridge``) are fitted for all folds and arms in common passes over the rows, see ``fold_models``, and
score by a JVM-side expression. Spark ML learners are fitted per fold, side by side. The assembled frame is stored once, so
iterative learners re-read vectors and not the feature plan.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from foldwise.functions.scalar import clip, safe_corr, to_logit
from foldwise.kernels.jobs import in_parallel
from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.store import materialize
from foldwise.operators.fold_models import Fit, FoldLearner, LinearModel, all_but, boosted_residuals, class_probabilities, fit_many, responses
from foldwise.operators.isotonic import isotonic_blocks, isotonic_values
from foldwise.operators.metrics import auc, delong
from foldwise.operators.rows import hashed_fold, min_max_weights, stratified_kfold

X = "_x"


def logistic(
    reg: float = 1e-4, iterations: int | None = None, family: str = "binomial", tol: float = 1e-10, standardization: bool = True
) -> FoldLearner:
    """Logistic model, multinomial if asked, run until no gradient entry is above ``tol``."""
    kind = "softmax" if family == "multinomial" else "logistic"
    return FoldLearner(kind, reg, standardization, tol, iterations)


def ridge(reg: float = 1.0) -> FoldLearner:
    return FoldLearner("ridge", reg)


def boosted_trees(rounds: int = 10, depth: int = 4, seed: int = 7) -> GBTClassifier:
    return GBTClassifier(featuresCol=X, maxIter=rounds, maxDepth=depth, seed=seed)


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    vectors = VectorAssembler(inputCols=features, outputCol=X, handleInvalid="error").transform(df)
    return vectors.select(*dict.fromkeys(keep), X)


def check_folds(work: DataFrame, fold: str, folds: int) -> None:
    """Every row must belong to one of the ``folds`` folds, or it would silently get no prediction."""
    low, high, missing = work.agg(F.min(fold), F.max(fold), F.sum(F.col(fold).isNull().cast("int"))).first()
    if missing or low < 0 or high >= folds:
        raise ValueError(f"column {fold} holds values outside 0..{folds - 1}")


def fitted(estimator: Estimator | FoldLearner, df: DataFrame, y: str, weight: str | None = None):
    if isinstance(estimator, FoldLearner):
        return fit_many(df, X, y, [Fit(frozenset({0}))], estimator, weight=weight)[0]
    params = {estimator.getParam("labelCol"): y}
    if weight is not None:
        params[estimator.getParam("weightCol")] = weight
    return estimator.fit(df, params)


def score(model, df: DataFrame, name: str) -> DataFrame:
    """``df`` with one more column: the probability of class 1, or the regression value."""
    if isinstance(model, LinearModel):
        return df.withColumn(name, responses([model], vector_to_array(X))[0])
    out = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.withColumn("_s", value).select(*df.columns, F.col("_s").alias(name))


def mean_score(models: list, df: DataFrame, name: str) -> DataFrame:
    """Average over several models, row by row: no shuffle."""
    out = df
    for i, m in enumerate(models):
        out = score(m, out, f"_s{i}")
    total = reduce(lambda a, b: a + b, [F.col(f"_s{i}") for i in range(len(models))])
    return out.withColumn(name, total / F.lit(float(len(models)))).drop(*[f"_s{i}" for i in range(len(models))])


def oof_predict(
    train: DataFrame, id: str, y: str, features: list[str], fold: str, folds: int, estimator: Estimator,
    test: DataFrame | None = None, external: DataFrame | None = None, weight: str | None = None, name: str = "pred",
) -> tuple[DataFrame, DataFrame | None, list]:
    """Out-of-fold predictions ``(id, fold, y, pred)``, test predictions averaged over the fold models, and the models.

    ``external`` rows with the same columns join the fit rows of every fold but their own.
    """
    keep = [id, fold, y] + ([weight] if weight else [])
    work = materialize(assemble(train, features, keep))
    check_folds(work, fold, folds)
    pool = work if external is None else work.unionByName(materialize(assemble(external, features, keep)))
    if isinstance(estimator, FoldLearner):
        cell = F.when(F.col(fold).between(0, folds - 1), F.col(fold)).otherwise(folds)
        known = pool.filter(F.col(fold).isNotNull()).withColumn("_cell", cell.cast("int"))
        models = fit_many(known, X, y, all_but(folds, cells=folds + 1), estimator, "_cell", folds + 1, weight)
        oof = materialize(work.withColumn(name, responses(models, vector_to_array(X), F.col(fold))[0]).drop(X))
        return oof, None if test is None else mean_score(models, assemble(test, features, [id]), name).drop(X), models
    models = in_parallel(
        train.sparkSession, [lambda f=f: fitted(estimator, pool.filter(F.col(fold) != f), y, weight) for f in range(folds)]
    )
    parts = [score(m, work.filter(F.col(fold) == f), name).drop(X) for f, m in enumerate(models)]
    oof = materialize(reduce(lambda a, b: a.unionByName(b), parts))
    if test is None:
        return oof, None, models
    tested = mean_score(models, assemble(test, features, [id]), name).drop(X)
    return oof, tested, models


def teacher_column(orig: DataFrame, df: DataFrame, features: list[str], y: str, estimator: Estimator, name: str = "teacher") -> DataFrame:
    """Score of a model fitted on ``orig`` only; pass it cleaned of overlaps."""
    model = fitted(estimator, materialize(assemble(orig, features, [y])), y)
    return score(model, assemble(df, features, df.columns), name).drop(X)


def aux_posteriors(
    orig: DataFrame, df: DataFrame, columns: list[str], levels: int, features: list[str] | None = None, reg: float = 1e-4
) -> DataFrame:
    """``<c>_p<k>``: probability of each level 0..levels-1 of an ordinal column, predicted from all the others by a
    multinomial model fitted on ``orig``; a level above the largest one seen has probability 0.

    Equal rows of ``orig`` are fitted as one weighted row, the models of all columns side by side, and equal rows of ``df`` are scored
    once: after two aggregates the work depends on the distinct rows, which of ordinal columns are few.
    """
    every = list(dict.fromkeys([*columns, *(features or [])]))
    counts = materialize(orig.groupBy(*every).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    scored = materialize(df.select(*every).distinct())

    def fit(c: str) -> LinearModel:
        inputs = [f for f in every if f != c]
        return fitted(logistic(reg, family="multinomial"), assemble(counts, inputs, [c, "_n"]), c, "_n")

    names = {c: [f"{c}_p{k}" for k in range(levels)] for c in columns}
    for c, model in zip(columns, in_parallel(df.sparkSession, [lambda c=c: fit(c) for c in columns])):
        inputs, known = [f for f in every if f != c], scored.columns
        probable = class_probabilities(assemble(scored, inputs, known), model, vector_to_array(X), "_p")
        have = max(1, len(model.coefficients))
        new = [(F.get("_p", F.lit(k)) if k < have else F.lit(0.0)).alias(n) for k, n in enumerate(names[c])]
        scored = probable.select(*known, *new)
    return lookup(df, materialize(scored), every).select(*df.columns, *[n for c in columns for n in names[c]])


def aux_expected_value(
    orig: DataFrame, df: DataFrame, columns: list[str], levels: int, features: list[str] | None = None, reg: float = 1e-4
) -> DataFrame:
    """``<c>_ev``: sum of k * P(k) of those posteriors."""
    scored = aux_posteriors(orig, df, columns, levels, features, reg)
    new = {f"{c}_ev": reduce(lambda a, b: a + b, [F.col(f"{c}_p{k}") * F.lit(float(k)) for k in range(levels)]) for c in columns}
    return scored.withColumns(new).select(*df.columns, *new)


def two_stage(
    train: DataFrame, id: str, y: str, features: list[str], fold: str, folds: int, first: Estimator, second: Estimator, test: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """The first model's out-of-fold prediction is a feature of the second."""
    one, one_test, _ = oof_predict(train, id, y, features, fold, folds, first, test, name="stage1")
    joined = train.join(one.select(id, "stage1"), id)
    joined_test = None if test is None else test.join(one_test, id)
    two, two_test, _ = oof_predict(joined, id, y, [*features, "stage1"], fold, folds, second, joined_test)
    return two.join(one.select(id, "stage1"), id), two_test


def backbone_margin(
    train: DataFrame, id: str, y: str, features: list[str], fold: str, folds: int, inner: int, seed: int, estimator: Estimator,
    test: DataFrame | None = None,
) -> DataFrame:
    """Per outer fold a logit margin for every row: fit rows from inner folds that did not see them, held rows and test rows
    from the mean of the inner models. ``(id, outer, role, margin)`` with role ``fit``, ``hold`` or ``test``."""
    work = materialize(assemble(hashed_fold(train, id, inner, seed, "_inner"), features, [id, fold, y, "_inner"]))
    check_folds(work, fold, folds)

    def one(f: int, g: int):
        return fitted(estimator, work.filter((F.col(fold) != f) & (F.col("_inner") != g)), y)

    cells = [(f, g) for f in range(folds) for g in range(inner)]
    if isinstance(estimator, FoldLearner):
        celled = work.withColumn("_cell", (F.col(fold) * inner + F.col("_inner")).cast("int"))
        seen = [Fit(frozenset(a * inner + b for a in range(folds) for b in range(inner) if a != f and b != g)) for f, g in cells]
        models = dict(zip(cells, fit_many(celled, X, y, seen, estimator, "_cell", folds * inner)))
    else:
        models = dict(zip(cells, in_parallel(train.sparkSession, [lambda c=c: one(*c) for c in cells])))
    parts = []
    for f in range(folds):
        for g in range(inner):
            rows = work.filter((F.col(fold) != f) & (F.col("_inner") == g))
            fit_part = score(models[(f, g)], rows, "_p").select(id, F.lit(f).alias("outer"), F.lit("fit").alias("role"), to_logit("_p").alias("margin"))
            parts.append(fit_part)
        mean = reduce(lambda a, b: a + b, [to_logit(f"_p{g}") for g in range(inner)]) / F.lit(float(inner))
        asked = [] if test is None else [("test", assemble(test, features, [id]))]
        for role, rows in [("hold", work.filter(F.col(fold) == f)), *asked]:
            for g in range(inner):
                rows = score(models[(f, g)], rows, f"_p{g}")
            parts.append(rows.select(id, F.lit(f).alias("outer"), F.lit(role).alias("role"), mean.alias("margin")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def drift_scores(train: DataFrame, test: DataFrame, id: str, features: list[str], folds: int, seed: int, estimator: Estimator) -> DataFrame:
    """Out-of-fold probability of being a test row, for all rows: ``(id, fold, is_test, pred)``."""
    both = train.select(id, *features).withColumn("is_test", F.lit(0)).unionByName(test.select(id, *features).withColumn("is_test", F.lit(1)))
    return oof_predict(hashed_fold(both, id, folds, seed), id, "is_test", features, "fold", folds, estimator)[0]


def drift_verdict(scores: DataFrame) -> DataFrame:
    """AUC of the train-against-test model with its reading: above 0.6 significant, above 0.55 mild, else low."""
    area = F.col("auc")
    return auc(scores, "is_test", ["pred"]).select("auc", F.when(area > 0.6, "significant").when(area > 0.55, "mild").otherwise("low").alias("drift"))


def adversarial_weights(train: DataFrame, scores: DataFrame, id: str, power: float, scale: float) -> DataFrame:
    """Weight of a train row: P(test) ** power, scaled linearly into [0.5, scale]."""
    joined = train.join(scores.filter("is_test = 0").select(id, F.col("pred").alias("_p")), id)
    return min_max_weights(joined, F.pow(F.col("_p"), F.lit(float(power))), 0.5, scale).drop("_p")


def noise_scores(train: DataFrame, id: str, y: str, features: list[str], fold: str, folds: int, estimator: Estimator) -> DataFrame:
    """Cross-fitted disagreement of label and prediction: ``noise = |y - p|`` with p from models that did not see the row."""
    oof, _, _ = oof_predict(train, id, y, features, fold, folds, estimator)
    return oof.withColumn("noise", F.abs(F.col(y) - F.col("pred")))


def full_refit(
    train: DataFrame, orig: DataFrame, test: DataFrame, id: str, y: str, features: list[str], fold: str, folds: int, estimator: Estimator, w: float
) -> DataFrame:
    """Test score ``(1 - w) * mean of fold models + w * one model fitted on all train and external rows``."""
    _, by_fold, _ = oof_predict(train, id, y, features, fold, folds, estimator, test, name="fold_mean")
    whole = assemble(train, features, [y]).unionByName(assemble(orig, features, [y]))
    model = fitted(estimator, materialize(whole), y)
    full = score(model, assemble(test, features, [id]), "refit").drop(X)
    joined = by_fold.join(full, id)
    return joined.withColumn("pred", F.col("fold_mean") * F.lit(1.0 - w) + F.col("refit") * F.lit(float(w)))


def oof_arms(train: DataFrame, id: str, y: str, arms: dict[str, list[str]], fold: str, folds: int, estimator: Estimator | FoldLearner) -> DataFrame:
    """``(id, y, one column per arm)``, stored: out-of-fold predictions of several feature lists on the same folds.

    Linear learners fit all arms and folds in the same passes over one frame; others fit arm by arm and are joined by id.
    """
    if not isinstance(estimator, FoldLearner):
        wide = None
        for n, features in arms.items():
            part = oof_predict(train, id, y, features, fold, folds, estimator, name=n)[0].select(id, y, n)
            wide = part if wide is None else wide.join(part.drop(y), id)
        return materialize(wide)
    every = list(dict.fromkeys(c for features in arms.values() for c in features))
    work = materialize(assemble(train, every, [id, fold, y]))
    check_folds(work, fold, folds)
    fits = [f for features in arms.values() for f in all_but(folds, tuple(every.index(c) for c in features))]
    models = fit_many(work, X, y, fits, estimator, fold, folds)
    x = vector_to_array(X)
    scored = [responses(models[i * folds : (i + 1) * folds], x, F.col(fold))[0].alias(n) for i, n in enumerate(arms)]
    return materialize(work.select(id, y, *scored))


def ablate(train: DataFrame, id: str, y: str, arms: dict[str, list[str]], fold: str, folds: int, estimator: Estimator) -> DataFrame:
    """Each arm (a feature list) on the same folds, compared with the first arm: AUCs, difference, standard error, z."""
    names = list(arms)
    wide = oof_arms(train, id, y, arms, fold, folds, estimator)
    parts = []
    for n in names[1:]:
        test = delong(wide, y, n, names[0])
        parts.append(test.select(F.lit(n).alias("arm"), F.col("auc_a").alias("auc"), (F.col("auc_a") - F.col("auc_b")).alias("gain"), "se", "z"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def isotonic(
    df: DataFrame, pred: str, y: str, fold: str | None = None, folds: int = 0, name: str = "calibrated", test: DataFrame | None = None
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Monotone calibration of ``pred``; with ``fold`` every row comes from a fit on the other folds, and the rows of ``test``, if
    given, get the mean over the folds as a second frame.

    Equal predictions are summed into one weighted point before the fit, once for all folds. Rows with a NULL label are not fitted; a NULL
    or NaN prediction, or one without any fitted point, gets NULL.
    """
    real = F.col("x").isNotNull() & ~F.isnan("x")
    part = F.lit(0) if fold is None else F.col(fold)
    if fold is not None:
        check_folds(df, fold, folds)
    rows = df.select(F.col(pred).cast("double").alias("x"), F.col(y).cast("double").alias("_y"), part.alias("_f")).filter(real)
    counts = materialize(rows.groupBy("x", "_f").agg(F.sum("_y").alias("s"), F.count("_y").cast("double").alias("w")))
    asked = None if test is None else materialize(test.select(F.col(pred).cast("double").alias("x")).filter(real).distinct())

    def values(f: int | None) -> DataFrame:
        seen = counts.filter("w > 0") if f is None else counts.filter((F.col("w") > 0) & (F.col("_f") != f))
        blocks = isotonic_blocks(seen.groupBy("x").agg(F.sum("s").alias("s"), F.sum("w").alias("w")))
        xs = (counts if f is None else counts.filter(F.col("_f") == f)).select("x")
        out = isotonic_values(xs if asked is None else xs.unionByName(asked).distinct(), blocks)
        return out.select(F.lit(f or 0).alias("_f"), F.col("x").alias(X), F.col("value").alias(name))

    tables = in_parallel(df.sparkSession, [lambda f=f: values(f) for f in (range(folds) if fold is not None else [None])])
    table = materialize(reduce(lambda a, b: a.unionByName(b), tables))
    keyed = df.withColumn(X, F.col(pred).cast("double")).withColumn("_f", part.cast("int"))
    oof = lookup(keyed, table, ["_f", X]).drop(X, "_f")
    if test is None:
        return oof
    means = table.groupBy(X).agg(F.avg(name).alias(name), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(tables)).drop("_n")
    return oof, lookup(test.withColumn(X, F.col(pred).cast("double")), means, [X]).drop(X)


def boosted_pseudo(
    train: DataFrame, test: DataFrame, id: str, y: str, features: list[str], fold: str, folds: int, estimator: Estimator,
    oof: str, pred: str, alpha: float, rounds: int, low: float, high: float,
) -> tuple[DataFrame, list[float]]:
    """Test pseudo-labels moved ``rounds`` times by ``alpha`` times the predicted train residual, clipped to ``[low, high]``.

    Returns the test rows with ``pseudo`` and the residual RMSE of each round. With ridge models the train rows are read for the first
    round only.
    """
    if isinstance(estimator, FoldLearner) and estimator.kind == "ridge":
        work = materialize(assemble(train.withColumn("_res", F.col(y) - F.col(oof)), features, [fold, "_res"]))
        check_folds(work, fold, folds)
        stages, errors = boosted_residuals(work, X, "_res", fold, folds, estimator, alpha, rounds)
        moved = assemble(test.withColumn("pseudo", F.col(pred)), features, [*test.columns, "pseudo"])
        for models in stages:
            moved = mean_score(models, moved, "_delta")
            moved = moved.withColumn("pseudo", clip(F.col("pseudo") + F.lit(alpha) * F.col("_delta"), low, high)).drop("_delta")
        return moved.drop(X), errors
    residual = train.withColumn("_res", F.col(y) - F.col(oof))
    current = test.withColumn("pseudo", F.col(pred))
    errors = []
    for _ in range(rounds):
        fit, moved, _ = oof_predict(residual, id, "_res", features, fold, folds, estimator, test, name="_delta")
        gap = F.col("_res") - F.col("_delta")
        errors.append(float(fit.agg(F.sqrt(F.avg(gap * gap))).first()[0]))
        step = current.join(moved.select(id, "_delta"), id)
        current = materialize(step.withColumn("pseudo", clip(F.col("pseudo") + F.lit(alpha) * F.col("_delta"), low, high)).drop("_delta"))
        residual = residual.join(fit.select(id, "_delta"), id).withColumn("_res", F.col("_res") - F.lit(alpha) * F.col("_delta")).drop("_delta")
        residual = materialize(residual)
    return current, errors


def stack_weights(fit: DataFrame, y: str, preds: list[str], c: float = 0.3) -> tuple[list[float], float]:
    """Coefficients and intercept of an L2 logistic model on the logits of the predictions."""
    logits = fit.select(y, *[to_logit(p).alias(p) for p in preds])
    rows = materialize(assemble(logits, preds, [y]))
    model = fitted(logistic(1.0 / (c * max(rows.count(), 1)), 200, standardization=False), rows, y)
    return list(model.coefficients[0]), model.intercepts[0]


def stack(
    df: DataFrame, id: str, y: str, preds: list[str], fold: str, folds: int, kind: str = "logistic", test: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Cross-fitted meta-model, L2 logistic on logits or ridge on the predictions; test rows get the mean over the folds."""
    columns = [(to_logit(p) if kind == "logistic" else F.col(p)).alias(p) for p in preds]
    learner = logistic() if kind == "logistic" else ridge(1e-3)
    rows = None if test is None else test.select(id, *columns)
    oof, tested, _ = oof_predict(df.select(id, fold, y, *columns), id, y, preds, fold, folds, learner, rows)
    return oof, tested


def sigmoid_calibration(
    df: DataFrame, id: str, pred: str, y: str, fold: str, folds: int, test: DataFrame | None = None, name: str = "calibrated"
) -> tuple[DataFrame, DataFrame | None]:
    """Platt's sigmoid of a score, fitted without a penalty on the other folds; test rows get the mean over the folds."""
    rows = df.select(id, fold, y, F.col(pred).cast("double").alias("_score"))
    asked = None if test is None else test.select(id, F.col(pred).cast("double").alias("_score"))
    learner = logistic(0.0, 200, tol=1e-10, standardization=False)
    oof, tested, _ = oof_predict(rows, id, y, ["_score"], fold, folds, learner, asked, name=name)
    return oof, tested


def multi_seed_oof(
    train: DataFrame, id: str, y: str, features: list[str], folds: int, seeds: list[int], estimator: Estimator, test: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Mean over seeds of the out-of-fold and test predictions, each seed with its own stratified folds."""
    rows = materialize(train.select(id, y, *features))
    runs = [oof_predict(stratified_kfold(rows, id, y, folds, s), id, y, features, "fold", folds, estimator, test) for s in seeds]
    oof = reduce(lambda a, b: a.unionByName(b), [r[0].select(id, y, "pred") for r in runs])
    oof = oof.groupBy(id).agg(F.max(y).alias(y), F.avg("pred").alias("pred"))
    if test is None:
        return oof, None
    tested = reduce(lambda a, b: a.unionByName(b), [r[1].select(id, "pred") for r in runs])
    return oof, tested.groupBy(id).agg(F.avg("pred").alias("pred"))


def screen_features(df: DataFrame, y: str, features: list[str], id: str, seed: int, estimator: GBTClassifier | None = None) -> DataFrame:
    """Features ranked by gain beside a random noise column: ``(feature, gain, abs_corr, above_noise)``."""
    noise = F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.lit(2**32)) / F.lit(float(2**32))
    work = df.withColumn("random_noise", noise)
    names = [*features, "random_noise"]
    rows = materialize(assemble(work, names, [y]))
    gains = fitted(estimator or boosted_trees(), rows, y)
    importances = [float(v) for v in gains.featureImportances.toArray()]
    found = work.agg(*[F.abs(safe_corr(n, y)).alias(n) for n in names]).first()
    floor = importances[-1]
    out = [(n, g, float(found[n]) if found[n] is not None else 0.0, int(g > floor)) for n, g in zip(names, importances)]
    return df.sparkSession.createDataFrame(out, "feature string, gain double, abs_corr double, above_noise int")


def forward_select(
    df: DataFrame, id: str, y: str, base: list[str], batches: dict[str, list[str]], folds: int, estimator: Callable[[], Estimator],
    min_gain: float = 1e-4, confirm_folds: int | None = None, seed: int = 42,
) -> dict[str, object]:
    """Batch screen, single-feature ablation, greedy forward selection, confirmation on more folds.

    The candidates of a stage are fitted side by side on all rows; only scores return to the driver.
    """
    every = list(dict.fromkeys([*base, *[c for cols in batches.values() for c in cols]]))
    rows = materialize(df.select(id, y, *every))

    def value(features: list[str], k: int = folds) -> float:
        oof, _, _ = oof_predict(hashed_fold(rows, id, k, seed, "_f"), id, y, features, "_f", k, estimator())
        return float(auc(oof, y, ["pred"]).first()["auc"])

    def gains(trials: list[list[str]]) -> list[float]:
        if isinstance(estimator(), FoldLearner) and trials:
            arms = {f"_arm{i}": [*base, *t] for i, t in enumerate(trials)}
            oof = oof_arms(hashed_fold(rows, id, folds, seed, "_f"), id, y, arms, "_f", folds, estimator())
            areas = {r["model"]: r["auc"] for r in auc(oof, y, list(arms)).collect()}
            return [float(areas[n]) - start for n in arms]
        return in_parallel(df.sparkSession, [lambda t=t: value([*base, *t]) - start for t in trials])

    start = value(base)
    screened = dict(zip(batches, gains(list(batches.values()))))
    alive = [c for b, gain in screened.items() if gain > 0 for c in batches[b]]
    single = dict(zip(alive, gains([[c] for c in alive]))) if alive else {}
    queue = sorted([c for c, gain in single.items() if gain > 0], key=lambda c: -single[c])
    chosen, best = list(base), start
    for c in queue:
        reached = value([*chosen, c])
        if reached - best > min_gain:
            chosen, best = [*chosen, c], reached
    final = value(chosen, confirm_folds) if confirm_folds else best
    return {"start": start, "batches": screened, "single": single, "selected": chosen[len(base) :], "auc": best, "confirmed": final}


def kmeans_features(df: DataFrame, ref: DataFrame, columns: list[str], k: int, y: str, seed: int = 42, iterations: int = 1000) -> DataFrame:
    """Cluster, distance to its centre and label rate of the cluster in ``ref``; columns are standardised on ``ref``.

    The fit ends when no centre moves by more than 1e-4; a warning says if ``iterations`` ended it before.
    """
    stats = ref.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])

    def scaled(frame: DataFrame, keep: list[str]) -> DataFrame:
        z = {f"_z_{c}": F.coalesce((F.col(c) - F.col(f"_mu_{c}")) / (F.col(f"_sd_{c}") + F.lit(1e-8)), F.lit(0.0)) for c in columns}
        return assemble(attach_row(frame, stats).withColumns(z), list(z), keep)

    fit = materialize(scaled(ref, [y]))
    model = KMeans(featuresCol=X, k=k, seed=seed, maxIter=iterations, tol=1e-4).fit(fit)
    if model.summary.numIter >= iterations:
        warnings.warn(f"the centres still move after {iterations} iterations", stacklevel=2)
    centres = model.clusterCenters()
    rates = model.transform(fit).groupBy(F.col("prediction").alias("cluster")).agg(F.avg(y).alias("cluster_rate"))
    out = model.transform(scaled(df, df.columns)).withColumnRenamed("prediction", "cluster").withColumn("_a", vector_to_array(X))
    nearest = None
    for i, centre in enumerate(centres):
        total = reduce(lambda a, b: a + b, [(F.col("_a")[j] - F.lit(float(v))) * (F.col("_a")[j] - F.lit(float(v))) for j, v in enumerate(centre)])
        nearest = F.when(F.col("cluster") == i, F.sqrt(total)) if nearest is None else nearest.when(F.col("cluster") == i, F.sqrt(total))
    out = lookup(out.withColumn("cluster_distance", nearest), materialize(rates), ["cluster"], {"cluster_rate": 0.5})
    return out.select(*df.columns, "cluster", "cluster_distance", "cluster_rate")
