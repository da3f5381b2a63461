"""Blends, weight searches, thresholds and prediction post-processing.

Predictions are one column per model. A search scores all candidates of a round in one job; only per-model or
per-candidate scalars come back to the driver.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce
from itertools import combinations, count as count_up

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.scalar import clip, safe_corr, to_logit
from foldwise.kernels.blocks import cell_counts, packed, unpacked
from foldwise.kernels.jobs import in_parallel
from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.quantiles import exact_quantiles, quantile_name
from foldwise.kernels.scan import join_on, value_scan
from foldwise.kernels.store import materialize
from foldwise.kernels.sums import summed
from foldwise.operators.metrics import auc, auc_from_counts, auc_long, class_counts, corr_matrix
from foldwise.operators.ordered import pct_rank
from foldwise.operators.reference import rank_table


def to_wide(archive: DataFrame, models: list[str], id: str = "id") -> DataFrame:
    """One column per model from the long archive ``(model, id, pred)``; a model that repeats an id stops the job."""
    cells = archive.filter(F.col("model").isin(models)).groupBy("model", id).agg(F.first("pred").alias("pred"), F.count(F.lit(1)).alias("_n"))
    once = F.when(F.col("_n") == 1, F.col("pred")).otherwise(F.raise_error(F.lit("a model repeats an id")))
    return cells.select("model", id, once.alias("pred")).groupBy(id).pivot("model", models).agg(F.first("pred"))


def weighted(columns: list[Column], weights: list[float] | None = None) -> Column:
    weights = weights or [1.0 / len(columns)] * len(columns)
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights)])


def blend(df: DataFrame, preds: list[str], kind: str, weights: list[float] | None = None, p: float = 1.0, name: str = "blend") -> DataFrame:
    """``rank``: mean of percentile ranks; ``logit``: mean of logits; ``mean``: weighted mean; ``power``: (sum w x^p)^(1/p)."""
    if kind == "rank":
        ranked = pct_rank(df, preds, suffix="_rk")
        return ranked.withColumn(name, weighted([F.col(f"{c}_rk") for c in preds], weights)).drop(*[f"{c}_rk" for c in preds])
    if kind == "logit":
        return df.withColumn(name, weighted([to_logit(c) for c in preds], weights))
    if kind == "mean":
        return df.withColumn(name, weighted([F.col(c) for c in preds], weights))
    if kind == "power":
        inner = weighted([F.pow(clip(c, 1e-15, 1.0 - 1e-15), F.lit(float(p))) for c in preds], weights)
        return df.withColumn(name, F.pow(inner, F.lit(1.0 / p)))
    raise ValueError(f"unknown blend {kind}")


def eligible(aucs: DataFrame, band: float) -> DataFrame:
    """Models whose AUC is within ``band`` of the best."""
    best = aucs.agg(F.max("auc").alias("_best"))
    return attach_row(aucs, best).filter(F.col("auc") >= F.col("_best") - F.lit(float(band))).drop("_best")


def merge_duplicates(df: DataFrame, y: str, preds: list[str], rho: float, min_models: int = 1) -> list[str]:
    """Models left after dropping the weaker of every pair whose ranks correlate above ``rho``; all if too few would be left.

    Pairs are visited in list order; a pair with a model that is already gone is skipped, equal scores keep the first.
    """
    solo = model_scores(df, y, preds)
    position = F.array_position(F.array(*[F.lit(p) for p in preds]), F.col("a")), F.array_position(F.array(*[F.lit(p) for p in preds]), F.col("b"))
    close = corr_matrix(df, preds, "spearman").filter(F.col("r") > rho).orderBy(*position)
    dropped: set[str] = set()
    for row in close.select("a", "b").collect():
        pair = {row["a"], row["b"]}
        if not pair & dropped:
            dropped.add(min(pair, key=lambda m: (solo[m], -preds.index(m))))
    left = [p for p in preds if p not in dropped]
    return left if len(left) >= min_models else list(preds)


def model_scores(df: DataFrame, y: str, preds: list[str]) -> dict[str, float]:
    return {r["model"]: r["auc"] for r in auc(df, y, preds).collect()}


def score_candidates(df: DataFrame, y: str, candidates: list[Column], by: list[str] | None = None) -> DataFrame:
    """AUC of many candidate expressions in one job: ``(by..., candidate, auc)``."""
    by = by or []
    entries = F.array(*[F.struct(F.lit(i).alias("candidate"), c.cast("double").alias("pred")) for i, c in enumerate(candidates)])
    long = df.select(*by, y, F.explode(entries).alias("_e")).select(*by, y, "_e.candidate", "_e.pred")
    return auc_long(long, y, [*by, "candidate"]).select(*by, "candidate", "auc")


def mix(weights: dict[str, float]) -> Column:
    total = sum(weights.values())
    return reduce(lambda a, b: a + b, [F.col(m) * F.lit(w / total) for m, w in weights.items()])


BATCH = 200
#: Bounds from counts and exact areas differ by rounding only; this much is left between them.
SLACK = 1e-12


def column_ranges(df: DataFrame, preds: list[str]) -> dict[str, tuple[float, float]]:
    """Least and largest value of every column; ``(0, 0)`` where there is none."""
    row = df.agg(*[f(p).cast("double") for p in preds for f in (F.min, F.max)]).first()
    return {p: (row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i, p in enumerate(preds)}


def mix_range(weights: dict[str, float], ranges: dict[str, tuple[float, float]]) -> tuple[float, float]:
    total = sum(weights.values())
    ends = [sorted((w / total * ranges[m][0], w / total * ranges[m][1])) for m, w in weights.items()]
    return sum(e[0] for e in ends), sum(e[1] for e in ends)


#: Cells of the first bounds of all trials, then of those that are left; trials counted in one job.
CELLS = ((4096, 80), (1 << 16, 8))


def mix_bounds(
    blocks: DataFrame, preds: list[str], trials: list[dict[str, float]], ranges: dict[str, tuple[float, float]], bins: int
) -> list[tuple[float, float] | None]:
    """Bounds of the AUC of every mix from its counts in ``bins`` cells, as ``auc_bounds`` gives them; None without both classes.

    Every task adds up its own cells, whatever the number of rows.
    """
    size = (bins + 1) * 2
    mixes = [([(preds.index(m), w / sum(t.values())) for m, w in t.items()], mix_range(t, ranges)) for t in trials]

    def part(batch: pa.RecordBatch) -> np.ndarray:
        found = np.zeros((len(mixes), size))
        for y, values, codes in unpacked(batch):
            for i, (legs, (low, high)) in enumerate(mixes):
                score = reduce(lambda a, b: a + b, [(values[j] * w)[codes[j]] for j, w in legs])
                found[i] += cell_counts(score, y, low, high, bins)
        return found.ravel()

    bounds = []
    for neg, pos in summed(blocks, part, size * len(mixes)).reshape(len(mixes), bins + 1, 2).transpose(0, 2, 1):
        won, tied, pairs = float(pos @ (np.cumsum(neg) - neg)), float(pos @ neg), float(pos.sum() * neg.sum())
        bounds.append((won / pairs, (won + tied) / pairs) if pairs else None)
    return bounds


def best_trial(
    df: DataFrame, blocks: DataFrame, y: str, trials: list[tuple[str, float, dict[str, float]]], preds: list[str], ranges: dict, floor: float,
    area: bool = True, order: list[str] | None = None,
):
    """``(auc, model, weight, weights)`` of the best trial, or None where no trial reaches ``floor``; a trial that its bounds alone show
    to be the best has no AUC unless ``area`` is asked for.

    Binned counts bound the area of every trial, finer cells those that are left; only those that could be the best are scored exactly.
    """
    left = list(range(len(trials)))
    for bins, at_once in CELLS:
        bounds = {}
        for at in range(0, len(left), at_once):
            part = left[at : at + at_once]
            bounds |= {i: b for i, b in zip(part, mix_bounds(blocks, preds, [trials[i][2] for i in part], ranges, bins)) if b}
        needed = max([floor, *[low for low, _ in bounds.values()]]) - SLACK
        left = [i for i, (_, high) in bounds.items() if high >= needed]
        if len(left) == 1 and not area:
            return (None, *trials[left[0]])
    scored = []
    for at in range(0, len(left), BATCH):
        part = [trials[i] for i in left[at : at + BATCH]]
        scored += [(r["auc"], *part[r["candidate"]]) for r in score_candidates(df, y, [mix(w) for _, _, w in part]).collect()]
    return max(scored, key=lambda s: (s[0], -(order or preds).index(s[1]), -abs(s[2])), default=None)


def hill_climb(
    df: DataFrame, y: str, preds: list[str], step: float = 0.1, negative: bool = False, min_gain: float = 1e-6, rounds: int | None = None
) -> tuple[dict[str, float], list[tuple[str, float, float]]]:
    """Weights found by adding, round by round, the (model, weight) that lifts the AUC most, until the gain falls below
    ``min_gain`` (or for at most ``rounds`` rounds, if given). ``negative`` also tries the weights from -1 on.

    Returns the weights (summing to 1) and the path ``[(model, weight, auc)]``. Each round counts all candidates in cells over the
    packed rows, and scores only those exactly whose bounds reach the best.
    """
    work = materialize(df.select(y, *preds))
    blocks = packed(work, preds, y)
    ranges = column_ranges(work, preds)
    solo = model_scores(work, y, preds)
    start = max(preds, key=lambda m: solo[m])
    weights, best, path = {start: 1.0}, solo[start], [(start, 1.0, solo[start])]
    count = round(1.0 / step)
    grid = [i * step for i in range(1, count + 1)]
    if negative:
        grid = [-i * step for i in range(1, count + 1)] + grid
    for _ in count_up() if rounds is None else range(rounds):
        total = sum(weights.values())
        trials = []
        for m in preds:
            for w in grid:
                trial = {**{k: v / total for k, v in weights.items()}}
                trial[m] = trial.get(m, 0.0) + w
                if sum(trial.values()) > 1e-9:
                    trials.append((m, w, trial))
        top = best_trial(work, blocks, y, trials, preds, ranges, best + min_gain)
        if top is None or top[0] - best < min_gain:
            break
        best, weights = top[0], top[3]
        path.append((top[1], top[2], best))
    total = sum(weights.values())
    return {m: w / total for m, w in weights.items()}, path


def gram(df: DataFrame, columns: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Cross products of the columns with each other and with the label: a table of models squared.

    Every task multiplies its own batches; the small tables are added up by cell. A row with a NULL stops the job.
    """
    k = len(columns) + 1
    values = df.select(F.array(*[F.col(c).cast("double") for c in [*columns, y]]).alias("_v"))

    def multiply(batches):
        total = np.zeros((k, k))
        for batch in batches:
            block = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, k)
            if np.isnan(block).any():
                raise ValueError("cross products need complete rows")
            total += block.T @ block
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["_cell", "_s"])

    cells = values.mapInArrow(multiply, "_cell bigint, _s double").groupBy("_cell").agg(F.sum("_s").alias("_s")).collect()
    table = np.zeros(k * k)
    for row in cells:
        table[row["_cell"]] = row["_s"]
    table = table.reshape(k, k)
    return table[:-1, :-1], table[:-1, -1], float(table[-1, -1])


# The weight changes tried for each model in one sweep.
WEIGHT_CHANGES = [0.01, -0.01, 0.05, -0.05, 0.1, -0.1]


def blend_errors(g: np.ndarray, b: np.ndarray, yy: float, n: int, trials: np.ndarray) -> np.ndarray:
    """RMSE of every row of weights, from the cross products alone."""
    quadratic = np.einsum("ti,ij,tj->t", trials, g, trials)
    return np.sqrt(np.maximum(quadratic - 2.0 * trials @ b + yy, 0.0) / n)


def hill_climb_rmse(df: DataFrame, y: str, preds: list[str]) -> tuple[dict[str, float], float]:
    """Non-negative weights with sum 1 that lower the RMSE by small changes, from equal weights until none helps.

    Each step scores every change of every model at once and takes the best. The squared error of any blend follows from the
    cross products, so the rows are read once for the whole search.
    """
    n, k = df.count(), len(preds)
    g, b, yy = gram(df, preds, y)
    changes = np.kron(np.eye(k), np.array(WEIGHT_CHANGES)[:, None])
    weights = np.full(k, 1.0 / k)
    best = float(blend_errors(g, b, yy, n, weights[None, :])[0])
    while True:
        trials = np.maximum(weights + changes, 0.0)
        trials = trials[trials.sum(axis=1) > 0]
        trials = trials / trials.sum(axis=1, keepdims=True)
        errors = blend_errors(g, b, yy, n, trials)
        if errors.min() >= best - 1e-12:
            return dict(zip(preds, weights.tolist())), best
        best, weights = float(errors.min()), trials[errors.argmin()]


def solve_nonnegative(g: np.ndarray, b: np.ndarray, sweeps: int | None = None) -> np.ndarray:
    """Minimiser of ``x'Gx/2 - b'x`` over ``x >= 0`` by coordinate descent on a small matrix, until a sweep moves no entry by more
    than 1e-14 of the largest, or no longer lowers the value. A given limit of ``sweeps`` that ends it early is announced by a warning."""
    x, value = np.zeros(len(b)), 0.0
    for n in count_up(1):
        before = x.copy()
        for i in range(len(b)):
            if g[i, i] > 0:
                x[i] = max(0.0, x[i] + (b[i] - g[i] @ x) / g[i, i])
        last, value = value, float(x @ g @ x / 2 - b @ x)
        if np.max(np.abs(x - before), initial=0.0) <= 1e-14 * np.max(x, initial=1.0) or (n > 1000 and value >= last):
            return x
        if n == sweeps:
            warnings.warn(f"the weights still move by {np.max(np.abs(x - before)):.1e} after {n} sweeps", stacklevel=2)
            return x


def nnls_weights(df: DataFrame, y: str, preds: list[str], logits: bool = False) -> dict[str, float]:
    """Non-negative least-squares weights scaled to sum 1; equal weights if all are zero."""
    work = df.select(y, *[(to_logit(p) if logits else F.col(p)).alias(p) for p in preds])
    g, b, _ = gram(work, preds, y)
    x = solve_nonnegative(g, b)
    x = x / x.sum() if x.sum() > 0 else np.full(len(preds), 1.0 / len(preds))
    return dict(zip(preds, x.tolist()))


def greedy_select(df: DataFrame, y: str, preds: list[str], steps: int, candidates: int | None = None) -> list[str]:
    """Legs of an equal-weight logit mean: start with the best, then add the best of the remaining models (of the
    ``candidates`` strongest, if given). Bounds from counted cells decide wherever they lie apart, exact areas where they do not."""
    work = materialize(df.select(y, *[to_logit(p).alias(p) for p in preds]))
    blocks, ranges = packed(work, preds, y), column_ranges(work, preds)
    spans = mix_bounds(blocks, preds, [{p: 1.0} for p in preds], ranges, CELLS[-1][0])
    if all(spans) and all(a[0] > b[1] + SLACK or b[0] > a[1] + SLACK for a, b in combinations(spans, 2)):
        strong = [p for _, p in sorted(zip(spans, preds), reverse=True)]
    else:
        solo = model_scores(work, y, preds)
        strong = sorted(preds, key=lambda m: -solo[m])
    chosen = [strong[0]]
    for _ in range(steps - 1):
        trial = [m for m in strong if m not in chosen][:candidates]
        if not trial:
            break
        if len(trial) == 1:
            chosen += trial
            continue
        mixes = [(m, 1.0, dict.fromkeys([*chosen, m], 1.0)) for m in trial]
        top = best_trial(work, blocks, y, mixes, preds, ranges, -math.inf, area=False, order=strong)
        chosen.append(top[1])
    return chosen


def cross_fitted_blend(
    df: DataFrame, y: str, a: str, b: str, fold: str, folds: int, grid: list[float]
) -> tuple[DataFrame, DataFrame]:
    """Linear logit blend ``(1-w) A + w B`` whose weight for each fold is chosen on the other folds.

    Returns the rows with ``blend`` and the table ``(fold, weight, auc)``; ties take the smaller weight. Each (candidate, score) is counted
    once with a column per fold; one scan then gives the areas of all folds, each from the total without its own part.
    """
    work = materialize(df.select(fold, y, to_logit(a).alias("_a"), to_logit(b).alias("_b")))
    mixed = [F.struct(F.lit(i).alias("candidate"), (F.col("_a") * F.lit(1.0 - w) + F.col("_b") * F.lit(w)).alias("pred")) for i, w in enumerate(grid)]
    long = work.select(fold, y, F.explode(F.array(*mixed)).alias("_e")).select(fold, y, "_e.candidate", "_e.pred")
    per_fold = [F.count(F.when((F.col(fold) == f) & (F.col(y) == c), 1)).alias(f"{n}{f}") for f in range(folds) for n, c in (("pos", 1), ("neg", 0))]
    counts = materialize(long.filter(F.col("pred").isNotNull()).groupBy("candidate", "pred").agg(*per_fold))
    other = lambda n, f: reduce(lambda a, b: a + b, [F.col(f"{n}{g}") for g in range(folds) if g != f], F.lit(0))
    scanned = value_scan(counts, ["candidate"], "pred", {f"_below{f}": other("neg", f) for f in range(folds)}, stored=True)
    won = lambda f: F.sum(other("pos", f).cast("double") * (F.col(f"_below{f}") + other("neg", f) / F.lit(2.0)))
    pairs = lambda f: F.sum(other("pos", f)).cast("double") * F.sum(other("neg", f))
    each = F.array(*[F.struct(F.lit(f).alias(fold), F.try_divide(won(f), pairs(f)).alias("auc")) for f in range(folds)])
    areas = scanned.groupBy("candidate").agg(each.alias("_a")).select("candidate", F.explode("_a").alias("_a")).select("candidate", f"_a.{fold}", "_a.auc")
    best = areas.groupBy(fold).agg(F.max_by("candidate", F.struct(F.col("auc"), -F.col("candidate"))).alias("_c"), F.max("auc").alias("auc"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in grid]), F.col("_c") + 1)
    table = materialize(best.select(fold, weight.alias("weight"), "auc"))
    out = lookup(df, table.select(fold, F.col("weight").alias("_w")), [fold])
    blended = to_logit(a) * (F.lit(1.0) - F.col("_w")) + to_logit(b) * F.col("_w")
    return out.withColumn("blend", blended).drop("_w"), table


def argmax_class(probs: list[Column]) -> Column:
    """Index of the largest value; ties go to the first."""
    best, index = probs[0], F.lit(0)
    for i, p in enumerate(probs[1:], 1):
        index = F.when(p > best, F.lit(i)).otherwise(index)
        best = F.greatest(best, p)
    return index


def tune_class_weights(df: DataFrame, y: str, probs: list[str], grid: list[list[float]]) -> DataFrame:
    """Balanced accuracy of ``argmax(p * w)`` for every weight vector: ``(candidate, balanced_accuracy)``."""
    listed = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in grid])
    long = df.select(F.col(y).alias("_y"), *[F.col(p).alias(f"_p{i}") for i, p in enumerate(probs)], F.posexplode(listed).alias("candidate", "_w"))
    guess = argmax_class([F.col(f"_p{i}") * F.get("_w", F.lit(i)) for i in range(len(probs))])
    return _mean_recall(long.select("_y", "candidate", guess.alias("guess")), "_y")


def drawn_weights(n: int, classes: int, low: float, high: float, seed: int) -> list[list[float]]:
    """``n`` weight vectors drawn evenly from ``[low, high]``."""
    return np.random.default_rng(seed).uniform(low, high, (n, classes)).tolist()


def weighted_argmax(df: DataFrame, y: str, probs: list[str], grid: list[list[float]], test: DataFrame | None = None) -> tuple[list[float], DataFrame]:
    """The weight vector of the best balanced accuracy (ties: the first), and the rows of ``test`` (or ``df``) with the class
    ``guess`` that it gives."""
    scores = tune_class_weights(df, y, probs, grid)
    top = scores.orderBy(F.col("balanced_accuracy").desc(), "candidate").first()
    best = grid[top["candidate"]]
    rows = df if test is None else test
    return best, rows.withColumn("guess", argmax_class([F.col(p) * F.lit(float(w)) for p, w in zip(probs, best)]))


def tune_thresholds(df: DataFrame, y: str, low: str, high: str, grid: list[tuple[float, float]]) -> DataFrame:
    """Balanced accuracy of the rule: class 2 if ``high`` is at its threshold, else class 0 if ``low`` is at its, else 1."""
    guesses = [
        F.struct(F.lit(i).alias("candidate"), F.when(F.col(high) >= h, 2).when(F.col(low) >= l, 0).otherwise(1).alias("guess"))
        for i, (l, h) in enumerate(grid)
    ]
    return _candidate_recall(df, y, guesses)


def _candidate_recall(df: DataFrame, y: str, guesses: list[Column]) -> DataFrame:
    long = df.select(y, F.explode(F.array(*guesses)).alias("_e")).select(y, "_e.candidate", "_e.guess")
    return _mean_recall(long, y)


def _mean_recall(long: DataFrame, y: str) -> DataFrame:
    recall = long.groupBy("candidate", y).agg(F.avg((F.col("guess") == F.col(y)).cast("double")).alias("_r"))
    return recall.groupBy("candidate").agg(F.avg("_r").alias("balanced_accuracy"))


def temperature_probs(probs: list[str], temperatures: list[float]) -> list[Column]:
    """Softmax of ``ln p_c / T_c``."""
    scaled = [F.ln(clip(p, 1e-10, 1.0)) / F.lit(float(t)) for p, t in zip(probs, temperatures)]
    peak = F.greatest(*scaled)
    parts = [F.exp(s - peak) for s in scaled]
    total = reduce(lambda a, b: a + b, parts)
    return [e / total for e in parts]


def temperature_scale(df: DataFrame, y: str, probs: list[str], grid: list[list[float]]) -> DataFrame:
    """Mean log loss per vector of class temperatures: ``(candidate, log_loss)``."""
    entries = []
    for i, ts in enumerate(grid):
        own = F.lit(None).cast("double")
        for c, e in enumerate(temperature_probs(probs, ts)):
            own = F.when(F.col(y) == c, e).otherwise(own)
        entries.append(F.struct(F.lit(i).alias("candidate"), (-F.ln(own)).alias("loss")))
    long = df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.candidate", "_e.loss")
    return long.groupBy("candidate").agg(F.avg("loss").alias("log_loss"))


def oracle_select(df: DataFrame, y: str, preds: list[str], features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per row the model with the smallest absolute error (ties: the first), and per model the rows won with feature means."""
    best = F.least(*[F.struct(F.abs(F.col(p) - F.col(y)).alias("e"), F.lit(i).alias("i"), F.lit(p).alias("model"), F.col(p).cast("double").alias("pred")) for i, p in enumerate(preds)])
    rows = df.withColumn("_b", best).withColumns({"best_model": F.col("_b.model"), "best_pred": F.col("_b.pred")}).drop("_b")
    table = rows.groupBy("best_model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("best_pred") - F.col(y))).alias("mae"), *[F.avg(f).alias(f"mean_{f}") for f in features]
    )
    return rows, table


def cell_blend(df: DataFrame, y: str, preds: list[str], cell: str, min_rows: int = 50, alpha: float = 1.0) -> DataFrame:
    """Ridge weights with intercept per cell that holds more than ``min_rows`` rows, plain mean elsewhere.

    The rows are reduced to cross products by one aggregate; only those small matrices reach Python.
    """
    k = len(preds)
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("sy")]
    sums += [F.sum(F.col(p)).alias(f"s{i}") for i, p in enumerate(preds)]
    sums += [F.sum(F.col(p) * F.col(y)).alias(f"b{i}") for i, p in enumerate(preds)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(preds) for j, b in enumerate(preds) if i <= j]
    table = df.groupBy(F.col(cell).cast("string").alias("_cell")).agg(*sums).filter(F.col("n") > min_rows)
    schema = "_cell string, " + ", ".join(f"_w{i} double" for i in range(k)) + ", _w0x double"

    def solve(batches):
        upper = [f"g{i}_{j}" for i in range(k) for j in range(i, k)]
        rows, columns = np.triu_indices(k)
        for pdf in batches:
            n, total = pdf["n"].to_numpy()[:, None], pdf["sy"].to_numpy()[:, None]
            s, b = (pdf[[f"{name}{i}" for i in range(k)]].to_numpy() for name in "sb")
            g = np.zeros((len(pdf), k, k))
            g[:, rows, columns] = g[:, columns, rows] = pdf[upper].to_numpy()
            centred = g - s[:, :, None] * s[:, None, :] / n[:, :, None] + alpha * np.eye(k)
            w = np.linalg.solve(centred, (b - s * total / n)[:, :, None])[:, :, 0]
            constant = (total - (s * w).sum(axis=1, keepdims=True)) / n
            out = pd.DataFrame(np.hstack([w, constant]), columns=[*[f"_w{i}" for i in range(k)], "_w0x"])
            out.insert(0, "_cell", pdf["_cell"].to_numpy())
            yield out

    weights = materialize(table.mapInPandas(solve, schema))
    out = lookup(df.withColumn("_cell", F.col(cell).cast("string")), weights, ["_cell"])
    fitted = reduce(lambda a, b: a + b, [F.col(p) * F.col(f"_w{i}") for i, p in enumerate(preds)]) + F.col("_w0x")
    return out.withColumn("blend", F.coalesce(fitted, weighted([F.col(p) for p in preds]))).drop("_cell", "_w0x", *[f"_w{i}" for i in range(k)])


def clip_predictions(df: DataFrame, pred: str, ref: DataFrame, y: str, qs: tuple[float, float] | None = None) -> DataFrame:
    """Predictions limited to the label's range, or to two of its quantiles."""
    if qs is None:
        ends = ref.agg(F.min(y).cast("double").alias("_lo"), F.max(y).cast("double").alias("_hi"))
    else:
        table = exact_quantiles(ref, [y], list(qs))
        ends = table.select(F.col(quantile_name(y, qs[0])).alias("_lo"), F.col(quantile_name(y, qs[1])).alias("_hi"))
    return attach_row(df, ends).withColumn(pred, clip(pred, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


RUN = 64


def values_at(ref: DataFrame, y: str, positions: DataFrame) -> DataFrame:
    """Order statistics: the value of ``y`` at each 0-based ``position`` of its sorted values.

    Positions and value ranges are cut into runs of 64 ranks, so a position meets at most 64 ranges.
    """
    counts = materialize(ref.filter(F.col(y).isNotNull()).groupBy(F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_n")))
    ranked = value_scan(counts, [], "_y", {"_from": F.col("_n")}, stored=True)
    runs = ranked.withColumn("_run", F.explode(F.sequence(F.floor(F.col("_from") / RUN), F.floor((F.col("_from") + F.col("_n") - 1) / RUN))))
    asked = positions.select("position").distinct().withColumn("_run", F.floor(F.col("position") / RUN))
    hit = (F.col("_from") <= F.col("position")) & (F.col("position") < F.col("_from") + F.col("_n"))
    return asked.join(runs, "_run").filter(hit).select("position", F.col("_y").alias("value"))


def quantile_match(df: DataFrame, pred: str, train: DataFrame, train_pred: str, y: str, name: str = "matched") -> DataFrame:
    """The prediction's share of train predictions at or below it, read as a percentile of the train label."""
    ref = train.select(F.col(train_pred).alias("_p"))
    table = rank_table(df.select(F.col(pred).alias("_p")), ref, "_p")
    share = table.select("_value", ((F.col("all_below") + F.col("all_equal")) / F.col("all_size")).alias("_share"))
    size = train.agg(F.count(y).alias("_size"))
    spots = attach_row(share, size).withColumn("_at", F.col("_share") * (F.col("_size") - 1))
    spots = materialize(spots.select("_value", F.floor("_at").alias("_lo"), F.ceil("_at").alias("_hi"), (F.col("_at") - F.floor("_at")).alias("_part")))
    asked = spots.select(F.explode(F.array("_lo", "_hi")).alias("position"))
    values = materialize(values_at(train, y, asked))
    for side in ("_lo", "_hi"):
        spots = join_on(spots, values.select(F.col("position").alias(side), F.col("value").alias(f"{side}_v")), [side])
    result = F.col("_lo_v") + (F.col("_hi_v") - F.col("_lo_v")) * F.col("_part")
    out = lookup(df.withColumn("_value", F.col(pred).cast("double")), materialize(spots.select("_value", result.alias(name))), ["_value"])
    return out.drop("_value")


def agreement_blend(df: DataFrame, preds: list[str], teacher: str) -> DataFrame:
    """Weighted mean with weights proportional to each model's correlation with the teacher model (its own being 1); a model
    that does not vary weighs 0."""
    ties = df.agg(*[(F.lit(1.0) if p == teacher else safe_corr(p, teacher)).alias(f"_w_{p}") for p in preds])
    out = attach_row(df, ties)
    weight = {p: F.coalesce(F.col(f"_w_{p}"), F.lit(0.0)) for p in preds}
    total = reduce(lambda a, b: a + b, weight.values())
    value = F.try_divide(reduce(lambda a, b: a + b, [F.col(p) * weight[p] for p in preds]), total)
    return out.withColumn("blend", value).drop(*[f"_w_{p}" for p in preds])


def rank_blend_scaled(df: DataFrame, preds: list[str], y: str, points: int = 100) -> DataFrame:
    """Mean average-rank of the models, mapped to the label scale through ``points`` evenly spaced label percentiles."""
    qs = [i / (points - 1) for i in range(points)]
    row = exact_quantiles(df, [y], qs)
    knots = row.select(F.array(*[F.col(quantile_name(y, q)) for q in qs]).alias("_knots"))
    size = df.agg(F.count(F.lit(1)).alias("_size"))
    ranked = attach_row(attach_row(pct_rank(df, preds, suffix="_rk"), knots), size)
    mean = weighted([F.col(f"{p}_rk") * F.col("_size") for p in preds])
    ranked = ranked.withColumn("_at", (mean - F.lit(1.0)) / (F.col("_size") - 1) * F.lit(float(points - 1)))
    low = F.least(F.greatest(F.floor("_at").cast("int"), F.lit(0)), F.lit(points - 2))
    ranked = ranked.withColumn("_i", low)
    left, right = F.element_at("_knots", F.col("_i") + 1), F.element_at("_knots", F.col("_i") + 2)
    value = left + (right - left) * (F.col("_at") - F.col("_i"))
    return ranked.withColumn("blend", value).select(*df.columns, "blend")


# ---------------------------------------------------------------------------------------------------------------
# fold-sealed combiners


def _nnls_logit(fit: DataFrame, y: str, preds: list[str], **_) -> Column:
    found = nnls_weights(fit, y, preds, logits=True)
    return weighted([to_logit(p) for p in preds], [found[p] for p in preds])


def _stack_logit(fit: DataFrame, y: str, preds: list[str], **_) -> Column:
    from foldwise.operators.models import stack_weights

    slopes, constant = stack_weights(fit, y, preds)
    return weighted([to_logit(p) for p in preds], slopes) + F.lit(constant)


#: A combiner is fitted on rows with percentile-rank columns ``<p>_rk`` beside the predictions and gives a blend expression.
COMBINERS = {
    "equal_rank": lambda fit, y, preds, **_: weighted([F.col(f"{p}_rk") for p in preds]),
    "mean_logit": lambda fit, y, preds, **_: weighted([to_logit(p) for p in preds]),
    "nnls_logit": _nnls_logit,
    "greedy_logit": lambda fit, y, preds, steps, candidates: weighted([to_logit(p) for p in greedy_select(fit, y, preds, steps, candidates)]),
    "stack_logit": _stack_logit,
}


def sealed_score(
    df: DataFrame, id: str, y: str, preds: list[str], fold: str, folds: int, kinds: list[str], steps: int = 5,
    candidates: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Each combiner applied to every fold with weights and legs chosen on the other folds only.

    Returns the rows with one sealed column per combiner, and ``(combiner, sealed, insample, optimism)``. The greedy combiner
    takes ``steps`` legs, from all models or the ``candidates`` strongest.
    """
    work = _ranked(df, [id, fold, y], preds)
    fits = [(kind, f) for kind in kinds for f in [*range(folds), None]]

    def fit(kind: str, f: int | None) -> Column:
        rows = work if f is None else work.filter(F.col(fold) != f)
        return COMBINERS[kind](rows, y, preds, steps=steps, candidates=candidates)

    found = dict(zip(fits, in_parallel(df.sparkSession, [lambda c=c: fit(*c) for c in fits])))
    sealed, inner = {}, {}
    for kind in kinds:
        choice = F.when(F.col(fold) == 0, found[(kind, 0)])
        for f in range(1, folds):
            choice = choice.when(F.col(fold) == f, found[(kind, f)])
        sealed[kind], inner[f"{kind}__in"] = choice, found[(kind, None)]
    rows = materialize(work.withColumns({**sealed, **inner}).select(id, fold, y, *sealed, *inner))
    scores = auc(rows, y, [*sealed, *inner]).select("model", "auc")
    base = F.regexp_replace("model", "__in$", "")
    inside = F.col("model").endswith("__in")
    table = scores.groupBy(base.alias("combiner")).agg(
        F.max(F.when(~inside, F.col("auc"))).alias("sealed"), F.max(F.when(inside, F.col("auc"))).alias("insample")
    )
    return rows.select(id, fold, y, *sealed), table.withColumn("optimism", F.col("insample") - F.col("sealed"))


def _ranked(df: DataFrame, keep: list[str], preds: list[str]) -> DataFrame:
    return materialize(pct_rank(df.select(*keep, *preds), preds, suffix="_rk"))


def combined_test(
    df: DataFrame, test: DataFrame, id: str, y: str, preds: list[str], kinds: list[str], steps: int = 5, candidates: int | None = None
) -> DataFrame:
    """Test predictions ``(id, kinds...)`` of combiners fitted on all labelled rows; ranks are taken within the test rows."""
    work, rows = _ranked(df, [id, y], preds), _ranked(test, [id], preds)
    fits = in_parallel(
        df.sparkSession, [lambda k=k: COMBINERS[k](work, y, preds, steps=steps, candidates=candidates) for k in kinds]
    )
    return rows.select(id, *[e.alias(k) for k, e in zip(kinds, fits)])


def pick_winner(table: DataFrame, order: list[str], band: float) -> DataFrame:
    """Of the combiners within ``band`` of the best sealed score, the first in the declared order."""
    best = table.agg(F.max("sealed").alias("_best"))
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("combiner"))
    near = attach_row(table, best).filter(F.col("_best") - F.col("sealed") <= F.lit(band)).drop("_best")
    return near.orderBy(place, F.col("sealed").desc()).limit(1)
