"""Linear models of many folds and arms fitted in common passes over the rows.

A fit is a set of cells (folds, or pairs of an outer and an inner fold) and a set of columns. One pass sums what every fit needs:
Gram matrices per cell, from which a least-squares fit of "all but this fold" is a subtraction, or gradients and
Hessians of all logistic fits at their own coefficients. The number of passes does not depend on the number of fits, and
what a pass returns has the size of the coefficients.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.kernels.sums import matrix, summed


@dataclass(frozen=True)
class FoldLearner:
    """``logistic`` (two classes), ``softmax`` (``classes`` of them) or ``ridge``, with an intercept.

    ``reg`` is the L2 penalty on coefficients of columns scaled by their deviation among the fit rows, beside a mean loss (mean
    log loss; half the mean squared error). Fits end when no gradient entry is above ``tolerance``; ``iterations`` limits the
    Newton steps and is announced by a warning if it ends a fit.
    """

    kind: str = "logistic"
    reg: float = 0.0
    scaled: bool = True
    tolerance: float = 1e-10
    iterations: int | None = None
    classes: int = 2


@dataclass(frozen=True)
class Fit:
    """The cells whose rows a fit may see, and the places of its columns (all of them by default)."""

    cells: frozenset[int]
    columns: tuple[int, ...] | None = None


@dataclass(frozen=True)
class LinearModel:
    """Intercepts and coefficients (zero for columns a fit did not have), a row per class of a softmax; None without fit rows."""

    kind: str
    intercepts: tuple[float, ...] | None
    coefficients: tuple[tuple[float, ...], ...]

    @property
    def coefs(self) -> list[float]:
        return [*(self.intercepts or ()), *[v for row in self.coefficients for v in row]]


def _margin(x: Column, flat: Column, row: int, rows: int, width: int) -> Column:
    """Intercept and products for one class, from coefficients laid out as in ``coefs``."""
    terms = [F.get(flat, F.lit(rows + row * width + j)) * F.get(x, F.lit(j)) for j in range(width)]
    return reduce(lambda a, b: a + b, terms, F.get(flat, F.lit(row)))


def _response(kind: str, margins: list[Column]) -> list[Column]:
    if kind == "ridge":
        return margins
    if kind == "logistic":
        return [F.lit(1.0) / (F.lit(1.0) + F.exp(-margins[0]))]
    top = F.greatest(*margins) if len(margins) > 1 else margins[0]
    powers = [F.exp(m - top) for m in margins]
    total = reduce(lambda a, b: a + b, powers)
    return [p / total for p in powers]


def margins(models: list[LinearModel], x: Column, which: Column | None = None) -> list[Column]:
    """Linear predictor per class, with the model number ``which`` of each row (the first by default); NULL without fit rows."""
    rows = max(1, *[len(m.coefficients) for m in models])
    width = max((len(m.coefficients[0]) for m in models if m.coefficients), default=0)
    listed = F.array(*[F.array(*[F.lit(v) for v in m.coefs]).cast("array<double>") if m.intercepts else F.lit(None).cast("array<double>") for m in models])
    flat = F.get(listed, F.lit(0) if which is None else which.cast("int"))
    return [_margin(x, flat, r, rows, width) for r in range(rows)]


def responses(models: list[LinearModel], x: Column, which: Column | None = None) -> list[Column]:
    """Value, probability of class 1, or the probabilities of all classes, from an array column: a JVM-side expression."""
    return _response(models[0].kind, margins(models, x, which))


def class_probabilities(df: DataFrame, model: LinearModel, x: Column, name: str) -> DataFrame:
    """``df`` with an array column of the class probabilities of a softmax; every margin is computed once."""
    out = df.withColumn("_margins", F.array(*margins([model], x)))
    out = out.withColumn("_powers", F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins"))))
    total = F.aggregate("_powers", F.lit(0.0), lambda a, b: a + b)
    return out.withColumn("_total", total).withColumn(name, F.transform("_powers", lambda e: e / F.col("_total"))).drop("_margins", "_powers", "_total")


class _Rows:
    """Narrow view of the fit rows: features as an array, label, cell, weight."""

    def __init__(self, df: DataFrame, vector: str, y: str, cell: str | None, weight: str | None):
        number = lambda c, default: (F.lit(default) if c is None else F.col(c)).cast("double")
        self.df = df.select(vector_to_array(vector).alias("x"), F.col(y).cast("double").alias("y"), number(cell, 0.0).alias("c"), number(weight, 1.0).alias("w"))
        first = self.df.select(F.size("x")).first()
        self.width = 0 if first is None else first[0]


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, label, cell and weight of a batch of fit rows."""
    y, c, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    return matrix(batch.column(0), width), y, c.astype(int), w


def _moments(rows: _Rows, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Global centre, and per cell the weighted Gram matrix of ``(1, x - centre, y - centre)``: two passes."""
    width = rows.width
    p = width + 2

    def extended(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, c, w = _read(batch, width)
        return np.column_stack([np.ones(len(x)), x, y]), c, w

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        e, _, w = extended(batch)
        return w @ e

    total = summed(rows.df, sums, p)
    centre = total / total[0] if total[0] else np.zeros(p)
    centre[0] = 0.0

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        e, c, w = extended(batch)
        e = e - centre
        out = np.zeros((cells, p, p))
        for k in np.unique(c):
            own = c == k
            out[k] = (e[own] * w[own, None]).T @ e[own]
        return out.ravel()

    return centre, summed(rows.df, gram, cells * p * p).reshape(cells, p, p)


def _spread(gram: np.ndarray) -> np.ndarray:
    """Variances of the features from a Gram matrix, 0 for columns that do not vary beyond rounding."""
    n = gram[0, 0]
    mean, square = gram[0, 1:-1] / n, np.diag(gram)[1:-1] / n
    variance = square - mean * mean
    return np.where(variance > 1e-14 * np.maximum(square, 1e-300), variance, 0.0)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-norm solution of a symmetric positive semidefinite system, scaled to unit diagonal first."""
    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    return np.linalg.lstsq(a / np.outer(d, d), b / d, rcond=1e-12)[0] / d


def _ridge(gram: np.ndarray, centre: np.ndarray, fit: Fit, learner: FoldLearner, width: int) -> LinearModel:
    n = gram[0, 0]
    at = np.array(fit.columns, int) + 1
    mx, my = gram[0, at] / n, gram[0, -1] / n
    sxx = gram[np.ix_(at, at)] / n - np.outer(mx, mx)
    sxy = gram[at, -1] / n - mx * my
    penalty = _spread(gram)[at - 1] if learner.scaled else np.ones(len(at))
    beta = np.zeros(width)
    beta[at - 1] = _solve(sxx + learner.reg * np.diag(penalty), sxy) if len(at) else []
    intercept = centre[-1] + my - float(beta @ (centre[1:-1] + gram[0, 1:-1] / n))
    return LinearModel("ridge", (intercept,), (tuple(beta.tolist()),))


def _newton_terms(z: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, classes: int) -> np.ndarray:
    """Loss, gradient and Hessian of a log loss at ``beta`` (a row per free class), laid out flat."""
    eta = z @ beta.T
    if classes == 2 and len(beta) == 1:
        mu = 1 / (1 + np.exp(-np.clip(eta[:, 0], -700, 700)))
        loss = w @ (np.logaddexp(0, eta[:, 0]) - y * eta[:, 0])
        return np.concatenate([[loss], z.T @ (w * (mu - y)), ((z * (w * mu * (1 - mu))[:, None]).T @ z).ravel()])
    top = eta.max(axis=1, keepdims=True)
    power = np.exp(eta - top)
    prob = power / power.sum(axis=1, keepdims=True)
    hit = y[:, None] == np.arange(classes)
    loss = w @ (np.log(power.sum(axis=1)) + top[:, 0] - (eta * hit).sum(axis=1))
    k, p = beta.shape
    hess = np.zeros((k, p, k, p))
    for a in range(k):
        for b in range(a, k):
            own = w * prob[:, a] * ((a == b) - prob[:, b])
            hess[a, :, b, :] = hess[b, :, a, :] = (z * own[:, None]).T @ z
    return np.concatenate([[loss], (((prob - hit) * w[:, None]).T @ z).ravel(), hess.ravel()])


def _logistic(rows: _Rows, fits: list[Fit], grams: list[np.ndarray], centre: np.ndarray, learner: FoldLearner) -> list[LinearModel | None]:
    """Newton's method for all fits side by side; steps are halved where the loss would grow."""
    k = 1 if learner.kind == "logistic" else learner.classes
    sizes = np.array([g[0, 0] for g in grams])
    overall = np.sqrt(_spread(sum(grams))) if sizes.sum() else np.ones(rows.width)
    overall = np.where(overall > 0, overall, 1.0)
    places = [np.array((0, *[c + 1 for c in f.columns])) for f in fits]
    penalty = [np.concatenate([[0.0], ((_spread(g) / overall**2 if learner.scaled else 1 / overall**2)[list(f.columns)])]) * learner.reg if n else np.zeros(len(f.columns) + 1) for f, g, n in zip(fits, grams, sizes)]
    beta = [np.zeros((k, len(p))) for p in places]
    step: list[np.ndarray | None] = [None] * len(fits)
    last = [np.inf] * len(fits)
    active = [i for i, n in enumerate(sizes) if n > 0]
    lengths = [1 + k * len(p) + (k * len(p)) ** 2 for p in places]
    rounds, width, classes, cells = 0, rows.width, learner.classes, [sorted(f.cells) for f in fits]
    while active:
        now, asked = {i: beta[i] for i in active}, list(active)

        def part(batch: pa.RecordBatch) -> np.ndarray:
            x, y, c, w = _read(batch, width)
            z = np.column_stack([np.ones(len(x)), (x - centre[1:-1]) / overall])
            out = []
            for i in asked:
                own = np.isin(c, cells[i])
                out.append(_newton_terms(z[own][:, places[i]], y[own], w[own], now[i], classes))
            return np.concatenate(out)

        found = summed(rows.df, part, sum(lengths[i] for i in asked))
        rounds += 1
        at = 0
        for i in asked:
            flat, m = found[at : at + lengths[i]] / sizes[i], k * len(places[i])
            at += lengths[i]
            v = np.tile(penalty[i], k)
            b = beta[i].ravel()
            loss = flat[0] + 0.5 * float(v @ (b * b))
            if not np.isfinite(flat).all() and step[i] is None:
                raise ValueError("features, labels and weights of a fit must be finite")
            loss = loss if np.isfinite(flat).all() else np.inf
            if loss > last[i] + 1e-13 * max(1.0, abs(last[i])) and step[i] is not None and np.abs(step[i]).max() > 1e-12:
                step[i] = step[i] / 2
                beta[i] = beta[i] - step[i].reshape(beta[i].shape)
                continue
            last[i] = loss
            gradient = flat[1 : 1 + m] + v * b
            if np.abs(gradient).max() <= learner.tolerance or (learner.iterations is not None and rounds > learner.iterations):
                if np.abs(gradient).max() > learner.tolerance:
                    warnings.warn(f"a logistic fit ended after {learner.iterations} steps with a gradient of {np.abs(gradient).max():.1e}", stacklevel=2)
                active.remove(i)
                continue
            step[i] = -_solve(flat[1 + m :].reshape(m, m) + np.diag(v), gradient)
            beta[i] = beta[i] + step[i].reshape(beta[i].shape)
    models: list[LinearModel | None] = []
    for f, n, b, p in zip(fits, sizes, beta, places):
        if not n:
            models.append(LinearModel(learner.kind, None, ()))
            continue
        full = np.zeros((k, rows.width))
        full[:, p[1:] - 1] = b[:, 1:] / overall[p[1:] - 1]
        intercepts = b[:, 0] - full @ centre[1:-1]
        models.append(LinearModel(learner.kind, tuple(intercepts.tolist()), tuple(tuple(r) for r in full.tolist())))
    return models


def fit_many(
    df: DataFrame, vector: str, y: str, fits: list[Fit], learner: FoldLearner, cell: str | None = None, cells: int = 1, weight: str | None = None
) -> list[LinearModel]:
    """One model per fit. ``df`` should be stored, since it is read once per pass: two passes for the moments and, for logistic fits,
    one per Newton step of the slowest fit. A fit whose cells have no rows predicts NULL; rows with a NULL label are left out."""
    rows = _Rows(df.filter(F.col(y).isNotNull()), vector, y, cell, weight)
    if not rows.width:
        return [LinearModel(learner.kind, None, ()) for _ in fits]
    fits = [f if f.columns is not None else replace(f, columns=tuple(range(rows.width))) for f in fits]
    centre, per_cell = _moments(rows, cells)
    grams = [per_cell[sorted(f.cells)].sum(axis=0) for f in fits]
    if learner.kind == "ridge":
        return [_ridge(g, centre, f, learner, rows.width) if g[0, 0] else LinearModel("ridge", None, ()) for f, g in zip(fits, grams)]
    if learner.kind == "softmax":
        top = rows.df.agg(F.max("y")).first()[0]
        learner = replace(learner, classes=int(top) + 1)
    return _logistic(rows, fits, grams, centre, learner)


def all_but(folds: int, columns: tuple[int, ...] | None = None, cells: int | None = None) -> list[Fit]:
    """A fit per fold on the rows of all other cells, of which the first ``folds`` are the folds."""
    return [Fit(frozenset(range(cells or folds)) - {f}, columns) for f in range(folds)]


def boosted_residuals(
    df: DataFrame, vector: str, y: str, fold: str, folds: int, learner: FoldLearner, alpha: float, rounds: int
) -> tuple[list[list[LinearModel]], list[float]]:
    """Ridge models per round and fold of the residual that the earlier rounds left, and the error of each round.

    A round takes ``alpha`` times the out-of-fold prediction off the label, which is linear in the features within a fold. So the Gram
    matrices of the next round follow from those of this one, and the rows are read for the first round only.
    """
    rows = _Rows(df.filter(F.col(y).isNotNull()), vector, y, fold, None)
    centre, grams = _moments(rows, folds)
    found, errors = [], []

    def without(gram: np.ndarray, model: LinearModel, share: float) -> np.ndarray:
        turn = np.eye(len(gram))
        b = np.array(model.coefficients[0])
        turn[-1, 0], turn[-1, 1:-1] = -share * (model.intercepts[0] + b @ centre[1:-1]), -share * b
        return turn @ gram @ turn.T

    for _ in range(rounds):
        models = []
        for fit in all_but(folds, tuple(range(rows.width))):
            gram = grams[sorted(fit.cells)].sum(axis=0)
            if not gram[0, 0]:
                raise ValueError("every fold needs rows in another fold")
            models.append(_ridge(gram, centre, fit, learner, rows.width))
        left = sum(without(g, m, 1.0) for g, m in zip(grams, models))
        square = left[-1, -1] + 2 * centre[-1] * left[0, -1] + centre[-1] ** 2 * left[0, 0]
        errors.append(float(np.sqrt(max(square, 0.0) / left[0, 0])))
        grams = np.array([without(g, m, alpha) for g, m in zip(grams, models)])
        found.append(models)
    return found, errors
