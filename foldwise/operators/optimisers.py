"""Continuous fits and exact searches over predictions: temperatures by a quasi-Newton loop, thresholds by one sweep, blend weights
and exponent by a moving simplex.

Every evaluation of a loop is one small aggregate over the rows; the sweep counts distinct scores once.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.scalar import clip
from foldwise.kernels.blocks import cell_counts, packed, unpacked
from foldwise.kernels.scan import running_max, value_scan
from foldwise.kernels.store import materialize
from foldwise.kernels.sums import matrix, summed
from foldwise.operators.blending import score_candidates
from foldwise.operators.metrics import BINS

#: Differences of balanced accuracy below this many digits are ties.
DIGITS = 12
#: Probabilities are kept this far from 0 and 1 before a power or logarithm.
PROB_EPS = 1e-6
#: Blends counted in one job.
SCORED_AT_ONCE = 16


def lbfgs(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float = 1e-8, memory: int = 8
) -> tuple[np.ndarray, float, np.ndarray]:
    """Minimum of a smooth function by limited-memory quasi-Newton steps: ``(point, value, gradient)``.

    The direction comes from the last ``memory`` pairs of moves and gradient changes; a step is halved until the value falls
    enough. Ends when no gradient entry is above ``tolerance``, or with a warning where rounding lets the value fall no further.
    """
    x = np.asarray(start, float)
    value, gradient = evaluate(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while np.abs(gradient).max(initial=0.0) > tolerance:
        direction, weights = gradient.copy(), []
        for s, g in reversed(pairs):
            weights.append(float(s @ direction) / float(s @ g))
            direction -= weights[-1] * g
        if pairs:
            s, g = pairs[-1]
            direction *= float(s @ g) / float(g @ g)
        else:
            direction /= max(1.0, float(np.linalg.norm(gradient)))
        for (s, g), w in zip(pairs, reversed(weights)):
            direction += s * (w - float(g @ direction) / float(s @ g))
        slope, step = -float(gradient @ direction), 1.0
        while True:
            moved = x - step * direction
            new, at = evaluate(moved)
            if np.isfinite(new) and new <= value + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-12:
                if pairs:
                    pairs, step = [], 0.0
                    break
                warnings.warn(f"the search ended with a gradient of {np.abs(gradient).max():.1e}", stacklevel=2)
                return x, value, gradient
        if step == 0.0:
            continue
        s, g = moved - x, at - gradient
        if float(s @ g) > 1e-14 * float(g @ g):
            pairs = [*pairs, (s, g)][-memory:]
        x, value, gradient = moved, new, at
    return x, value, gradient


@dataclass(frozen=True)
class Temperatures:
    """One temperature per class, the mean log loss they give, and the largest entry of its gradient (by log temperature)."""

    values: tuple[float, ...]
    log_loss: float
    gradient: float


def fit_temperatures(df: DataFrame, y: str, probs: list[str], shared: bool = False, tolerance: float = 1e-8) -> Temperatures:
    """Temperatures of ``softmax(ln p_c / T_c)`` with the least mean log loss for labels 0, 1, ...; one for all classes if ``shared``.

    The search runs over ``ln T``, so temperatures stay positive. Rows with a NULL label or probability do not count;
    no rows give temperatures of 1.
    """
    k = len(probs)
    logs = F.array(*[F.ln(clip(F.col(p).cast("double"), 1e-10, 1.0)) for p in probs])
    known = df.filter(F.col(y).isNotNull() & ~F.exists(F.array(*[F.col(p).isNull() for p in probs]), lambda b: b))
    rows = materialize(known.select(logs.alias("z"), F.col(y).cast("int").alias("y")))
    n = rows.count()
    if not n:
        return Temperatures((1.0,) * k, 0.0, 0.0)

    def evaluate(log_t: np.ndarray) -> tuple[float, np.ndarray]:
        beta = np.exp(-np.broadcast_to(log_t, k))

        def part(batch: pa.RecordBatch) -> np.ndarray:
            z, label = matrix(batch.column(0), k), batch.column(1).to_numpy(zero_copy_only=False)
            eta = z * beta
            top = eta.max(axis=1, keepdims=True)
            power = np.exp(eta - top)
            total = power.sum(axis=1, keepdims=True)
            loss = (np.log(total) + top)[:, 0] - eta[np.arange(len(z)), label]
            slope = ((power / total - (label[:, None] == np.arange(k))) * eta).sum(axis=0)
            return np.concatenate([[loss.sum()], -slope])

        out = summed(rows, part, 1 + k) / n
        return float(out[0]), np.array([out[1:].sum()]) if shared else out[1:]

    log_t, loss, gradient = lbfgs(evaluate, np.zeros(1 if shared else k), tolerance)
    return Temperatures(tuple(np.exp(np.broadcast_to(log_t, k)).tolist()), loss, float(np.abs(gradient).max()))


def sweep_threshold(df: DataFrame, y: str, score: str) -> DataFrame:
    """``(threshold, balanced_accuracy)``: the best rule "1 from the threshold on" over all distinct scores, ties to the smallest."""
    counts = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).cast("double").alias("s"))
    table = materialize(counts.agg(*[F.count(F.when(F.col(y) == c, 1)).alias(f"n{c}") for c in (0, 1)]))
    before = value_scan(table, [], "s", {"b0": F.col("n0"), "b1": F.col("n1")}, stored=True)
    n0, n1 = table.agg(F.sum("n0"), F.sum("n1")).first()
    value = F.round((F.try_divide(F.col("b0"), F.lit(n0)) + F.lit(1.0) - F.try_divide(F.col("b1"), F.lit(n1))) / 2, DIGITS)
    return before.select(F.col("s").alias("threshold"), value.alias("balanced_accuracy")).orderBy(F.desc("balanced_accuracy"), "threshold").limit(1)


def sweep_two_thresholds(df: DataFrame, y: str, score: str) -> DataFrame:
    """``(low, high, balanced_accuracy)``: the best cuts of one score into classes 0 (below ``low``), 2 (from ``high`` on) and 1 between.

    Exact over all pairs of distinct scores with ``low <= high``, without a grid: the balanced accuracy is a part that depends on ``low``
    plus one that depends on ``high``, so for every ``high`` the best ``low`` is a running maximum over the sorted distinct scores. Ties go
    to the smallest ``high``, then the smallest ``low``. Scores and labels that are NULL do not count.
    """
    counts = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).cast("double").alias("s"))
    table = materialize(counts.agg(*[F.count(F.when(F.col(y) == c, 1)).alias(f"n{c}") for c in (0, 1, 2)]))
    before = materialize(value_scan(table, [], "s", {f"b{c}": F.col(f"n{c}") for c in (0, 1, 2)}, stored=True))
    totals = table.agg(*[F.sum(f"n{c}") for c in (0, 1, 2)]).first()
    share = lambda c: F.coalesce(F.try_divide(F.col(f"b{c}"), F.lit(totals[c])), F.lit(0.0))
    own = F.struct(F.round(share(0) - share(1), DIGITS).alias("v"), (-F.col("s")).alias("s"))
    swept = running_max(before, "s", own, "best")
    value = F.round((F.col("best.v") + share(1) + F.lit(1.0) - share(2)) / 3, DIGITS)
    found = swept.select((-F.col("best.s")).alias("low"), F.col("s").alias("high"), value.alias("balanced_accuracy"))
    return found.orderBy(F.desc("balanced_accuracy"), "high").limit(1)


@dataclass(frozen=True)
class PowerBlend:
    """Weights (summing to 1) and exponent of a power mean, its exact AUC, and the steps of the search."""

    weights: dict[str, float]
    p: float
    auc: float
    steps: int


def power_score(preds: list[str], weights: np.ndarray, p: float) -> Column:
    """A score that orders rows as the weighted power mean ``(sum w x^p)^(1/p)`` does; ``p = 0`` is the geometric mean."""
    shape = lambda m: clip(m, PROB_EPS, 1.0 - PROB_EPS)
    if abs(p) < 1e-9:
        terms = [F.ln(shape(m)) for m in preds]
    else:
        terms = [F.pow(shape(m), F.lit(float(p))) * F.lit(math.copysign(1.0, p)) for m in preds]
    return reduce(lambda a, b: a + b, [t * F.lit(float(w)) for t, w in zip(terms, weights)])


def power_shape(x: np.ndarray, p: float) -> np.ndarray:
    inside = np.clip(x, PROB_EPS, 1.0 - PROB_EPS)
    return np.log(inside) if abs(p) < 1e-9 else math.copysign(1.0, p) * inside**p


def binned_areas(blocks: DataFrame, ranges: list[tuple[float, float]], blends: list[tuple[np.ndarray, float]]) -> list[float]:
    """Area of every ``(weights, p)`` over packed predictions and labels, pairs that share a cell counted as half.

    Every task counts its rows in ``BINS`` cells per blend; these counts are what is added up, whatever the number of rows. Powers
    are taken once per exponent and distinct value of a block.
    """
    size = (BINS + 1) * 2
    ends = [[weights @ power_shape(np.array(ranges, float)[:, i], p) for i in (0, 1)] for weights, p in blends]
    powers = sorted({p for _, p in blends})

    def part(batch: pa.RecordBatch) -> np.ndarray:
        found = np.zeros((len(blends), size))
        for y, values, codes in unpacked(batch):
            for power in powers:
                x = np.column_stack([power_shape(v, power)[c] for v, c in zip(values, codes)])
                for i, ((weights, p), (low, high)) in enumerate(zip(blends, ends)):
                    if p == power:
                        found[i] += cell_counts(x @ weights, y, low, high, BINS)
        return found.ravel()

    found = summed(blocks, part, size * len(blends)).reshape(len(blends), BINS + 1, 2)
    neg, pos = found[:, :, 0], found[:, :, 1]
    won = (pos * (np.cumsum(neg, axis=1) - neg / 2)).sum(axis=1)
    return [round(float(v), DIGITS) for v in won / (pos.sum(axis=1) * neg.sum(axis=1))]


def simplex_climb(
    evaluate: Callable[[list[np.ndarray]], list[float]], start: list[np.ndarray], values: list[float], gain: float, width: float
) -> tuple[np.ndarray, float, int]:
    """Largest value by a simplex that reflects, expands, contracts or shrinks: ``(point, value, steps)``.

    All points that a step might need are evaluated in one call, those of a shrink included, so a step is one job. Ends when
    the values of the simplex lie within ``gain`` or its points within ``width`` of the best.
    """
    points, steps = [np.asarray(s, float) for s in start], 0
    values = list(values)
    while True:
        order = sorted(range(len(points)), key=lambda i: (-values[i], i))
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[0] - values[-1] <= gain or max(np.abs(q - points[0]).max() for q in points) <= width:
            return points[0], values[0], steps
        centre = np.mean(points[:-1], axis=0)
        away = centre - points[-1]
        shrunk = [points[0] + (q - points[0]) / 2 for q in points[1:]]
        trials = [centre + away, centre + 2 * away, centre + away / 2, centre - away / 2, *shrunk]
        reflected, expanded, outside, inside, *small = evaluate(trials)
        steps += 1
        if reflected > values[0]:
            taken = 1 if expanded > reflected else 0
        elif reflected > values[-2]:
            taken = 0
        elif reflected > values[-1] and outside >= reflected:
            taken = 2
        elif inside > values[-1]:
            taken = 3
        else:
            points, values = [points[0], *shrunk], [values[0], *small]
            continue
        points[-1], values[-1] = trials[taken], [reflected, expanded, outside, inside][taken]


def fit_power_blend(
    df: DataFrame, y: str, preds: list[str], exponents: list[float] = [0.5, 1.0, 2.0], parts: int = 4, gain: float = 1e-7, width: float = 1e-4
) -> PowerBlend:
    """Continuous weights and exponent of the power mean with the largest AUC.

    First every mix in steps of ``1 / parts`` is scored under every start exponent; a simplex around the best of them then moves
    freely, and starts again around its end with half the spread until that gains no more than ``gain``. Weights below 0 count as 0. The
    search compares areas of binned counts, half a megabyte per task whatever the rows; where it ends is compared exactly with
    where it began, and the better one is returned. No randomness: equal rows give equal results.
    Rows where a prediction or the label is NULL do not count; without both classes the mix is the plain mean.
    """
    k = len(preds)
    known = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [y, *preds]]))
    rows = materialize(known.select(y, *[F.col(p).cast("double").alias(p) for p in preds]))
    found = rows.agg(*[f(p) for p in preds for f in (F.min, F.max)], F.count_distinct(y)).first()
    if found[2 * k] < 2:
        return PowerBlend(dict.fromkeys(preds, 1.0 / k), 1.0, float("nan"), 0)
    ranges = [(found[2 * i], found[2 * i + 1]) for i in range(k)]

    def split(point: np.ndarray) -> tuple[np.ndarray, float]:
        raw = np.maximum(np.append(point[:-1], 1.0 - point[:-1].sum()), 0.0)
        return raw / raw.sum(), float(point[-1])

    blocks = packed(rows, preds, y)

    def binned(points: list[np.ndarray]) -> list[float]:
        starts = range(0, len(points), SCORED_AT_ONCE)
        return [v for at in starts for v in binned_areas(blocks, ranges, [split(q) for q in points[at : at + SCORED_AT_ONCE]])]

    mixes = [np.array(c, float) / parts for c in product(range(parts + 1), repeat=k) if sum(c) == parts]
    grid = [np.append(m[:-1], p) for p in exponents for m in mixes]
    first = binned(grid)
    top = max(range(len(grid)), key=lambda i: (first[i], -i))
    best, value, steps, spread = grid[top], first[top], 0, 0.5 / parts
    while True:
        corners = [best + spread * e * (-1.0 if j < k - 1 and best[j] + spread > 1.0 else 1.0) for j, e in enumerate(np.eye(k))]
        moved, reached, more = simplex_climb(binned, [best, *corners], [value, *binned(corners)], gain, width)
        gained, best, value, steps, spread = reached - value, moved, reached, steps + more, spread / 2
        if gained <= gain or spread <= width:
            break
    ends = [split(best), split(grid[top])]
    exact = {r["candidate"]: r["auc"] for r in score_candidates(rows, y, [power_score(preds, *e) for e in ends]).collect()}
    pick = max(range(2), key=lambda i: (exact[i], -i))
    return PowerBlend(dict(zip(preds, ends[pick][0].tolist())), ends[pick][1], exact[pick], steps)
