"""Whitening of feature rows: leading eigenvectors by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.kernels.store import materialize
from foldwise.llm.columns import id_type, quoted

#: Guard vectors beside the wanted ones: the spectrum below the block is what the filter damps.
LEAST_GUARD = 8
#: Residual of an eigenpair, relative to the largest eigenvalue, that counts as converged.
TOLERANCE = 1e-13
#: The filter may spread the columns of a block by this factor before they are made orthogonal again.
SPREAD = 1e9
MOST_DEGREE = 24
#: Partial results that go to the driver at once; more tasks are first summed in this many groups.
GROUPS = 64
#: Bytes of one vector block as doubles inside a task.
BLOCK_BYTES = 16 << 20
LIMB = 21


def quantised(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """Whole numbers ``floor(scale * entry) + shift`` of a vector of fractions; NULL where an entry or the vector is NULL, is not
    finite or leaves 64 bits."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**62 / scale)))
    return F.when(sound, F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift).cast("bigint")))


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation; its size depends on the vectors' length alone.

    ``totals`` are the exact sums per dimension, ``vectors`` has one unit eigenvector a column, ``values`` their eigenvalues,
    falling. An eigenvalue below 1e-12 of the largest counts as 0. ``residual`` is the largest ``|V q - e q|`` over the largest eigenvalue, ``certified`` whether it met the tolerance,
    ``passes`` how often the rows were read. ``identity_error`` is the largest absolute entry of the whitened covariance minus the
    identity, over the components of positive variance; None without any.
    """

    rows: int
    totals: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    certified: bool
    passes: int
    identity_error: float | None

    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace > 0 else None for e in self.values]


def _length(rows: DataFrame) -> int:
    """The most frequent length of the vectors, of equally frequent ones the largest; 0 without rows."""
    counts = rows.groupBy(F.size("features").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return counts["d"] if counts else 0


def usable(rows: DataFrame, id: str = "id", features: str = "features") -> DataFrame:
    """``(id, features)`` of the rows that take part, stored: vectors without NULL and of the most frequent length."""
    pairs = rows.select(quoted(id).alias("id"), quoted(features).cast("array<bigint>").alias("features"))
    kept = materialize(pairs.filter(F.col("features").isNotNull() & F.forall("features", lambda c: c.isNotNull())))
    return kept.filter(F.size("features") == _length(kept))


def _blocks(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """A batch of vectors as whole-number matrices of bounded size."""
    step = max(1, BLOCK_BYTES // (8 * max(d, 1)))
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _summed(fit: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple, kind: str) -> np.ndarray:
    """Sum over all blocks of what ``part`` makes of each: one small matrix a task, added up in a fixed order.

    Beyond ``GROUPS`` tasks their matrices are added in groups on the executors first, so the driver never gets more than
    ``GROUPS`` of them.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape, kind), False
        for batch in batches:
            for block in _blocks(batch.column(0), d):
                total += part(block)
                seen = True
        if seen:
            n = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "data"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(shape, kind), None
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = n if first is None else first
                total += np.frombuffer(data, kind).reshape(shape)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "data"])

    parts = fit.select("features").mapInArrow(one, "part int, data binary")
    if parts.rdd.getNumPartitions() > GROUPS:
        parts = parts.repartition(GROUPS, F.col("part") % GROUPS).sortWithinPartitions("part")
        parts = parts.mapInArrow(grouped, "part int, data binary")
    total = np.zeros(shape, kind)
    for row in sorted(parts.collect(), key=lambda r: r["part"]):
        total += np.frombuffer(row["data"], kind).reshape(shape)
    return total


def _limbs(x: np.ndarray) -> np.ndarray:
    """Three 21-bit limbs of whole numbers and a count: their sums stay exact in 64 bits for 2^41 rows."""
    mask = (1 << LIMB) - 1
    return np.stack([(x & mask).sum(0), ((x >> LIMB) & mask).sum(0), (x >> 2 * LIMB).sum(0), np.full(x.shape[1], len(x))])


def _scaled(x: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """``n * x - totals`` exactly: 64-bit whole numbers where they fit, else Python's."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max((abs(int(t)) for t in totals), default=0)
    return x * np.int64(n) - totals.astype(np.int64) if most < 1 << 62 else x.astype(object) * n - totals


def centred(x: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """``x - mean`` as doubles, subtracted in whole numbers before any rounding."""
    return _scaled(x, n, totals).astype(np.float64) / n


def filter_degree(fast: float, slow: float, cut: float, residual: float, goal: float) -> int:
    """Degree that should bring ``residual`` to ``goal`` at the wanted value ``slow``, within what the columns' spread allows."""
    rate = lambda e: math.acosh(max(2 * e / cut - 1, 1 + 1e-12))
    need = math.log(max(residual / goal, 10.0)) / max(rate(slow), 1e-6)
    allowed = math.log(SPREAD) / max(rate(fast) - rate(slow), 1e-6)
    return max(2, int(min(MOST_DEGREE, math.ceil(need), allowed)))


def leading_eigenpairs(
    apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int, tolerance: float = TOLERANCE, seed: int = 42
) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """``(values, vectors, residual, certified)`` of a positive semidefinite operator known by ``apply(Q) = V Q`` alone.

    A block of ``k + guard`` vectors is filtered by the Chebyshev polynomial that stays within 1 on the unwanted spectrum (from 0
    to the block's smallest Ritz value) and grows steeply above it; QR makes the block orthogonal, Rayleigh-Ritz turns it. The
    product of that step serves as the first term of the next recurrence. Leading pairs that have converged are locked: the
    recurrence runs on what is orthogonal to them, so a steep spectrum does not drown the rest. It ends when every wanted pair
    has a residual of at most ``tolerance`` times the largest value, or when rounding lets the residual fall no further.
    """
    b = min(d, k + guard)
    Q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))[0]
    best, stale = math.inf, 0
    while True:
        W = apply(Q)
        H = Q.T @ W
        values, U = np.linalg.eigh((H + H.T) / 2)
        values, U = values[::-1], U[:, ::-1]
        X, VX = Q @ U, W @ U
        top = max(float(values[0]), 0.0)
        norms = np.linalg.norm(VX - X * values, axis=0)[:k] / (top or 1.0)
        residual, locked = float(norms.max()), int(np.cumprod(norms <= tolerance).sum())
        progress = float(norms.sum())
        stale = stale + 1 if progress > best * 0.9 else 0
        best = min(best, progress)
        if locked == min(k, b) or top == 0 or stale >= (3 if residual < 1e-9 else 40):
            return values[:k], X[:, :k], residual, residual <= tolerance
        L = X[:, :locked]
        deflated = lambda Y: Y - L @ (L.T @ Y)
        cut = max(float(values[-1]), 1e-9 * top)
        half, fast = cut / 2, max(float(values[locked]), cut)
        sigma = first = half / max(fast - half, half)
        before, now = X[:, locked:], (deflated(VX[:, locked:]) - half * X[:, locked:]) * (first / half)
        for _ in range(filter_degree(fast, values[min(k, b) - 1], cut, residual, tolerance) - 1):
            onward = 1 / (2 / first - sigma)
            before, now = now, (deflated(apply(now)) - half * now) * (2 * onward / half) - sigma * onward * before
            sigma = onward
        Q = np.concatenate([L, np.linalg.qr(deflated(deflated(now)))[0]], axis=1)


def fit_whitening(fit: DataFrame, components: int = 32, tolerance: float = TOLERANCE) -> Whitening:
    """Eigenvectors of the covariance (divisor n) of all rows of ``usable``.

    No task or driver ever holds more than a ``d x block`` matrix beside one bounded block of rows: every product with the
    covariance is a pass that sums ``X'(XQ)`` over centred blocks. Sums are exact, and rows are centred in whole numbers
    before they are multiplied. Nothing is sampled.
    """
    d = _length(fit)
    k = min(components, d)
    passes = 0
    if not d:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, True, 0, None)

    def total(part: Callable[[np.ndarray], np.ndarray], shape: tuple, kind: str = "f8") -> np.ndarray:
        nonlocal passes
        passes += 1
        return _summed(fit, d, part, shape, kind)

    limbs = total(_limbs, (4, d), "i8")
    n = int(limbs[3, 0])
    exact = [int(a) + (int(b) << LIMB) + (int(c) << 2 * LIMB) for a, b, c in limbs[:3].T]
    totals = np.array(exact, object)

    def apply(Q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, totals)
            return c.T @ (c @ Q)

        return total(part, Q.shape) / n

    trace = float(total(lambda x: (centred(x, n, totals) ** 2).sum(0), (d,)).sum()) / n
    if trace == 0:
        return Whitening(n, tuple(exact), np.eye(d)[:, :k], np.zeros(k), 0.0, 0.0, True, passes, None)
    values, vectors, residual, certified = leading_eigenpairs(apply, d, k, max(LEAST_GUARD, k // 2), tolerance)
    if not certified:
        warnings.warn(f"residual {residual:.1e} of the eigenpairs is above {tolerance:.0e}", stacklevel=2)
    values = np.where(values > 1e-12 * values[0], values, 0.0)
    known = values > 0
    scale = vectors[:, known] / np.sqrt(values[known])
    m = int(known.sum())
    mean = total(lambda x: (centred(x, n, totals) @ scale).sum(0), (m,)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, totals) @ scale - mean
        return z.T @ z

    error = float(np.abs(total(spread, (m, m)) / n - np.eye(m)).max())
    return Whitening(n, tuple(exact), vectors, values, trace, residual, certified, passes, error)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """``(id, component, deviation, whitened)`` of rows of the model's length, a row per component from 1.

    ``deviation`` is the exact sum over dimensions of ``(n x - S)^2``, NULL beyond 38 digits; ``whitened`` is the projection on
    the component over the root of its eigenvalue, NULL for a component without variance.
    """
    n, totals = model.rows, np.array(model.totals, object)
    d, k = model.vectors.shape if n else (0, 0)
    known = model.values > 0
    scale = np.divide(model.vectors, np.sqrt(model.values), out=np.zeros((d, k)), where=known) if n else model.vectors
    wide = pa.decimal128(38, 0)

    def deviations(x: np.ndarray) -> pa.Array:
        c = _scaled(x, n, totals)
        if c.dtype != object and d * int(max(abs(int(c.max(initial=0))), abs(int(c.min(initial=0))))) ** 2 < 1 << 62:
            return pa.array((c * c).sum(1), pa.int64()).cast(wide)
        exact = (c.astype(object) ** 2).sum(1)
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1), d):
                ids = batch.column(0).slice(at, len(x))
                at += len(x)
                row = pa.array(np.repeat(np.arange(len(x)), k))
                component = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
                z = (centred(x, n, totals) @ scale).ravel()
                value = pa.array(z, mask=np.tile(~known, len(x)))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), component, deviations(x).take(row), value], ["id", "component", "deviation", "whitened"]
                )

    sound = rows.filter(F.size("features") == d) if n else rows.filter(F.lit(False))
    schema = f"id {id_type(rows, 'id')}, component int, deviation decimal(38,0), whitened double"
    return sound.select("id", "features").mapInArrow(run, schema)


def whiten(rows: DataFrame, id: str = "id", features: str = "features", components: int = 32) -> DataFrame:
    """Whiten whole-number feature rows, e.g. ``quantised`` outputs of one model per column, fitted on all of them.

    Returns ``(id, component, n, deviation, whitened, explained, identity_error)``, see ``whitened`` and ``Whitening``;
    ``explained`` is the component's share of the trace. There are as many components as asked for, at most the vectors'
    length. NULL vectors, vectors with a NULL entry and vectors of another than the most frequent length take no part; rows
    that share an id stay apart; further columns are ignored. No rows give no rows, one row (or equal ones) has NULL for
    ``whitened``, ``explained`` and ``identity_error``.
    """
    kept = usable(rows, id, features)
    model = fit_whitening(kept, components)
    found = whitened(kept, model)
    share = F.array(*[F.lit(v).cast("double") for v in model.explained()]) if model.rows else F.array(F.lit(None).cast("double"))
    return found.select(
        "id", "component", F.lit(model.rows).cast("bigint").alias("n"), "deviation", "whitened",
        F.try_element_at(share, F.col("component")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
