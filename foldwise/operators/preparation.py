"""Filling, scaling and pruning of columns before a model; every statistic comes from the fit rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldwise.functions.scalar import normal_quantile
from foldwise.kernels.lookup import attach_row
from foldwise.kernels.quantiles import exact_quantiles, quantile_name
from foldwise.kernels.sums import matrix, summed
from foldwise.operators.metrics import corr_pairs
from foldwise.operators.reference import _drop_parts, _ranked, rank_table


def fill_medians(df: DataFrame, fit: DataFrame, numeric: list[str], categorical: list[str] | None = None) -> DataFrame:
    """Median of the fit rows for numbers, first level of the fit rows for text; a NULL that is left stops the job."""
    categorical = categorical or []
    medians = exact_quantiles(fit, numeric, [0.5])
    out = attach_row(df, medians)
    if categorical:
        out = attach_row(out, fit.agg(*[F.min(c).alias(f"_first_{c}") for c in categorical]))
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(quantile_name(c, 0.5))) for c in numeric}
    filled |= {c: F.coalesce(F.col(c), F.col(f"_first_{c}")) for c in categorical}
    checked = {c: F.when(e.isNull(), F.raise_error(F.lit(f"NULL left in {c}"))).otherwise(e) for c, e in filled.items()}
    return out.withColumns(checked).select(*df.columns)


def standard_scale(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """``<c>_std``: (x - mean) / population deviation; a constant column gives 0."""
    stats = fit.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    out = attach_row(df, stats)
    spread = {c: F.when(F.col(f"_sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_sd_{c}")) for c in columns}
    out = out.withColumns({f"{c}_std": (F.col(c) - F.col(f"_mu_{c}")) / spread[c] for c in columns})
    return out.drop(*stats.columns)


def robust_scale(df: DataFrame, fit: DataFrame, columns: list[str], smooth_clip: bool = False, l2: bool = False) -> DataFrame:
    """``<c>_rob``: (x - median) / IQR; with IQR 0 half the range, with range 0 the result is 0.

    ``smooth_clip`` maps x to x / sqrt(1 + (x/3)^2); ``l2`` scales the row of results to unit length.
    """
    stats = exact_quantiles(fit, columns, [0.25, 0.5, 0.75])
    ends = fit.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = attach_row(attach_row(df, stats), ends)
    new = {}
    for c in columns:
        q1, q2, q3 = (F.col(quantile_name(c, q)) for q in (0.25, 0.5, 0.75))
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        factor = F.when(q3 != q1, F.lit(1.0) / F.nullif(q3 - q1, F.lit(0.0))).when(span > 0, F.lit(2.0) / F.nullif(span, F.lit(0.0))).otherwise(0.0)
        x = (F.col(c) - q2) * factor
        new[f"{c}_rob"] = x
    out = out.withColumns(new)
    if smooth_clip:
        third = {n: F.col(n) / F.lit(3.0) for n in new}
        out = out.withColumns({n: F.col(n) / F.sqrt(F.lit(1.0) + third[n] * third[n]) for n in new})
    if l2:
        total = F.lit(0.0)
        for n in new:
            total = total + F.coalesce(F.col(n) * F.col(n), F.lit(0.0))
        out = out.withColumn("_norm", F.sqrt(total))
        out = out.withColumns({n: F.when(F.col("_norm") > 0, F.col(n) / F.col("_norm")).otherwise(F.col(n)) for n in new})
    return out.select(*df.columns, *new)


def quantile_normal(df: DataFrame, fit: DataFrame, columns: list[str], edge: float = 1e-7) -> DataFrame:
    """``<c>_norm``: normal quantile of the mid-rank share in the fit rows, the share clipped to ``[edge, 1 - edge]``."""
    out = df
    for c in columns:
        out = _ranked(out, rank_table(df, fit, c), c, [])
        share = (F.col("all_below") * 2 + F.col("all_equal")) / (F.col("all_size") * 2)
        inside = F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(edge)), F.lit(1.0 - edge)))
        out = _drop_parts(out.withColumn(f"{c}_norm", normal_quantile(inside)), ["all"])
    return out


#: Random sign projections that make up the signature of a column.
PROJECTIONS = 16
#: Signatures of columns with |r| above 1 - 1e-12 differ by 1.4e-6 in standard deviation; this is over 14 times as much.
SIGNATURE_GAP = 2e-5


def column_signatures(df: DataFrame, columns: list[str], means: list[float], scales: list[float]) -> np.ndarray:
    """One row of ``PROJECTIONS`` numbers per complete column: the standardised column against rows of random signs.

    A row's signs are bits of the hash of its values. One pass, a small table per task.
    """
    k, centre, scale = len(columns), np.array(means), np.array(scales)
    values = [F.col(c).cast("double") for c in columns]

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = (matrix(batch.column(0), k) - centre) / scale
        bits = batch.column(1).to_numpy(zero_copy_only=False)[:, None] >> np.arange(PROJECTIONS) & 1
        return np.concatenate([(x * x).sum(axis=0), (x.T @ (bits * 2.0 - 1.0)).ravel()])

    total = summed(df.select(F.array(*values).alias("x"), F.xxhash64(*values).alias("h")), part, k * (1 + PROJECTIONS))
    return total[k:].reshape(k, PROJECTIONS) / np.sqrt(total[:k])[:, None]


def earlier_twins(signatures: np.ndarray) -> dict[int, list[int]]:
    """For each column the earlier ones whose signature is the same or the opposite up to ``SIGNATURE_GAP``."""
    order = np.argsort(np.abs(signatures[:, 0]), kind="stable")
    sizes, found = np.abs(signatures[order, 0]), {}
    for at, b in enumerate(order):
        first, last = np.searchsorted(sizes, [sizes[at] - SIGNATURE_GAP, sizes[at] + SIGNATURE_GAP])
        near = order[first:last]
        near = near[near < b]
        gap = np.minimum(np.abs(signatures[near] - signatures[b]).max(axis=1, initial=0), np.abs(signatures[near] + signatures[b]).max(axis=1, initial=0))
        if (gap <= SIGNATURE_GAP).any():
            found[int(b)] = sorted(int(a) for a in near[gap <= SIGNATURE_GAP])
    return found


def redundant_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Constant columns, and of each pair with |r| = 1 (to 1e-12, over the rows where both are set) the later one.

    Pairs of complete columns are proposed by their signatures and verified by their exact correlation, a column against its earliest
    proposal first, so a thousand columns need one pass and about as many correlations as there are twins. Columns with NULLs are
    correlated with every other one, since each pair has rows of its own.
    """
    stats = [f(c).cast("double") for c in columns for f in (F.min, F.max, F.avg, F.count)]
    row = df.agg(*[s.alias(f"_{i}") for i, s in enumerate(stats)], F.count(F.lit(1)).alias("n")).first()
    low, high, mean, count = ([row[4 * i + j] for i in range(len(columns))] for j in range(4))
    rest = [i for i in range(len(columns)) if low[i] != high[i]]
    whole, gaps = [i for i in rest if count[i] == row["n"]], [i for i in rest if count[i] != row["n"]]
    twins: set[int] = set()

    def verified(pairs: list[tuple[int, int]]) -> set[int]:
        found = corr_pairs(df, [(columns[a], columns[b]) for a, b in pairs]).collect() if pairs else []
        later = {(columns[a], columns[b]): b for a, b in pairs}
        return {later[r["a"], r["b"]] for r in found if r["r"] is not None and abs(abs(r["r"]) - 1.0) < 1e-12}

    if len(whole) > 1:
        signatures = column_signatures(df, [columns[i] for i in whole], [mean[i] for i in whole], [high[i] - low[i] for i in whole])
        open_pairs = {whole[b]: [whole[a] for a in near] for b, near in earlier_twins(signatures).items()}
        while open_pairs:
            twins |= verified([(near[0], b) for b, near in open_pairs.items()])
            open_pairs = {b: near[1:] for b, near in open_pairs.items() if b not in twins and near[1:]}
    twins |= verified([(min(i, j), max(i, j)) for n, i in enumerate(gaps) for j in [*whole, *gaps[n + 1 :]]])
    return [c for i, c in enumerate(columns) if i not in rest] + [columns[i] for i in rest if i in twins]


def drop_redundant(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*redundant_columns(df, columns))


def expanded_width(df: DataFrame, numeric: list[str], categorical: list[str], limit: int, embedding: int) -> DataFrame:
    """Width after one-hot (up to ``limit`` levels) or embedding, and the width with everything one-hot."""
    levels = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in categorical])
    width, worst, hot = F.lit(len(numeric)), F.lit(len(numeric)), F.lit(0)
    for c in categorical:
        width = width + F.when(F.col(c) <= limit, F.col(c)).otherwise(F.lit(embedding))
        worst = worst + F.col(c)
        hot = hot + F.when(F.col(c) <= limit, 1).otherwise(0)
    return levels.select(width.alias("width"), worst.alias("worst"), hot.alias("one_hot"), (F.lit(len(categorical)) - hot).alias("embedded"))
