"""Supervised bins: the partition of counted pre-bins with the most information value, for columns and for pairs of columns.

One aggregate counts rows and events per (column, pre-bin) for all columns together; the partition of a column is then a
dynamic program over its few pre-bins, run per column on the executors. The work of that program does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.kernels.quantiles import exact_quantiles, quantile_name
from foldwise.kernels.store import materialize

MISSING = -1
#: Two information values closer than this are equal: fewer bins win, then the smaller cut positions.
EQUAL = 1e-12


def woe_of(n: np.ndarray, events: np.ndarray, positives: float, negatives: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of evidence ``ln(share of negatives / share of positives)`` and information value; both 0 where a class is absent."""
    p, q = events / positives, (n - events) / negatives
    both = (p > 0) & (q > 0)
    woe = np.log(np.where(both, q, 1.0) / np.where(both, p, 1.0))
    return woe, (q - p) * woe


def optimal_partition(
    n: np.ndarray, events: np.ndarray, positives: float, negatives: float, max_bins: int, least: float, directions: tuple[int, ...] = (1, -1)
) -> list[int]:
    """First pre-bins of the bins (after the first) in the contiguous partition with the most information value.

    Every bin has at least ``least`` rows, and event rates never fall (direction 1) or never rise (-1) from bin to bin; the better
    direction is taken. Dynamic program over (first, last pre-bin of the last bin): cubic in the pre-bins. If not even all
    pre-bins together are large enough they are one bin.
    """
    m = len(n)
    rows, hits = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(events)))
    size = rows[None, 1:] - rows[:-1, None]
    good = hits[None, 1:] - hits[:-1, None]
    upper = np.triu(np.ones((m, m), bool))
    value = np.where(upper, woe_of(np.where(upper, size, 1), np.where(upper, good, 0), positives, negatives)[1], -np.inf)
    value = np.where(upper & (size >= least), value, -np.inf)
    rate = good / np.where(upper, size, 1)
    best: tuple[float, int, list[int]] | None = None
    for direction in directions:
        total = np.where(np.arange(m)[:, None] == 0, value, -np.inf)
        back: list[np.ndarray] = []
        for bins in range(1, max_bins + 1):
            if bins > 1:
                following, chosen = np.full((m, m), -np.inf), np.zeros((m, m), int)
                for i in range(1, m):
                    before = total[:i, i - 1]
                    if not np.isfinite(before).any():
                        continue
                    for j in range(i, m):
                        if not np.isfinite(value[i, j]):
                            continue
                        fits = np.where((rate[i, j] - rate[:i, i - 1]) * direction >= 0, before, -np.inf)
                        k = int(np.flatnonzero(fits >= fits.max() - EQUAL)[0]) if np.isfinite(fits.max()) else 0
                        following[i, j], chosen[i, j] = fits[k] + value[i, j], k
                total = following
                back.append(chosen)
            found = total[:, m - 1].max() if m else -np.inf
            if np.isfinite(found) and (best is None or found > best[0] + EQUAL):
                i, j, cuts = int(np.flatnonzero(total[:, m - 1] >= found - EQUAL)[0]), m - 1, []
                for chosen in reversed(back):
                    cuts.append(i)
                    i, j = int(chosen[i, j]), i - 1
                best = (found, bins, cuts[::-1])
    return best[2] if best else []


@dataclass(frozen=True)
class PreBins:
    """How a row finds its pre-bin: a code for each column, inner edges of numbers, kept values of categories."""

    edges: dict[str, list[float]]
    values: dict[str, list[str]]

    def code(self, column: str) -> Column:
        """Number of edges at or below a number, or the place of a value; NULL stays NULL, other values come last."""
        if column in self.edges:
            x = F.col(column).cast("double")
            listed = F.array(*[F.lit(e) for e in self.edges[column]]).cast("array<double>")
            return F.when(x.isNotNull(), F.size(F.filter(listed, lambda e: e <= x)))
        x, kept = F.col(column).cast("string"), self.values[column]
        at = F.array_position(F.array(*[F.lit(v) for v in kept]).cast("array<string>"), x).cast("int") - 1
        return F.when(x.isNotNull(), F.when(at < 0, F.lit(len(kept))).otherwise(at))


def fit_prebins(fit: DataFrame, numbers: list[str], categories: list[str], prebins: int) -> PreBins:
    """Quantile edges of all numeric columns in one job; of a category the values that hold at least one row in ``2 * prebins``, so
    there are at most that many."""
    edges: dict[str, list[float]] = {c: [] for c in numbers}
    if numbers:
        qs = [i / prebins for i in range(1, prebins)]
        row = exact_quantiles(fit, numbers, qs).first()
        for c in numbers:
            edges[c] = sorted({row[quantile_name(c, q)] for q in qs} - {None}) if row is not None else []
    values: dict[str, list[str]] = {c: [] for c in categories}
    if categories:
        long = fit.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categories])).alias("s"))
        counts = materialize(long.select("s.*").filter(F.col("value").isNotNull()).groupBy("column", "value").count())
        total = fit.count()
        for row in counts.filter(F.col("count") * (2 * prebins) >= total).collect():
            values[row["column"]].append(row["value"])
    return PreBins(edges, {c: sorted(v, key=str.encode) for c, v in values.items()})


def _partitioned(by_rate: Callable[[str], bool], max_bins: int, share: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.copy()
        positives, rows = float(pdf["events"].sum()), float(pdf["n"].sum())
        known = pdf[pdf["code"].notna()]
        out["bin"] = MISSING
        if len(known):
            rated = by_rate(pdf["column"].iloc[0])
            keys = [known["code"], known["events"] / known["n"]] if rated else [known["code"]]
            order = known.index[np.lexsort(keys)]
            n, events = known.loc[order, "n"].to_numpy(float), known.loc[order, "events"].to_numpy(float)
            one_class = positives == 0 or positives == rows
            directions = (1,) if rated else (1, -1)
            cuts = [] if one_class else optimal_partition(n, events, positives, rows - positives, max_bins, share * rows, directions)
            out.loc[order, "bin"] = np.searchsorted(cuts, np.arange(len(order)), side="right")
        sums = out.groupby("bin")[["n", "events"]].transform("sum")
        out["bin_n"], out["bin_events"] = sums["n"], sums["events"]
        out["woe"] = out["iv"] = np.nan
        if 0 < positives < rows:
            out["woe"], out["iv"] = woe_of(sums["n"].to_numpy(float), sums["events"].to_numpy(float), positives, rows - positives)
        return out

    return run


BINNED = "column string, code int, n bigint, events bigint, bin int, bin_n bigint, bin_events bigint, woe double, iv double"


def _binned(codes: DataFrame, by_rate: Callable[[str], bool], max_bins: int, share: float) -> DataFrame:
    """Pre-bins ``(column, code, n, events)`` of ``(column, code, y)`` rows with their bin and its figures, stored."""
    counts = codes.groupBy("column", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("events"))
    found = counts.groupBy("column").applyInPandas(_partitioned(by_rate, max_bins, share), BINNED)
    return materialize(found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("woe", "iv")}))


def optimal_bins(
    fit: DataFrame, numbers: list[str], categories: list[str], y: str, prebins: int = 20, max_bins: int = 5, share: float = 0.05
) -> tuple[PreBins, DataFrame]:
    """Best supervised bins of every column for a 0/1 label: ``(pre-bins, table)``.

    Numbers start from quantile pre-bins in their order and keep a monotone event rate; categories start from their frequent
    values (the others together) in the order of event rate, where the best grouping of values that all have both classes is
    contiguous. A bin holds at least ``share`` of the rows. The table has one row per pre-bin: ``(column, code, n, events, bin, bin_n, bin_events, woe, iv)``, figures
    of the bin; NULL is bin -1. Rows without a label do not count; with one class alone there is one bin and ``woe`` and ``iv`` are NULL.
    """
    labelled = fit.filter(F.col(y).isNotNull())
    cuts = fit_prebins(labelled, numbers, categories, prebins)
    each = [F.struct(F.lit(c).alias("column"), cuts.code(c).cast("int").alias("code")) for c in [*numbers, *categories]]
    codes = labelled.select(F.explode(F.array(*each)).alias("s"), F.col(y).alias("y")).select("s.*", "y")
    return cuts, _binned(codes, lambda c: c in categories, max_bins, share)


def pair_code(cuts: PreBins, a: str, b: str) -> Column:
    """Number of the cell of two pre-binned columns; NULL where either is."""
    width = len(cuts.edges[b]) + 1 if b in cuts.edges else len(cuts.values[b]) + 1
    return cuts.code(a) * width + cuts.code(b)


def optimal_bins_2d(
    fit: DataFrame, pairs: list[tuple[str, str]], numbers: list[str], y: str, prebins: int = 5, max_bins: int = 5, share: float = 0.05
) -> tuple[PreBins, DataFrame]:
    """The same over the cells of pairs of columns, all pairs in one aggregate; cells stand in the order of event rate (equal ones by
    number) and ``column`` reads ``a*b``. Columns not in ``numbers`` are categories."""
    labelled = fit.filter(F.col(y).isNotNull())
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    cuts = fit_prebins(labelled, [c for c in columns if c in numbers], [c for c in columns if c not in numbers], prebins)
    each = [F.struct(F.lit(f"{a}*{b}").alias("column"), pair_code(cuts, a, b).cast("int").alias("code")) for a, b in pairs]
    codes = labelled.select(F.explode(F.array(*each)).alias("s"), F.col(y).alias("y")).select("s.*", "y")
    return cuts, _binned(codes, lambda c: True, max_bins, share)


def bin_table(table: DataFrame) -> DataFrame:
    """One row per bin: ``(column, bin, n, events, woe, iv)``."""
    return table.select("column", "bin", F.col("bin_n").alias("n"), F.col("bin_events").alias("events"), "woe", "iv").distinct()


def optimal_iv_ranking(table: DataFrame) -> DataFrame:
    """Total information value per column or pair."""
    return bin_table(table).groupBy("column").agg(F.sum("iv").alias("iv"), F.max("bin").alias("last_bin"))


def optimal_woe(df: DataFrame, cuts: PreBins, table: DataFrame, columns: list[str], pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """Adds ``{column}_woe`` or ``{a}_{b}_woe``: the weight of evidence of a row's bin; 0 for a pre-bin the fit rows did not have.

    The table has a bounded number of rows (pre-bins), so it enters as literals and rows are neither shuffled nor joined.
    """
    wanted = {c: (f"{c}_woe", cuts.code(c)) for c in columns} | {f"{a}*{b}": (f"{a}_{b}_woe", pair_code(cuts, a, b)) for a, b in pairs}
    known: dict[str, dict[int, float]] = {c: {} for c in wanted}
    for row in table.filter(F.col("column").isin(list(wanted))).select("column", "code", "bin", "woe").collect():
        known[row["column"]][MISSING if row["code"] is None else row["code"]] = row["woe"]
    new = {}
    for c, (name, code) in wanted.items():
        woes = [known[c].get(k, 0.0) for k in range(MISSING, max(known[c], default=0) + 1)]
        listed = F.array(*[F.lit(w).cast("double") for w in woes])
        new[name] = F.coalesce(F.get(listed, F.coalesce(code, F.lit(MISSING)) + 1), F.lit(0.0))
    return df.withColumns(new)
