"""Bins: quantile, equal-width, fixed edges, supervised, and encodings over edges.

Edges are a short list of numbers (one per bin) fitted by a distributed job; rows find their bin by binary search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foldwise.functions.scalar import clip, hinge
from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.quantiles import exact_quantiles, quantile_name, quantile_values
from foldwise.kernels.scan import add_slices, join_on, value_scan
from foldwise.kernels.store import materialize


def count_at_or_below(df: DataFrame, column: str, edges: list[float], name: str) -> DataFrame:
    """Number of edges ``e <= x``; NULL stays NULL."""
    out = add_slices(df, F.col(column), edges, "_bin")
    return out.withColumn(name, F.when(F.col(column).isNotNull(), F.col("_bin"))).drop("_bin")


def count_below(df: DataFrame, column: str, edges: list[float], name: str) -> DataFrame:
    """Number of edges ``e < x``; NULL stays NULL."""
    mirrored = add_slices(df, -F.col(column).cast("double"), sorted(-e for e in edges), "_bin")
    return mirrored.withColumn(name, F.when(F.col(column).isNotNull(), F.lit(len(edges)) - F.col("_bin"))).drop("_bin")


def quantile_edges(fit: DataFrame, column: str, k: int) -> list[float]:
    """Distinct quantile edges 0/k ... k/k."""
    return sorted(set(quantile_values(fit, column, [i / k for i in range(k + 1)])))


def quantile_bins(df: DataFrame, fit: DataFrame, column: str, k: int, name: str | None = None) -> DataFrame:
    """Code 0..k-1: number of inner quantile edges of the fit rows at or below the value; NULL counts as the fit median."""
    median, *edges = quantile_values(fit, column, [0.5, *[i / k for i in range(k + 1)]])
    if not fit.filter(F.col(column).isNull()).isEmpty():
        filled = fit.select(F.coalesce(F.col(column).cast("double"), F.lit(median)).alias(column))
        edges = quantile_edges(filled, column, k)
    inner = sorted(set(edges))[1:-1]
    probe = df.withColumn("_x", F.coalesce(F.col(column).cast("double"), F.lit(median)))
    return count_at_or_below(probe, "_x", inner, name or f"{column}_q{k}").drop("_x")


def fold_quantile_bins(df: DataFrame, column: str, k: int, fold: str, folds: int, name: str | None = None) -> DataFrame:
    """Quantile codes whose edges come, for each fold, from the rows of the other folds; NULL stays NULL.

    One job fits the edges of all folds: each row counts for the folds that may see it.
    """
    qs = [i / k for i in range(1, k)]
    readers = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold)))
    seen = df.select(readers.alias(fold), column)
    fitted = exact_quantiles(seen, [column], qs, [fold])
    edges = F.array_distinct(F.array(*[F.col(quantile_name(column, q)) for q in qs])).alias("_edges")
    out = lookup(df, materialize(fitted.select(fold, edges)), [fold])
    code = F.size(F.filter("_edges", lambda e: e <= F.col(column)))
    return out.withColumn(name or f"{column}_fq{k}", F.when(F.col(column).isNotNull(), code)).drop("_edges")


def qcut(df: DataFrame, column: str, q: int, name: str | None = None) -> DataFrame:
    """Quantile intervals closed on the right, duplicate edges dropped."""
    return count_below(df, column, quantile_edges(df, column, q)[1:-1], name or f"{column}_qcut{q}")


def cut_equal(df: DataFrame, column: str, n: int, name: str | None = None) -> DataFrame:
    """``n`` equal-width intervals between minimum and maximum, closed on the right, the lowest one widened to hold the minimum."""
    out = attach_row(df, df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi")))
    code = F.lit(0)
    for i in range(1, n):
        edge = F.col("_lo") + (F.col("_hi") - F.col("_lo")) / F.lit(float(n)) * F.lit(float(i))
        code = code + (F.col(column) > edge).cast("int")
    return out.withColumn(name or f"{column}_cut{n}", code).drop("_lo", "_hi")


def equal_width_bin(df: DataFrame, column: str, n: int, name: str | None = None) -> DataFrame:
    """``floor((x - min) * n / (max - min + 1))``; 0 everywhere if the range is 0."""
    out = attach_row(df, df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi")))
    span = F.col("_hi") - F.col("_lo")
    code = F.floor((F.col(column) - F.col("_lo")) * (F.lit(float(n)) / (span + F.lit(1.0))))
    return out.withColumn(name or f"{column}_w{n}", F.when(span > 0, code).otherwise(F.lit(0).cast("bigint"))).drop("_lo", "_hi")


def cut_edges(df: DataFrame, column: str, edges: list[float], labels: list, outside: object = -1, lowest: bool = True, name: str | None = None) -> DataFrame:
    """Label of the interval ``(e_i, e_i+1]``; the first one includes its lower edge; outside and NULL give ``outside``."""
    x, out = F.col(column), None
    for i, label in enumerate(labels):
        above = (x >= edges[i]) if i == 0 and lowest else (x > edges[i])
        inside = above & (x <= edges[i + 1])
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return df.withColumn(name or f"{column}_band", out.otherwise(F.lit(outside)))


def ref_quantile_code(df: DataFrame, ref: DataFrame, column: str, k: int, name: str | None = None) -> DataFrame:
    """1 + number of inner quantile edges of ``ref`` at or below the value, equal edges counted each."""
    inner = quantile_values(ref, column, [i / k for i in range(1, k)])
    code = F.lit(1)
    for e in inner:
        code = code + (F.col(column) >= F.lit(e)).cast("int")
    return df.withColumn(name or f"{column}_ref{k}", code)


def best_split(leaves: DataFrame) -> tuple[float, float, int] | None:
    """``(last value of the left part, gain, leaf)`` of the split of counted values ``(_leaf, _v, _n, _p)`` that lowers the Gini
    impurity most; ties go to the smallest value."""
    before = value_scan(leaves, ["_leaf"], "_v", {"_ln": F.col("_n"), "_lp": F.col("_p")})
    whole = leaves.groupBy("_leaf").agg(F.sum("_n").alias("_tn"), F.sum("_p").alias("_tp"))
    n, p = (F.col("_ln") + F.col("_n")).cast("double"), (F.col("_lp") + F.col("_p")).cast("double")
    pure = lambda n, p: F.try_divide(p * p + (n - p) * (n - p), n)
    total_n, total_p = F.col("_tn").cast("double"), F.col("_tp").cast("double")
    gain = pure(n, p) + pure(total_n - n, total_p - p) - pure(total_n, total_p)
    cuts = join_on(before, whole, ["_leaf"]).select("_v", gain.alias("_gain"), "_leaf").filter(F.col("_gain") > 1e-9)
    top = cuts.orderBy(F.col("_gain").desc(), "_v").first()
    return None if top is None else tuple(top)


def tree_edges(fit: DataFrame, column: str, y: str, max_leaves: int) -> list[float]:
    """At most ``max_leaves - 1`` thresholds of a one-feature tree for a 0/1 label, grown best leaf first by exact counts per
    distinct value; a threshold is the middle of two neighbouring values. Inner quantiles if it finds fewer than two."""
    rows = fit.filter(F.col(column).isNotNull() & F.col(y).isNotNull())
    counts = materialize(rows.groupBy(F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_p")))
    lasts: list[float] = []
    while len(lasts) + 1 < max_leaves:
        leaf = reduce(lambda a, b: a + b, [(F.col("_v") > F.lit(e)).cast("int") for e in lasts], F.lit(0))
        found = best_split(counts.withColumn("_leaf", leaf))
        if found is None:
            break
        lasts.append(found[0])
    if len(lasts) < 2:
        return quantile_edges(fit, column, max_leaves)[1:-1]
    following = counts.agg(*[F.min(F.when(F.col("_v") > e, F.col("_v"))).alias(f"e{i}") for i, e in enumerate(lasts)]).first()
    return sorted((e + following[f"e{i}"]) / 2 for i, e in enumerate(lasts))


def tree_bins(df: DataFrame, fit: DataFrame, column: str, y: str, max_leaves: int, name: str | None = None) -> DataFrame:
    """Number of tree thresholds below the value."""
    return count_below(df, column, tree_edges(fit, column, y, max_leaves), name or f"{column}_tree")


def ple(df: DataFrame, column: str, edges: list[float], scaled: bool = True) -> DataFrame:
    """Thermometer encoding over inner edges: below the first edge a 0/1 step, between two edges the share passed, and 0
    for the open end. Unscaled: ``clip(x - e, 0, width)`` per segment, the last one open."""
    x, new = F.col(column), {}
    if scaled:
        new[f"{column}_ple0"] = (x >= edges[0]).cast("double")
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]), 1):
            new[f"{column}_ple{i}"] = clip((x - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0)
        new[f"{column}_ple{len(edges)}"] = F.when(x.isNotNull(), F.lit(0.0))
    else:
        for i, lo in enumerate(edges):
            width = edges[i + 1] - lo if i + 1 < len(edges) else None
            new[f"{column}_seg{i}"] = hinge(column, lo, width)
    return df.withColumns(new)


def _woe_rows(counts: DataFrame, totals: DataFrame) -> DataFrame:
    out = attach_row(counts, totals)
    pos = F.try_divide(F.col("events"), F.col("_pos"))
    neg = F.try_divide(F.col("n") - F.col("events"), F.col("_neg"))
    woe = F.when((pos > 0) & (neg > 0), F.ln(neg / pos)).otherwise(F.lit(0.0))
    return out.withColumns({"woe": woe, "iv": (neg - pos) * woe}).drop("_pos", "_neg")


def _totals(df: DataFrame, y: str) -> DataFrame:
    return df.agg(F.sum(y).alias("_pos"), F.sum(F.lit(1) - F.col(y)).alias("_neg"))


def iv_table(df: DataFrame, column: str, y: str, bins: int) -> DataFrame:
    """Rows, events, weight of evidence and information value per quantile bin; with one class alone the value is NULL."""
    coded = quantile_bins(df, df, column, bins, "bin")
    counts = coded.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("events"))
    return _woe_rows(counts, _totals(df, y))


def iv_table_2d(df: DataFrame, a: str, b: str, y: str, bins: int) -> DataFrame:
    """The same for the cells of two binned columns."""
    coded = quantile_bins(quantile_bins(df, df, a, bins, "bin_a"), df, b, bins, "bin_b")
    counts = coded.groupBy("bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("events"))
    return _woe_rows(counts, _totals(df, y))


def iv_ranking(df: DataFrame, columns: list[str], y: str, bins: int) -> DataFrame:
    """Total information value per column."""
    parts = [iv_table(df, c, y, bins).agg(F.lit(c).alias("column"), F.sum("iv").alias("iv")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
