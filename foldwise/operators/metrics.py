"""Exact ranking metrics, error metrics, calibration, significance and correlation.

Scores are counted per distinct value first; ranks then come from one scan over the counts.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.functions.hashing import MODULUS, key_hash
from foldwise.functions.scalar import clip, safe_corr
from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.scan import value_scan
from foldwise.kernels.store import materialize
from foldwise.operators.ordered import pct_rank


def long_scores(df: DataFrame, preds: list[str], keep: list[str]) -> DataFrame:
    """``(keep..., model, pred)`` from one column per model."""
    return df.select(*keep, *[F.col(p).cast("double").alias(p) for p in preds]).unpivot(keep, preds, "model", "pred")


def class_counts(long: DataFrame, y: str, by: list[str], weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    pos, neg = (F.sum(F.when(F.col(y) == c, w).otherwise(F.lit(0))) for c in (1, 0))
    return materialize(long.filter(F.col("pred").isNotNull()).groupBy(*by, "pred").agg(pos.alias("pos"), neg.alias("neg")))


def auc_from_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve per group: pairs won plus half the ties, over all pairs."""
    scanned = value_scan(counts, by, "pred", {"neg_below": F.col("neg")}, stored=True)
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    totals = scanned.groupBy(*by).agg(won.alias("_won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    area = F.try_divide(F.col("_won"), F.col("n_pos").cast("double") * F.col("n_neg"))
    return totals.select(*by, area.alias("auc"), "n_pos", "n_neg")


def auc(df: DataFrame, y: str, preds: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact AUC of each prediction column, optionally by group: ``(by..., model, auc, n_pos, n_neg)``."""
    by = by or []
    return auc_long(long_scores(df, preds, [*by, y]), y, [*by, "model"])


def auc_long(long: DataFrame, y: str, by: list[str]) -> DataFrame:
    return auc_from_counts(class_counts(long, y, by), by)


BINS = 4096


def auc_bounds(df: DataFrame, y: str, candidates: list[Column], ranges: list[tuple[float, float]], bins: int = BINS) -> DataFrame:
    """``(candidate, low, high)``: bounds of the AUC of every candidate score from its counts in ``bins`` cells of its range.

    Pairs in different cells keep their order, pairs inside one cell are counted as lost for ``low`` and as won for ``high``. Any ranges
    are right, tight ones give tight bounds. The map side reduces every task to at most ``bins`` rows per candidate, so what is
    shuffled does not grow with the rows. NULL scores do not count; a candidate without both classes has NULL bounds.
    """
    entries = F.array(*[
        F.struct(F.lit(i).alias("candidate"), F.floor((c.cast("double") - F.lit(lo)) * F.lit(bins / (hi - lo) if hi > lo else 0.0)).alias("cell"))
        for i, (c, (lo, hi)) in enumerate(zip(candidates, ranges))
    ])
    long = df.select(y, F.explode(entries).alias("_e")).select(y, "_e.candidate", clip("_e.cell", 0, bins).alias("cell"))
    pos, neg = (F.count(F.when((F.col(y) == c) & F.col("cell").isNotNull(), 1)) for c in (1, 0))
    counts = long.groupBy("candidate", "cell").agg(pos.alias("pos"), neg.alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.partitionBy("candidate").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won, tied = F.sum(F.col("pos").cast("double") * F.col("_b")), F.sum(F.col("pos").cast("double") * F.col("neg"))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    scanned = counts.withColumn("_b", below).groupBy("candidate")
    return scanned.agg(F.try_divide(won, pairs).alias("low"), F.try_divide(won + tied, pairs).alias("high"))


def regression_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    gap = F.col(pred) - F.col(y)
    return df.groupBy(*(by or [])).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap).alias("bias"), F.count(F.lit(1)).alias("n")
    )


def log_loss(y: str, p: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return -F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q))


def prob_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    gap = F.col(pred) - F.col(y)
    hit = ((F.col(pred) >= 0.5).cast("int") == F.col(y)).cast("double")
    return df.groupBy(*(by or [])).agg(
        F.avg(gap * gap).alias("brier"), F.avg(log_loss(y, F.col(pred))).alias("log_loss"), F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def balanced_accuracy(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Mean recall over the classes that occur."""
    by = by or []
    recall = df.groupBy(*by, y).agg(F.avg((F.col(pred) == F.col(y)).cast("double")).alias("_recall"))
    return recall.groupBy(*by).agg(F.avg("_recall").alias("balanced_accuracy"), F.count(F.lit(1)).alias("classes"))


def calibration_curve(df: DataFrame, y: str, pred: str, bins: int) -> DataFrame:
    """Uniform bins, each closed on the right: mean prediction and observed rate of the bins that hold rows."""
    bin_id = F.lit(0)
    for i in range(1, bins):
        bin_id = bin_id + (F.col(pred) > F.lit(i / bins)).cast("int")
    return df.groupBy(bin_id.alias("bin")).agg(F.avg(pred).alias("mean_pred"), F.avg(y).alias("observed"), F.count(F.lit(1)).alias("n"))


def placements(df: DataFrame, y: str, preds: list[str]) -> DataFrame:
    """``<p>_v``: share of the opposite class that the row beats, ties counting half (for negatives: that beats it)."""
    out = df
    for p in preds:
        counts = class_counts(df.select(y, F.col(p).cast("double").alias("pred")), y, [])
        scanned = value_scan(counts, [], "pred", {"pos_below": F.col("pos"), "neg_below": F.col("neg")}, stored=True)
        sized = attach_row(scanned, counts.agg(F.sum("pos").alias("m"), F.sum("neg").alias("n")))
        v10 = (F.col("neg_below") + F.col("neg") / F.lit(2.0)) / F.col("n")
        v01 = F.lit(1.0) - (F.col("pos_below") + F.col("pos") / F.lit(2.0)) / F.col("m")
        table = materialize(sized.select(F.col("pred").alias("_p"), v10.alias("_v10"), v01.alias("_v01")))
        out = lookup(out.withColumn("_p", F.col(p).cast("double")), table, ["_p"])
        out = out.withColumn(f"{p}_v", F.when(F.col(y) == 1, F.col("_v10")).otherwise(F.col("_v01"))).drop("_p", "_v10", "_v01")
    return out


def delong(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row: both AUCs, the standard error of their difference and z (Sun and Xu 2014); se = 0 gives z NULL."""
    va, vb = F.col(f"{a}_v"), F.col(f"{b}_v")
    gap = F.var_samp(va) + F.var_samp(vb) - F.lit(2.0) * F.covar_samp(va, vb)
    per_class = placements(df, y, [a, b]).groupBy(y).agg(
        F.avg(va).alias("_a"), F.avg(vb).alias("_b"), (gap / F.count(F.lit(1))).alias("_var")
    )
    pos = F.col(y) == 1
    out = per_class.agg(
        F.max(F.when(pos, F.col("_a"))).alias("auc_a"),
        F.max(F.when(pos, F.col("_b"))).alias("auc_b"),
        F.sqrt(F.greatest(F.sum("_var"), F.lit(0.0))).alias("se"),
    )
    return out.withColumn("z", F.try_divide(F.col("auc_a") - F.col("auc_b"), F.nullif(F.col("se"), F.lit(0.0))))


# Cumulative probabilities of the Poisson distribution with mean 1 in steps of the hash, up to where its tail is below one step.
POISSON_ONE = sorted({
    round(MODULUS * sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1))) for k in range(13)
} - {MODULUS})


# Fixed value: step between the multipliers of two replicates.
REPLICATE_STEP = 1_597_334_677


def replicate_number(rep: Column) -> Column:
    """Number in ``[0, MODULUS)`` of a row in replicate ``rep``: ``h1 * m + h2`` of two hashes of the row's key, with a multiplier
    ``m`` of the replicate. Any two replicates are independent, at one product each."""
    multiplier = F.pmod(rep.cast("bigint") * F.lit(REPLICATE_STEP) + F.lit(1), F.lit(MODULUS))
    return F.pmod(F.col("_h1") * multiplier + F.col("_h2"), F.lit(MODULUS))


def poisson_weight(number: Column) -> Column:
    return reduce(lambda w, edge: w + (number >= F.lit(edge)).cast("int"), POISSON_ONE, F.lit(0))


def bootstrap_auc_diff(df: DataFrame, id: str, y: str, a: str, b: str, reps: int, seed: int) -> DataFrame:
    """One row: mean, standard deviation and 95 % interval of AUC(a) - AUC(b) over weighted resamples, and the share above 0.

    Each row gets a Poisson(1) weight per replicate from a hash of its key, so no resample is ever drawn or stored. Weights are
    summed per (replicate, model, score) before anything is shuffled.
    """
    rows = df.select(y, a, b, key_hash(id, seed).alias("_h1"), key_hash(id, seed + 1).alias("_h2"))
    copies = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    numbered = copies.withColumn("_u", replicate_number(F.col("rep"))).filter(F.col("_u") >= POISSON_ONE[0])
    weighted = numbered.withColumn("_w", poisson_weight(F.col("_u")))
    long = long_scores(weighted, [a, b], ["rep", y, "_w"])
    areas = auc_from_counts(class_counts(long, y, ["rep", "model"], F.col("_w")), ["rep", "model"])
    gap = areas.groupBy("rep").agg(F.sum(F.when(F.col("model") == a, F.col("auc")).otherwise(-F.col("auc"))).alias("gap"))
    return gap.agg(
        F.avg("gap").alias("mean"),
        F.stddev_samp("gap").alias("sd"),
        F.percentile("gap", F.lit(0.025)).alias("low"),
        F.percentile("gap", F.lit(0.975)).alias("high"),
        F.avg((F.col("gap") > 0).cast("double")).alias("share_above"),
    )


WIDE_CORRELATION = 16
PAIRS_PER_PASS = 100


def corr_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """``(a, b, r)`` for every pair ``a < b`` in list order, over the rows where both are set; the Spearman form
    correlates average ranks. ``r`` is NULL where a column does not vary, at any number of columns.

    Many columns without NULLs are correlated as one vector in a single pass; otherwise pairs go through aggregates,
    ``PAIRS_PER_PASS`` at a time.
    """
    work, names = df, {c: c for c in columns}
    if method == "spearman":
        work, names = pct_rank(df, columns, suffix="_rk"), {c: f"{c}_rk" for c in columns}
    pairs = list(combinations(columns, 2))
    if len(columns) > WIDE_CORRELATION:
        work = materialize(work.select(*[F.col(names[c]).cast("double").alias(names[c]) for c in columns]))
        counts = work.agg(F.count(F.lit(1)).alias("rows"), *[F.count(names[c]).alias(names[c]) for c in columns]).first()
        if all(counts[names[c]] == counts["rows"] for c in columns):
            dense = VectorAssembler(inputCols=[names[c] for c in columns], outputCol="_v").transform(work)
            grid = Correlation.corr(dense.select("_v"), "_v").first()[0].toArray()
            at = {c: i for i, c in enumerate(columns)}
            value = lambda a, b: float(grid[at[a], at[b]])
            rows = [(a, b, None if math.isnan(value(a, b)) else value(a, b)) for a, b in pairs]
            return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    return corr_pairs(work, pairs, names)


def corr_pairs(df: DataFrame, pairs: list[tuple[str, str]], names: dict[str, str] | None = None) -> DataFrame:
    """``(a, b, r)`` of the given pairs, each over the rows where both are set; ``names`` gives the column behind a name."""
    names, parts = names or {c: c for pair in pairs for c in pair}, []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[start : start + PAIRS_PER_PASS]
        exprs = [safe_corr(names[a], names[b]).alias(f"r{i}") for i, (a, b) in enumerate(part)]
        entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(part)]
        parts.append(df.agg(*exprs).select(F.explode(F.array(*entries)).alias("_e")).select("_e.a", "_e.b", "_e.r"))
    return reduce(lambda x, z: x.unionByName(z), parts)


def rank_shift(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean and largest absolute difference of the percentile ranks of two prediction columns."""
    gap = F.abs(F.col(f"{a}_rk") - F.col(f"{b}_rk"))
    return pct_rank(df, [a, b], suffix="_rk").agg(F.avg(gap).alias("mean_shift"), F.max(gap).alias("max_shift"))


def resolution_table(df: DataFrame, y: str, column: str, bins: list[int]) -> DataFrame:
    """AUC of the raw column (bins = 0) and of its equal-width integer bins, with the share of the raw AUC kept."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    rows = attach_row(df.filter(F.col(column).isNotNull()).select(y, F.col(column).cast("double").alias("_x")), ends)
    rows = rows.withColumn("bins", F.explode(F.array(*[F.lit(b) for b in [0, *bins]])))
    span = F.col("_hi") - F.col("_lo")
    cell = F.when(span <= 0, 0.0).otherwise(F.floor((F.col("_x") - F.col("_lo")) * (F.col("bins").cast("double") / (span + F.lit(1.0)))).cast("double"))
    long = rows.select("bins", y, F.when(F.col("bins") == 0, F.col("_x")).otherwise(cell).alias("pred"))
    areas = materialize(auc_long(long, y, ["bins"]))
    raw = areas.filter("bins = 0").select(F.col("auc").alias("_raw"))
    return attach_row(areas, raw).select("bins", "auc", (F.col("auc") / F.col("_raw")).alias("kept"))


def fold_report(df: DataFrame, y: str, preds: list[str], fold: str, baseline: str) -> DataFrame:
    """Per model: mean and sample deviation of the fold AUCs, their extremes, and folds won against the baseline."""
    per_fold = materialize(auc(df, y, preds, [fold]).select(fold, "model", "auc"))
    base = per_fold.filter(F.col("model") == baseline).select(fold, F.col("auc").alias("_base"))
    won = (F.col("auc") > F.col("_base")).cast("int")
    return per_fold.join(base, fold).groupBy("model").agg(
        F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("std_auc"), F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc"), F.sum(won).alias("wins")
    )


def top_k(df: DataFrame, by: str, k: int, ties: list[str], worst: bool = False) -> DataFrame:
    """The ``k`` best (or worst) rows by a score; ``ties`` makes the choice unique."""
    first = F.col(by).asc() if worst else F.col(by).desc()
    return df.orderBy(first, *ties).limit(k)
