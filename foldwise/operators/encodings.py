"""Label encodings that never let a row see its own label.

Sums per (value, fold) are aggregated once for all columns; what a fold may see is the total minus its own part,
so k folds cost one pass over the rows instead of k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.kernels.keyed import COLUMN, KEY, attach_keyed, keyed_stats
from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.quantiles import exact_quantiles, quantile_name
from foldwise.kernels.scan import SLICE, join_on, slice_hot_groups, sums_before, value_scan
from foldwise.kernels.store import materialize

Smoothing = float | str


def label_sums(y: str) -> dict[str, Column]:
    v = F.col(y)
    return {"n": F.count(v), "s": F.sum(v), "q": F.sum(v * v)}


# ---------------------------------------------------------------------------------------------------------------
# external statistics


def external_target_mean(
    df: DataFrame, orig: DataFrame, columns: list[str], y: str, m: float = 0.0, default: float | None = None, suffix: str = "_ext"
) -> DataFrame:
    """``<c>_ext``: mean label of the value in ``orig``, shrunk by ``m`` prior rows; an unseen value gives the prior or ``default``."""
    stats = keyed_stats(orig, columns, label_sums(y), carry=[y])
    prior = orig.agg(F.avg(y).alias("_prior"))
    table = attach_row(stats, prior).withColumn("v", (F.col("s") + F.lit(float(m)) * F.col("_prior")) / (F.col("n") + F.lit(float(m))))
    out = attach_keyed(attach_row(df, prior), table, columns, lambda c, _: c + suffix, ["v"])
    filler = F.col("_prior") if default is None else F.lit(float(default))
    return out.withColumns({c + suffix: F.coalesce(F.col(c + suffix), filler) for c in columns}).drop("_prior")


def saturation_census(df: DataFrame, orig: DataFrame, columns: list[str], y: str) -> DataFrame:
    """Per column: cells of ``orig``, cells whose mean is exactly 0 or 1 with their support, and rows of ``df`` mapped to them."""
    cells = keyed_stats(orig, columns, label_sums(y), carry=[y])
    full = (F.col("s") == 0) | (F.col("s") == F.col("n"))
    rows = keyed_stats(df, columns, {"rows": F.count(F.lit(1))})
    joined = cells.join(rows, [COLUMN, KEY], "left")
    return joined.groupBy(F.col(COLUMN).alias("column")).agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum((F.col("s") == F.col("n")).cast("int")).alias("cells_one"),
        F.sum((F.col("s") == 0).cast("int")).alias("cells_zero"),
        F.min(F.when(full, F.col("n"))).alias("saturated_min_n"),
        F.max(F.when(full, F.col("n"))).alias("saturated_max_n"),
        F.coalesce(F.sum(F.when(full, F.col("rows"))), F.lit(0)).alias("saturated_rows"),
    )


def external_target_stats(df: DataFrame, orig: DataFrame, key: str, y: str, qs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Mean, sample deviation, count and exact quantiles of the label per group of ``orig``.

    An unseen group takes the overall mean (also for quantiles), the overall deviation and count 1.
    """
    known = orig.filter(F.col(key).isNotNull())
    stats = known.groupBy(key).agg(
        F.avg(y).alias(f"{key}_y_mean"), F.stddev_samp(y).alias(f"{key}_y_std"), F.count(F.lit(1)).alias(f"{key}_y_count")
    )
    names = {quantile_name(y, q): f"{key}_y_q{round(q * 100)}" for q in qs}
    table = materialize(join_on(stats, exact_quantiles(known, [y], list(qs), [key]).withColumnsRenamed(names), [key]))
    whole = orig.agg(F.avg(y).alias("_mean"), F.stddev_samp(y).alias("_std"))
    out = attach_row(lookup(df, table, [key], {f"{key}_y_count": 1}), whole)
    filled = {n: F.coalesce(F.col(n), F.col("_mean")) for n in [f"{key}_y_mean", *names.values()]}
    filled[f"{key}_y_std"] = F.coalesce(F.col(f"{key}_y_std"), F.col("_std"))
    return out.withColumns(filled).drop("_mean", "_std")


# ---------------------------------------------------------------------------------------------------------------
# ordered encoding


def ordered_te(
    fit: DataFrame, columns: list[str], y: str, classes: list[int], order: str, a: float = 1.0, query: DataFrame | None = None,
    hot_rows: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """``<c>_ote_<class>`` on fit rows from strictly earlier rows of the same value, by the unique number ``order``;
    query rows use all fit rows. NULL is a value of its own."""
    priors = fit.agg(*[F.avg((F.col(y) == k).cast("double")).alias(f"_p{k}") for k in classes])
    out = attach_row(fit, priors)
    for c in columns:
        sliced, _ = slice_hot_groups(out, [c], F.col(order), hot_rows, source=fit.select(c, order))
        sums = {"_n": F.lit(1), **{f"_s{k}": (F.col(y) == k).cast("int") for k in classes}}
        scanned = sums_before(sliced, [c], [order], sums).drop(SLICE)
        new = {f"{c}_ote_{k}": (F.col(f"_s{k}") + F.lit(a) * F.col(f"_p{k}")) / (F.col("_n") + F.lit(a)) for k in classes}
        out = scanned.withColumns(new).drop(*sums)
    out = out.drop(*priors.columns)
    if query is None:
        return out, None
    counts = {"n": F.count(F.lit(1)), **{f"s{k}": F.sum((F.col(y) == k).cast("int")) for k in classes}}
    stats = keyed_stats(fit, columns, counts, carry=[y], nulls=True)
    asked = attach_keyed(attach_row(query, priors), stats, columns, lambda c, m: f"_{c}_{m}", list(counts))
    new = {}
    for c in columns:
        for k in classes:
            value = (F.col(f"_{c}_s{k}") + F.lit(a) * F.col(f"_p{k}")) / (F.col(f"_{c}_n") + F.lit(a))
            new[f"{c}_ote_{k}"] = F.coalesce(value, F.col(f"_p{k}"))
    return out, asked.withColumns(new).select(*query.columns, *new)


# ---------------------------------------------------------------------------------------------------------------
# cross-fitted encodings

TOTAL = -1


def visible_sums(df: DataFrame, columns: list[str], y: str, fold: str) -> tuple[DataFrame, DataFrame]:
    """Sums each fold may see per value, and per fold in all; fold -1 stands for rows outside the fit set and sees everything."""
    own = keyed_stats(df, columns, label_sums(y), carry=[y], extra_by=[fold], nulls=True)

    def complement(parts: DataFrame, keys: list[str]) -> DataFrame:
        whole = parts.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "s", "q")])
        joined = join_on(parts, whole, keys) if keys else attach_row(parts, whole)
        rest = joined.select(*keys, fold, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in ("n", "s", "q")])
        every = whole.select(*keys, F.lit(TOTAL).alias(fold), *[F.col(f"t_{c}").alias(c) for c in ("n", "s", "q")])
        return rest.unionByName(every)

    per_fold = materialize(df.groupBy(fold).agg(*[e.alias(n) for n, e in label_sums(y).items()]))
    overall = materialize(complement(per_fold, []).withColumnsRenamed({"n": "all_n", "s": "all_s", "q": "all_q"}))
    return complement(own, [COLUMN, KEY]), overall


def smoothed_mean(m: Smoothing) -> Column:
    """Shrunk mean from n, s, q (the value) and all_n, all_s, all_q (all rows).

    ``auto`` is the empirical-Bayes weight ``n t / (n t + v)``, t the label variance and v that of the value.
    """
    prior = F.col("all_s") / F.col("all_n")
    if m == "auto":
        tau = F.col("all_q") / F.col("all_n") - prior * prior
        mean = F.try_divide(F.col("s"), F.col("n"))
        var = F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0))
        weight = F.try_divide(F.col("n") * tau, F.col("n") * tau + var)
        return F.coalesce(weight * mean + (F.lit(1.0) - weight) * prior, prior)
    return F.coalesce(F.try_divide(F.col("s") + F.lit(float(m)) * prior, F.col("n") + F.lit(float(m))), prior)


def smoothing_tag(m: Smoothing) -> str:
    return "auto" if m == "auto" else f"m{m:g}"


def crossfit(
    df: DataFrame, columns: list[str], y: str, fold: str, measures: dict[str, Column], defaults: dict[str, Column],
    name, query: DataFrame | None, prepare=None,
) -> tuple[DataFrame, DataFrame | None]:
    """Evaluate ``measures`` on the visible sums and attach them; query rows use the sums of all fit rows."""
    seen, overall = visible_sums(df, columns, y, fold)
    table = seen.join(overall, fold)
    if prepare is not None:
        table = prepare(table, fold)
    stored = materialize(table.select(COLUMN, KEY, fold, *[e.alias(n) for n, e in measures.items()]), partition_by=COLUMN)
    out = attach_keyed(df, stored, columns, name, list(measures), extra_on=[fold])
    if query is None:
        return out, None
    rest = overall.filter(F.col(fold) == TOTAL).select("all_n", "all_s", "all_q")
    asked = attach_keyed(
        attach_row(query.withColumn(fold, F.lit(TOTAL)), rest), stored, columns, name, list(measures), extra_on=[fold]
    )
    fills = {name(c, m): F.coalesce(F.col(name(c, m)), defaults[m]) for c in columns for m in measures}
    return out, asked.withColumns(fills).drop("all_n", "all_s", "all_q", fold)


def kfold_te(
    df: DataFrame, columns: list[str], y: str, fold: str, m: list[Smoothing] | Smoothing, query: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``<c>_te_<tag>`` per smoothing: fit rows from the other folds, query rows from all of them. NULL is a value."""
    levels = m if isinstance(m, list) else [m]
    measures = {smoothing_tag(v): smoothed_mean(v) for v in levels}
    prior = {tag: F.col("all_s") / F.col("all_n") for tag in measures}
    return crossfit(df, columns, y, fold, measures, prior, lambda c, t: f"{c}_te_{t}", query)


def james_stein_te(
    df: DataFrame, columns: list[str], y: str, fold: str, query: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``<c>_js``: ``(1 - B) mean + B prior`` with ``B = (v/n) / (v/n + t)``, the published James-Stein form.

    v is the label variance inside the value and t the spread of the value means around the prior, weighted by n.
    """
    prior, mean = F.col("all_s") / F.col("all_n"), F.try_divide(F.col("s"), F.col("n"))

    def spread(table: DataFrame, fold: str) -> DataFrame:
        gap = mean - prior
        t = table.groupBy(COLUMN, fold).agg((F.sum(F.col("n") * gap * gap) / F.sum("n")).alias("t"))
        return table.join(t, [COLUMN, fold])

    var = F.greatest(F.try_divide(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0))
    noise = F.try_divide(var, F.col("n"))
    b = F.try_divide(noise, noise + F.col("t"))
    value = F.when(F.col("n") == 0, prior).otherwise(F.coalesce((F.lit(1.0) - b) * mean + b * prior, mean, prior))
    return crossfit(df, columns, y, fold, {"js": value}, {"js": prior}, lambda c, _: f"{c}_js", query, spread)


def smoothed_woe(smooth: float) -> Column:
    p = F.col("all_s") / F.col("all_n")
    pos = F.col("s") + F.lit(float(smooth)) * p
    neg = F.col("n") - F.col("s") + F.lit(float(smooth)) * (F.lit(1.0) - p)
    return F.ln(pos) - F.ln(neg) - (F.ln(p) - F.ln(F.lit(1.0) - p))


def woe_crossfit(
    df: DataFrame, columns: list[str], y: str, fold: str, smooth: float, query: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``<c>_woe``: smoothed weight of evidence centred on the prior log-odds; an unseen value gives 0."""
    value = F.coalesce(smoothed_woe(smooth), F.lit(0.0))
    return crossfit(df, columns, y, fold, {"woe": value}, {"woe": F.lit(0.0)}, lambda c, _: f"{c}_woe", query)


def woe_encode(df: DataFrame, fit: DataFrame, columns: list[str], y: str, smooth: float | None = None, eps: float = 1e-4) -> DataFrame:
    """Weight of evidence fitted on ``fit``: with ``smooth`` the centred form, else ln(share of negatives / share of positives)."""
    stats = keyed_stats(fit, columns, label_sums(y), carry=[y])
    whole = fit.agg(F.count(y).alias("all_n"), F.sum(y).alias("all_s"))
    if smooth is None:
        pos = (F.col("s") + F.lit(eps)) / (F.col("all_s") + F.lit(eps))
        neg = (F.col("n") - F.col("s") + F.lit(eps)) / (F.col("all_n") - F.col("all_s") + F.lit(eps))
        value = F.ln(neg / pos)
    else:
        value = smoothed_woe(smooth)
    table = attach_row(stats, whole).withColumn("woe", value)
    return attach_keyed(df, table, columns, lambda c, _: f"{c}_woe", ["woe"], {"woe": 0.0})


def kfold_target_stats(
    df: DataFrame, columns: list[str], y: str, fold: str, k: int, stats: tuple[str, ...] = ("std", "min", "max"),
    defaults: dict[str, float] | None = None, query: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """``<c>_y_<stat>`` from the other folds. Minimum and maximum cannot be subtracted, so the per-fold parts, not
    the rows, are copied to the folds that may see them."""
    defaults = defaults or {}
    centre = df.agg(F.avg(y).alias("_c"))
    centred = attach_row(df, centre).withColumn("_yc", F.col(y) - F.col("_c"))
    parts = keyed_stats(
        centred, columns,
        {"n": F.count(y), "s": F.sum("_yc"), "q": F.sum(F.col("_yc") * F.col("_yc")), "lo": F.min(y), "hi": F.max(y)},
        carry=[y, "_yc"], extra_by=[fold],
    )
    readers = F.explode(F.array(*[F.lit(f) for f in [TOTAL, *range(k)]]))
    spread = parts.withColumn("_reader", readers).filter(F.col("_reader") != F.col(fold))
    merged = attach_row(
        spread.groupBy(COLUMN, KEY, F.col("_reader").alias(fold)).agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
        ),
        centre,
    )
    square = F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    forms = {
        "mean": F.col("s") / F.col("n") + F.col("_c"),
        "std": F.when(F.col("n") > 1, F.sqrt(square / F.nullif(F.col("n") - 1, F.lit(0)))),
        "min": F.col("lo").cast("double"),
        "max": F.col("hi").cast("double"),
        "count": F.col("n").cast("double"),
    }
    table = materialize(merged.select(COLUMN, KEY, fold, *[forms[s].alias(s) for s in stats]), partition_by=COLUMN)
    fills = {s: float(defaults.get(s, 0.0)) for s in stats}
    name = lambda c, s: f"{c}_y_{s}"
    out = attach_keyed(df, table, columns, name, list(stats), fills, extra_on=[fold])
    if query is None:
        return out, None
    asked = attach_keyed(query.withColumn(fold, F.lit(TOTAL)), table, columns, name, list(stats), fills, extra_on=[fold])
    return out, asked.drop(fold)


def mean_rank_encode(df: DataFrame, fit: DataFrame, columns: list[str], y: str) -> DataFrame:
    """``<c>_rank``: position 0... of the value when values are ordered by mean label, ties by the value itself.

    NULL is a value; an unseen one gives NULL.
    """
    means = keyed_stats(fit, columns, {"mean": F.avg(y)}, carry=[y], nulls=True)
    per_mean = means.groupBy(COLUMN, "mean").agg(F.count(F.lit(1)).alias("n"))
    below = value_scan(per_mean, [COLUMN], "mean", {"below": F.col("n")}).drop("n")
    within = value_scan(means, [COLUMN, "mean"], KEY, {"within": F.lit(1)}, stored=True)
    ranked = join_on(within, below, [COLUMN, "mean"])
    table = materialize(ranked.select(COLUMN, KEY, (F.col("below") + F.col("within")).alias("rank")), partition_by=COLUMN)
    return attach_keyed(df, table, columns, lambda c, _: f"{c}_rank", ["rank"])
