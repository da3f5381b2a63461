"""Group profiles, lookups, exact matches, overlap removal and cell statistics.

Statistics are aggregated (with map-side partials) and joined back. No window is partitioned by a data key, so a
key that holds a third of the rows never ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.quantiles import exact_quantiles, quantile_name
from foldwise.kernels.scan import join_on, row_numbers, slice_hot_groups, SLICE
from foldwise.kernels.store import materialize
from foldwise.operators.keys import level_name


def present(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are all set: grouping drops NULL keys."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).isNotNull()
    return df.filter(condition)


STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "range": lambda c: F.max(c) - F.min(c),
}


def grouped(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Stored table of named aggregates ``{out: (column, stat)}`` per key; ``median`` is exact."""
    plain = {n: (c, s) for n, (c, s) in aggregates.items() if s != "median"}
    medians = {n: c for n, (c, s) in aggregates.items() if s == "median"}
    rows = present(df, keys)
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[STATS[s](c).alias(n) for n, (c, s) in plain.items()])
    if medians:
        middle = exact_quantiles(rows, list(dict.fromkeys(medians.values())), [0.5], keys)
        renamed = middle.select(*keys, *[F.col(quantile_name(c, 0.5)).alias(n) for n, c in medians.items()])
        out = join_on(out, renamed, keys)
    return materialize(out.drop("_rows"))


def group_profile(df: DataFrame, pool: DataFrame, key: str, measures: list[str], prefix: str = "profile") -> DataFrame:
    """Mean, sample deviation and residual of each measure in the row's group of ``pool``, and the group size (1 if unseen)."""
    spec = {f"{prefix}_{m}_{s}": (m, s) for m in measures for s in ("mean", "std")}
    spec[f"{prefix}_count"] = (key, "count")
    out = lookup(df, grouped(pool, [key], spec), [key], {f"{prefix}_count": 1})
    return out.withColumns({f"{prefix}_{m}_resid": F.col(m) - F.col(f"{prefix}_{m}_mean") for m in measures})


def group_share_table(pool: DataFrame, key: str, category: str) -> DataFrame:
    """``(key, category, share)`` for a vocabulary of any size: share of each level that occurs in a group."""
    counts = pool.filter(F.col(category).isNotNull()).groupBy(key, category).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(key).agg(F.sum("_n").alias("_all"))
    return join_on(counts, sizes, [key]).select(key, category, (F.col("_n") / F.col("_all")).alias("share"))


def group_shares(df: DataFrame, pool: DataFrame, key: str, category: str, levels: list) -> DataFrame:
    """A column with the share of each of the given levels of ``category`` within the row's group; an unseen group takes the
    overall share."""
    known = pool.filter(F.col(category).isNotNull())
    share = {f"share_{level_name(category, v)}": F.avg((F.col(category) == F.lit(v)).cast("double")) for v in levels}
    table = materialize(present(known, [key]).groupBy(key).agg(*[e.alias(n) for n, e in share.items()]))
    prior = known.agg(*[e.alias(f"_prior_{n}") for n, e in share.items()])
    out = attach_row(lookup(df, table, [key]), prior)
    filled = out.withColumns({n: F.coalesce(F.col(n), F.col(f"_prior_{n}")) for n in share})
    return filled.drop(*[f"_prior_{n}" for n in share])


def group_deviation(df: DataFrame, pool: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(x - group mean) / (group sample deviation + 1e-6), for each key and column; a missing deviation counts as 0."""
    out = df
    for k in keys:
        spec = {f"_{c}_{s}": (c, s) for c in columns if c != k for s in ("mean", "std")}
        out = lookup(out, grouped(pool, [k], spec), [k])
        spread = {c: F.coalesce(F.col(f"_{c}_std"), F.lit(0.0)) + F.lit(1e-6) for c in columns if c != k}
        out = out.withColumns({f"{k}_{c}_dev": (F.col(c) - F.col(f"_{c}_mean")) / s for c, s in spread.items()})
        out = out.drop(*spec)
    return out


def group_zscore(df: DataFrame, key: str, column: str, eps: float = 1e-6) -> DataFrame:
    """Mean, sample deviation and z-score of ``column`` within its own group."""
    names = {f"{column}_{key}_{s}": (column, s) for s in ("mean", "std")}
    out = lookup(df, grouped(df, [key], names), [key])
    mean, std = (F.col(n) for n in names)
    return out.withColumn(f"{column}_{key}_z", (F.col(column) - mean) / (F.coalesce(std, F.lit(0.0)) + F.lit(eps)))


def group_stats(df: DataFrame, keys: list[str], measures: list[str], stats: tuple[str, ...] = ("mean", "std", "median")) -> DataFrame:
    """Per key and measure the group statistics and the difference to the group mean."""
    out = df
    for k in keys:
        spec = {f"{k}_{m}_{s}": (m, s) for m in measures for s in stats}
        out = lookup(out, grouped(df, [k], spec), [k])
        if "mean" in stats:
            out = out.withColumns({f"{k}_{m}_diff": F.col(m) - F.col(f"{k}_{m}_mean") for m in measures})
    return out


def entity_aggregates(
    df: DataFrame, fit: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]], fill: str | None = "mean"
) -> DataFrame:
    """Aggregates per entity of ``fit`` on each row; with ``fill='mean'`` a missing one takes its mean over the rows."""
    out = lookup(df, grouped(fit, keys, aggregates), keys)
    if fill is None:
        return out
    means = out.agg(*[F.avg(n).alias(f"_mean_{n}") for n in aggregates])
    filled = attach_row(out, means)
    filled = filled.withColumns({n: F.coalesce(F.col(n).cast("double"), F.col(f"_mean_{n}")) for n in aggregates})
    return filled.select(*out.columns)


def group_residual(df: DataFrame, ref: DataFrame, key: str, column: str, eps: float = 1e-5) -> DataFrame:
    """Distance of the value to mean and median of its group in ``ref``, and the z-score (a missing deviation counts as 1)."""
    spec = {f"_{s}": (column, s) for s in ("mean", "median", "std")}
    out = lookup(df, grouped(ref, [key], spec), [key])
    x = F.col(column)
    return out.withColumns(
        {
            f"{column}_{key}_resid_mean": x - F.col("_mean"),
            f"{column}_{key}_resid_median": x - F.col("_median"),
            f"{column}_{key}_resid_z": (x - F.col("_mean")) / (F.coalesce(F.col("_std"), F.lit(1.0)) + F.lit(eps)),
        }
    ).drop("_mean", "_median", "_std")


#: Values below this are tried as whole millionths, which a double then holds exactly.
MOST_EXACT = 2**53 / 1e6


def group_slope(df: DataFrame, keys: list[str], order: list[str], lead: Column, value: str, hot_rows: int | None = None) -> DataFrame:
    """Least-squares slope of ``value`` over the position inside each group; 0 for a single row.

    ``lead`` is a number that never decreases along ``order``; it cuts groups above ``hot_rows`` into slices. A group whose values all
    have six decimals at most (and are below ``MOST_EXACT``) is summed in whole numbers and divided once, so its slope depends on no
    order of summation; the last digits of any other group's slope do.
    """
    sliced, _ = slice_hot_groups(present(df, keys).select(*keys, *[o for o in order if o not in keys], F.col(value).alias("_v"), lead.alias("_by")), keys, F.col("_by"), hot_rows)
    placed = row_numbers(sliced, keys, order, SLICE, "_pos")
    v = F.col("_v").cast("double")
    units = F.when(F.abs(v) < MOST_EXACT, F.rint(v * 1e6).cast("bigint"))
    placed = placed.withColumn("_units", F.when(units / 1e6 == v, units).cast("decimal(16,0)"))
    n = F.count(F.lit(1))
    rows = n.cast("decimal(12,0)")
    rise = 2 * F.sum(F.col("_pos").cast("decimal(12,0)") * F.col("_units")) - (rows + 1) * F.sum("_units")
    run = (rows * (rows * rows - 1)).cast("double") / 6.0 * 1e6
    exact = F.when(F.count("_units") == n, F.try_divide(rise.cast("double"), run))
    slope = F.coalesce(exact, F.regr_slope("_v", F.col("_pos").cast("double")), F.lit(0.0))
    return placed.groupBy(*keys).agg(slope.alias("slope"), n.alias("n"))


def exact_match(df: DataFrame, fit: DataFrame, columns: list[str], y: str, order: str, default: float = 0.5) -> DataFrame:
    """Label of the last fit row with exactly the same feature tuple, with a match flag; no match gives ``default``."""
    table = fit.groupBy(*columns).agg(F.max_by(F.col(y).cast("double"), order).alias("match_pred"))
    out = join_on(df, table.withColumn("matched", F.lit(1)), columns)
    return out.withColumns(
        {"matched": F.coalesce("matched", F.lit(0)), "match_pred": F.coalesce("match_pred", F.lit(float(default)))}
    )


def remove_overlap(orig: DataFrame, pool: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Rows of ``orig`` whose predictor tuple is not in ``pool``; of equal tuples the first by ``order`` stays."""
    fresh = join_on(orig, pool.select(*columns).distinct(), columns, "left_anti")
    rest = [c for c in orig.columns if c not in columns]
    first = fresh.groupBy(*columns).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*columns, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*orig.columns)


def shared_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct tuples found in both; empty if the sets are disjoint."""
    return a.select(*columns).intersect(b.select(*columns))


def region_purity(
    fit: DataFrame,
    orig: DataFrame,
    keysets: list[list[str]],
    y: str,
    purity: float,
    orig_rows: int,
    fit_rows: int,
) -> DataFrame:
    """``rho``: over the row's cells that are near-deterministic in ``orig``, the largest share of fit rows that
    contradict it; ``mapped`` says whether any such cell exists."""
    out = fit
    names = []
    for i, keys in enumerate(keysets):
        rate = F.avg(F.col(y).cast("double"))
        law = present(orig, keys).groupBy(*keys).agg(rate.alias("_o"), F.count(F.lit(1)).alias("_no"))
        law = law.filter((F.col("_no") >= orig_rows) & ((F.col("_o") >= purity) | (F.col("_o") <= 1.0 - purity)))
        seen = present(fit, keys).groupBy(*keys).agg(rate.alias("_f"), F.count(F.lit(1)).alias("_nf"))
        cells = law.join(seen.filter(F.col("_nf") >= fit_rows), keys)
        against = F.when(F.col("_o") >= purity, F.lit(1.0) - F.col("_f")).otherwise(F.col("_f"))
        name = f"_rho{i}"
        out = lookup(out, materialize(cells.select(*keys, F.greatest(against, F.lit(0.0)).alias(name))), keys)
        names.append(name)
    best = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    out = out.withColumns({"rho": F.coalesce(best, F.lit(0.0)), "mapped": best.isNotNull().cast("int")})
    return out.drop(*names)


def region_alpha(df: DataFrame, alpha: float, low: float, high: float) -> DataFrame:
    """Per-row weight ``alpha * rho / mean(rho of mapped rows)`` inside bounds; unmapped rows keep ``alpha``."""
    mean = df.agg(F.avg(F.when(F.col("mapped") == 1, F.col("rho"))).alias("_bar"))
    out = attach_row(df, mean)
    scaled = F.least(F.greatest(F.lit(alpha) * F.col("rho") / F.col("_bar"), F.lit(low)), F.lit(high))
    usable = (F.col("mapped") == 1) & (F.col("_bar") > 1e-9)
    return out.withColumn("alpha", F.when(usable, scaled).otherwise(F.lit(alpha))).drop("_bar")


def centroid_distance(df: DataFrame, fit: DataFrame, group: str, columns: list[str], y: str, min_rows: int = 10) -> DataFrame:
    """Euclidean distance, in standardised columns, to the mean of the positives of the row's group.

    Groups with fewer than ``min_rows`` positives have the origin as their centre; rows outside any fit group get 0.
    NULL counts as the column mean.
    """
    stats = fit.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])

    def scaled(frame: DataFrame) -> DataFrame:
        z = {
            f"_z_{c}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_mu_{c}"), F.nullif(F.col(f"_sd_{c}"), F.lit(0.0))), F.lit(0.0))
            for c in columns
        }
        return attach_row(frame, stats).withColumns(z)

    positive = F.col(y) == 1
    enough = F.count(F.when(positive, 1)) >= min_rows
    centres = present(scaled(fit), [group]).groupBy(group).agg(
        F.lit(1).alias("_known"),
        *[F.when(enough, F.avg(F.when(positive, F.col(f"_z_{c}")))).otherwise(F.lit(0.0)).alias(f"_c_{c}") for c in columns],
    )
    out = lookup(scaled(df), materialize(centres), [group])
    total = F.lit(0.0)
    for c in columns:
        gap = F.col(f"_z_{c}") - F.col(f"_c_{c}")
        total = total + gap * gap
    distance = F.when(F.col("_known").isNotNull(), F.sqrt(total)).otherwise(F.lit(0.0))
    return out.withColumn("centroid_distance", distance).select(*df.columns, "centroid_distance")
