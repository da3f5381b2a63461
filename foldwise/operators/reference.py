"""Where a value lies in a reference sample: ranks, z-scores, quantile distances, density ratios.

Ranks never compare rows pairwise: query values and reference counts are merged per value and scanned once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.quantiles import exact_quantiles, quantile_name
from foldwise.kernels.scan import join_on, value_scan
from foldwise.kernels.store import materialize


def rank_table(
    df: DataFrame, ref: DataFrame, column: str, by: list[str] | None = None, parts: dict[str, Column] | None = None
) -> DataFrame:
    """Per ``(by, value)`` of ``df``: reference rows strictly below, equal, and in all, for each part of ``ref``."""
    by = by or []
    parts = parts or {"all": F.lit(True)}
    counted = {n: F.sum(F.when(p, 1).otherwise(0)) for n, p in parts.items()}
    known = ref.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_value"))
    known = known.agg(*[e.alias(n) for n, e in counted.items()])
    asked = df.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_value")).distinct()
    both = known.unionByName(asked.select("*", *[F.lit(0).cast("bigint").alias(n) for n in parts]))
    merged = materialize(both.groupBy(*by, "_value").agg(*[F.sum(n).alias(n) for n in parts]))
    sizes = merged.groupBy(*by).agg(*[F.sum(n).alias(f"{n}_size") for n in parts])
    scanned = value_scan(merged, by, "_value", {f"{n}_below": F.col(n) for n in parts}, stored=True)
    out = join_on(scanned, sizes, by) if by else attach_row(scanned, sizes)
    return materialize(out.withColumnsRenamed({n: f"{n}_equal" for n in parts}))


def _ranked(df: DataFrame, table: DataFrame, column: str, by: list[str]) -> DataFrame:
    return lookup(df.withColumn("_value", F.col(column).cast("double")), table, [*by, "_value"]).drop("_value")


def _drop_parts(df: DataFrame, parts: list[str]) -> DataFrame:
    return df.drop(*[f"{p}_{s}" for p in parts for s in ("below", "equal", "size")])


def _share(part: str) -> Column:
    return F.try_divide(F.col(f"{part}_below"), F.col(f"{part}_size"))


def class_parts(y: str) -> dict[str, Column]:
    return {"c0": F.col(y) == 0, "c1": F.col(y) == 1}


def pctrank_against(df: DataFrame, ref: DataFrame, column: str, y: str | None = None) -> DataFrame:
    """``<c>_pct``: share of the reference strictly below; with ``y`` also per class and their gap."""
    parts = {"all": F.lit(True), **(class_parts(y) if y else {})}
    out = _ranked(df, rank_table(df, ref, column, parts=parts), column, [])
    new = {f"{column}_pct": _share("all")}
    if y:
        new |= {f"{column}_pct0": _share("c0"), f"{column}_pct1": _share("c1"), f"{column}_pct_gap": _share("c1") - _share("c0")}
    return _drop_parts(out.withColumns(new), list(parts))


def midrank_against(df: DataFrame, ref: DataFrame, column: str, y: str) -> DataFrame:
    """Mid-rank share per class, (below + not above) / 2n, and the gap; a missing value counts as 0.5."""
    out = _ranked(df, rank_table(df, ref, column, parts=class_parts(y)), column, [])

    def mid(p: str) -> Column:
        both = F.col(f"{p}_below") * 2 + F.col(f"{p}_equal")
        return F.coalesce(F.try_divide(both, F.col(f"{p}_size") * 2), F.lit(0.5))

    new = {f"{column}_mid0": mid("c0"), f"{column}_mid1": mid("c1"), f"{column}_mid_gap": mid("c1") - mid("c0")}
    return _drop_parts(out.withColumns(new), ["c0", "c1"])


def conditional_pctrank(df: DataFrame, ref: DataFrame, column: str, by: list[str], min_rows: int = 5) -> DataFrame:
    """Percentile rank inside the reference rows of the row's own group; below ``min_rows`` of them, in all."""
    name = f"{column}_pct_in_{'_'.join(by)}"
    whole = pctrank_against(df, ref, column)
    out = _ranked(whole, rank_table(df, ref, column, by), column, by)
    own = F.when(F.col("all_size") >= min_rows, _share("all"))
    return _drop_parts(out.withColumn(name, F.coalesce(own, F.col(f"{column}_pct"))), ["all"]).drop(f"{column}_pct")


def zscore_against(df: DataFrame, ref: DataFrame, column: str, y: str | None = None) -> DataFrame:
    """Z-score with the reference mean and population deviation (0 if that is 0); with ``y`` per class, and |z1| - |z0|."""
    parts = {"z": F.lit(True), **({"z0": F.col(y) == 0, "z1": F.col(y) == 1} if y else {})}
    stats = ref.agg(
        *[f(F.when(p, F.col(column))).alias(f"_{n}_{s}") for n, p in parts.items() for s, f in (("mu", F.avg), ("sd", F.stddev_pop))]
    )
    out = attach_row(df, stats)
    new = {}
    for n in parts:
        mu, sd = F.col(f"_{n}_mu"), F.col(f"_{n}_sd")
        new[f"{column}_{n}"] = F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(column) - mu, sd))
    out = out.withColumns(new)
    if y:
        out = out.withColumn(f"{column}_z_gap", F.abs(F.col(f"{column}_z1")) - F.abs(F.col(f"{column}_z0")))
    return out.drop(*stats.columns)


def quantile_distance(df: DataFrame, ref: DataFrame, column: str, y: str, qs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Absolute distance to each quantile of either class, and the difference class 0 minus class 1."""
    split = ref.select(F.when(F.col(y) == 0, F.col(column)).alias("c0"), F.when(F.col(y) == 1, F.col(column)).alias("c1"))
    out = attach_row(df, exact_quantiles(split, ["c0", "c1"], list(qs)))
    new = {}
    for q in qs:
        tag = f"q{round(q * 100)}"
        d0, d1 = (F.abs(F.col(column) - F.col(quantile_name(c, q))) for c in ("c0", "c1"))
        new |= {f"{column}_d0_{tag}": d0, f"{column}_d1_{tag}": d1, f"{column}_dgap_{tag}": d0 - d1}
    return out.withColumns(new).select(*df.columns, *new)


HERMITE_TERMS = 24
REACH = 9


def gaussian_density(df: DataFrame, ref: DataFrame, column: str) -> DataFrame:
    """Per distinct value of ``df`` the Gaussian kernel density of ``ref`` with Scott's bandwidth: ``(_value, density)``.

    Reference rows are summed into boxes one bandwidth wide, as moments around the box centre (the Hermite series
    of the fast Gauss transform, Greengard and Strain 1991); a value then reads only the boxes within nine
    bandwidths. The truncation is below 1e-17, and no pair of rows is ever formed. A ``ref`` without spread has no bandwidth
    and gives no rows.
    """
    shape = ref.agg(F.count(column).alias("_n"), F.stddev_samp(column).alias("_sd"), F.min(column).alias("_origin"))
    shape = shape.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))

    def boxed(frame: DataFrame, value: str) -> DataFrame:
        return attach_row(frame, shape).withColumn("_box", F.floor(F.try_divide(F.col(value) - F.col("_origin"), F.nullif("_h", F.lit(0.0)))))

    scale = F.lit(math.sqrt(2.0))
    sources = boxed(ref.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_s")), "_s")
    offset = F.try_divide(F.col("_s") - F.col("_origin"), F.nullif("_h", F.lit(0.0))) - (F.col("_box") + F.lit(0.5))
    moments = [F.sum(F.pow(F.col("_o"), F.lit(float(i)))).alias(f"_a{i}") for i in range(1, HERMITE_TERMS)]
    boxes = materialize(
        sources.withColumn("_o", offset / scale).groupBy("_box").agg(F.count(F.lit(1)).cast("double").alias("_a0"), *moments)
    )
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_value")).distinct()
    near = F.explode(F.sequence(F.col("_box") - REACH, F.col("_box") + REACH))
    targets = boxed(values, "_value").withColumn("_at", near).drop("_box")
    pairs = targets.join(boxes.withColumnRenamed("_box", "_at"), "_at", "left")
    x = (F.try_divide(F.col("_value") - F.col("_origin"), F.nullif("_h", F.lit(0.0))) - (F.col("_at") + F.lit(0.5))) / scale
    pairs = pairs.withColumn("_x", x).withColumn("_h0", F.exp(-F.col("_x") * F.col("_x")))
    pairs = pairs.withColumn("_h1", F.lit(2.0) * F.col("_x") * F.col("_h0"))
    total = F.col("_a0") * F.col("_h0") + F.col("_a1") * F.col("_h1")
    for i in range(2, HERMITE_TERMS):
        step = F.lit(2.0) * F.col("_x") * F.col(f"_h{i - 1}") - F.lit(2.0 * (i - 1)) * F.col(f"_h{i - 2}")
        pairs = pairs.withColumn(f"_h{i}", step)
        total = total + F.col(f"_a{i}") * F.col(f"_h{i}") / F.lit(float(math.factorial(i)))
    summed = pairs.select("_value", "_n", "_h", F.coalesce(total, F.lit(0.0)).alias("_t")).groupBy("_value").agg(
        F.sum("_t").alias("_t"), F.first("_n").alias("_n"), F.first("_h").alias("_h")
    )
    norm = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2.0 * math.pi))
    return summed.select("_value", (F.greatest(F.col("_t"), F.lit(0.0)) / norm).alias("density"))


def kde_log_ratio(df: DataFrame, ref: DataFrame, column: str, y: str, eps: float = 1e-10) -> DataFrame:
    """``ln((density of class 1 + eps) / (density of class 0 + eps))`` at the row's value; NULL if a class does not vary."""
    out = df.withColumn("_value", F.col(column).cast("double"))
    for c in (0, 1):
        table = materialize(gaussian_density(df, ref.filter(F.col(y) == c), column))
        out = lookup(out, table.withColumnRenamed("density", f"_d{c}"), ["_value"])
    ratio = F.ln((F.col("_d1") + F.lit(eps)) / (F.col("_d0") + F.lit(eps)))
    return out.withColumn(f"{column}_kde_log_ratio", ratio).drop("_value", "_d0", "_d1")
