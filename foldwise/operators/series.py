"""Calendar parts, daily rolling statistics, factor decomposition, group bounds and duplicate collapse."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.quantiles import exact_quantiles, quantile_name
from foldwise.kernels.store import materialize
from foldwise.operators.groups import present


def calendar_features(df: DataFrame, ts: str, harmonics: int = 1) -> DataFrame:
    """Year, month, day, weekday (1 = Sunday), day of year, and sine/cosine of month and day of year."""
    t = F.col(ts)
    new: dict[str, Column] = {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "weekday": F.dayofweek(t), "yearday": F.dayofyear(t)
    }
    turn = F.lit(2.0) * F.pi()
    for h in range(1, harmonics + 1):
        for part, period in (("month", 12.0), ("yearday", 365.0)):
            angle = turn * F.lit(float(h)) * new[part] / F.lit(period)
            new |= {f"{part}_sin{h}": F.sin(angle), f"{part}_cos{h}": F.cos(angle)}
    return df.withColumns(new)


def daily(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """One row per entity and day with the mean value and ``_day``, days since 1970.

    An entity has at most one row per calendar day, so windows over this table stay small whatever the rows behind it.
    """
    day = F.unix_date(F.col(ts).cast("date"))
    return df.groupBy(*keys, day.alias("_day")).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))


class OrderedCounts:
    """Order statistics of a multiset of ranks: add, remove and pick the k-th, each in the logarithm of the number of ranks."""

    def __init__(self, ranks: int):
        self.sums, self.size, self.top = [0] * (ranks + 1), 0, 1 << max(ranks, 1).bit_length() - 1

    def change(self, rank: int, by: int) -> None:
        self.size += by
        at = rank + 1
        while at < len(self.sums):
            self.sums[at] += by
            at += at & -at

    def pick(self, k: int) -> int:
        """Rank of the ``k``-th smallest, from 0."""
        at, step = 0, self.top
        while step:
            if at + step < len(self.sums) and self.sums[at + step] <= k:
                at += step
                k -= self.sums[at]
            step >>= 1
        return at


def medians_before(days: list[int | None], values: list[float | None], span: int | None) -> list[float | None]:
    """Median of the values of the last ``span`` days before each day (all earlier rows if None); ``days`` ascend, an unknown day first.

    As in a range frame, the row of the unknown day sees itself and no other row sees it by its day. Missing values do not count.
    """
    levels = sorted({v for v in values if v is not None})
    rank = {v: i for i, v in enumerate(levels)}
    held, oldest, out = OrderedCounts(len(levels)), 0, []
    for i, day in enumerate(days):
        if span is not None and day is None:
            out.append(values[i])
            continue
        while span is not None and oldest < i and (days[oldest] is None or days[oldest] < day - span):
            if days[oldest] is not None and values[oldest] is not None:
                held.change(rank[values[oldest]], -1)
            oldest += 1
        n = held.size
        out.append((levels[held.pick((n - 1) // 2)] + levels[held.pick(n // 2)]) / 2 if n else None)
        if values[i] is not None:
            held.change(rank[values[i]], 1)
    return out


def rolling_features(series: DataFrame, keys: list[str], days: list[int]) -> DataFrame:
    """On a daily table: mean, variance, median, minimum and maximum of the last ``d`` days and of all days before,
    both without the current day, and the previous value.

    Medians come from counted ranks in one walk over an entity's days, so they cost ``n log n`` for ``n`` days, not a sort per day. They
    use the partitioning by ``keys`` of the window before them; an entity has one row per calendar day and fits one task.
    """
    order = W.partitionBy(*keys).orderBy("_day")
    frames = {f"last{d}": order.rangeBetween(-d, -1) for d in days}
    frames["before"] = order.rowsBetween(W.unboundedPreceding, -1)
    new: dict[str, Column] = {"previous": F.lag("value").over(order)}
    for n, w in frames.items():
        new |= {
            f"{n}_mean": F.avg("value").over(w),
            f"{n}_var": F.var_samp("value").over(w),
            f"{n}_min": F.min("value").over(w),
            f"{n}_max": F.max("value").over(w),
        }
    wide = series.withColumns(new)
    spans = {f"last{d}_median": d for d in days} | {"before_median": None}

    def add_medians(entity: pa.Table) -> pa.Table:
        entity = entity.sort_by([("_day", "ascending")])
        entity = pa.concat_tables([entity.filter(pc.is_null(entity["_day"])), entity.filter(pc.is_valid(entity["_day"]))])
        at, values = entity["_day"].to_pylist(), entity["value"].to_pylist()
        for n, span in spans.items():
            entity = entity.append_column(n, pa.array(medians_before(at, values, span), pa.float64()))
        return entity

    schema = StructType([*wide.schema.fields, *[StructField(n, DoubleType()) for n in spans]])
    done = wide.groupBy(*keys).applyInArrow(add_medians, schema)
    kinds = ["mean", "var", "median", "min", "max"]
    return done.select(*series.columns, "previous", *[f"{n}_{k}" for n in frames for k in kinds])


def factor_decompose(df: DataFrame, value: str, factors: list[str]) -> tuple[DataFrame, DataFrame]:
    """Multiplicative factors estimated one after the other: level mean of what is left over its overall mean.

    Returns the rows with ``remainder`` and the table ``(factor, level, effect)``.
    """
    out, tables = df.withColumn("remainder", F.col(value).cast("double")), []
    for f in factors:
        overall = out.agg(F.avg("remainder").alias("_all"))
        level = attach_row(out.groupBy(f).agg(F.avg("remainder").alias("_m")), overall)
        table = materialize(level.select(f, (F.col("_m") / F.col("_all")).alias("_effect")))
        out = lookup(out, table, [f]).withColumn("remainder", F.col("remainder") / F.col("_effect")).drop("_effect")
        tables.append(table.select(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level"), F.col("_effect").alias("effect")))
    return out, reduce(lambda a, b: a.unionByName(b), tables)


def clip_by_group(df: DataFrame, pred: str, ref: DataFrame, keys: list[str], y: str, alpha: float, min_rows: int = 5) -> DataFrame:
    """Prediction limited above by ``Q3 + 1.5 IQR alpha`` of the reference group (more than ``min_rows`` rows) and
    raised to the group minimum; other groups are left alone."""
    rows = present(ref, keys)
    q = exact_quantiles(rows, [y], [0.25, 0.75], keys)
    ends = rows.groupBy(*keys).agg(F.min(y).alias("_floor"), F.count(F.lit(1)).alias("_n"))
    q1, q3 = F.col(quantile_name(y, 0.25)), F.col(quantile_name(y, 0.75))
    table = q.join(ends, keys).filter(F.col("_n") > min_rows).select(*keys, "_floor", (q3 + F.lit(1.5 * alpha) * (q3 - q1)).alias("_top"))
    out = lookup(df, materialize(table), keys)
    bounded = F.greatest(F.least(F.col(pred), F.coalesce(F.col("_top"), F.col(pred))), F.coalesce(F.col("_floor"), F.col(pred)))
    return out.withColumn(pred, bounded).drop("_floor", "_top")


def iqr_flag(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """``<c>_outlier``: 1 above ``Q3 + factor * IQR``."""
    table = exact_quantiles(df, [column], [0.25, 0.75])
    q1, q3 = F.col(quantile_name(column, 0.25)), F.col(quantile_name(column, 0.75))
    top = table.select((q3 + F.lit(factor) * (q3 - q1)).alias("_top"))
    flagged = attach_row(df, top).withColumn(f"{column}_outlier", F.coalesce((F.col(column) > F.col("_top")).cast("int"), F.lit(0)))
    return flagged.drop("_top")


def collapse_duplicates(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """One row per feature tuple with the mean label and the number of rows as weight."""
    return df.groupBy(*columns).agg(F.avg(y).alias(y), F.count(F.lit(1)).alias("weight"))
