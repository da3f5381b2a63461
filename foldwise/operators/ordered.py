"""Ranks, lags, rolling means and range-window rates.

Windows are cut into bounded pieces: by slices of the order with carried values, or by chunks of the axis with a
margin copied from the neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.scan import SLICE, add_slices, join_on, row_numbers, slice_count, slice_hot_groups, split_points, value_scan
from foldwise.kernels.store import materialize


# Types whose values a double holds exactly, so that columns of different types fit into one long table.
SMALL_NUMBERS = {"double", "float", "integer", "short", "byte"}


def pct_rank(df: DataFrame, columns: list[str], by: list[str] | None = None, suffix: str = "_rank") -> DataFrame:
    """``<c>_rank``: average rank of the value over the number of set values, in the table or in its group.

    Numeric columns are counted, scanned and stored together, one job each for all of them; a column then meets only its own
    part of the stored table.
    """
    by = by or []
    if {df.schema[c].dataType.typeName() for c in columns} <= SMALL_NUMBERS:
        long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "_column", "_value")
        shares = _rank_shares(long, [*by, "_column"], partition_by="_column")
        parts = {c: shares.filter(F.col("_column") == c).drop("_column") for c in columns}
    else:
        parts = {c: _rank_shares(df.select(*by, F.col(c).alias("_value")), by) for c in columns}
    out = df
    for c in columns:
        probe = F.col(c).cast(parts[c].schema["_value"].dataType)
        out = lookup(out.withColumn("_value", probe), parts[c].withColumnRenamed("_share", c + suffix), [*by, "_value"]).drop("_value")
    return out


def _rank_shares(values: DataFrame, by: list[str], partition_by: str | None = None) -> DataFrame:
    """Stored ``(by..., _value, _share)``: average rank over size per distinct value."""
    counts = materialize(values.filter(F.col("_value").isNotNull()).groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n")))
    ranked = value_scan(counts, by, "_value", {"_below": F.col("_n")}, stored=True)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
    ranked = join_on(ranked, sizes, by) if by else attach_row(ranked, sizes)
    share = (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)) / F.col("_size")
    return materialize(ranked.select(*by, "_value", share.alias("_share")), partition_by)


def add_lags(
    df: DataFrame, keys: list[str], order: list[str], lead: Column, columns: list[str], default: float = 0.0, hot_rows: int | None = None
) -> DataFrame:
    """``<c>_lag1``: value of the previous row of the entity; the first row takes ``default``."""
    sliced, cut = slice_hot_groups(df, keys, lead, hot_rows)
    within = W.partitionBy(*keys, SLICE).orderBy(*order)
    previous = F.lag(F.struct(*[F.col(c) for c in columns])).over(within)
    out = sliced.withColumn("_prev", previous)
    if cut:
        last = sliced.groupBy(*keys, SLICE).agg(
            F.max_by(F.struct(*[F.col(c) for c in columns]), F.struct(*order)).alias("_last")
        )
        carried = last.select(*keys, SLICE, F.lag("_last").over(W.partitionBy(*keys).orderBy(SLICE)).alias("_carry"))
        out = join_on(out, carried.filter(F.col("_carry").isNotNull()), [*keys, SLICE])
        out = out.withColumn("_prev", F.coalesce("_prev", "_carry"))
    first = F.col("_prev").isNull()
    new = {f"{c}_lag1": F.when(first, F.lit(default)).otherwise(F.col("_prev")[c]) for c in columns}
    return out.withColumns(new).select(*df.columns, *new)


def in_chunks(df: DataFrame, axis: str, before: int, after: int, chunk: int) -> DataFrame:
    """Copy each row to its own chunk of an integer axis and to those whose margin it lies in (``_own`` marks the first)."""
    at = F.col(axis)
    home = F.floor(at / F.lit(chunk))
    reach = F.array_distinct(F.array(home, F.floor((at - F.lit(after)) / F.lit(chunk)), F.floor((at + F.lit(before)) / F.lit(chunk))))
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(reach)).withColumn("_own", F.col("_chunk") == F.col("_home"))


def rolling_mean(
    df: DataFrame, order: list[str], lead: Column, column: str, n: int, name: str = "rolling", chunk: int = 500_000
) -> DataFrame:
    """Mean of the last ``n`` rows of the whole table in order; NULL before ``n`` rows are there."""
    marked = add_slices(df, lead, split_points(df, lead, slice_count(df)))
    placed = row_numbers(marked, [], order, SLICE, "_pos").drop(SLICE)
    pieces = in_chunks(placed, "_pos", n - 1, 0, max(chunk, n))
    last = W.partitionBy("_chunk").orderBy("_pos").rowsBetween(-(n - 1), 0)
    out = pieces.withColumn(name, F.when(F.col("_pos") >= n, F.avg(column).over(last)))
    return out.filter("_own").drop("_home", "_chunk", "_own").withColumnRenamed("_pos", "position")


def rolling_shift(df: DataFrame, order: list[str], lead: Column, column: str, n: int, ratio: float, chunk: int = 500_000) -> DataFrame:
    """One row: position of the first row whose rolling mean exceeds ``ratio`` times the overall mean, and both means."""
    mean = df.agg(F.avg(column).alias("overall"))
    rolled = attach_row(rolling_mean(df, order, lead, column, n, chunk=chunk), mean)
    over = F.col("rolling") > F.lit(float(ratio)) * F.col("overall")
    return rolled.agg(
        F.min(F.when(over, F.col("position"))).alias("position"),
        F.min_by(F.when(over, F.col("rolling")), F.when(over, F.col("position"))).alias("rolling"),
        F.max("overall").alias("overall"),
    )


def _window_sums(counts: DataFrame, by: list[str], widths: list[int], fold: str | None) -> DataFrame:
    widest = max(widths)
    pieces = in_chunks(counts, "_v", widest, widest, max(4 * widest, 1024))
    sums = {}
    for w in widths:
        every = W.partitionBy(*by, "_chunk").orderBy("_v").rangeBetween(-w, w)
        n, s = F.sum("n").over(every), F.sum("s").over(every)
        if fold is not None:
            own = W.partitionBy(*by, fold, "_chunk").orderBy("_v").rangeBetween(-w, w)
            n, s = n - F.sum("n").over(own), s - F.sum("s").over(own)
        sums |= {f"_n{w}": n, f"_s{w}": s}
    return pieces.withColumns(sums).filter("_own")


def _rates(df: DataFrame, widths: list[int], prior: float, prefix: str) -> dict[str, Column]:
    shrunk = lambda w: (F.col(f"_s{w}") + F.lit(prior) * F.col("_mu")) / (F.col(f"_n{w}") + F.lit(prior))
    return {f"{prefix}_{w}": F.coalesce(shrunk(w), F.col("_mu")) for w in widths}


def range_rate(
    df: DataFrame, fit: DataFrame, column: str, y: str, widths: list[int], prior: float, by: list[str] | None = None, prefix: str = "rate"
) -> DataFrame:
    """Smoothed label mean of the fit rows whose integer value is within ``w`` of the row's value, for each width."""
    by = by or []
    v = F.col(column).cast("bigint").alias("_v")
    known = fit.filter(F.col(column).isNotNull()).groupBy(*by, v).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))
    asked = df.filter(F.col(column).isNotNull()).select(*by, v).distinct()
    zeros = asked.select("*", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("s"))
    counts = known.unionByName(zeros).groupBy(*by, "_v").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    table = _window_sums(counts, by, widths, None).select(*by, "_v", *[f"_{p}{w}" for w in widths for p in "ns"])
    mean = fit.agg(F.avg(y).alias("_mu"))
    out = attach_row(lookup(df.withColumn("_v", F.col(column).cast("bigint")), materialize(table), [*by, "_v"]), mean)
    new = _rates(out, widths, prior, prefix)
    return out.withColumns(new).select(*df.columns, *new)


def range_rate_crossfit(
    df: DataFrame, column: str, y: str, widths: list[int], prior: float, fold: str, by: list[str] | None = None, prefix: str = "rate"
) -> DataFrame:
    """The same for fit rows, each from the other folds: window sums of all rows minus those of the own fold."""
    by = by or []
    v = F.col(column).cast("bigint").alias("_v")
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, fold, v).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))
    table = _window_sums(counts, by, widths, fold).select(*by, fold, "_v", *[f"_{p}{w}" for w in widths for p in "ns"])
    mean = df.agg(F.avg(y).alias("_mu"))
    out = attach_row(lookup(df.withColumn("_v", F.col(column).cast("bigint")), materialize(table), [*by, fold, "_v"]), mean)
    new = _rates(out, widths, prior, prefix)
    return out.withColumns(new).select(*df.columns, *new)
