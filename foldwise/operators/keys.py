"""Composite keys, vocabularies and their codes."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from foldwise.kernels.jobs import in_parallel
from foldwise.kernels.keyed import COLUMN, KEY, attach_keyed, keyed_stats
from foldwise.kernels.lookup import attach_row, lookup
from foldwise.kernels.scan import join_on, value_scan
from foldwise.kernels.store import materialize

MISSING_TEXT = "nan"  # fixed value: how a missing part is written inside a composite key


def ngram_name(columns: tuple[str, ...] | list[str]) -> str:
    return "__".join(columns)


def ngram_keys(df: DataFrame, columns: list[str], n: int, sep: str = "_") -> DataFrame:
    """A text key for every combination of ``n`` columns; a missing part is written ``nan``."""
    part = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TEXT)) for c in columns}
    return df.withColumns({ngram_name(g): F.concat_ws(sep, *[part[c] for c in g]) for g in combinations(columns, n)})


def ladder_keys(df: DataFrame, column: str, divisors: list[int]) -> DataFrame:
    """Integer keys ``rint(x) // d``; half-even rounding, floor division."""
    whole = F.rint(F.col(column).cast("double"))
    return df.withColumns({f"{column}_div{d}": F.floor(whole / F.lit(float(d))) for d in divisors})


def vocabulary(pool: DataFrame, column: str, first: int = 0) -> DataFrame:
    """Distinct non-NULL values in ascending order with dense codes from ``first``: ``(value, code)``."""
    values = pool.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    ranked = value_scan(values, [], "value", {"code": F.lit(1)})
    return ranked.select("value", (F.col("code") + first).cast("int").alias("code"))


def label_encode(df: DataFrame, pool: DataFrame, columns: list[str], unseen: int = -1) -> DataFrame:
    """``<c>_code``: position of the value in the sorted vocabulary of ``pool``; other values give ``unseen``."""
    out = df
    for c in columns:
        codes = materialize(vocabulary(pool, c)).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        out = lookup(out, codes, [c], {f"{c}_code": unseen})
    return out


def integer_encode(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """``<c>_code`` from 1 upward over the values of the fit rows; 0 is kept for unknown ones."""
    out = df
    for c in columns:
        codes = materialize(vocabulary(fit, c, first=1)).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        out = lookup(out, codes, [c], {f"{c}_code": 0})
    return out


def factorize(df: DataFrame, column: str, order: str, pool: DataFrame | None = None) -> DataFrame:
    """``<c>_code`` in order of first appearance by the unique number ``order``; NULL and unseen give -1."""
    source = df if pool is None else pool
    first = source.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    ranked = value_scan(first, [], "_first", {"_code": F.lit(1)})
    codes = materialize(ranked.select(column, F.col("_code").cast("int").alias(f"{column}_code")))
    return lookup(df, codes, [column], {f"{column}_code": -1})


def level_list(pool: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted values of a closed vocabulary; fails above ``limit`` instead of growing with the data."""
    rows = pool.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} levels: encode it instead of widening the table")
    return sorted(r[0] for r in rows)


def level_name(column: str, level: object) -> str:
    return f"{column}_is_{re.sub(r'[^0-9a-z]+', '_', str(level).lower())}"


def one_hot(df: DataFrame, column: str, vocab: list, keep: bool = True) -> DataFrame:
    """A 0/1 column per level of a fixed vocabulary; an unseen or missing value gives all zeros."""
    out = df.withColumns({level_name(column, v): F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in vocab})
    return out if keep else out.drop(column)


def as_category(df: DataFrame, columns: list[str], suffix: str = "_cat") -> DataFrame:
    """Text twins of numeric columns; the numbers stay."""
    return df.withColumns({c + suffix: F.col(c).cast("string") for c in columns})


def _seen(pool: DataFrame, columns: list[str], nulls: bool) -> DataFrame:
    return keyed_stats(pool, columns, {"_seen": F.lit(1)}, nulls=nulls)


def filter_representable(df: DataFrame, pool: DataFrame, columns: list[str], cap: float) -> DataFrame:
    """Keep the rows whose every value, NULL included, occurs in ``pool``; fail if more than ``cap`` of them go."""
    marked = attach_keyed(df, _seen(pool, columns, nulls=True), columns, lambda c, m: f"_seen_{c}", ["_seen"])
    known = F.lit(True)
    for c in columns:
        known = known & F.col(f"_seen_{c}").isNotNull()
    share = marked.agg(F.avg((~known).cast("int"))).first()[0] or 0.0
    if share > cap:
        raise ValueError(f"{share:.2%} of the rows hold a value outside the pool, above the cap of {cap:.2%}")
    return marked.filter(known).select(*df.columns)


def novelty_flag(df: DataFrame, orig: DataFrame, columns: list[str]) -> DataFrame:
    """``<c>_novel``: 1 where the value does not occur in ``orig``."""
    marked = attach_keyed(df, _seen(orig, columns, nulls=False), columns, lambda c, m: f"_seen_{c}", ["_seen"])
    flags = {f"{c}_novel": F.col(f"_seen_{c}").isNull().cast("int") for c in columns}
    return marked.withColumns(flags).select(*df.columns, *flags)


def key_counts(pool: DataFrame, columns: list[str], normalize: bool) -> DataFrame:
    """Count, or share of the non-NULL rows, per value of each column."""
    counts = keyed_stats(pool, columns, {"n": F.count(F.lit(1))})
    if not normalize:
        return counts
    totals = counts.groupBy(COLUMN).agg(F.sum("n").alias("_total"))
    return counts.join(totals, COLUMN).select(COLUMN, KEY, (F.col("n") / F.col("_total")).alias("n"))


def freq_encode(df: DataFrame, pool: DataFrame, columns: list[str], normalize: bool = True) -> DataFrame:
    """``<c>_freq``: share (or count) of the value in ``pool``; 0 if absent."""
    zero = 0.0 if normalize else 0
    return attach_keyed(df, key_counts(pool, columns, normalize), columns, lambda c, m: f"{c}_freq", ["n"], {"n": zero})


def rarity_encode(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """``<c>_rarity``: -ln(max(share in the fit rows, 1/n))."""
    size = fit.agg(F.count(F.lit(1)).alias("_size"))

    out = attach_row(freq_encode(df, fit, columns), size)
    floor = F.lit(1.0) / F.col("_size")
    out = out.withColumns({f"{c}_rarity": -F.ln(F.greatest(F.col(f"{c}_freq"), floor)) for c in columns})
    return out.drop("_size", *[f"{c}_freq" for c in columns])


def lift_encode(df: DataFrame, pool: DataFrame, orig: DataFrame, columns: list[str]) -> DataFrame:
    """``<c>_lift``: share in ``pool`` over share in ``orig``; 0 where the value is not in ``orig``."""
    p, o = key_counts(pool, columns, True), key_counts(orig, columns, True)
    ratio = o.withColumnRenamed("n", "_orig").join(p, [COLUMN, KEY], "left")
    table = ratio.select(COLUMN, KEY, (F.coalesce(F.col("n"), F.lit(0.0)) / F.col("_orig")).alias("lift"))
    stored = materialize(table, partition_by=COLUMN)
    return attach_keyed(df, stored, columns, lambda c, m: f"{c}_lift", ["lift"], {"lift": 0.0})


def pair_lift(df: DataFrame, pool: DataFrame, orig: DataFrame, columns: list[str]) -> DataFrame:
    """``<a>__<b>_lift`` and ``<a>__<b>_novel`` of every column pair: share in ``pool`` over share in ``orig`` (0 if not there), and 1
    where the pair does not occur in ``orig``.

    A pair is keyed by its two columns, so different pairs never meet in one text; NULL parts match NULL. Each sample is counted
    once per pair, all pairs side by side.
    """
    whole = pool.agg(F.count(F.lit(1)).alias("_all_p")), orig.agg(F.count(F.lit(1)).alias("_all_o"))

    def fitted(a: str, b: str) -> DataFrame:
        own, other = (d.groupBy(a, b).agg(F.count(F.lit(1)).alias(n)) for d, n in ((orig, "_o"), (pool, "_p")))
        both = attach_row(attach_row(join_on(own, other, [a, b]), whole[0]), whole[1])
        lift = F.coalesce("_p", F.lit(0)) / F.col("_all_p") / (F.col("_o") / F.col("_all_o"))
        return materialize(both.select(a, b, lift.alias("_lift")))

    pairs = list(combinations(columns, 2))
    out = df
    for (a, b), table in zip(pairs, in_parallel(df.sparkSession, [lambda p=p: fitted(*p) for p in pairs])):
        name = ngram_name((a, b))
        new = {f"{name}_lift": F.coalesce("_lift", F.lit(0.0)), f"{name}_novel": F.col("_lift").isNull().cast("int")}
        out = lookup(out, table, [a, b]).withColumns(new).drop("_lift")
    return out
