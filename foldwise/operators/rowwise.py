"""Features computed from one row at a time: no shuffle, except one small aggregate where a maximum is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.scalar import as_column, clip, digit
from foldwise.kernels.lookup import attach_row
from foldwise.operators.schema import literal_map


def add_digits(df: DataFrame, columns: list[str], positions: range | list[int] = range(-4, 4)) -> DataFrame:
    """``<c>_digit<k>`` for each column and decimal position."""
    return df.withColumns({f"{c}_digit{k}": digit(c, k) for c in columns for k in positions})


def round_by_magnitude(df: DataFrame, columns: list[str]) -> DataFrame:
    """Round half-even to 3 digits if the column maximum is below 10, 2 if below 100, else 1."""
    tops = df.agg(*[F.max(c).alias(f"_top_{c}") for c in columns])
    out = attach_row(df, tops)
    for c in columns:
        top = F.col(f"_top_{c}")
        out = out.withColumn(
            c, F.when(top < 10, F.bround(c, 3)).when(top < 100, F.bround(c, 2)).otherwise(F.bround(c, 1))
        )
    return out.select(*df.columns)


def add_digit_strings(df: DataFrame, column: str, scales: tuple[int, ...] = (10, 100)) -> DataFrame:
    """Digits of the whole part as text positions, fractional part, moduli, multiples, distance to round values."""
    x = F.col(column).cast("double")
    whole = F.floor(x)
    text = whole.cast("string")
    new = {
        f"{column}_first_digit": F.substring(text, 1, 1).cast("int"),
        f"{column}_second_digit": F.when(F.length(text) > 1, F.substring(text, 2, 1)).otherwise("0").cast("int"),
        f"{column}_last_digit": F.substring(text, -1, 1).cast("int"),
        f"{column}_num_digits": F.length(text),
        f"{column}_fractional": x - whole,
        f"{column}_mod12": F.pmod(whole, F.lit(12)),
        f"{column}_per_digit": x / (F.length(text) + F.lit(0.001)),
    }
    for s in scales:
        rounded = F.rint(x / F.lit(float(s))) * F.lit(float(s))
        new[f"{column}_mod{s}"] = F.pmod(whole, F.lit(s))
        new[f"{column}_is_multiple_{s}"] = (F.pmod(whole, F.lit(s)) == 0).cast("int")
        new[f"{column}_dev_from_round{s}"] = F.abs(x - rounded)
    return df.withColumns(new)


def product(a: str, b: str) -> Column:
    return F.col(a) * F.col(b)


def product_gap(a: str, b: str, c: str) -> Column:
    """``a - b * c``: what is left of a total after rate times count."""
    return F.col(a) - F.col(b) * F.col(c)


def ratio(a: str, b: str, eps: float = 1.0) -> Column:
    return F.col(a) / (F.col(b) + F.lit(eps))


def ratio_square(a: str, b: str, eps: float = 1.0) -> Column:
    return F.col(a) / (F.col(b) * F.col(b) + F.lit(eps))


def log_ratio(a: str, b: str) -> Column:
    """``ln(1 + a) - ln(1 + b)`` of values clipped at 0."""
    return F.log1p(clip(a, 0.0)) - F.log1p(clip(b, 0.0))


def add_interactions(df: DataFrame, spec: dict[str, Column]) -> DataFrame:
    """Named arithmetic expressions, usually built by the helpers above."""
    return df.withColumns(spec)


def transform_column(column: str, kind: str, scale: float = 1.0) -> Column:
    x = F.col(column).cast("double")
    kinds = {
        "log1p": lambda: F.log1p(clip(x, 0.0)),
        "sqrt": lambda: F.sqrt(clip(x, 0.0)),
        "cbrt": lambda: F.cbrt(x),
        "square": lambda: x * x,
        "cube": lambda: x * x * x,
        "inverse": lambda: F.lit(1.0) / (x + F.lit(1.0)),
        "tanh": lambda: F.tanh(x / F.lit(scale)),
        "saturate": lambda: F.lit(1.0) - F.exp(-x / F.lit(scale)),
    }
    return kinds[kind]()


def add_transforms(df: DataFrame, columns: list[str], kinds: list[str], scale: float = 1.0) -> DataFrame:
    """Monotone transforms ``<c>_<kind>``; ``sigmoid`` is that of the z-score (sample deviation plus 1e-5)."""
    out = df
    if "sigmoid" in kinds:
        stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_samp))])
        out = attach_row(df, stats)
    new = {}
    for c in columns:
        for kind in kinds:
            if kind == "sigmoid":
                z = (F.col(c) - F.col(f"_mu_{c}")) / (F.col(f"_sd_{c}") + F.lit(1e-5))
                new[f"{c}_sigmoid"] = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
            else:
                new[f"{c}_{kind}"] = transform_column(c, kind, scale)
    return out.withColumns(new).select(*df.columns, *new)


def add_periodic(df: DataFrame, column: str, period: float) -> DataFrame:
    angle = F.lit(2.0) * F.pi() * F.col(column) / F.lit(float(period))
    return df.withColumns({f"{column}_sin": F.sin(angle), f"{column}_cos": F.cos(angle)})


def linear_score(
    df: DataFrame,
    coefficients: dict[str, float],
    levels: dict[tuple[str, str], float] | None = None,
    intercept: float = 0.0,
    name: str = "score",
) -> DataFrame:
    """Hand-set linear formula: number terms, and level terms for (column, level); a NULL number adds nothing."""
    total = F.lit(float(intercept))
    for c, w in coefficients.items():
        total = total + F.coalesce(F.col(c) * F.lit(float(w)), F.lit(0.0))
    for (c, level), w in (levels or {}).items():
        total = total + F.when(F.col(c) == level, F.lit(float(w))).otherwise(F.lit(0.0))
    return df.withColumn(name, total)


def add_flags(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """0/1 columns; a condition that is NULL counts as 0."""
    return df.withColumns({n: F.coalesce(rule.cast("int"), F.lit(0)) for n, rule in rules.items()})


def ordinal_map(df: DataFrame, column: str, mapping: dict, default: object, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.try_element_at(literal_map(mapping), F.col(column)), F.lit(default)))


def banded(df: DataFrame, name: str, conditions: list[tuple[Column, object]], default: object) -> DataFrame:
    """First matching condition wins."""
    out = None
    for condition, value in conditions:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return df.withColumn(name, out.otherwise(F.lit(default)))


def _kept(columns: list[str], ignore: float | None) -> tuple[Column, Column, Column]:
    """Count, sum and sum of squares over the columns that are neither NULL nor the sentinel."""
    valid = [F.col(c).isNotNull() & ((F.col(c) != F.lit(ignore)) if ignore is not None else F.lit(True)) for c in columns]
    n, s, ss = F.lit(0), F.lit(0.0), F.lit(0.0)
    for c, ok in zip(columns, valid):
        x = F.col(c).cast("double")
        n = n + F.when(ok, 1).otherwise(0)
        s = s + F.when(ok, x).otherwise(0.0)
        ss = ss + F.when(ok, x * x).otherwise(0.0)
    return n, s, ss


def row_stats(
    df: DataFrame, columns: list[str], ignore: float | None = None, prefix: str = "row", ddof: int = 1
) -> DataFrame:
    """Mean, standard deviation, minimum, maximum and range over the columns of a row, without the sentinel.

    With no value left all are NULL; with ``ddof`` values or fewer the deviation is.
    """
    n, s, _ = _kept(columns, ignore)
    keep = [
        F.when(F.col(c) != F.lit(ignore), F.col(c).cast("double")) if ignore is not None else F.col(c).cast("double")
        for c in columns
    ]
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    squares = F.lit(0.0)
    for k in keep:
        squares = squares + F.coalesce((k - F.col("_m")) * (k - F.col("_m")), F.lit(0.0))
    low, high = (f(*keep) if len(keep) > 1 else keep[0] for f in (F.least, F.greatest))
    out = df.withColumns({"_n": n, "_s": s}).withColumn("_m", mean)
    out = out.withColumns(
        {
            f"{prefix}_mean": F.col("_m"),
            f"{prefix}_std": F.when(F.col("_n") > ddof, F.sqrt(squares / (F.col("_n") - ddof))),
            f"{prefix}_min": low,
            f"{prefix}_max": high,
            f"{prefix}_range": high - low,
        }
    )
    return out.drop("_n", "_s", "_m")


def row_counts(df: DataFrame, columns: list[str], tests: dict[str, object]) -> DataFrame:
    """Per test (a function of a Column) the number of columns that pass it; NULL never passes."""
    new = {}
    for name, test in tests.items():
        total = F.lit(0)
        for c in columns:
            total = total + F.coalesce(test(F.col(c)).cast("int"), F.lit(0))
        new[name] = total
    return df.withColumns(new)


def row_sorted(df: DataFrame, columns: list[str], prefix: str = "sorted") -> DataFrame:
    """The row's values in ascending order as new columns, with mean, population deviation, maximum, minimum, range."""
    ordered = F.array_sort(F.array(*[F.col(c).cast("double") for c in columns]))
    out = df.withColumn("_sorted", ordered)
    out = out.withColumns({f"{prefix}_{i}": F.col("_sorted")[i] for i in range(len(columns))}).drop("_sorted")
    return row_stats(out, columns, prefix=prefix, ddof=0)


def row_center(df: DataFrame, columns: list[str], ignore: float = 0.0, suffix: str = "_centred") -> DataFrame:
    """Value minus the row mean over rated columns; 0 where not rated."""
    n, s, _ = _kept(columns, ignore)
    out = df.withColumns({"_n": n, "_s": s})
    rated = {
        c + suffix: F.when(F.col(c) != F.lit(ignore), F.col(c) - F.col("_s") / F.col("_n")).otherwise(F.lit(0.0))
        for c in columns
    }
    return out.withColumns(rated).drop("_n", "_s")


def delay_features(df: DataFrame, first: str, second: str, per: str | None = None) -> DataFrame:
    """Gap and total of two delays where the second may be missing: it then counts as the first."""
    total = F.col(first) + F.coalesce(F.col(second), F.col(first))
    new = {
        f"{first}_positive": F.coalesce((F.col(first) > 0).cast("int"), F.lit(0)),
        f"{second}_missing": F.col(second).isNull().cast("int"),
        "delay_gap": F.col(second) - F.col(first),
        "delay_total": total,
    }
    if per:
        new["delay_per_100"] = F.try_divide(total, F.col(per) / F.lit(100.0))
    return df.withColumns(new)


def cell_code(df: DataFrame, bins: list[str], radix: list[int], name: str = "cell") -> DataFrame:
    """One integer from several small codes; ``radix[i]`` is the number of levels of ``bins[i]``."""
    code = F.lit(0)
    for b, r in zip(bins, radix):
        code = code * F.lit(r) + F.col(b)
    return df.withColumn(name, code)


def route(df: DataFrame, rules: list[tuple[Column, Column]], default: Column, name: str = "routed") -> DataFrame:
    """Prediction of the first rule whose condition holds, else the default blend."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return df.withColumn(name, out.otherwise(as_column(default)))
