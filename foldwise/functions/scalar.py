"""Scalar column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digit(x: Column | str, k: int) -> Column:
    """Decimal digit of ``x`` at position ``k``, floor division and a modulus with the sign of the divisor."""
    c = as_column(x).cast("double")
    scaled = c / F.lit(10.0**k) if k >= 0 else c * F.lit(10.0**-k)
    return F.pmod(F.floor(scaled), F.lit(10)).cast("int")


def clip(x: Column | str, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Value limited to ``[low, high]``; NULL stays NULL."""
    c = as_column(x)
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def to_logit(p: Column | str, eps: float = 1e-6, bound: float = 30.0) -> Column:
    inside = clip(p, eps, 1.0 - eps)
    return clip(F.ln(inside / (F.lit(1.0) - inside)), -bound, bound)


def from_logit(z: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_column(z)))


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation (an aggregate) over the rows where both are set; NULL where a side does not vary."""
    a, b = as_column(a).cast("double"), as_column(b).cast("double")
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def hinge(x: Column | str, low: float, width: float | None) -> Column:
    """``clip(x - low, 0, width)``; an open end with ``width=None``."""
    return clip(as_column(x) - F.lit(float(low)), 0.0, width)


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


# Coefficients of Acklam's published rational approximation of the normal quantile function.
NORMAL_CENTRE_NUM = [
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
]
NORMAL_CENTRE_DEN = [
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0,
]
NORMAL_TAIL_NUM = [
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
]
NORMAL_TAIL_DEN = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
NORMAL_TAIL_START = 0.02425


def normal_quantile(p: Column | str) -> Column:
    """Standard normal quantile of ``0 < p < 1`` (absolute error about 1e-9)."""
    c = as_column(p)
    q = c - F.lit(0.5)
    r = q * q
    centre = _polynomial(r, NORMAL_CENTRE_NUM) * q / _polynomial(r, NORMAL_CENTRE_DEN)
    low = F.sqrt(F.lit(-2.0) * F.ln(c))
    high = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - c))
    tail = lambda s: _polynomial(s, NORMAL_TAIL_NUM) / _polynomial(s, NORMAL_TAIL_DEN)
    return (
        F.when(c < NORMAL_TAIL_START, tail(low)).when(c > 1.0 - NORMAL_TAIL_START, -tail(high)).otherwise(centre)
    )
