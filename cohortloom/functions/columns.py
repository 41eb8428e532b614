"""Column expressions: everything here stays in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def required(ok: Column, value: Column, message: str) -> Column:
    """value where ok holds; elsewhere the query fails with the message."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("void"))


def strict_binary(x: Column, name: str) -> Column:
    """0 or 1 as an integer; anything else, null included, fails: 0.5 isn't rounded."""
    d = x.cast("double")
    return required(F.coalesce(d.isin(0.0, 1.0), F.lit(False)), d.cast("int"), f"{name} must be 0 or 1")


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.when(p.isNotNull(), F.ln(q / (1 - q)))  # greatest and least pass over nulls


def expit(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def softplus(z: Column) -> Column:
    """ln(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def wilson(k: Column, n: Column, clipped: bool = True) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval; null at n = 0."""
    k, n = k.cast("double"), n.cast("double")
    z2 = Z95 * Z95
    share = k / n
    centre = (share + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low, high = centre - half, centre + half
    if clipped:
        low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
    return F.when(n > 0, low), F.when(n > 0, high)


def half_up(x: Column, places: int = 3) -> Column:
    """Decimal rounding for display, halves away from zero."""
    return F.round(F.round(x, 12).cast("decimal(38,12)"), places)


def unbiased_skew(x: Column) -> Column:
    """Aggregate: bias-corrected skewness."""
    n = F.count(x).cast("double")
    return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)


def unbiased_kurtosis(x: Column) -> Column:
    """Aggregate: bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of the complete pairs, within -1 and 1; null without spread."""
    x, y = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    return F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))  # greatest and least pass over nulls


def unit(values: Column) -> Column:
    """An array scaled to length 1; null at length 0."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm > 0, F.transform(values, lambda v: v / norm))


def centred_log(values: Column) -> Column:
    """Centred log-ratio of an array of positive numbers; others fail."""
    logs = F.transform(values, lambda v: required(finite(v) & (v > 0), F.ln(v), "values must be positive and finite"))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, v: a + v) / F.size(logs)
    return F.transform(logs, lambda v: v - mean)


def within(a: Column, b: Column, absolute: float = 1e-12) -> Column:
    """Equal up to a tolerance, or both null."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= absolute)


def safe_path(p: Column) -> Column:
    """A relative path without drives, parents, device names or trailing dots and spaces."""
    device = r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)"
    return (p != "") & ~p.startswith("/") & ~p.rlike(r"[\\:*?\"<>|\x00-\x1f]") & ~p.rlike(r"(^|/)\.{1,2}(/|$)") & ~p.rlike(r"[. ](/|$)") & ~p.rlike(r"//|/$") & ~p.rlike(device)
