"""Closed-form statistics over counts and moments; undefined results are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % normal quantile used for Wilson bounds.
WILSON_Z = 1.959963984540054


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def clamp01(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r over rows where both are present, null if constant.

    ``corr`` raises on a constant column under ANSI, so the quotient is guarded.
    """
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_samp(F.when(both, x))
    sy = F.stddev_samp(F.when(both, y))
    r = F.try_divide(F.covar_samp(x, y), sx * sy)
    return F.when(~F.isnan(r), r)


def weighted_pearson(x: Column, y: Column, n: Column) -> Column:
    """Aggregate: Pearson r of rows that each stand for ``n`` observations.

    For ranks, whose values are exact halves; callers centre them first.
    """
    total, sx, sy = F.sum(n), F.sum(n * x), F.sum(n * y)
    sxy, sxx, syy = F.sum(n * x * y), F.sum(n * x * x), F.sum(n * y * y)
    cov = sxy - F.try_divide(sx * sy, total)
    vx = sxx - F.try_divide(sx * sx, total)
    vy = syy - F.try_divide(sy * sy, total)
    return F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))


def adjusted_skewness(g1: Column, n: Column, minimum: Column, maximum: Column) -> Column:
    """Bias-adjusted Fisher-Pearson skewness from the population coefficient."""
    n = n.cast("double")
    adjusted = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when((n >= 3) & (minimum < maximum), adjusted)


def n_log_n(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 0, n * F.ln(n)).otherwise(F.lit(0.0))


def entropy(sum_n_log_n: Column, total: Column) -> Column:
    """Shannon entropy (nats) of counts from their sum of n ln n."""
    total = total.cast("double")
    return F.when(total > 0, F.ln(total) - F.try_divide(sum_n_log_n, total))


def uncertainty(h_target: Column, h_other: Column, h_joint: Column) -> Column:
    """Theil's U of the target given the other variable, clamped to [0, 1]."""
    value = F.try_divide(h_target + h_other - h_joint, h_target)
    return F.when(h_target > 1e-12, clamp01(value))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a·d)/(b·c); one half is added to all cells when any cell is zero."""
    cells = [x.cast("double") for x in (a, b, c, d)]
    some_zero = (cells[0] == 0) | (cells[1] == 0) | (cells[2] == 0) | (cells[3] == 0)
    shift = F.when(some_zero, F.lit(0.5)).otherwise(F.lit(0.0))
    a, b, c, d = (x + shift for x in cells)
    empty = (cells[0] + cells[1] + cells[2] + cells[3]) == 0
    return F.when(~empty, F.try_divide(a * d, b * c))


def wilson(successes: Column, total: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    n = F.nullif(total.cast("double"), F.lit(0.0))
    p = successes.cast("double") / n
    scale = 1 + (z * z) / n
    centre = (p + (z * z) / (2 * n)) / scale
    margin = z * F.sqrt(p * (1 - p) / n + (z * z) / (4 * n * n)) / scale
    lower = F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - margin))
    upper = F.when(n.isNotNull(), F.least(F.lit(1.0), centre + margin))
    return lower, upper


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return ratio_or_zero((1 + b2) * precision * recall, b2 * precision + recall)
