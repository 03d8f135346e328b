"""Rounding, guarded division and clamping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


EXACT_BELOW = float(2**53)


def half_up(value: Column, digits: int = 2) -> Column:
    """Round half away from zero as plain double arithmetic.

    ``F.round`` on a double goes through ``BigDecimal``; this form is three codegen'd
    instructions and gives the same bits in any IEEE engine. From 2^53 on a scaled double has no
    fraction left to round, so such values (and infinities) stay as they are.
    """
    scale = float(10**digits)
    v = value.cast("double")
    scaled = F.abs(v) * F.lit(scale)
    rounded = F.signum(v) * F.floor(scaled + F.lit(0.5)) / F.lit(scale)
    return F.when(scaled < F.lit(EXACT_BELOW), rounded).otherwise(v)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` in double, 0.0 where the denominator is not positive."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` in double, NULL where the denominator is zero."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(d != 0, n / d)


def clamp(value: Column, low: float, high: float) -> Column:
    """Keep ``value`` within ``[low, high]``; NULL stays NULL (``least`` would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def mean_of(total: Column, count: Column) -> Column:
    """Mean from an exact decimal sum and a count."""
    return ratio_or_null(total, count)


def stddev_from_moments(count: Column, total: Column, total_sq: Column, scale: int) -> Column:
    """Sample standard deviation from exact decimal moments of a ``scale``-digit column.

    ``n * sum(x^2) - sum(x)^2`` is formed in decimal, so nothing cancels and the result
    does not depend on the order rows were merged in.
    """
    n = count.cast("decimal(12,0)")
    s = total.cast(f"decimal(18,{scale})")
    ss = total_sq.cast(f"decimal(24,{2 * scale})")
    spread = ((n * ss) - (s * s)).cast("double")
    c = count.cast("double")
    return F.when(count > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (c * (c - 1.0))))
