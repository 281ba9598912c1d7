"""Scalar column helpers shared by every operator (JVM-side expressions only)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

EPSILON = 2.220446049250313e-16  # added before rounding, so 1.005 rounds up


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int = 4) -> Column:
    """Round half toward +infinity at ``digits`` decimals; null stays null.

    ``F.round`` rounds half away from zero on the decimal text, which differs
    between engines; the floor form does not.
    """
    f = float(10**digits)
    x = col(c)
    scaled = (x + F.lit(EPSILON)) * F.lit(f) + F.lit(0.5)
    # floor() is a 64-bit integer; beyond 2**53 a double has no decimals left to round
    return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double") / F.lit(f)).otherwise(x)


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    """Null-preserving clamp (``least``/``greatest`` skip nulls)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, null when the denominator is null or zero."""
    num, den = col(num), col(den)
    return F.when(den != 0, num / den)


def change(current: Column | str, previous: Column | str) -> Column:
    """Growth over the absolute previous value."""
    current, previous = col(current), col(previous)
    return F.when(previous != 0, (current - previous) / F.abs(previous))


def premium(value: Column | str, reference: Column | str) -> Column:
    """value / reference - 1, only against a positive reference."""
    value, reference = col(value), col(reference)
    return F.when(reference > 0, value / reference - 1)


def volume_price_bridge(volume_change: Column | str, price_change: Column | str) -> Column:
    return (1 + col(volume_change)) * (1 + col(price_change)) - 1


def logistic(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def finite(c: Column | str) -> Column:
    """NaN and infinities become null: missing stays missing."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def weighted_mean(pairs: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are present, renormalised to their weight."""
    total = sum((F.coalesce(v * F.lit(w), F.lit(0.0)) for v, w in pairs), F.lit(0.0))
    return ratio(total, available_weight(pairs))


def available_weight(pairs: list[tuple[Column, float]]) -> Column:
    return sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in pairs), F.lit(0.0))


def row_mean(values: list[Column]) -> Column:
    """Mean over the non-null columns of a row; null if all are null."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    n = sum((F.when(v.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for v in values), F.lit(0))
    return F.when(n > 0, total / n)


def direction(ret: Column | str, band: float = 0.01) -> Column:
    ret = col(ret)
    return (F.when(ret > band, "BULLISH").when(ret < -band, "BEARISH")
            .when(ret.isNotNull(), "NEUTRAL"))
