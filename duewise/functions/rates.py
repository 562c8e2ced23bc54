"""Ratio, change and clipping expressions with the engine's null and zero rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean(value: Column | str) -> Column:
    """A double without NaN: NaN counts as missing everywhere in the engine."""
    number = col(value).cast("double")
    return F.when(~F.isnan(number), number)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null."""
    out = value
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def steady_round(value: Column | str, digits: int) -> Column:
    """Round with exact halves going up, whatever the last bit of a floating mean happens to be.

    Means of rounded rates often fall exactly between two results; a nudge far below the last digit makes
    the outcome independent of the order in which partial sums were added.
    """
    return F.round(col(value) + 10.0 ** -(digits + 4), digits)


def safe_rate(num: Column | str, den: Column | str, *, clipped: bool = True, scale: int | None = 6) -> Column:
    """num / den where den > 0, else 0. By default clipped to [0, 1] and rounded to 6 places.

    A missing numerator counts as 0, a missing denominator gives 0.
    """
    if isinstance(num, str) and isinstance(den, str):
        value = f"coalesce(nanvl(double({num}), null), 0D) / nanvl(double({den}), null)"
        value = f"least(greatest({value}, 0D), 1D)" if clipped else value
        value = f"CASE WHEN nanvl(double({den}), null) > 0 THEN {value} ELSE 0D END"
        return F.expr(f"round({value} + 1e-{scale + 4}D, {scale})" if scale is not None else value)
    n, d = F.coalesce(clean(num), F.lit(0.0)), clean(den)
    rate = F.when(d > 0, n / d).otherwise(F.lit(0.0))
    if clipped:
        rate = clip(rate, 0.0, 1.0)
    return steady_round(rate, scale) if scale is not None else rate


def rate_or_zero(num: Column | str, den: Column | str) -> Column:
    """num / den where den is non-zero; a zero or missing side gives 0. Not clipped, not rounded."""
    n, d = clean(num), clean(den)
    return F.coalesce(F.when(d != 0, n / d), F.lit(0.0))


def relative_change(baseline: Column | str, recent: Column | str) -> Column:
    b, r = col(baseline), col(recent)
    return F.when(b == 0, F.lit(0.0)).otherwise((r - b) / F.abs(b))


def total(value: Column | str) -> Column:
    """Sum that is 0 for a group with no value."""
    return F.coalesce(F.sum(col(value)), F.lit(0.0))


def flag_sum(value: Column | str) -> Column:
    """Number of true flags as a long; null flags count as false."""
    return F.coalesce(F.sum(col(value).cast("long")), F.lit(0).cast("long"))


def log_amount(value: Column | str) -> Column:
    """log(1 + x) with negative amounts lifted to zero."""
    return F.log1p(clip(clean(value), 0.0))
