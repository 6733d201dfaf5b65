"""Rounding, ratios and clipping in plain double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# relative; sums in another order differ by less
TIE = 1e-12


def round_half_away(x: Column, digits: int = 2) -> Column:
    """Round half away from zero; what lies within ``TIE`` of a half counts as one, so that the last bit of a mean,
    which depends on the order of the rows, does not decide."""
    factor = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * (factor * (1 + TIE)) + 0.5) / F.lit(factor)


def safe_ratio(num: Column, den: Column, otherwise=None) -> Column:
    """``num / den``, with ``otherwise`` (null by default) where the denominator is zero."""
    ratio = num / F.nullif(den, F.lit(0))
    return ratio if otherwise is None else F.coalesce(ratio, F.lit(otherwise))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def decimal_round(x: Column, digits: int) -> Column:
    """Round through an exact decimal with nine fractional digits."""
    return F.round(x.cast("decimal(38,9)"), digits)
