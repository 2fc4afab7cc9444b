"""Numeric helpers shared by every job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def r6(c) -> Column:
    """Round a double to 6 decimals as ``round(x * 1e6) / 1e6`` (half away from
    zero on the scaled value), the rule used for every reported score and the
    order key of every ranking, so ties are decided the same way everywhere."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") * F.lit(1e6)) / F.lit(1e6)


def r6_stable(c) -> Column:
    """``r6`` after a 9-digit rounding: for interpolated values (quantiles) whose
    last bits depend on the order of floating-point operations, so engines
    that differ by an ulp still report the same 6-digit value."""
    c = F.col(c) if isinstance(c, str) else c
    return r6(F.round(c.cast("double") * F.lit(1e9)) / F.lit(1e9))
