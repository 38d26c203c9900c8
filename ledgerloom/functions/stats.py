"""Guarded arithmetic shared by the return and risk operators (ANSI mode raises where these give NULL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, default=None) -> Column:
    """``num / den``; ``default`` where the denominator is zero or missing."""
    out = F.when(den != 0, F.try_divide(num, den))
    return out if default is None else F.coalesce(out, F.lit(default))


def pct_of_positive(part: Column, whole: Column) -> Column:
    """Share of a positive total in percent, 0 otherwise."""
    return F.when(whole > 0, F.try_divide(part, whole) * 100.0).otherwise(F.lit(0.0))


def log_growth(ret: Column) -> Column:
    """ln(1 + r), floored so that a total loss stays finite."""
    return F.ln(F.greatest(1.0 + ret, F.lit(1e-12)))


def annualised(growth: Column, years: Column) -> Column:
    """(1 + growth) ** (1 / years) - 1."""
    return F.pow(1.0 + growth, F.try_divide(F.lit(1.0), years)) - 1.0


def compound(ret: Column) -> Column:
    """Product of (1 + r) minus one over a group, exact for zero and negative factors."""
    return F.product(1.0 + ret) - 1.0


def round_cols(df, digits: int, *names: str):
    """Round the named columns."""
    return df.withColumns({n: F.round(n, digits) for n in names})
