"""Null/NaN-safe numeric expressions (X3, X4, trap 1, 7, 8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid(c: Column | str) -> Column:
    """True for a present, non-NaN value (pandas' notna on floats)."""
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c)


def nan_to_null(c: Column | str) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r over complete pairs; null (not an error) for constant input.

    Both columns are masked to the rows where the other one is present too,
    so the deviations use exactly the rows the covariance uses.
    """
    xv, yv = nan_to_null(x), nan_to_null(y)
    xm = F.when(yv.isNotNull(), xv)
    ym = F.when(xv.isNotNull(), yv)
    return F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym))


def pair_count(x: Column | str, y: Column | str) -> Column:
    return F.count(F.when(is_valid(x) & is_valid(y), F.lit(1)))


def high_label(value: Column | str, threshold: Column) -> Column:
    """1 where value >= threshold, else 0."""
    return (_c(value) >= threshold).cast("int")


def round_even(c: Column | str, digits: int) -> Column:
    """Half-to-even rounding, as NumPy rounds."""
    return F.bround(_c(c), digits)
