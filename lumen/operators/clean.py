"""Conform and clean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.numeric import is_valid
from lumen.schema import CALENDAR, PHYSICAL, PRECIP, UVB


class MissingColumnError(ValueError):
    pass


def conform(df: DataFrame, required: tuple[str, ...] = (UVB, PRECIP)) -> DataFrame:
    """Add absent calendar columns as null INT; fail early on a missing
    required variable instead of deep inside a later step (trap 17)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnError(f"required observation columns missing: {missing}")
    absent = [c for c in CALENDAR if c not in df.columns]
    if not absent:
        return df
    return df.withColumns({c: F.lit(None).cast("int") for c in absent})


def clean_positive(df: DataFrame, variables: list[str] = PHYSICAL) -> DataFrame:
    """keep rows where every present physical variable is a number > 0.

    ``NaN > 0`` is true in Spark, so NaN is excluded explicitly (trap 1); the
    ``> 0`` conjuncts still reach the Parquet scan as pushed filters.
    """
    present = [c for c in variables if c in df.columns]
    if not present:
        return df
    cond = reduce(lambda a, b: a & b, [(F.col(c) > 0) & ~F.isnan(F.col(c)) for c in present])
    return df.where(cond)


def dropna_one(df: DataFrame, column: str) -> DataFrame:
    """drop rows whose ``column`` is null or NaN."""
    return df.where(is_valid(column))


def dropna_subset(df: DataFrame, columns: list[str]) -> DataFrame:
    """drop rows with a null or NaN in any of ``columns``."""
    return df.dropna(subset=columns)
