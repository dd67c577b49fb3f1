"""Time axis ordering and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.calendar import derive_timestamp
from lumen.functions.numeric import is_valid
from lumen.schema import UVB


def with_time(df: DataFrame, name: str = "fecha_hora") -> DataFrame:
    """X1 applied: the derived timestamp; rows without a valid time or value dropped."""
    return (df.withColumn(name, derive_timestamp())
              .where(F.col(name).isNotNull() & is_valid(UVB)))


def time_series(df: DataFrame, ts: str, tie_break: list[str]) -> DataFrame:
    """O1: rows ordered by time; ``tie_break`` makes the order total."""
    return df.orderBy(ts, *tie_break)


def first_days(df: DataFrame, ts: str, value: str, days: int = 7) -> DataFrame:
    """rows with ``ts`` in [min(ts), min(ts) + days], both ends included.

    The minimum is a scalar subquery (one small aggregate), so no join and no
    driver round trip. The range predicate reaches the scan where ``ts`` is a stored
    column; on the derived time axis it is evaluated after the scan.
    """
    base = df.where(F.col(ts).isNotNull() & is_valid(value))
    start = base.select(F.min(ts)).scalar()
    return base.where(F.col(ts).between(start, start + F.make_interval(days=F.lit(days))))


def first_rows(df: DataFrame, ts: str, tie_break: list[str], n: int = 500) -> DataFrame:
    """O3: the first ``n`` rows in time order (top-k per partition, then merged)."""
    return df.orderBy(ts, *tie_break).limit(n)


def series_bound(window: DataFrame, value: str = UVB, factor: float = 1.1) -> DataFrame:
    """The value-axis bound, max x ``factor``, over the shown window."""
    return window.agg((F.max(value) * F.lit(factor)).alias("y_max"))
