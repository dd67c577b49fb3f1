"""Display formats, as a presentation view over result frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(c: Column | str) -> Column:
    """Integer with ',' grouping: 53457 -> '53,457'."""
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def fixed(c: Column | str, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", F.col(c) if isinstance(c, str) else c)


def scientific(c: Column | str, decimals: int = 3) -> Column:
    return F.format_string(f"%.{decimals}e", F.col(c) if isinstance(c, str) else c)
