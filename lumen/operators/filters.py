"""Dashboard filters as an immutable specification.

The reference defines a month, value-range, season and variable control but
never wires them; here they are one conjunctive filter over DataFrames whose
defaults are exactly what its reset button restores (F11).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.calendar import ALL_SEASONS, SEASON_KEYS, season
from lumen.schema import PHYSICAL, UVB

# --- fixed values: control defaults ----------------------------------------
DEFAULT_MONTHS = tuple(range(1, 13))
SLIDER_BOUNDS = (0.0, 3.0)   # ends of the control; its default position sets no predicate
DEFAULT_VARIABLE = UVB
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class FilterSpec:
    months: tuple[int, ...] = DEFAULT_MONTHS
    value_range: tuple[float, float] | None = None
    season: str = ALL_SEASONS
    variable: str = DEFAULT_VARIABLE

    @staticmethod
    def reset() -> "FilterSpec":
        """the defaults the reset control restores."""
        return FilterSpec()


def month_slice(df: DataFrame, month: int) -> DataFrame:
    """rows of one month."""
    return df.where(F.col("MO") == F.lit(month))


def filter_months(df: DataFrame, months=DEFAULT_MONTHS) -> DataFrame:
    """rows whose month is in the chosen set."""
    return df.where(F.col("MO").isin([int(m) for m in months]))


def filter_range(df: DataFrame, lo: float, hi: float, column: str = UVB) -> DataFrame:
    """F8: inclusive value range."""
    return df.where(F.col(column).between(F.lit(float(lo)), F.lit(float(hi))))


def filter_season(df: DataFrame, key: str = ALL_SEASONS) -> DataFrame:
    """one season by its key, or no predicate for 'todas'."""
    if key == ALL_SEASONS:
        return df
    if key not in SEASON_KEYS:
        raise ValueError(f"unknown season key {key!r}; expected one of {sorted(SEASON_KEYS)}")
    return df.where(season("MO") == F.lit(SEASON_KEYS[key]))


def select_variable(df: DataFrame, variable: str = DEFAULT_VARIABLE,
                    keep: list[str] | None = None) -> DataFrame:
    """the chosen variable as ``value``, validated against the four."""
    if variable not in PHYSICAL:
        raise ValueError(f"variable must be one of {PHYSICAL}, got {variable!r}")
    keep = [c for c in (keep or []) if c in df.columns]
    return df.select(*keep, F.lit(variable).alias("variable"), F.col(variable).alias("value"))


def long_variables(df: DataFrame, variables: list[str] = PHYSICAL,
                   keep: list[str] | None = None) -> DataFrame:
    """All present variables in long form (variable, value) by ``unpivot``."""
    present = [v for v in variables if v in df.columns]
    keep = [c for c in (keep or []) if c in df.columns]
    return df.unpivot(keep, present, "variable", "value")


def apply_filters(df: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """All parts of the specification that are set, conjunctive; the value range applies
    to UVB. The defaults keep every row, nulls and values beyond the control's ends included."""
    out = df
    if tuple(spec.months) != DEFAULT_MONTHS:
        out = filter_months(out, spec.months)
    if spec.value_range is not None:
        out = filter_range(out, *spec.value_range, column=UVB)
    return filter_season(out, spec.season)


def existing(df: DataFrame, wanted: list[str]) -> list[str]:
    """the wanted columns that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, colour by month; 1 when there is no month column)."""
    colour = F.col("MO") if "MO" in df.columns else F.lit(1)
    return df.select(F.col(x).alias("x"), F.col(y).alias("y"), colour.cast("int").alias("MO"))
