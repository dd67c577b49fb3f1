"""Calendar expressions: time axis, seasons, month names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumen.schema import BASE_YEAR

# --- fixed values: season names and their months (southern dry/wet seasons) --
SEASON_SUMMER = "Verano (Seco)"           # months 12, 1, 2
SEASON_AUTUMN = "Otoño (Transición)"      # months 3, 4, 5
SEASON_WINTER = "Invierno (Lluvioso)"     # months 6, 7, 8
SEASON_SPRING = "Primavera (Transición)"  # every other value, null included
SEASON_ORDER = [SEASON_SUMMER, SEASON_AUTUMN, SEASON_WINTER, SEASON_SPRING]
SEASON_KEYS = {"verano": SEASON_SUMMER, "otoño": SEASON_AUTUMN,
               "invierno": SEASON_WINTER, "primavera": SEASON_SPRING}
ALL_SEASONS = "todas"
# --- fixed values: month labels 1..12 --------------------------------------
MONTH_LABELS = ["Ene", "Feb", "Mar", "Abr", "May", "Jun",
                "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]
# ---------------------------------------------------------------------------


def season(month: Column | str) -> Column:
    """Season of a month; the final branch also takes null and out-of-range."""
    m = F.col(month) if isinstance(month, str) else month
    return (F.when(m.isin(12, 1, 2), F.lit(SEASON_SUMMER))
             .when(m.isin(3, 4, 5), F.lit(SEASON_AUTUMN))
             .when(m.isin(6, 7, 8), F.lit(SEASON_WINTER))
             .otherwise(F.lit(SEASON_SPRING)))


def season_ordinal(name: Column | str) -> Column:
    """Position of a season name in the display order (0-based)."""
    c = F.col(name) if isinstance(name, str) else name
    expr = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(SEASON_ORDER))):
        expr = F.when(c == F.lit(s), F.lit(i)).otherwise(expr)
    return expr


def month_label(month: Column | str) -> Column:
    """Month name of 1..12; null outside (try_ form, safe under ANSI)."""
    m = F.col(month) if isinstance(month, str) else month
    return F.try_element_at(F.array(*[F.lit(x) for x in MONTH_LABELS]), m)


def derive_timestamp(month: str = "MO", day: str = "DY", hour: str = "HR",
                     base_year: int = BASE_YEAR) -> Column:
    """Timestamp from calendar parts with a fixed year; invalid dates -> null."""
    return F.try_make_timestamp_ntz(F.lit(base_year), F.col(month), F.col(day),
                                    F.col(hour), F.lit(0), F.lit(0))
