"""Observation schema and the fixed names of the data set."""

from pyspark.sql import types as T

# --- fixed values: column names of the hourly observation table -------------
UVB = "ALLSKY_SFC_UVB"
LW = "ALLSKY_SFC_LW_DWN"
PRECIP = "PRECTOTCORR"
PS = "PS"
PHYSICAL = [UVB, LW, PRECIP, PS]
CALENDAR = ["YEAR", "MO", "DY", "HR"]
EXTENDED = [UVB, LW, PRECIP, PS, "MO", "HR"]
CORR_PARTNERS = [PRECIP, PS, LW]
NUMERIC_FEATURES = [LW, PRECIP, PS]
CATEGORICAL_FEATURES = ["HR", "DY", "MO"]
LABEL = "HighUVB"
BASE_YEAR = 2025
# ---------------------------------------------------------------------------

OBS_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType(), True) for c in CALENDAR]
    + [T.StructField(c, T.DoubleType(), True) for c in PHYSICAL]
)

# Unique row key of the lineitem-derived fixtures (FIXTURES.md §3).
ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
