"""Registered queries and their DuckDB oracle statements.

Each query takes ``(spark, sf_dir)``, reads the driver's tables through the
fixture views and returns a DataFrame; its oracle repeats the views as CTEs.
Floating results are rounded to 6 decimals on both sides (value-hash hygiene).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.functions import formats
from lumen.functions.calendar import derive_timestamp, month_label, season
from lumen.functions.numeric import high_label
from lumen.functions.special import SW_C1, SW_C2, SW_C5, SW_C6, normal_quantile_sql
from lumen.operators import clean as C
from lumen.operators import correlate, distribution, filters, hypothesis, summarize
from lumen.operators.filters import FilterSpec
from lumen.plans import report
from lumen.schema import LW, PHYSICAL, PRECIP, PS, ROW_KEY, UVB
from lumen.sources import files
from lumen.sources import fixtures as fx
from lumen.sources.footers import bounds, footer_session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _round(c, digits: int):
    r = F.round(c, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)  # no negative zero


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- SQL views
OBS = """obs AS (
  SELECT CAST(year(l_shipdate) AS INT) AS YEAR, CAST(month(l_shipdate) AS INT) AS MO,
         CAST(day(l_shipdate) AS INT) AS DY, CAST(l_orderkey % 24 AS INT) AS HR,
         l_extendedprice / 35000e0 AS ALLSKY_SFC_UVB, l_quantity AS ALLSKY_SFC_LW_DWN,
         l_discount AS PRECTOTCORR, l_tax AS PS,
         l_orderkey, l_partkey, l_suppkey, l_linenumber
  FROM lineitem)"""
CLEAN = """clean AS (
  SELECT * FROM obs
  WHERE ALLSKY_SFC_UVB > 0 AND NOT isnan(ALLSKY_SFC_UVB)
    AND ALLSKY_SFC_LW_DWN > 0 AND NOT isnan(ALLSKY_SFC_LW_DWN)
    AND PRECTOTCORR > 0 AND NOT isnan(PRECTOTCORR)
    AND PS > 0 AND NOT isnan(PS))"""
DIRTY = """dirty AS (
  SELECT YEAR, CASE WHEN l_linenumber = 7 THEN NULL ELSE MO END AS MO, DY, HR,
         CASE WHEN l_linenumber = 6 THEN -999e0 ELSE ALLSKY_SFC_UVB END AS ALLSKY_SFC_UVB,
         CASE WHEN l_linenumber = 5 THEN CAST('NaN' AS DOUBLE)
              WHEN l_linenumber = 4 THEN NULL ELSE ALLSKY_SFC_LW_DWN END AS ALLSKY_SFC_LW_DWN,
         PRECTOTCORR, PS, l_orderkey, l_partkey, l_suppkey, l_linenumber
  FROM obs)"""
DIRTY_CLEAN = """dclean AS (
  SELECT * FROM dirty
  WHERE ALLSKY_SFC_UVB > 0 AND NOT isnan(ALLSKY_SFC_UVB)
    AND ALLSKY_SFC_LW_DWN > 0 AND NOT isnan(ALLSKY_SFC_LW_DWN)
    AND PRECTOTCORR > 0 AND NOT isnan(PRECTOTCORR)
    AND PS > 0 AND NOT isnan(PS))"""
SEASON = ("CASE WHEN MO IN (12, 1, 2) THEN 'Verano (Seco)' "
          "WHEN MO IN (3, 4, 5) THEN 'Otoño (Transición)' "
          "WHEN MO IN (6, 7, 8) THEN 'Invierno (Lluvioso)' "
          "ELSE 'Primavera (Transición)' END")
MONTHS = "['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic']"
KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
VARS = [UVB, LW, PRECIP, PS]


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def r6(expr: str, fn: str = "round", digits: int = 6) -> str:
    """Rounded, with negative zero mapped to zero (as the Spark side does)."""
    return f"(CASE WHEN {fn}({expr}, {digits}) = 0 THEN 0e0 ELSE {fn}({expr}, {digits}) END)"


def long_sql(src: str, cols: list[str] = VARS, keep: str = "") -> str:
    """unpivot in SQL: one row per (row, variable)."""
    return " UNION ALL ".join(
        f"SELECT {keep + ', ' if keep else ''}'{c}' AS variable, {c} AS value FROM {src}"
        for c in cols)


def clean_obs(spark: SparkSession, sf: str) -> DataFrame:
    return C.clean_positive(fx.obs(spark, sf))


# ------------------------------------------------------------- S: sources
@register("conform_schema", with_(OBS) + f"""
SELECT CAST(NULL AS INT) AS YEAR, MO, DY, CAST(NULL AS INT) AS HR, ALLSKY_SFC_UVB,
       PRECTOTCORR, {KEYS} FROM obs""")
def q_conform(spark, sf):
    narrow = fx.obs(spark, sf).select("MO", "DY", UVB, PRECIP, *ROW_KEY)
    return C.conform(narrow).select("YEAR", "MO", "DY", "HR", UVB, PRECIP, *ROW_KEY)


@register("clean_positive", with_(OBS, CLEAN) + "SELECT * FROM clean")
def q_clean(spark, sf):
    return clean_obs(spark, sf)


@register("clean_dirty", with_(OBS, DIRTY, DIRTY_CLEAN) + "SELECT * FROM dclean")
def q_clean_dirty(spark, sf):
    return C.clean_positive(fx.obs_dirty(spark, sf))


@register("dropna_one", with_(OBS, DIRTY) + f"""
SELECT * FROM dirty WHERE {LW} IS NOT NULL AND NOT isnan({LW})""")
def q_dropna_one(spark, sf):
    return C.dropna_one(fx.obs_dirty(spark, sf), LW)


@register("dropna_subset", with_(OBS, DIRTY) + f"""
SELECT * FROM dirty WHERE MO IS NOT NULL AND {LW} IS NOT NULL AND NOT isnan({LW})""")
def q_dropna_subset(spark, sf):
    return C.dropna_subset(fx.obs_dirty(spark, sf), ["MO", LW])


@register("month_slice", with_(OBS, CLEAN) + "SELECT * FROM clean WHERE MO = 6")
def q_month_slice(spark, sf):
    return filters.month_slice(clean_obs(spark, sf), 6)


@register("filter_months", with_(OBS, CLEAN) + "SELECT * FROM clean WHERE MO IN (1, 2, 12)")
def q_filter_months(spark, sf):
    return filters.filter_months(clean_obs(spark, sf), [1, 2, 12])


@register("filter_range", with_(OBS, CLEAN) + f"""
SELECT * FROM clean WHERE {UVB} BETWEEN 0.5e0 AND 1.5e0""")
def q_filter_range(spark, sf):
    return filters.filter_range(clean_obs(spark, sf), 0.5, 1.5)


@register("filter_season", with_(OBS, CLEAN) + f"""
SELECT * FROM clean WHERE {SEASON} = 'Invierno (Lluvioso)'""")
def q_filter_season(spark, sf):
    return filters.filter_season(clean_obs(spark, sf), "invierno")


@register("filter_combined", with_(OBS, CLEAN) + f"""
SELECT * FROM clean
WHERE MO IN (3, 4, 5, 6) AND {UVB} BETWEEN 0.2e0 AND 2.5e0
  AND {SEASON} = 'Otoño (Transición)'""")
def q_filter_combined(spark, sf):
    spec = FilterSpec(months=(3, 4, 5, 6), value_range=(0.2, 2.5), season="otoño")
    return filters.apply_filters(clean_obs(spark, sf), spec)


@register("filter_reset", with_(OBS, CLEAN) + f"""
SELECT * FROM clean WHERE {UVB} BETWEEN 0e0 AND 3e0""")
def q_filter_reset(spark, sf):
    return filters.apply_filters(clean_obs(spark, sf), FilterSpec.reset())


@register("select_variable", with_(OBS, CLEAN) + f"""
SELECT {KEYS}, '{PS}' AS variable, {PS} AS value FROM clean""")
def q_select_variable(spark, sf):
    return filters.select_variable(clean_obs(spark, sf), PS, keep=ROW_KEY)


@register("scatter_points", with_(OBS, CLEAN) + f"""
SELECT {PRECIP} AS x, {UVB} AS y, MO FROM clean""")
def q_scatter(spark, sf):
    return filters.scatter_points(clean_obs(spark, sf), PRECIP, UVB)


# --------------------------------------------------------- A: aggregates
@register("sql_count", with_(OBS) + "SELECT COUNT(*) AS total_registros FROM obs")
def q_sql_count(spark, sf):
    session = footer_session(spark)  # the count comes from the files' footers
    return report.sql_count(session, fx.obs(session, sf))


@register("sql_stats", with_(OBS) + f"""
SELECT {r6(f'AVG({UVB})')} AS uv_promedio, {r6(f'MIN({UVB})')} AS uv_minimo,
       {r6(f'MAX({UVB})')} AS uv_maximo
FROM obs WHERE {UVB} > 0""")
def q_sql_stats(spark, sf):
    return report.sql_stats(spark, fx.obs(spark, sf))


@register("sql_month", with_(OBS) + f"""
SELECT MO AS mes, {r6(f'AVG({UVB})')} AS uv_promedio_mes
FROM obs WHERE MO IS NOT NULL GROUP BY MO ORDER BY MO""")
def q_sql_month(spark, sf):
    return report.sql_month(spark, fx.obs(spark, sf))


@register("kpis", with_(OBS, CLEAN) + f"""
SELECT COUNT(*) AS total_registros, {r6(f'AVG({UVB})')} AS uvb_promedio,
       {r6(f'MAX({PRECIP})')} AS precipitacion_max FROM clean""")
def q_kpis(spark, sf):
    return summarize.kpis(clean_obs(spark, sf))


@register("format_kpis", with_(OBS, CLEAN) + f"""
SELECT format('{{:,}}', COUNT(*)) AS total, printf('%.3f', AVG({UVB})) AS uvb,
       printf('%.1f', MAX({PRECIP})) AS precip FROM clean""")
def q_format_kpis(spark, sf):
    k = summarize.kpis(clean_obs(spark, sf))
    return k.select(formats.thousands("total_registros").alias("total"),
                    formats.fixed("uvb_promedio", 3).alias("uvb"),
                    formats.fixed("precipitacion_max", 1).alias("precip"))


@register("format_scientific", with_(OBS, CLEAN) + f"""
SELECT MO, printf('%.3e', AVG({UVB}) / 1000) AS mean, printf('%.2e', SUM({UVB})) AS total FROM clean GROUP BY MO""")
def q_format_scientific(spark, sf):
    per_month = clean_obs(spark, sf).groupBy("MO").agg((F.avg(UVB) / 1000).alias("mean"), F.sum(UVB).alias("total"))
    return per_month.select("MO", formats.scientific("mean", 3).alias("mean"), formats.scientific("total", 2).alias("total"))


@register("month_table", with_(OBS, CLEAN) + f"""
SELECT MO, {r6(f'AVG({UVB})')} AS mean, {r6(f'STDDEV_SAMP({UVB})')} AS std,
       {r6(f'MIN({UVB})')} AS min, {r6(f'MAX({UVB})')} AS max
FROM clean WHERE MO IS NOT NULL GROUP BY MO ORDER BY MO""")
def q_month_table(spark, sf):
    return summarize.month_table(clean_obs(spark, sf))


@register("month_table_dirty", with_(OBS, DIRTY, DIRTY_CLEAN) + f"""
SELECT MO, {r6(f'AVG({UVB})')} AS mean, {r6(f'STDDEV_SAMP({UVB})')} AS std,
       {r6(f'MIN({UVB})')} AS min, {r6(f'MAX({UVB})')} AS max
FROM dclean WHERE MO IS NOT NULL GROUP BY MO ORDER BY MO""")
def q_month_table_dirty(spark, sf):
    return summarize.month_table(C.clean_positive(fx.obs_dirty(spark, sf)))


@register("season_table", with_(OBS, CLEAN) + f"""
SELECT {SEASON} AS Estacion, {r6(f'AVG({UVB})', 'round_even', 3)} AS mean,
       {r6(f'STDDEV_SAMP({UVB})', 'round_even', 3)} AS std, COUNT({UVB}) AS count
FROM clean GROUP BY 1""")
def q_season_table(spark, sf):
    return summarize.season_table(clean_obs(spark, sf))


@register("season_table_dirty", with_(OBS, DIRTY, DIRTY_CLEAN) + f"""
SELECT {SEASON} AS Estacion, {r6(f'AVG({UVB})', 'round_even', 3)} AS mean,
       {r6(f'STDDEV_SAMP({UVB})', 'round_even', 3)} AS std, COUNT({UVB}) AS count
FROM dclean GROUP BY 1""")
def q_season_table_dirty(spark, sf):
    return summarize.season_table(C.clean_positive(fx.obs_dirty(spark, sf)))


@register("month_dense", with_(OBS, CLEAN) + f"""
, m AS (SELECT MO, AVG({UVB}) AS a FROM clean WHERE MO IS NOT NULL GROUP BY MO)
SELECT CAST(x.i AS INT) AS MO, {MONTHS}[x.i] AS label, {r6('COALESCE(m.a, 0e0)')} AS uvb_promedio
FROM range(1, 13) AS x(i) LEFT JOIN m ON m.MO = x.i""")
def q_month_dense(spark, sf):
    return summarize.month_dense(clean_obs(spark, sf))


@register("month_dense_winter", with_(OBS, CLEAN) + f"""
, m AS (SELECT MO, AVG({UVB}) AS a FROM clean WHERE MO IN (6, 7, 8) GROUP BY MO)
SELECT CAST(x.i AS INT) AS MO, {MONTHS}[x.i] AS label, {r6('COALESCE(m.a, 0e0)')} AS uvb_promedio
FROM range(1, 13) AS x(i) LEFT JOIN m ON m.MO = x.i""")
def q_month_dense_winter(spark, sf):
    return summarize.month_dense(filters.filter_season(clean_obs(spark, sf), "invierno"))


@register("season_order", with_(OBS, CLEAN) + f"""
, s AS (SELECT {SEASON} AS Estacion, AVG({UVB}) AS mean FROM clean GROUP BY 1),
d AS (SELECT * FROM (VALUES ('Verano (Seco)', 0), ('Otoño (Transición)', 1),
      ('Invierno (Lluvioso)', 2), ('Primavera (Transición)', 3)) AS t(Estacion, orden))
SELECT CAST(d.orden AS INT) AS orden, s.Estacion, {r6('s.mean')} AS mean
FROM s JOIN d USING (Estacion) ORDER BY orden""")
def q_season_order(spark, sf):
    return summarize.season_order(clean_obs(spark, sf))


@register("median_threshold", with_(OBS, CLEAN) + f"""
SELECT {r6(f'quantile_cont({UVB}, 0.5)')} AS threshold FROM clean""")
def q_median(spark, sf):
    return summarize.median_threshold(clean_obs(spark, sf))


# ------------------------------------------------------- X: scalar functions
@register("derive_timestamp", with_(OBS, CLEAN) + f"""
SELECT {KEYS}, MO, DY, HR,
       try_strptime(printf('2025-%02d-%02d %02d:00:00', MO, DY, HR), '%Y-%m-%d %H:%M:%S')
         AS fecha_hora
FROM clean""")
def q_derive_ts(spark, sf):
    return clean_obs(spark, sf).select(*ROW_KEY, "MO", "DY", "HR",
                                       derive_timestamp().alias("fecha_hora"))


@register("derive_season", with_(OBS, DIRTY) + f"""
SELECT {KEYS}, MO, {SEASON} AS Estacion FROM dirty""")
def q_derive_season(spark, sf):
    return fx.obs_dirty(spark, sf).select(*ROW_KEY, "MO", season("MO").alias("Estacion"))


@register("month_label", with_(OBS, DIRTY) + f"""
SELECT {KEYS}, MO, {MONTHS}[MO] AS label FROM dirty""")
def q_month_label(spark, sf):
    return fx.obs_dirty(spark, sf).select(*ROW_KEY, "MO", month_label("MO").alias("label"))


@register("label_high", with_(OBS, CLEAN) + f"""
, t AS (SELECT quantile_cont({UVB}, 0.5) AS thr FROM clean)
SELECT {KEYS}, CAST(CASE WHEN {UVB} >= t.thr THEN 1 ELSE 0 END AS INT) AS HighUVB
FROM clean, t""")
def q_label_high(spark, sf):
    c = clean_obs(spark, sf)
    return c.select(*ROW_KEY, high_label(UVB, summarize.threshold_value(c)).alias("HighUVB"))


# ----------------------------------------------------- A9-A13 distributions
def _box_sql(src: str, key: str, key_expr: str) -> str:
    return f"""
, v AS (SELECT {key_expr} AS {key}, {UVB} AS x FROM {src} WHERE {key_expr} IS NOT NULL),
q AS (SELECT {key}, COUNT(*) AS n, AVG(x) AS mean, quantile_cont(x, 0.25) AS q1,
             quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY {key}),
f AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM q),
a AS (SELECT v.{key}, MIN(CASE WHEN x >= lo THEN x END) AS wlo,
             MAX(CASE WHEN x <= hi THEN x END) AS whi,
             COUNT(*) FILTER (WHERE x < lo) AS fliers_low,
             COUNT(*) FILTER (WHERE x > hi) AS fliers_high
      FROM v JOIN f USING ({key}) GROUP BY v.{key})
SELECT {key}, n, {r6('mean')} AS mean, {r6('q1')} AS q1, {r6('med')} AS med, {r6('q3')} AS q3,
       {r6('q3 - q1')} AS iqr,
       {r6('CASE WHEN wlo IS NULL OR wlo > q1 THEN q1 ELSE wlo END')} AS whislo,
       {r6('CASE WHEN whi IS NULL OR whi < q3 THEN q3 ELSE whi END')} AS whishi,
       fliers_low, fliers_high
FROM f JOIN a USING ({key})"""


@register("box_month", with_(OBS, CLEAN) + _box_sql("clean", "MO", "MO"))
def q_box_month(spark, sf):
    return distribution.box_stats(clean_obs(spark, sf), "MO", UVB)


@register("box_month_dirty", with_(OBS, DIRTY, DIRTY_CLEAN) + _box_sql("dclean", "MO", "MO"))
def q_box_month_dirty(spark, sf):
    return distribution.box_stats(C.clean_positive(fx.obs_dirty(spark, sf)), "MO", UVB)


@register("box_season", with_(OBS, CLEAN) + _box_sql("clean", "Estacion", SEASON))
def q_box_season(spark, sf):
    return distribution.box_stats(summarize.with_season(clean_obs(spark, sf)), "Estacion", UVB)


# a product of two variables: skewed, so that fliers exist
_DOSE = f"{UVB} * {PRECIP} * {LW}"


def _outlier_sql(src: str) -> str:
    return f"""
, d AS (SELECT MO, {KEYS}, {_DOSE} AS dose FROM {src} WHERE MO IS NOT NULL AND {LW} IS NOT NULL AND NOT isnan({LW})),
q AS (SELECT MO, quantile_cont(dose, 0.25) AS q1, quantile_cont(dose, 0.75) AS q3 FROM d GROUP BY MO),
f AS (SELECT MO, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM q)
SELECT MO, {KEYS}, {r6('dose')} AS dose, CASE WHEN dose < lo THEN 'low' ELSE 'high' END AS side
FROM d JOIN f USING (MO) WHERE dose < lo OR dose > hi"""


def _with_dose(df: DataFrame) -> DataFrame:
    return df.withColumn("dose", F.col(UVB) * F.col(PRECIP) * F.col(LW))


@register("box_outliers", with_(OBS, CLEAN) + _outlier_sql("clean"))
def q_box_outliers(spark, sf):
    return distribution.box_outliers(_with_dose(clean_obs(spark, sf)), "MO", "dose", keep=ROW_KEY)


@register("box_outliers_dirty", with_(OBS, DIRTY, DIRTY_CLEAN) + _outlier_sql("dclean"))
def q_box_outliers_dirty(spark, sf):
    return distribution.box_outliers(_with_dose(C.clean_positive(fx.obs_dirty(spark, sf))), "MO", "dose", keep=ROW_KEY)


@register("box_fliers", with_(OBS, CLEAN, f"dosed AS (SELECT MO, {_DOSE} AS {UVB} FROM clean)")
          + _box_sql("dosed", "MO", "MO"))
def q_box_fliers(spark, sf):
    return distribution.box_stats(_with_dose(clean_obs(spark, sf)), "MO", "dose")


_LONG_CLEAN = f"l AS ({long_sql('clean')})"
_EDGES = """e AS (
  SELECT variable, COUNT(*) AS n, STDDEV_SAMP(value) AS std, MIN(value) AS vmin, MAX(value) AS vmax,
         CASE WHEN MIN(value) = MAX(value) THEN MIN(value) - 0.5 ELSE MIN(value) END AS lo,
         CASE WHEN MIN(value) = MAX(value) THEN MAX(value) + 0.5 ELSE MAX(value) END AS hi
  FROM l GROUP BY variable)"""


@register("histogram", with_(OBS, CLEAN, _LONG_CLEAN, _EDGES) + f"""
, c AS (SELECT l.variable, CAST(LEAST(29, FLOOR((value - lo) / (hi - lo) * 30)) AS INT) AS bin,
              COUNT(*) AS cnt FROM l JOIN e USING (variable) GROUP BY 1, 2),
ax AS (SELECT variable, lo, hi, CAST(b.i AS INT) AS bin FROM e, range(0, 30) AS b(i))
SELECT ax.variable, ax.bin, {r6('lo + ax.bin * ((hi - lo) / 30)')} AS bin_lo,
       {r6('lo + (ax.bin + 1) * ((hi - lo) / 30)')} AS bin_hi,
       CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count
FROM ax LEFT JOIN c ON c.variable = ax.variable AND c.bin = ax.bin""")
def q_histogram(spark, sf):
    return distribution.histogram(clean_obs(spark, sf), PHYSICAL, bins=30)


@register("kde", with_(OBS, CLEAN, _LONG_CLEAN, _EDGES) + f"""
, p AS (SELECT variable, std * pow(n, -0.2) AS h, (vmax - vmin) / 199 AS step,
               (vmax - vmin) / 30 AS binw, vmin FROM e WHERE vmax > vmin AND std > 0),
g AS (SELECT variable, h, step, binw, vmin, CAST(j.i AS INT) AS j,
             CAST(j.i AS INT) * step + vmin AS x FROM p, range(0, 200) AS j(i)),
s AS (SELECT g.variable, g.j, SUM(exp(-0.5 * pow((g.x - l.value) / g.h, 2))) AS s
      FROM g JOIN l ON l.variable = g.variable GROUP BY 1, 2)
SELECT g.variable, g.j, {r6('g.x')} AS x,
       {r6('g.binw / (g.h * sqrt(2 * pi())) * s.s')} AS density
FROM g JOIN s ON s.variable = g.variable AND s.j = g.j""")
def q_kde(spark, sf):
    return distribution.kde(clean_obs(spark, sf), PHYSICAL, gridsize=200, bins=30)


# ------------------------------------------------- A14/A15, T: statistics
def _corr_sql(cols: list[str], src: str, digits: int | None) -> str:
    parts = []
    for a in cols:
        for b in cols:
            r = f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"
            r = r6(r, "round_even", digits) if digits is not None else r6(r)
            parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {r} AS r FROM {src}")
    return "\nUNION ALL ".join(parts)


@register("corr_matrix", with_(OBS, CLEAN) + _corr_sql(PHYSICAL, "clean", None))
def q_corr_matrix(spark, sf):
    return correlate.corr_matrix(clean_obs(spark, sf), PHYSICAL)


@register("corr_extended", with_(OBS, CLEAN) + _corr_sql(
    [UVB, LW, PRECIP, PS, "MO", "HR"], "clean", 2))
def q_corr_extended(spark, sf):
    return correlate.corr_extended(clean_obs(spark, sf))


@register("corr_dirty", with_(OBS, DIRTY) + _corr_sql(
    [UVB, LW, PS], f"(SELECT {UVB}, CASE WHEN isnan({LW}) THEN NULL ELSE {LW} END AS {LW}, "
                   f"{PS} FROM dirty)", None))
def q_corr_dirty(spark, sf):
    return correlate.corr_matrix(fx.obs_dirty(spark, sf), [UVB, LW, PS])


@register("pearson_r", with_(OBS, CLEAN) + "\nUNION ALL ".join(
    f"SELECT '{v}' AS variable, {r6(f'corr({UVB}, {v})')} AS r, COUNT(*) AS n FROM clean"
    for v in [PRECIP, PS, LW]))
def q_pearson_r(spark, sf):
    return correlate.pearson_table(clean_obs(spark, sf), with_p=False)


# p-values by quadrature: Simpson's rule over the density, up to where it vanishes
_SIMPSON = "CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


@register("pearson_p", with_(OBS, CLEAN) + ", s AS (" + "\nUNION ALL ".join(
    f"SELECT '{v}' AS variable, corr({UVB}, {v}) AS r, COUNT(*) AS n FROM clean" for v in [PRECIP, PS, LW]) + f"""),
w AS (SELECT variable, r, n, least(1e0, 40e0 / sqrt(n)) AS top, abs(r) AS a FROM s),
q AS (SELECT variable,
        SUM({_SIMPSON} * pow(1 - pow(least(1e0, a + i * greatest(top - a, 0e0) / 20000), 2), (n - 4) / 2e0)) * greatest(any_value(top - a), 0e0) AS tail,
        SUM({_SIMPSON} * pow(1 - pow(i * top / 20000, 2), (n - 4) / 2e0)) * any_value(top) AS half
      FROM w, range(0, 20001) AS t(i) GROUP BY variable, a, top, n)
SELECT variable, {r6('r')} AS r, n, {r6('tail / half')} AS p FROM w JOIN q USING (variable)""")
def q_pearson_p(spark, sf):
    return correlate.pearson_table(clean_obs(spark, sf), with_p=True)


_ANOVA = """
, g AS (SELECT {key}, COUNT(*) AS n_i, AVG(z) AS m_i, VAR_POP(z) AS v_i FROM v GROUP BY {key}),
t AS (SELECT SUM(n_i * m_i) / SUM(n_i) AS grand FROM g)
SELECT '{name}' AS test,
       {stat} AS statistic, COUNT(*) AS k, CAST(SUM(n_i) AS BIGINT) AS N
FROM g, t"""
_F = r6("(SUM(n_i * pow(m_i - grand, 2)) / (COUNT(*) - 1)) / "
        "(SUM(n_i * v_i) / (SUM(n_i) - COUNT(*)))")


@register("anova_f", with_(OBS, CLEAN) + f", v AS (SELECT MO, {UVB} AS z FROM clean WHERE MO IS NOT NULL)"
          + _ANOVA.format(key="MO", name="anova_uvb_by_month", stat=_F))
def q_anova(spark, sf):
    return hypothesis.anova(clean_obs(spark, sf))


def _f_density(x: str) -> str:
    return f"exp(d1 / 2 * ({x}) - (d1 + d2) / 2 * ln(1 + d1 / d2 * exp({x})))"


def _anova_p(name: str) -> str:
    """The statistic over the groups of ``v`` with p, by Simpson's rule over log f."""
    return f"""
, g AS (SELECT MO, COUNT(*) AS n_i, AVG(z) AS m_i, VAR_POP(z) AS v_i FROM v GROUP BY MO),
t AS (SELECT SUM(n_i * m_i) / SUM(n_i) AS grand FROM g),
st AS (SELECT COUNT(*) AS k, CAST(SUM(n_i) AS BIGINT) AS N,
              (SUM(n_i * pow(m_i - grand, 2)) / (COUNT(*) - 1)) / (SUM(n_i * v_i) / (SUM(n_i) - COUNT(*))) AS f
       FROM g, t),
dd AS (SELECT k, N, f, ln(f) AS lf, k - 1e0 AS d1, N - k * 1e0 AS d2 FROM st),
fq AS (SELECT k, N, f,
              SUM({_SIMPSON} * {_f_density('lf + i * (12 - lf) / 20000')}) * (12 - lf) AS tail,
              SUM({_SIMPSON} * {_f_density('-30 + i * 42e0 / 20000')}) * 42 AS whole
       FROM dd, range(0, 20001) AS x(i) GROUP BY k, N, f, lf)
SELECT '{name}' AS test, {r6('f')} AS statistic, k, N, {r6('tail / whole')} AS p FROM fq"""


@register("anova_p", with_(OBS, CLEAN) + f", v AS (SELECT MO, {UVB} AS z FROM clean WHERE MO IS NOT NULL)"
          + _anova_p("anova_uvb_by_month"))
def q_anova_p(spark, sf):
    return hypothesis.with_f_pvalue(hypothesis.anova(clean_obs(spark, sf)))


@register("levene_w", with_(OBS, CLEAN) + f"""
, m AS (SELECT MO, quantile_cont({UVB}, 0.5) AS med FROM clean WHERE MO IS NOT NULL GROUP BY MO),
v AS (SELECT MO, abs({UVB} - med) AS z FROM clean JOIN m USING (MO))"""
          + _ANOVA.format(key="MO", name="levene_uvb_by_month", stat=_F))
def q_levene(spark, sf):
    return hypothesis.levene(clean_obs(spark, sf))


@register("levene_p", with_(OBS, CLEAN) + f"""
, m AS (SELECT MO, quantile_cont({UVB}, 0.5) AS med FROM clean WHERE MO IS NOT NULL GROUP BY MO),
v AS (SELECT MO, abs({UVB} - med) AS z FROM clean JOIN m USING (MO))""" + _anova_p("levene_uvb_by_month"))
def q_levene_p(spark, sf):
    return hypothesis.with_f_pvalue(hypothesis.levene(clean_obs(spark, sf)))


@register("sample_cap", with_(OBS, CLEAN, f"l AS ({long_sql('clean')})") + """
SELECT variable, CAST(LEAST(5000, COUNT(*)) AS BIGINT) AS n FROM l GROUP BY variable""")
def q_sample_cap(spark, sf):
    long = filters.long_variables(clean_obs(spark, sf), PHYSICAL, keep=ROW_KEY)
    s = hypothesis.sample_cap(long, "variable", 5000, 42, key_cols=ROW_KEY)
    return s.groupBy("variable").agg(F.count(F.lit(1)).alias("n"))


def _poly(coeffs, x: str) -> str:
    return " + ".join(f"({c!r}) * pow({x}, {k})" for k, c in enumerate(coeffs))


@register("shapiro_w", with_(OBS, CLEAN, f"l AS ({long_sql('clean')})") + f"""
, r AS (SELECT variable, value, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY value) AS i,
               COUNT(*) OVER (PARTITION BY variable) AS n,
               value - AVG(value) OVER (PARTITION BY variable) AS dx FROM l),
s AS (SELECT *, {normal_quantile_sql('(i - 0.375e0) / (n + 0.25e0)')} AS m FROM r),
a AS (SELECT variable, n, SUM(dx * dx) AS ssx, SUM(m * m) AS mm, SUM(m * dx) AS mx,
             MAX(CASE WHEN i = 1 THEN m END) AS m1, MAX(CASE WHEN i = 2 THEN m END) AS m2,
             MAX(CASE WHEN i = n THEN dx END) - MAX(CASE WHEN i = 1 THEN dx END) AS e1,
             MAX(CASE WHEN i = n - 1 THEN dx END) - MAX(CASE WHEN i = 2 THEN dx END) AS e2
      FROM s GROUP BY variable, n),
b AS (SELECT *, {_poly(SW_C1, '(1 / sqrt(n))')} - m1 / sqrt(mm) AS a1, {_poly(SW_C2, '(1 / sqrt(n))')} - m2 / sqrt(mm) AS a2 FROM a),
w AS (SELECT *, pow(sqrt((1 - 2 * a1 * a1 - 2 * a2 * a2) / (mm - 2 * m1 * m1 - 2 * m2 * m2)) * (mx + m1 * e1 + m2 * e2)
               + a1 * e1 + a2 * e2, 2) / ssx AS W FROM b),
z AS (SELECT *, (ln(1 - W) - ({_poly(SW_C5, 'ln(n)')})) / exp({_poly(SW_C6, 'ln(n)')}) AS z FROM w),
p AS (SELECT variable, SUM({_SIMPSON} * exp(-0.5 * pow(z + i * 40e0 / 20000, 2))) * 40 / 60000 / sqrt(2 * pi()) AS p
      FROM z, range(0, 20001) AS t(i) GROUP BY variable)
SELECT 'shapiro_' || variable AS test, variable, {r6('W')} AS statistic, {r6('p')} AS p, n FROM z JOIN p USING (variable)""")
def q_shapiro(spark, sf):
    return hypothesis.shapiro(clean_obs(spark, sf), PHYSICAL)


# ------------------------------------------- F5, O1, O3, A18: time axis
from lumen.operators import evaluate, ordering, split  # noqa: E402

_TS = ("try_strptime(printf('2025-%02d-%02d %02d:00:00', MO, DY, HR), '%Y-%m-%d %H:%M:%S')")
_SERIES = f"""ts AS (SELECT {KEYS}, {_TS} AS fecha_hora, {UVB} FROM clean),
b AS (SELECT * FROM ts WHERE fecha_hora IS NOT NULL AND {UVB} IS NOT NULL AND NOT isnan({UVB})),
w AS (SELECT * FROM b WHERE fecha_hora BETWEEN (SELECT MIN(fecha_hora) FROM b)
                          AND (SELECT MIN(fecha_hora) FROM b) + INTERVAL 7 DAY)"""


def _series(spark, sf):
    return ordering.with_time(clean_obs(spark, sf)).select(*ROW_KEY, "fecha_hora", UVB)


@register("time_series", with_(OBS, CLEAN, _SERIES) + f"SELECT {KEYS}, fecha_hora, {r6(UVB)} AS {UVB} FROM b")
def q_time_series(spark, sf):
    return ordering.time_series(_series(spark, sf), "fecha_hora", ROW_KEY)


@register("first_days", with_(OBS, CLEAN, _SERIES) + f"SELECT {KEYS}, fecha_hora, {r6(UVB)} AS {UVB} FROM w")
def q_first_days(spark, sf):
    return ordering.first_days(_series(spark, sf), "fecha_hora", UVB, days=7)


@register("first_days_events", """
WITH b AS (SELECT event_id, ts, value FROM events
           WHERE ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value))
SELECT event_id, ts, """ + r6("value") + """ AS value FROM b
WHERE ts BETWEEN (SELECT MIN(ts) FROM b) AND (SELECT MIN(ts) FROM b) + INTERVAL 7 DAY""")
def q_first_days_events(spark, sf):
    return ordering.first_days(fx.events_series(spark, sf), "ts", "value", days=7)


@register("series_bound", with_(OBS, CLEAN, _SERIES) + f"SELECT {r6(f'MAX({UVB}) * 1.1e0')} AS y_max FROM w")
def q_series_bound(spark, sf):
    return ordering.series_bound(ordering.first_days(_series(spark, sf), "fecha_hora", UVB))


@register("first_rows", with_(OBS, CLEAN, _SERIES) + f"""
SELECT {KEYS}, fecha_hora, {r6(UVB)} AS {UVB} FROM b ORDER BY fecha_hora, {KEYS} LIMIT 500""")
def q_first_rows(spark, sf):
    return ordering.first_rows(_series(spark, sf), "fecha_hora", ROW_KEY, 500)


# --------------------------------------------- M1-M3, A16, A17: split
_LABELLED = f"""thr AS (SELECT quantile_cont({UVB}, 0.5) AS t FROM clean),
lab AS (SELECT clean.*, CAST(CASE WHEN {UVB} >= thr.t THEN 1 ELSE 0 END AS INT) AS HighUVB
        FROM clean, thr),
cc AS (SELECT HighUVB, COUNT(*) AS n_c FROM lab GROUP BY HighUVB),
a1 AS (SELECT HighUVB, n_c, SUM(n_c) OVER () AS n,
              SUM(n_c) OVER () - CEIL(0.2e0 * SUM(n_c) OVER ()) AS ntr FROM cc),
a2 AS (SELECT *, CAST(ntr * n_c AS DOUBLE) / CAST(n AS DOUBLE) AS cont FROM a1),
a3 AS (SELECT *, FLOOR(cont) AS fl, cont - FLOOR(cont) AS rem FROM a2),
a4 AS (SELECT *, ntr - SUM(fl) OVER () AS need,
              ROW_NUMBER() OVER (ORDER BY rem DESC, HighUVB) AS rk FROM a3),
alloc AS (SELECT HighUVB, n_c, CAST(fl + CASE WHEN rk <= need THEN 1 ELSE 0 END AS BIGINT) AS n_train
          FROM a4),
sc AS (SELECT 'train' AS split, HighUVB, n_train AS n FROM alloc WHERE n_train > 0
       UNION ALL SELECT 'test', HighUVB, n_c - n_train FROM alloc WHERE n_c > n_train)"""


def labelled(spark, sf) -> DataFrame:
    c = clean_obs(spark, sf)
    return c.withColumn("HighUVB", high_label(UVB, summarize.threshold_value(c)))


def _split(spark, sf, folds: int | None = None) -> DataFrame:
    return split.stratified_split(labelled(spark, sf), "HighUVB", ROW_KEY, 0.2, 42, folds=folds)


@register("split_counts", with_(OBS, CLEAN, _LABELLED) + "SELECT split, HighUVB, CAST(n AS BIGINT) AS n FROM sc")
def q_split_counts(spark, sf):
    return split.split_counts(_split(spark, sf), "HighUVB")


_ROW_HASH = ("CAST('0x' || substr(md5('42|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' "
             "|| l_linenumber), 1, 15) AS BIGINT)")
_SPLIT_ROWS = f"""ranked AS (
  SELECT lab.*, n_train, ROW_NUMBER() OVER (PARTITION BY HighUVB ORDER BY {_ROW_HASH}) - 1 AS pos
  FROM lab JOIN alloc USING (HighUVB))"""


@register("split_rows", with_(OBS, CLEAN, _LABELLED, _SPLIT_ROWS) + f"""
SELECT {KEYS}, HighUVB, CASE WHEN pos < n_train THEN 'train' ELSE 'test' END AS split FROM ranked""")
def q_split_rows(spark, sf):
    return _split(spark, sf).select(*ROW_KEY, "HighUVB", "split")


@register("class_proportion", with_(OBS, CLEAN, _LABELLED) + f"""
SELECT split, {r6('CAST(SUM(n * HighUVB) AS DOUBLE) / SUM(n)')} AS proportion,
       CAST(SUM(n) AS BIGINT) AS n FROM sc GROUP BY split""")
def q_class_proportion(spark, sf):
    return summarize.class_proportion(_split(spark, sf), "HighUVB")


@register("class_weight", with_(OBS, CLEAN, _LABELLED) + f"""
SELECT CAST(SUM(CASE WHEN HighUVB = 1 THEN n ELSE 0 END) AS BIGINT) AS pos,
       CAST(SUM(CASE WHEN HighUVB = 0 THEN n ELSE 0 END) AS BIGINT) AS neg,
       {r6('COALESCE(CAST(SUM(CASE WHEN HighUVB = 0 THEN n ELSE 0 END) AS DOUBLE) / NULLIF(SUM(CASE WHEN HighUVB = 1 THEN n ELSE 0 END), 0), 1e0)')} AS scale_pos_weight
FROM sc WHERE split = 'train'""")
def q_class_weight(spark, sf):
    return summarize.class_weight(_split(spark, sf).where(F.col("split") == "train"), "HighUVB")


@register("fold_counts", with_(OBS, CLEAN, _LABELLED) + """
, tr AS (SELECT HighUVB, n_train AS n_c FROM alloc WHERE n_train > 0),
bl AS (SELECT HighUVB, n_c, COALESCE(SUM(n_c) OVER (ORDER BY HighUVB
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tr),
fo AS (SELECT HighUVB, n_c, s, CAST(x.i AS INT) AS fold FROM bl, range(0, 5) AS x(i)),
fc AS (SELECT fold, HighUVB,
              CAST(GREATEST(0, FLOOR((s + n_c - fold - 1) / 5) + 1)
                   - GREATEST(0, FLOOR((s - fold - 1) / 5) + 1) AS BIGINT) AS n FROM fo)
SELECT fold, HighUVB, n FROM fc WHERE n > 0""")
def q_fold_counts(spark, sf):
    return split.fold_counts(_split(spark, sf, folds=5).where(F.col("split") == "train"), "HighUVB")


@register("fold_rows", with_(OBS, CLEAN, _LABELLED, _SPLIT_ROWS) + f"""
, tr AS (SELECT HighUVB, n_train AS n_c FROM alloc WHERE n_train > 0),
bl AS (SELECT HighUVB, n_c, COALESCE(SUM(n_c) OVER (ORDER BY HighUVB
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tr),
fo AS (SELECT HighUVB, n_c, s, CAST(x.i AS INT) AS fold FROM bl, range(0, 5) AS x(i)),
fc AS (SELECT fold, HighUVB, GREATEST(0, FLOOR((s + n_c - fold - 1) / 5) + 1)
                             - GREATEST(0, FLOOR((s - fold - 1) / 5) + 1) AS n FROM fo),
fb AS (SELECT fold, HighUVB, n, SUM(n) OVER (PARTITION BY HighUVB ORDER BY fold) - n AS first FROM fc)
SELECT {KEYS}, ranked.HighUVB, fb.fold FROM ranked JOIN fb
  ON fb.HighUVB = ranked.HighUVB AND pos >= fb.first AND pos < fb.first + fb.n
WHERE pos < n_train""")
def q_fold_rows(spark, sf):
    return _split(spark, sf, folds=5).where(F.col("split") == "train").select(*ROW_KEY, "HighUVB", "fold")


# ------------------------------------------------------- E1-E5: evaluation
_SCORED = f"""scored AS (
  SELECT CASE WHEN {UVB} >= 1.5e0 THEN 1 ELSE 0 END AS label,
         floor(({UVB} / 3e0 * 0.6e0 + {LW} / 50e0 * 0.4e0) * 100e0) / 100e0 AS score FROM obs),
sp AS (SELECT label, score, CASE WHEN score >= 0.5e0 THEN 1 ELSE 0 END AS prediction FROM scored),
ps AS (SELECT score, COUNT(*) FILTER (WHERE label = 1) AS pos,
              COUNT(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY score),
cum AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC) AS tps, SUM(neg) OVER (ORDER BY score DESC) AS fps,
               ROW_NUMBER() OVER (ORDER BY score DESC) - 1 AS idx,
               LEAD(pos) OVER (ORDER BY score DESC) AS npos, LEAD(neg) OVER (ORDER BY score DESC) AS nneg,
               COUNT(*) OVER () AS D FROM ps),
auc AS (SELECT SUM(neg * ((tps - pos) + pos / 2e0)) / (SUM(pos) * SUM(neg)) AS auc FROM cum),
cells AS (SELECT COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                 COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                 COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
                 COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM sp),
pc AS (SELECT *, tp + fp + fn + tn AS N,
              CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS p1,
              CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END AS r1,
              CASE WHEN tn + fn = 0 THEN 0e0 ELSE tn / (tn + fn) END AS p0,
              CASE WHEN tn + fp = 0 THEN 0e0 ELSE tn / (tn + fp) END AS r0 FROM cells),
m AS (SELECT *, CASE WHEN p1 + r1 = 0 THEN 0e0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1_1,
             CASE WHEN p0 + r0 = 0 THEN 0e0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f1_0 FROM pc)"""


# one score per order line, so runs of equal steps occur and thinning acts
_RUNS_SQL = f"""runs AS (SELECT CASE WHEN {UVB} >= 1.5e0 THEN 1 ELSE 0 END AS label,
  CAST(l_orderkey AS DOUBLE) + l_linenumber / 16e0 AS score FROM obs),
ps AS (SELECT score, COUNT(*) FILTER (WHERE label = 1) AS pos,
              COUNT(*) FILTER (WHERE label = 0) AS neg FROM runs GROUP BY score),
cum AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC) AS tps, SUM(neg) OVER (ORDER BY score DESC) AS fps,
               ROW_NUMBER() OVER (ORDER BY score DESC) - 1 AS idx,
               LEAD(pos) OVER (ORDER BY score DESC) AS npos, LEAD(neg) OVER (ORDER BY score DESC) AS nneg,
               COUNT(*) OVER () AS D FROM ps)"""


def _run_scores(spark, sf):
    o = fx.obs(spark, sf)
    return o.select(F.when(F.col(UVB) >= 1.5, 1).otherwise(0).alias("label"),
                    (F.col("l_orderkey").cast("double") + F.col("l_linenumber") / F.lit(16.0)).alias("score"))


def _scored(spark, sf):
    return evaluate.with_prediction(fx.scored(spark, sf), "score", 0.5)


@register("confusion", with_(OBS, _SCORED) + """
, ax AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(label, prediction))
SELECT ax.label, ax.prediction, CAST(COUNT(sp.label) AS BIGINT) AS n
FROM ax LEFT JOIN sp ON sp.label = ax.label AND sp.prediction = ax.prediction
GROUP BY ax.label, ax.prediction""")
def q_confusion(spark, sf):
    return evaluate.confusion(_scored(spark, sf))


@register("roc_auc", with_(OBS, _SCORED) + f"SELECT {r6('auc')} AS auc FROM auc")
def q_roc_auc(spark, sf):
    return evaluate.roc_auc(_scored(spark, sf))


_ROC_SQL = f"""
, tot AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM ps)
SELECT CAST('inf' AS DOUBLE) AS threshold, 0e0 AS fpr, 0e0 AS tpr
UNION ALL
SELECT {r6('score')}, {r6('fps / N')}, {r6('tps / P')} FROM cum, tot"""
_THINNED = "\nWHERE idx = 0 OR idx = D - 1 OR npos <> pos OR nneg <> neg"


@register("roc_points", with_(OBS, _RUNS_SQL) + _ROC_SQL + _THINNED)
def q_roc_points(spark, sf):
    return evaluate.roc_points(_run_scores(spark, sf))


@register("roc_points_ties", with_(OBS, _SCORED) + _ROC_SQL + _THINNED)
def q_roc_points_ties(spark, sf):
    return evaluate.roc_points(_scored(spark, sf))


@register("roc_points_all", with_(OBS, _RUNS_SQL) + _ROC_SQL)
def q_roc_points_all(spark, sf):
    return evaluate.roc_points(_run_scores(spark, sf), drop_intermediate=False)


@register("class_metrics", with_(OBS, _SCORED) + f"""
SELECT {r6('(tp + tn) / N')} AS accuracy, {r6('(f1_0 + f1_1) / 2')} AS f1_macro,
       {r6('(r0 + r1) / 2')} AS balanced_accuracy, {r6('auc.auc')} AS auc FROM m, auc""")
def q_class_metrics(spark, sf):
    return evaluate.class_metrics(_scored(spark, sf))


@register("class_report", with_(OBS, _SCORED) + f"""
SELECT '0' AS class, {r6('p0')} AS precision, {r6('r0')} AS recall, {r6('f1_0')} AS f1,
       CAST(tn + fp AS BIGINT) AS support FROM m
UNION ALL SELECT '1', {r6('p1')}, {r6('r1')}, {r6('f1_1')}, CAST(tp + fn AS BIGINT) FROM m
UNION ALL SELECT 'accuracy', {r6('(tp + tn) / N')}, {r6('(tp + tn) / N')}, {r6('(tp + tn) / N')},
       CAST(N AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', {r6('(p0 + p1) / 2')}, {r6('(r0 + r1) / 2')}, {r6('(f1_0 + f1_1) / 2')},
       CAST(N AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', {r6('(p0 * (tn + fp) + p1 * (tp + fn)) / N')},
       {r6('(r0 * (tn + fp) + r1 * (tp + fn)) / N')}, {r6('(f1_0 * (tn + fp) + f1_1 * (tp + fn)) / N')},
       CAST(N AS BIGINT) FROM m""")
def q_class_report(spark, sf):
    return evaluate.class_report(_scored(spark, sf))


# ------------------------------------------------ M4-M13: model pipeline
from pyspark.ml import Pipeline, PipelineModel  # noqa: E402
from pyspark.ml.feature import OneHotEncoder  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

from lumen.operators import prep  # noqa: E402
from lumen.plans import modeling  # noqa: E402

_NUM, _CAT = [LW, PRECIP, PS], ["HR", "DY", "MO"]


def _valid(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


@register("impute_median", with_(OBS, DIRTY) + ", med AS (SELECT "
          + ", ".join(f"quantile_cont({_valid(c)}, 0.5) AS m{i}" for i, c in enumerate(_NUM))
          + " FROM dirty)\nSELECT " + KEYS + ", "
          + ", ".join(f"{r6(f'COALESCE({_valid(c)}, m{i})')} AS {c}" for i, c in enumerate(_NUM))
          + " FROM dirty, med")
def q_impute_median(spark, sf):
    d = fx.obs_dirty(spark, sf)
    m = prep.MedianImputer(inputCols=_NUM).fit(d)
    return m.transform(d).select(*ROW_KEY, *_NUM)


@register("impute_mode", with_(OBS, DIRTY) + ", " + ",\n".join(
    f"md{i} AS (SELECT {c} AS v FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY COUNT(*) DESC, {c} LIMIT 1)" for i, c in enumerate(_CAT))
          + "\nSELECT " + KEYS + ", "
          + ", ".join(f"CAST(COALESCE({c}, (SELECT v FROM md{i})) AS INT) AS {c}"
                      for i, c in enumerate(_CAT)) + " FROM dirty")
def q_impute_mode(spark, sf):
    d = fx.obs_dirty(spark, sf)
    m = prep.ModeImputer(inputCols=_CAT).fit(d)
    return m.transform(d).select(*ROW_KEY, *_CAT)


@register("standardize", with_(OBS, CLEAN) + ", st AS (SELECT "
          + ", ".join(f"AVG({c}) AS a{i}, STDDEV_POP({c}) AS s{i}" for i, c in enumerate(_NUM))
          + " FROM clean)\nSELECT " + KEYS + ", "
          + ", ".join(f"{r6(f'({c} - a{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END')} AS {c}"
                      for i, c in enumerate(_NUM)) + " FROM clean, st")
def q_standardize(spark, sf):
    c = clean_obs(spark, sf)
    return prep.PopulationScaler(inputCols=_NUM).fit(c).transform(c).select(*ROW_KEY, *_NUM)


@register("one_hot", with_(OBS, CLEAN) + "\nSELECT " + KEYS + ", "
          + ", ".join(f"CAST(DENSE_RANK() OVER (ORDER BY {c}) - 1 AS INT) AS {c}_hot, "
                      f"CAST((SELECT COUNT(DISTINCT {c}) FROM clean) AS INT) AS {c}_width"
                      for c in _CAT) + " FROM clean")
def q_one_hot(spark, sf):
    c = clean_obs(spark, sf)
    idx = prep.CategoryIndexer(inputCols=_CAT)
    ohe = OneHotEncoder(inputCols=[f"{x}_idx" for x in _CAT], outputCols=[f"{x}_ohe" for x in _CAT],
                        dropLast=True)
    out = Pipeline(stages=[idx, ohe]).fit(c).transform(c)
    cols = []
    for x in _CAT:
        arr = vector_to_array(f"{x}_ohe")
        cols += [(F.array_position(arr, F.lit(1.0)) - 1).cast("int").alias(f"{x}_hot"),
                 F.size(arr).cast("int").alias(f"{x}_width")]
    return out.select(*ROW_KEY, *cols)


# the label's variable mixed with a feature, so that a model can tell the classes apart
_SIGNAL = f"signal AS (SELECT * REPLACE ({UVB} / 3e0 * 0.3e0 + {LW} / 50e0 * 0.7e0 AS {UVB}) FROM clean)"
_MODEL_ROWS = _LABELLED.replace("FROM clean)", "FROM signal)").replace("clean.*", "signal.*").replace("FROM clean, thr", "FROM signal, thr")


def _search(spark: SparkSession, sf: str):
    """One search per session and folder, kept on the session that made it, so the views
    below share a fit and nothing outlives the session."""
    runs = spark.__dict__.setdefault("_lumen_searches", {})
    if sf not in runs:
        signal = clean_obs(spark, sf).withColumn(UVB, F.col(UVB) / 3.0 * 0.3 + F.col(LW) / 50.0 * 0.7)
        runs[sf] = modeling.run_search(spark, signal)
    return runs[sf]


@register("grid_search")
def q_grid_search(spark, sf):
    return modeling.grid_table(spark, _search(spark, sf))


@register("model_predict")
def q_model_predict(spark, sf):
    return _search(spark, sf).predictions.select(*ROW_KEY, "HighUVB", "prediction", "score")


@register("model_reloaded")
def q_model_reloaded(spark, sf):
    """Predictions of the fitted pipeline after it was saved and loaded again."""
    path, found = files.shared_path(spark, "model"), _search(spark, sf)
    found.model.write().save(path)
    rows = found.predictions.select(*ROW_KEY, "HighUVB", *_NUM, *_CAT)
    return PipelineModel.load(path).transform(rows).select(*ROW_KEY, "HighUVB", F.col("prediction").cast("int").alias("prediction"), "score")


@register("model_test_rows", with_(OBS, CLEAN, _SIGNAL, _MODEL_ROWS, _SPLIT_ROWS)
          + f"SELECT {KEYS}, HighUVB FROM ranked WHERE pos >= n_train")
def q_model_test_rows(spark, sf):
    return _search(spark, sf).predictions.select(*ROW_KEY, "HighUVB")


@register("model_shape", with_(OBS, CLEAN, _SIGNAL, _MODEL_ROWS, _SPLIT_ROWS, "train AS (SELECT * FROM ranked WHERE pos < n_train)")
          + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS train_rows,
       CAST((SELECT COUNT(*) FROM ranked WHERE pos >= n_train) AS BIGINT) AS test_rows,
       CAST({len(_NUM)} + {" + ".join(f"COUNT(DISTINCT {c})" for c in _CAT)} AS INT) AS n_features,
       {r6('CAST(COUNT(*) FILTER (WHERE HighUVB = 0) AS DOUBLE) / COUNT(*) FILTER (WHERE HighUVB = 1)')} AS scale_pos_weight
FROM train""")
def q_model_shape(spark, sf):
    """The part of the model's record that the prepared rows decide."""
    return modeling.record(spark, _search(spark, sf)).select("train_rows", "test_rows", "n_features", "scale_pos_weight")


@register("model_metrics")
def q_model_metrics(spark, sf):
    return evaluate.class_metrics(_search(spark, sf).predictions, "HighUVB", "prediction", "score")


@register("model_confusion")
def q_model_confusion(spark, sf):
    return evaluate.confusion(_search(spark, sf).predictions, "HighUVB", "prediction")


@register("model_record")
def q_model_record(spark, sf):
    try:
        result = _search(spark, sf)
    except Exception as e:  # noqa: BLE001 - M13 keeps a failed run as its record
        result = modeling.failed(e)
    return modeling.record(spark, result)


# ----------------------------------------------- S1-S7: sources and sinks
from lumen.sources import sinks  # noqa: E402
from lumen.streaming import kpis as stream_kpis  # noqa: E402

_OBS_COLS = ["YEAR", "MO", "DY", "HR", UVB, LW, PRECIP, PS, *ROW_KEY]


@register("csv_roundtrip", with_(OBS, CLEAN) + "SELECT * FROM clean")
def q_csv_roundtrip(spark, sf):
    path = files.shared_path(spark, "csv")
    files.write_csv(clean_obs(spark, sf).select(*_OBS_COLS), path)
    return files.read_csv(spark, path, files.KEYED_SCHEMA)


@register("csv_reordered", with_(OBS, CLEAN) + f"""
SELECT CAST(NULL AS INT) AS YEAR, MO, DY, HR, {UVB}, {LW}, {PRECIP}, {PS}, {KEYS} FROM clean""")
def q_csv_reordered(spark, sf):
    """Columns in another order, one calendar column missing, one column more."""
    path = files.shared_path(spark, "csv")
    files.write_csv(clean_obs(spark, sf).select(PS, *ROW_KEY, F.lit("x").alias("station"), LW, UVB, "MO", PRECIP, "HR", "DY"), path)
    return C.conform(files.read_csv(spark, path, files.KEYED_SCHEMA)).select(*_OBS_COLS)


@register("sink_roundtrip", with_(OBS, CLEAN) + "SELECT * FROM clean")
def q_sink_roundtrip(spark, sf):
    path = files.shared_path(spark, "datos_uvb")
    sinks.write_table(clean_obs(spark, sf).select(*_OBS_COLS), path, ("YEAR", "MO"))
    return spark.read.parquet(path).select(*_OBS_COLS)


@register("sink_count", with_(OBS) + "SELECT COUNT(*) AS total FROM obs")
def q_sink_count(spark, sf):
    path = files.shared_path(spark, "datos_uvb")
    sinks.write_table(fx.obs(spark, sf).select(*_OBS_COLS), path, ("YEAR", "MO"))
    return sinks.load_count(spark, path)


@register("sink_replaced", with_(OBS, CLEAN) + "SELECT * FROM clean WHERE MO <> 7")
def q_sink_replaced(spark, sf):
    """A stored table replaced twice, the second time by rows read from itself."""
    path = files.shared_path(spark, "datos_uvb")
    sinks.replace_table(clean_obs(spark, sf).select(*_OBS_COLS), path)
    sinks.replace_table(sinks.open_table(spark, path).where(F.col("MO") != 7), path)
    return sinks.open_table(spark, path).select(*_OBS_COLS)


@register("sink_bounds", with_(OBS, CLEAN) + f"""
SELECT MO, COUNT(*) AS rows, MIN(DY) AS DY_min, MAX(DY) AS DY_max, {r6(f'MIN({UVB})')} AS {UVB}_min,
       {r6(f'MAX({UVB})')} AS {UVB}_max FROM clean GROUP BY MO""")
def q_sink_bounds(spark, sf):
    path = files.shared_path(spark, "datos_uvb")
    sinks.write_table(clean_obs(spark, sf).select(*_OBS_COLS), path, ("MO",))
    return bounds(spark, path, ["DY", UVB], ["MO"])


@register("sink_check", with_(OBS, CLEAN) + """
SELECT COUNT(*) AS total, COUNT(*) AS expected, true AS complete FROM clean""")
def q_sink_check(spark, sf):
    path = files.shared_path(spark, "datos_uvb")
    sinks.replace_table(clean_obs(spark, sf).select(*_OBS_COLS), path)
    return sinks.load_check(spark, path).select("total", "expected", "complete")


@register("sink_month_pruned", with_(OBS, CLEAN) + "SELECT * FROM clean WHERE MO = 7")
def q_sink_month(spark, sf):
    path = files.shared_path(spark, "datos_uvb")
    sinks.write_table(clean_obs(spark, sf).select(*_OBS_COLS), path, ("YEAR", "MO"))
    return spark.read.parquet(path).where(F.col("MO") == 7).select(*_OBS_COLS)


@register("stream_kpis", with_(OBS, CLEAN) + f"""
SELECT COUNT(*) AS total_registros, {r6(f'AVG({UVB})')} AS uvb_promedio,
       {r6(f'MAX({PRECIP})')} AS precipitacion_max FROM clean""")
def q_stream_kpis(spark, sf):
    folder = files.shared_path(spark, "landing")
    at_once = stream_kpis.land(fx.obs(spark, sf).select(*_OBS_COLS), folder)
    stream = stream_kpis.observation_stream(spark, folder, files.KEYED_SCHEMA, files_per_trigger=at_once)
    return stream_kpis.run_available(stream_kpis.running_kpis(stream), files.shared_path(spark, "kpis"),
                                     files.shared_path(spark, "stream-ckpt"))
