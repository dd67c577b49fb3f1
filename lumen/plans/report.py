"""The SQL report (A1-A3, F6): three statements over the stored table.

They run through ``spark.sql`` with the table passed as a DataFrame
parameter, so Catalyst plans them like any other query (the ``> 0`` and
``IS NOT NULL`` predicates reach the Parquet scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COUNT_SQL = "SELECT COUNT(*) AS total_registros FROM {datos_uvb}"

STATS_SQL = """
SELECT AVG(ALLSKY_SFC_UVB) AS uv_promedio,
       MIN(ALLSKY_SFC_UVB) AS uv_minimo,
       MAX(ALLSKY_SFC_UVB) AS uv_maximo
FROM {datos_uvb}
WHERE ALLSKY_SFC_UVB > 0
"""

MONTH_SQL = """
SELECT MO AS mes, AVG(ALLSKY_SFC_UVB) AS uv_promedio_mes
FROM {datos_uvb}
WHERE MO IS NOT NULL
GROUP BY MO
ORDER BY MO
"""


def sql_count(spark: SparkSession, table: DataFrame) -> DataFrame:
    return spark.sql(COUNT_SQL, datos_uvb=table)


def sql_stats(spark: SparkSession, table: DataFrame) -> DataFrame:
    return spark.sql(STATS_SQL, datos_uvb=table)


def sql_month(spark: SparkSession, table: DataFrame) -> DataFrame:
    return spark.sql(MONTH_SQL, datos_uvb=table)


def report(spark: SparkSession, table: DataFrame) -> dict[str, DataFrame]:
    """All three statements, as the report prints them."""
    return {"total": sql_count(spark, table), "stats": sql_stats(spark, table),
            "by_month": sql_month(spark, table)}
