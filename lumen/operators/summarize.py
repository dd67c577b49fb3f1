"""Aggregations (A1-A8, A16-A18) and axis lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.calendar import (MONTH_LABELS, SEASON_ORDER, month_label,
                                      season, season_ordinal)
from lumen.operators.ranking import quantiles
from lumen.schema import PRECIP, UVB


def row_count(df: DataFrame, alias: str = "total_registros") -> DataFrame:
    """Number of rows."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def positive_stats(df: DataFrame, column: str = UVB) -> DataFrame:
    """A2: mean, min, max over the rows where ``column > 0``."""
    return df.where(F.col(column) > 0).agg(
        F.avg(column).alias("uv_promedio"),
        F.min(column).alias("uv_minimo"),
        F.max(column).alias("uv_maximo"))


def monthly_mean(df: DataFrame, column: str = UVB) -> DataFrame:
    """A3: mean by month over non-null months, ordered by month."""
    return (df.where(F.col("MO").isNotNull())
              .groupBy(F.col("MO").alias("mes"))
              .agg(F.avg(column).alias("uv_promedio_mes"))
              .orderBy("mes"))


def kpis(df: DataFrame) -> DataFrame:
    """A4: the key figures of the dashboard in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.avg(UVB).alias("uvb_promedio"),
        F.max(PRECIP).alias("precipitacion_max"))


def month_table(df: DataFrame, column: str = UVB) -> DataFrame:
    """A5: mean, sample std, min, max by month; null months dropped (trap 3)."""
    return (df.where(F.col("MO").isNotNull())
              .groupBy("MO")
              .agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
                   F.min(column).alias("min"), F.max(column).alias("max"))
              .orderBy("MO"))


def with_season(df: DataFrame, month: str = "MO", name: str = "Estacion") -> DataFrame:
    return df.withColumn(name, season(month))


def season_table(df: DataFrame, column: str = UVB, digits: int = 3) -> DataFrame:
    """Mean, std, count by season, rounded half-to-even like NumPy."""
    return (with_season(df)
            .groupBy("Estacion")
            .agg(F.bround(F.avg(column), digits).alias("mean"),
                 F.bround(F.stddev_samp(column), digits).alias("std"),
                 F.count(column).alias("count")))


def month_axis(df: DataFrame) -> DataFrame:
    """The 12-month axis with labels (a dimension of 12 rows)."""
    spark = df.sparkSession
    return spark.range(1, 13).select(F.col("id").cast("int").alias("MO"),
                                     month_label(F.col("id").cast("int")).alias("label"))


def month_dense(df: DataFrame, column: str = UVB) -> DataFrame:
    """A7 + J1 + F15: monthly means completed to 1..12, missing months = 0."""
    means = df.where(F.col("MO").isNotNull()).groupBy("MO").agg(F.avg(column).alias("_m"))
    axis = month_axis(df)
    return (axis.join(F.broadcast(means), "MO", "left")
                .select("MO", "label", F.coalesce("_m", F.lit(0.0)).alias("uvb_promedio")))


def season_order(df: DataFrame, column: str = UVB) -> DataFrame:
    """Season means in display order, only seasons present."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(SEASON_ORDER)],
                                "Estacion string, orden int")
    means = with_season(df).groupBy("Estacion").agg(F.avg(column).alias("mean"))
    return means.join(F.broadcast(dim), "Estacion", "inner").select(
        "orden", "Estacion", "mean").orderBy("orden")


def median_threshold(df: DataFrame, column: str = UVB) -> DataFrame:
    """Exact global median (linear interpolation), as ``threshold``."""
    return quantiles(df, column, {"threshold": 0.5}).select("threshold")


def threshold_value(df: DataFrame, column: str = UVB):
    """M1: the median as a literal (one number crosses to the driver), so the
    label expression does not re-run the median inside every later plan."""
    value = median_threshold(df, column).first()[0]
    return F.lit(value).cast("double")


def class_proportion(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Share of positives per split."""
    return df.groupBy(split).agg(F.avg(F.col(label).cast("double")).alias("proportion"),
                                 F.count(F.lit(1)).alias("n"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives / positives; 1.0 when there is no positive."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("pos"), neg.alias("neg"),
                  F.coalesce(F.try_divide(neg.cast("double"), F.nullif(pos, F.lit(0)).cast("double")),
                             F.lit(1.0)).alias("scale_pos_weight"))
