"""Observation views derived by Spark from the driver's tables (FIXTURES.md).

The reference ships no data; these views give the observation schema real,
scale-growing content: every row of ``lineitem`` becomes one hourly record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.schema import LW, PRECIP, PS, ROW_KEY, UVB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-shaped observations, one per lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.year("l_shipdate").cast("int").alias("YEAR"),
        F.month("l_shipdate").cast("int").alias("MO"),
        F.dayofmonth("l_shipdate").cast("int").alias("DY"),
        (F.col("l_orderkey") % 24).cast("int").alias("HR"),
        (F.col("l_extendedprice") / F.lit(35000.0)).alias(UVB),
        F.col("l_quantity").alias(LW),
        F.col("l_discount").alias(PRECIP),
        F.col("l_tax").alias(PS),
        *ROW_KEY,
    )


def obs_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with null months, a -999 sentinel, NaN and null values."""
    o = obs(spark, sf_dir)
    ln = F.col("l_linenumber")
    return o.select(
        "YEAR",
        F.when(ln == 7, F.lit(None).cast("int")).otherwise(F.col("MO")).alias("MO"),
        "DY", "HR",
        F.when(ln == 6, F.lit(-999.0)).otherwise(F.col(UVB)).alias(UVB),
        F.when(ln == 5, F.lit(float("nan")))
         .when(ln == 4, F.lit(None).cast("double"))
         .otherwise(F.col(LW)).alias(LW),
        PRECIP, PS, *ROW_KEY,
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and a tied formula score, for evaluation without training."""
    o = obs(spark, sf_dir)
    return o.select(
        F.when(F.col(UVB) >= F.lit(1.5), F.lit(1)).otherwise(F.lit(0)).alias("label"),
        (F.floor((F.col(UVB) / F.lit(3.0) * F.lit(0.6) + F.col(LW) / F.lit(50.0) * F.lit(0.4))
                 * F.lit(100.0)) / F.lit(100.0)).alias("score"),
    )


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real time axis: (ts, value) of the events table."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "value")
