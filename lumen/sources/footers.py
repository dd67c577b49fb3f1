"""Counts and bounds of stored Parquet tables from their footers.

The newer Parquet reader answers COUNT, MIN and MAX from the files' footers, also per
partition, without reading a column; it is only used where a session asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every built-in file source but Parquet stays with its older reader.
OLDER_READERS = "avro,csv,json,kafka,orc,text"


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet aggregations are pushed to footers."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.sources.useV1SourceList", OLDER_READERS)
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    # else the reader compares lower-cased partition names with the names as they are written
    session.conf.set("spark.sql.caseSensitive", "true")
    return session


def bounds(spark: SparkSession, path: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by ..., rows, <column>_min, <column>_max ...) of the table at ``path``; ``by`` may name
    partition columns. Null values do not count; a column without any value has null bounds.
    Doubles must hold no NaN (a footer leaves it out of its bounds)."""
    table = footer_session(spark).read.parquet(path)
    ends = [f(c).alias(f"{c}_{name}") for c in columns for f, name in ((F.min, "min"), (F.max, "max"))]
    return table.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *ends)
