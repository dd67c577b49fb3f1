"""Database source (S1) and connection profiles.

Credentials never live in code: a profile comes from explicit arguments or
from environment variables (``LUMEN_DB_URL``, ``LUMEN_DB_USER``,
``LUMEN_DB_PASSWORD``, optional ``LUMEN_DB_DRIVER``).
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ConnectionProfile:
    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str | None = None


def profile_from_env(prefix: str = "LUMEN_DB", env: Mapping[str, str] | None = None
                     ) -> ConnectionProfile | None:
    """The connection profile of this environment, or None when unset."""
    env = os.environ if env is None else env
    url = env.get(f"{prefix}_URL")
    if not url:
        return None
    return ConnectionProfile(url=url, user=env.get(f"{prefix}_USER"),
                             password=env.get(f"{prefix}_PASSWORD"),
                             driver=env.get(f"{prefix}_DRIVER"))


def jdbc_options(profile: ConnectionProfile, table: str) -> dict[str, str]:
    opts = {"url": profile.url, "dbtable": table}
    if profile.user is not None:
        opts["user"] = profile.user
    if profile.password is not None:
        opts["password"] = profile.password
    if profile.driver:
        opts["driver"] = profile.driver
    return opts


def partition_options(column: str | None, lower: int | None, upper: int | None,
                      num_partitions: int | None) -> dict[str, str]:
    """Options that split a JDBC scan into ``num_partitions`` range queries on
    ``column`` (strides of (upper - lower) / num_partitions; the first and last
    ranges are open, so no row is lost outside the bounds). Empty when the
    scan cannot or need not be split."""
    if not column or not num_partitions or num_partitions < 2:
        return {}
    if lower is None or upper is None or upper <= lower:
        return {}
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
            "numPartitions": str(num_partitions)}


def read_table(spark: SparkSession, profile: ConnectionProfile, table: str,
               partition_column: str | None = None, lower: int | None = None,
               upper: int | None = None, num_partitions: int | None = None,
               fetch_size: int = 10_000) -> DataFrame:
    """Full-table scan, split into ``num_partitions`` range queries on a
    numeric column so executors read in parallel. Missing bounds are taken
    by one small min/max query pushed to the database."""
    reader = spark.read.format("jdbc").options(**jdbc_options(profile, table)).option(
        "fetchsize", fetch_size)
    if partition_column and num_partitions and num_partitions > 1:
        if lower is None or upper is None:
            b = (spark.read.format("jdbc")
                 .options(**jdbc_options(profile, f"(SELECT MIN({partition_column}) AS lo, "
                                                  f"MAX({partition_column}) AS hi FROM {table}) b"))
                 .load().select(F.col("lo").cast("long"), F.col("hi").cast("long")).first())
            lower, upper = b[0], b[1]
        reader = reader.options(**partition_options(partition_column, lower, upper, num_partitions))
    return reader.load()
