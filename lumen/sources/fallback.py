"""Source fallback (S3): database first, then CSV, else a clear error.

Reads are lazy, so a source counts as available only once its schema is
resolved: a JDBC reader connects while loading, a file reader checks paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lumen.schema import OBS_SCHEMA
from lumen.sources.files import exists, read_csv
from lumen.sources.jdbc import ConnectionProfile, profile_from_env, read_table


class NoSourceError(FileNotFoundError):
    pass


def load_observations(spark: SparkSession, profile: ConnectionProfile | None = None,
                      table: str = "datos_uvb", csv_path: str | None = None,
                      schema: T.StructType = OBS_SCHEMA, **jdbc_kwargs) -> tuple[DataFrame, str]:
    """Returns (frame, name of the source used)."""
    errors: list[str] = []
    profile = profile or profile_from_env()
    if profile is not None:
        try:
            df = read_table(spark, profile, table, **jdbc_kwargs)
            _ = df.schema  # resolved: the database answered
            return df, "jdbc"
        except Exception as e:  # noqa: BLE001 - any connection failure falls through
            errors.append(f"database: {type(e).__name__}: {e}")
    if csv_path is not None:
        if exists(spark, csv_path):
            return read_csv(spark, csv_path, schema), "csv"
        errors.append(f"csv: no file at {csv_path}")
    raise NoSourceError("no observation source available; " + "; ".join(errors or ["none given"]))
