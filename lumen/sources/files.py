"""File sources and the shared scratch location."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.schema import OBS_SCHEMA, ROW_KEY
from lumen.session import ensure_checkpoint_dir

# Observation columns plus the fixture row key, for reading back what we wrote.
KEYED_SCHEMA = T.StructType(list(OBS_SCHEMA.fields) + [
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType())])
assert [f.name for f in KEYED_SCHEMA.fields][-4:] == ROW_KEY


def read_csv(spark: SparkSession, path: str, schema: T.StructType = OBS_SCHEMA,
             encoding: str = "UTF-8", keep_extra: bool = False) -> DataFrame:
    """CSV with a header row; columns are found by their header names, whatever their
    order, and cast to the types of ``schema`` (a value that is no number is null).
    Columns of ``schema`` that the file lacks are absent from the result, so that
    ``conform_schema`` can add them; other columns are left out unless ``keep_extra``
    (as strings, after the known ones). No inference pass: only the header is read."""
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    known = [f for f in schema.fields if f.name in raw.columns]
    extra = [c for c in raw.columns if c not in schema.names] if keep_extra else []
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in known],
                      *[F.col(f"`{c}`") for c in extra])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder: the shared location named by
    ``spark.checkpoint.dir`` on a cluster, a scratch folder in local mode."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/lumen-tables/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a readable file or folder is at ``path`` (probe via a lazy read)."""
    try:
        spark.read.format("text").load(path)
        return True
    except Exception:  # noqa: BLE001 - Spark raises AnalysisException PATH_NOT_FOUND
        return False


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
