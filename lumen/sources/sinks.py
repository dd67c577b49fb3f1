"""Table sinks and the post-load check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.operators.summarize import row_count
from lumen.sources.files import exists, remove
from lumen.sources.jdbc import ConnectionProfile, jdbc_options

MANIFEST = "number long, folder string, files long, rows long"


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("YEAR", "MO"),
                mode: str = "overwrite") -> None:
    """Replace the stored table; Parquet partitioned by year and month so
    later month filters prune whole folders. Rows are rebalanced on the partition columns
    first (one month's rows meet in few tasks, a hot month is split), so the number of
    files follows the data, not tasks x months. No index column is written."""
    parts = [c for c in partition_by if c in df.columns]
    writer = (df.hint("rebalance", *parts) if parts else df).write.mode(mode)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(path)


def write_jdbc(df: DataFrame, profile: ConnectionProfile, table: str, mode: str = "overwrite",
               batch_size: int = 10_000, num_partitions: int | None = None) -> None:
    """S6 for a database: each partition inserts in batches over its own connection;
    ``num_partitions`` caps concurrent connections."""
    out = df.coalesce(num_partitions) if num_partitions else df
    (out.write.format("jdbc").options(**jdbc_options(profile, table))
        .option("batchsize", batch_size).mode(mode).save())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The versions of the table at ``path`` (number, folder, files, rows), the newest first."""
    log = f"{path}/manifest"
    if not exists(spark, log):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(log).orderBy(F.desc("number"), F.desc("folder"))


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("YEAR", "MO")) -> None:
    """Replace the stored table without ever taking the old one away. The rows go to a
    folder of their own; only when that is complete, and holds the rows counted in its footers,
    one manifest row is added, which is what readers go by. A write that fails leaves the table
    as it was. ``df`` may read the table it replaces. One writer at a time."""
    spark = df.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    write_table(df, f"{path}/{folder}", partition_by, mode="errorifexists")
    stored = spark.read.parquet(f"{path}/{folder}")
    last = manifest(spark, path).first()
    row = ((last["number"] if last else 0) + 1, folder, len(stored.inputFiles()), stored.count())
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def open_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The newest version of the table at ``path``, or version ``number``."""
    versions = manifest(spark, path)
    row = (versions if number is None else versions.where(F.col("number") == number)).first()
    if row is None:
        raise FileNotFoundError(f"no table {'' if number is None else f'version {number} '}at {path}")
    return spark.read.parquet(f"{path}/{row['folder']}")


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the data of all but the newest ``keep`` versions; returns how many went."""
    old = [r for r in manifest(spark, path).collect()[max(1, keep):] if exists(spark, f"{path}/{r['folder']}")]
    for r in old:
        remove(spark, f"{path}/{r['folder']}")
    return len(old)


def load_count(spark: SparkSession, path: str) -> DataFrame:
    """Row count of the table as stored (read back, not the frame written)."""
    return row_count(spark.read.parquet(path), "total")


def load_check(spark: SparkSession, path: str) -> DataFrame:
    """S7 for a replaced table: rows and files as stored, as the manifest has them, and
    whether both agree."""
    table, row = open_table(spark, path), manifest(spark, path).first()
    files, rows = F.lit(len(table.inputFiles())).cast("long"), F.lit(row["rows"]).cast("long")
    return row_count(table, "total").select("total", rows.alias("expected"), files.alias("files"),
                                       ((F.col("total") == rows) & (files == row["files"])).alias("complete"))
