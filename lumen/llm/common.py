"""Helpers shared by the operators: table access, shared scratch tables, seeded hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.session import ensure_checkpoint_dir

#: A token of all contracts: a run of bytes other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage, keeps columnar pruning, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_turn(frames: Iterator[DataFrame]) -> DataFrame:
    """The rows of all ``frames`` (at least one, of one schema), each written to the shared
    checkpoint folder before the next is asked for, so what a frame holds on the driver is
    held once."""
    path = df = None
    for df in frames:
        path = path or f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """128-bit identity of a text (null and empty are one key)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def unit_hash(*cols: Column, seed: str = "") -> Column:
    """Uniform double in [0, 1) from 52 bits of an MD5 over the columns' text;
    DuckDB repeats it digit by digit."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))
