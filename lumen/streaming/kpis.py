"""Key figures over a stream of observation files (A4 as Structured Streaming).

The dashboard's "real-time" figures are running aggregates: new files landing
in a folder update count, mean UVB and maximum precipitation. Running totals
are kept by Spark's state store (complete mode); a daily variant closes each
day's window once the event-time watermark has passed it (append mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.operators.clean import clean_positive
from lumen.operators.ordering import with_time
from lumen.operators.summarize import kpis
from lumen.schema import PRECIP, UVB


#: Rows of a landing file, and the micro-batches that the files are read in.
LANDING_ROWS, BATCHES = 1 << 18, 4


def land(observations: DataFrame, folder: str) -> int:
    """Writes ``observations`` as files of a folder, more files the more rows there are and
    ``BATCHES`` at least, so that no task gets a share that grows with the input. Returns the
    files of a micro-batch, for a stream that reads the folder in about ``BATCHES`` of them."""
    files = max(BATCHES, -(-observations.count() // LANDING_ROWS))
    observations.repartition(files).write.parquet(folder)
    return -(-files // BATCHES)


def observation_stream(spark: SparkSession, folder: str, schema: T.StructType,
                       fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def running_kpis(stream: DataFrame) -> DataFrame:
    """Count, mean UVB and maximum precipitation of all valid rows so far."""
    return kpis(clean_positive(stream))


def daily_kpis(stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Per event-time day; late rows within ``watermark`` still count."""
    # watermarks need TIMESTAMP (with time zone semantics); the derived axis is NTZ
    timed = with_time(clean_positive(stream)).withColumn(
        "event_time", F.col("fecha_hora").cast("timestamp"))
    return (timed.withWatermark("event_time", watermark)
                 .groupBy(F.window("event_time", "1 day").alias("day"))
                 .agg(F.count(F.lit(1)).alias("total_registros"),
                      F.avg(UVB).alias("uvb_promedio"), F.max(PRECIP).alias("precipitacion_max")))


def run_available(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process every file present now (``availableNow``) into a Parquet table at ``path``
    and return that table as a batch frame. Complete mode replaces the table after each
    micro-batch; append mode adds the closed windows through the file sink."""
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return result.sparkSession.read.schema(result.schema).parquet(path)
