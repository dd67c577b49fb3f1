"""Quality classifier: learned hashed word and character n-gram vectors averaged
per document, softmax output, stochastic gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import subword
from lumen.llm.common import crc_of_id, read_table

#: Rows of each label used for fitting (the documented bound of the sample).
FIT_ROWS_PER_LABEL = 1000


def fit_quality_model(labelled: DataFrame, texts: DataFrame, rows_per_label: int = FIT_ROWS_PER_LABEL
                      ) -> subword.SubwordModel:
    """``labelled``: label (0 or 1), key; ``texts``: key, text. Null texts count as empty."""
    return subword.fit(labelled.where(F.col("label").isin(0, 1)), texts, fold_case=False,
                       rows_per_class=rows_per_label)


def score_quality(docs: DataFrame, model: subword.SubwordModel) -> DataFrame:
    """doc_id, held_out and text of ``docs`` -> doc_id, held_out, score, predicted.

    score is the calibrated probability of label 1; null and empty texts get the
    labels' prior. If only one label was learned the score is that label, and 0.5
    if none was. Repeated rows get equal scores.
    """
    one = model.labels.index("1") if "1" in model.labels else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(model.labels) == 2:
                p = model.probabilities(batch.column("text"))[0][:, one]
            else:
                p = np.full(batch.num_rows, 0.5 if not model.labels else float(one is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()),
                 pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = crc_of_id(F.col("doc_id")) % 3 == 1
    labels = (read_table(spark, sf_dir, "labels")
              .where(F.col("quality").isNotNull() & (crc_of_id(F.col("doc_id")) % 3 != 1))
              .groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").alias("label")))
    texts = docs.where(~held).select(F.col("doc_id").alias("key"), "text")
    model = fit_quality_model(labels, texts)
    return score_quality(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model)
