"""Language identification: averaged hashed subword embeddings, linear softmax,
calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import subword
from lumen.llm import textops as tx
from lumen.llm.common import crc_of_id, read_table

#: Rows of each language used for fitting (the documented bound of the sample).
FIT_ROWS_PER_LANGUAGE = 500


def fit_language_model(labelled: DataFrame, rows_per_language: int = FIT_ROWS_PER_LANGUAGE) -> subword.SubwordModel:
    """``labelled``: label (language), text, key. Rows without label or text are ignored."""
    labelled = labelled.where(F.col("text").isNotNull())
    return subword.fit(labelled.select("label", "key"), labelled.select("key", "text"), fold_case=True,
                       rows_per_class=rows_per_language, rejection=True)


def identify(docs: DataFrame, model: subword.SubwordModel, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score (calibrated probability of it) and rejected.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so
    is every text if no two languages were learned (with one, it is that one).
    Other texts get their likeliest language and are rejected if their byte grams are
    too rare in the learned languages, all weighed alike, whatever that probability. Whole texts are scored; repeated
    rows get equal results; all other columns pass through, but for columns of
    the three new names, which are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = docs.columns
    has_letter = F.coalesce(F.regexp_like(F.col(text), F.lit(r"\p{L}")), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(model.labels + ["und"], dtype=object)
        for batch in batches:
            letter = np.asarray(batch.column("__letter").to_numpy(zero_copy_only=False), bool)
            if len(model.labels):
                p, _, known = model.probabilities(batch.column(text))
                best = np.where(letter, p.argmax(1), len(model.labels))
                score = np.where(letter, p.max(1), 0.0)
            else:
                best, score, known = np.zeros(len(letter), int), np.zeros(len(letter)), np.zeros(len(letter))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))]
                + [pa.array(labels[best], pa.string()), pa.array(score, pa.float64()),
                   pa.array(~letter | (known < model.reject_below) | (best == len(model.labels)))],
                names=names + ["lang_pred", "score", "rejected"])

    return docs.withColumn("__letter", has_letter).mapInArrow(
        tx.tidy(run), f"{fields}, lang_pred string, score double, rejected boolean")


def _training(docs: DataFrame) -> DataFrame:
    return (docs.where(crc_of_id(F.col("doc_id")) % 4 != 2)
            .select(F.col("lang").alias("label"), "text", F.col("doc_id").alias("key")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_language_model(_training(docs))
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model does not reject, same columns."""
    model = fit_language_model(_training(docs))
    return identify(docs, model).where(~F.col("rejected")).select(*docs.columns)
