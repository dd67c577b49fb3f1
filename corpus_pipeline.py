"""Corpus pipeline: the stages that turn raw documents into a sharded training mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read back as the next stage's ``docs``. A filtering stage
keeps the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumen.llm.common import materialize, read_table
from lumen.llm.op1_sharding import sharding_stage
from lumen.llm.op3_mixing import mixing_stage
from lumen.llm.op5_decontamination import decontamination_stage
from lumen.llm.op7_language import language_stage
from lumen.llm.op9_neardup import neardup_stage

STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Trained models and iterative stages: SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
