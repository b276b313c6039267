"""The corpus pipeline: language, toxicity, near copies, personal data, packing.

Each stage reads its predecessor's Parquet output, works on every row of it, and passes on the columns of `documents`;
the last returns the packing. Every stage is the thin `stage` function of its operator.

Rows with null or empty text, or without a letter, have no language and go in the first stage. Rows with a null id stay
(they are in no group of copies, so all of them are kept). Repeated rows count as copies: one of them stays. Further
columns pass through the first four stages, whatever their names. Empty tables give an empty packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veilstat.functions.session import checkpointed, removed, shared_folder
from veilstat.llm import lang_id, ngram_join, packing, pii, toxicity

STAGES = [
    ("language", lang_id.stage),
    ("toxicity", toxicity.stage),
    ("near_copies", ngram_join.stage),
    ("personal_data", pii.stage),
    ("packing", packing.stage),
]

# Trained models and byte offsets of packed bins have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each result is written to the shared folder and read again as the next one's input.

    A stage's input is deleted when its output is written; the packing is checkpointed, so nothing is left but that.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            removed(spark, f"{folder}/{STAGES[k - 1][0]}")
    packed = checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    removed(spark, folder)
    return packed
