"""The corpus pipeline: language ID, line dedup, n-gram join, decontamination, mixing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. run() writes to the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language, line_dedup, mixing, ngram_join
from tessera.operators.shared import shared_folder

STAGES = [
    ("language_id", language.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("decontaminate", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: The recurrent network and the cube method cannot be put in SQL. A test chains the stages and holds each one's rows
#: against brute force on its own input; for language ID and mixing that is what they may reject, and the words taken.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
