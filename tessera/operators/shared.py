"""Folders and checkpoints that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Where it is unset a local session, as in tests, takes a temporary one; on a cluster that would lose rows, so it fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint in the context's checkpoint folder, or in the shared one where the context has none."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again, so what reads few of its columns or rows reads no others."""
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.parquet(folder)
