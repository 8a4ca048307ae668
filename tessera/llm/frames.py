"""Small DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.kernels import NO_ID
from tessera.operators.shared import saved


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, size: Column, limit: int = 16 << 20) -> DataFrame:
    """A saved df, marked for broadcast if the sum of size over its rows, measured, is within the limit in bytes."""
    df = saved(df)
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_or_last(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def shown_id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def utf8(name: str = "text") -> Column:
    """The whole text as bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def narrow(docs: DataFrame) -> DataFrame:
    """id and text bytes alone: other columns, whatever their names, never meet the operators' own."""
    return docs.select(id_or_last().alias("id"), utf8().alias("text"))
