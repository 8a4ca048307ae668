"""The append-only event log as a stream: counts by type, and the last writer of each key, kept over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n): state is dropped once the watermark has passed a window."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def _newest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (*key, order)]
    best = rows.groupBy(*key).agg(F.max(F.struct(order, *others)).alias("best_"))
    return best.select(*key, "best_.*").select(*rows.columns)


def upsert(events: DataFrame, key: list[str], order: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's newest row of a key; latest() reads the view. A repeated batch replaces its own files, so a
    restart neither loses nor doubles rows. The order column must tell a key's rows apart."""

    def write(batch: DataFrame, number: int) -> None:
        _newest(batch, key, order).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, key: list[str], order: str, folder: str) -> DataFrame:
    return _newest(spark.read.parquet(folder).drop("batch"), key, order)
