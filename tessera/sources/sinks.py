"""Reports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(files: DataFrame) -> DataFrame:
    """One row: files, errors and cached of a scan (error string, cached boolean)."""
    return files.agg(F.count("*").alias("files"), F.count("error").alias("errors"), F.count_if(F.coalesce("cached", F.lit(False))).alias("cached"))


def append_events(events: DataFrame, folder: str) -> None:
    """Adds rows to the event log, Parquet files that streaming.event_log reads."""
    events.write.mode("append").parquet(folder)


def manifest(books: DataFrame, states: list[str], folder: str) -> None:
    """The books in these states as JSON lines; the folder is replaced."""
    books.where(F.col("state").isin(*states)).write.mode("overwrite").json(folder)
