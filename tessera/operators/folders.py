"""Folders: which spelling stays, which may be removed and in what order; records that merge into others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_folder(rows: DataFrame, key: str, folder: str, current: Column) -> DataFrame:
    """(key, folder) of each key: the folder with most current rows, then with most others, then the first by name. Null folders do not count."""
    counted = rows.where(F.col(folder).isNotNull()).groupBy(key, folder).agg(F.count_if(current).alias("c_"), F.count_if(~F.coalesce(current, F.lit(False))).alias("o_"))
    # the first of equal counts: the smallest of a struct whose counts are negative
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("c_")).alias("c_"), (-F.col("o_")).alias("o_"), folder)).alias("best_"))
    return best.select(key, F.col(f"best_.{folder}").alias(folder))


def removal_order(folders: DataFrame, path: str) -> DataFrame:
    """folders that may go, the deepest first, then by path: no part begins with "_" or ".", none is empty or climbs."""
    parts = F.split(path, "/")
    return folders.where(F.forall(parts, lambda p: (p != "") & ~p.rlike("^[_.]"))).orderBy(F.size(parts).desc(), path)


def merge_records(records: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """records (key, state, alternates) after merges (key, into): merged ones are superseded and lose their alternates,
    which with their key go to the record they merge into, distinct and sorted.

    A record merges into one other that itself merges into none; merges of or into unknown records do nothing. A record's
    alternates are one array, so it suits records that few others merge into.
    """
    merges = merges.join(records.select(F.col(key).alias("into")), "into", "left_semi")
    known = merges.join(records.select(key, "alternates"), key).select(F.col(key).alias("from_"), "into", F.explode(F.array_append(F.coalesce("alternates", F.array().cast("array<string>")), F.col(key).cast("string"))).alias("a_"))
    given = known.groupBy(F.col("into").alias("into_")).agg(F.array_sort(F.collect_set("a_")).alias("given_"))
    gone = merges.select(F.col(key).alias("gone_")).distinct()
    both = records.join(given, records[key] == given["into_"], "left").join(gone, records[key] == gone["gone_"], "left")
    none = F.array().cast("array<string>")
    union = F.array_sort(F.array_distinct(F.concat(F.coalesce("alternates", none), F.coalesce("given_", none))))
    return both.select(key, F.when(F.col("gone_").isNotNull(), "superseded").otherwise(F.col("state")).alias("state"), F.when(F.col("gone_").isNotNull(), none).otherwise(union).alias("alternates"))
