"""Canonical members, completeness and state views."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: each key's row that is greatest by order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def claims(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """Every row with the first one's order value of its key, and whether it conflicts with that. Null keys are keys, too.

    The minimum is aggregated and joined back: a window would bring all rows of a key to one task.
    """
    return with_group(log, key, owner=F.min(order)).withColumn("conflict", F.col(order) != F.col("owner"))


def with_group(rows: DataFrame, key: list[str], **totals: Column) -> DataFrame:
    """rows with their key's aggregates, by a partial aggregate and a join that splits hot keys where it must."""
    keyed = rows.groupBy(*[F.col(k).alias(f"{k}_g") for k in key]).agg(*[c.alias(n) for n, c in totals.items()])
    same = [rows[k].eqNullSafe(keyed[f"{k}_g"]) for k in key]
    return rows.join(keyed, reduce(and_, same)).drop(*[f"{k}_g" for k in key])


def completeness(members: DataFrame, key: str, number: str) -> DataFrame:
    """Per key: are the numbers a whole range from 0, how many are missing, how many repeat."""
    n = members.groupBy(key).agg(F.count(number).alias("members"), F.countDistinct(number).alias("distinct_"), F.max(number).alias("top_"))
    missing = F.col("top_") + 1 - F.col("distinct_")
    return n.select(key, "members", missing.alias("missing"), (F.col("members") - F.col("distinct_")).alias("repeated"), ((missing == 0) & (F.col("members") == F.col("distinct_"))).alias("complete"))


def trichotomy(expected: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Full outer join of two key sets: current, missing or untracked."""
    a = expected.select(F.col(key).alias("a_")).distinct()
    b = current.select(F.col(key).alias("b_")).distinct()
    state = F.when(F.col("b_").isNull(), "missing").when(F.col("a_").isNull(), "untracked").otherwise("current")
    return a.join(b, F.col("a_") == F.col("b_"), "full").select(F.coalesce("a_", "b_").alias(key), state.alias("state"))


def preferred_spelling(rows: DataFrame, key: str, spelling: str) -> DataFrame:
    """Each key's best spelling: mixed case, then words with an initial capital, then capitals, then the first by code point."""
    s = F.col(spelling)
    mixed = (s != F.upper(s)) & (s != F.lower(s))
    order = Window.partitionBy(key).orderBy(mixed.desc(), F.regexp_count(s, F.lit(r"\b[A-Z]")).desc(), F.regexp_count(s, F.lit("[A-Z]")).desc(), s)
    return rows.select(key, spelling).distinct().withColumn("rank_", F.row_number().over(order)).where("rank_ = 1").drop("rank_")


def alias_overlap(rows: DataFrame, key: str, on: list[str], aliases: str) -> DataFrame:
    """Per key: does any of its aliases (an array) belong to another key, too, with equal `on` columns.

    An alias's smallest and greatest key tell that, so no pairs are made.
    """
    each = rows.select(key, *on, F.explode(aliases).alias("alias_"))
    shared = each.groupBy(*on, "alias_").agg(F.min(key).alias("low_"), F.max(key).alias("high_")).where("low_ < high_")
    hit = each.join(shared, [*on, "alias_"], "left_semi").select(key).distinct().withColumn("hit_", F.lit(True))
    return rows.select(key).distinct().join(hit, key, "left").select(key, F.coalesce("hit_", F.lit(False)).alias("shared"))


def cache_state(files: DataFrame, cache: DataFrame, key: list[str], stamp: list[str]) -> DataFrame:
    """files with state: hit (key and stamps equal, nulls too), stale (key alone) or miss. The cache has one row a key."""
    known = cache.select(*key, F.struct(*stamp).alias("cached_"))
    same = F.struct(*stamp).eqNullSafe(F.col("cached_"))
    return files.join(known, key, "left").withColumn("state", F.when(F.col("cached_").isNull(), "miss").when(same, "hit").otherwise("stale")).drop("cached_")


def greedy_clusters(rows: DataFrame, key: str, value: str, tie: str, absolute: float, relative: float) -> DataFrame:
    """(key, tie, cluster): in order of value, a row joins its predecessor's cluster while it is within tolerance of the
    cluster's first value. A key's rows are one array: for keys with few rows, as the parts of one entity."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(tie).alias("t"))))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("cluster"), F.array().cast("array<struct<t:bigint,cluster:int>>").alias("out"))

    def step(acc, x):  # noqa: ANN001, ANN202
        near = x["v"] - acc["first"] <= F.greatest(F.lit(absolute), relative * x["v"])
        cluster = F.when(near, acc["cluster"]).otherwise(acc["cluster"] + 1)
        return F.struct(F.when(near, acc["first"]).otherwise(x["v"]).alias("first"), cluster.alias("cluster"), F.array_append(acc["out"], F.struct(x["t"].cast("bigint").alias("t"), cluster.alias("cluster"))).alias("out"))

    out = rows.groupBy(key).agg(F.aggregate(ordered, start, step, lambda acc: acc["out"]).alias("out"))
    return out.select(key, F.explode("out").alias("o")).select(key, F.col("o.t").alias(tie), F.col("o.cluster").alias("cluster"))
