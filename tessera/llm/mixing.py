"""Mixing sources to target weights by the cube method.

Each source's target over its size is its documents' rate: the whole part is taken surely, the rest is an inclusion
probability. A flight moves three undecided documents at a time through the null space of the balancing equations
(words and documents) until one of them is 0 or 1, so the totals stay exact. Documents fly in blocks, largest first;
what a block leaves, LAND documents at most, flies again with other blocks' rests. A source's last flight ends where LAND
documents are undecided, the smallest and two others at most; of all their choices the one with the smallest error in
words is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.frames import id_or_last, load, partitions, saved
from tessera.llm.kernels import NO_ID

WEIGHTS, SHARE, MOST, BLOCK, LAND = (5.0, 2.0, 1.0), 1.5, 2.0, 4096, 14
_NEAR = 1e-9
_FIELDS = "doc_id long, digest binary, place int, source_size long, target double, size long, base int, pi double, draw double, row long"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(place, source, source_size, target) from one row per source (source, source_size).

    Sources by code point, null last, weigh weights in turn. Targets are level x weight, or most x size where that is
    less; level is such that they add up to share x all sizes. These windows see one row per source, no documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full", F.col("cap") / F.col("weight"))
    whole, upto = Window.partitionBy(), Window.orderBy("full", "place").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    level = F.min_by("level", F.when(F.col("level") <= F.col("full"), F.struct("full", "place"))).over(whole)
    return ranked.withColumn("best", level).select("place", "source", "source_size", F.when(F.col("best") < F.col("full"), F.col("best") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def settle_heavy(units: list[list], most: int = 16, share: float = 0.004) -> None:
    """Decides the heaviest units first, while all others can still make up for them in words.

    Each moves along a direction that shifts the others' probabilities alike; three at a time they could not, and the
    landing would be left with a document that nothing weighs up.
    """
    size, pi = np.array([u[0] for u in units], float), np.array([u[1] for u in units])
    for i in np.argsort(-size, kind="stable")[:most].tolist():
        open_now = (pi > 0) & (pi < 1)
        open_now[i] = False
        rest = size[open_now].sum()
        if size[i] < share * size.sum() or not rest:
            break
        for to in (1.0, 0.0) if units[i][2] < pi[i] else (0.0, 1.0):
            moved = pi[open_now] - (to - pi[i]) * size[i] / rest
            if moved.min() > 0 and moved.max() < 1:
                pi[open_now], pi[i] = moved, to
                break
    for u, x in zip(units, pi.tolist(), strict=True):
        u[1] = x


def fly(units: list[list], leave: int = 2) -> list[list]:
    """Moves units ([size, pi, draw, ...]) in place and returns the undecided ones, `leave` at most (2 or more)."""
    held: list[list] = []
    units = [u for u in units if _NEAR < u[1] < 1 - _NEAR]
    settle_heavy(units)
    units = [u for u in units if 0 < u[1] < 1]
    for n, u in enumerate(units):
        if len(held) + len(units) - n <= leave:
            return held + units[n:]
        held.append(u)
        if len(held) < 3:
            continue
        a, b, c = held
        way = (b[0] - c[0], c[0] - a[0], a[0] - b[0])
        if way == (0, 0, 0):
            way = (1, -1, 0)
        up = min((1 - x[1]) / v if v > 0 else -x[1] / v for x, v in zip(held, way, strict=True) if v)
        down = min(x[1] / v if v > 0 else (x[1] - 1) / v for x, v in zip(held, way, strict=True) if v)
        draw = (a[2] + b[2] * 0.618 + c[2] * 0.382) % 1
        step = up if draw * (up + down) < down else -down
        for x, v in zip(held, way, strict=True):
            x[1] += step * v
            if not _NEAR < x[1] < 1 - _NEAR:
                x[1] = float(round(x[1]))
        held = [x for x in held if 0 < x[1] < 1]
    return held


def land(held: list[list]) -> None:
    """Decides the last units of a source: words as near as can be, then documents, then the earlier units."""
    size, pi = np.array([u[0] for u in held], float), np.array([u[1] for u in held])
    choices = (np.arange(1 << len(held))[:, None] >> np.arange(len(held))) & 1
    error = np.abs(choices @ size - size @ pi), np.abs(choices.sum(axis=1) - pi.sum())
    best = int(np.lexsort((np.round(error[1], 6), np.round(error[0], 6)))[0])
    for u, x in zip(held, choices[best].tolist(), strict=True):
        u[1] = float(x)


def _flight(last: bool, leave: int, batches):  # noqa: ANN001, ANN202
    """Rows come sorted by (place, block), the largest first; all are returned with their new pi. last: the rest lands."""
    key, rows, units = None, [], []

    def out():  # noqa: ANN202
        held = fly(units, leave)
        if last:
            land(held)
        for r, u in zip(rows, units, strict=True):
            r["pi"] = u[1] if _NEAR < u[1] < 1 - _NEAR else float(round(u[1]))
        names = list(rows[0])[:10]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], schema.field(n).type) for n in names], names=names)

    for batch in batches:
        schema = batch.schema
        for r in batch.to_pylist():
            if (r["place"], r["block"]) != key:
                if rows:
                    yield out()
                key, rows, units = (r["place"], r["block"]), [], []
            rows.append(r)
            units.append([r["size"], r["pi"], r["draw"]])
    if rows:
        yield out()


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("digest")


def _row(docs: DataFrame) -> Column:
    """A hash of all columns but the text; rows that agree in it and in the text are interchangeable."""
    return F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.col("text").isNull().alias("no text")))).alias("row")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, digest (MD5 of the text), row (a hash of the other columns), source place, size, source_size, target, copies, taken.

    size counts runs of characters other than white space; null and empty texts have 0 and move no words. A source of
    size 0 has target 0. copies is the source's rate rounded down or up, so at most `most`, rounded up. Draws are hashes
    of id and text: reruns agree. Repeated rows are documents of their own. Columns other than doc_id, text and source
    are ignored; an empty table gives no rows. Blocks hold some `block` documents whatever a source's size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _digest(), _row(docs), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    docs = saved(docs)  # read three times, without the texts
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("members"))
    goals = targets(sizes, weights, share, most).join(sizes.select(F.col("source").alias("own"), "members"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    goals = goals.withColumnRenamed("source", "own")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    units = docs.join(goals, docs["source"].eqNullSafe(F.col("own"))).select(
        "doc_id", "digest", "place", "source_size", "target", "size", F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("pi"),
        (F.pmod(F.xxhash64("doc_id", "digest", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)).alias("draw"), "row", F.ceil(F.col("members") / block).alias("blocks"),
    )
    done, n = [], 0
    while True:
        most_blocks = units.agg(F.max("blocks")).first()[0] or 0
        dealt = units.withColumn("block", F.pmod(F.xxhash64("doc_id", "digest", F.lit(n)), "blocks")).drop("blocks")
        dealt = dealt.repartition(partitions(docs), "place", "block").sortWithinPartitions("place", "block", F.desc("size"), "doc_id", "digest", "row")
        flown = saved(dealt.mapInArrow(lambda b, last=most_blocks <= 1: _flight(last, LAND if last else max(2, min(LAND, block // 4)), b), _FIELDS))
        if most_blocks <= 1:
            done.append(flown)
            break
        open_now = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(flown.where(~open_now))
        left = flown.where(open_now)
        units = left.join(left.groupBy(F.col("place").alias("at")).agg(F.ceil(F.count("*") / block).alias("blocks")), F.col("place") == F.col("at")).drop("at")
        n += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.col("base") + F.round("pi").cast("int")
    return out.select("doc_id", "digest", "row", "place", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: rows repeat, or go. Rows that are wholly equal add up their copies."""
    key = ["id", "digest", "row"]
    copies = mix(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "digest", "row", "copies").groupBy(key).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("whole"), id_or_last().alias("id"), _digest(), _row(docs)).groupBy(key).agg(F.any_value("whole").alias("whole"))
    return rows.join(copies, key).select("whole", F.explode(F.sequence(F.lit(1), "copies"))).select("whole.*")
