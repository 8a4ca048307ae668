"""Connected components by contraction: each node joins one of its neighbours, and what is left is a smaller graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.shared import saved


#: Edges of one task where equal ones are dropped; more tasks for more edges, so none of them grows.
_EDGES = 1_000_000
#: So few edges are merged in one task, whatever the input: rounds over a small graph would cost the driver more than the work.
_ALONE = 250_000


def _ranked(a: str | Column, b: str | Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _merged(batches):  # noqa: ANN001, ANN202
    """(node, up: the smallest node of its component) of the edges of one task. Larger roots join smaller ones until no edge is left between two."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    ends = pa.concat_arrays([b.column(c) for c in (0, 1) for b in batches]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = root = np.arange(len(order))
    x, y = place[ends.indices.to_numpy()].reshape(2, -1)
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    nodes = ends.dictionary.take(order)
    for a in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([nodes.slice(a, 1 << 16), nodes.take(pa.array(root[a : a + (1 << 16)]))], names=["node", "up"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of the component.

    Each round a node joins the first of itself and its neighbours, by size in the first round and by a hash of the round after it,
    so chains shrink too. Nodes of one choice are one node of the next round, with the smallest of their names; edges between such nodes
    are kept once. So rounds grow with the logarithm of the nodes and get smaller, and the whole component never meets at its root
    before the roots go back down. Edges are streamed past the choices, not sorted. Each step is a groupBy or an equi-join; edges and choices are checkpointed once a round.
    Once at most _ALONE edges are left, one task merges them all, as one last round. Self-loops and repeated edges are allowed. No edges give no rows.
    """
    edges = saved(edges.where("a <> b").select(_ranked("a", "b")).distinct())
    levels: list[DataFrame] = []
    low = edges.select(F.col("a").alias("node"), F.col("a").alias("low"))
    kind, alone = edges.schema["a"].dataType.simpleString(), False
    while n := edges.count():
        rank = lambda c: F.xxhash64(F.lit(len(levels)), c) if levels else F.col(c)  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg((F.min_by("b", rank("b")) if levels else F.min("b")).alias("m"))
        choice = near.select(F.col("a").alias("node"), F.when(rank("a") <= rank("m"), F.col("a")).otherwise(F.col("m")).alias("up"))
        if alone := n <= _ALONE:
            choice = edges.coalesce(1).mapInArrow(_merged, f"node {kind}, up {kind}")
        # a node without edges is a whole component; it has no choice and takes no part in later rounds
        level = saved(low.join(choice, "node", "left") if levels else choice.select("node", F.col("node").alias("low"), "up"))
        levels.append(level)
        moved = level.where("up is not null")
        low = moved.groupBy(F.col("up").alias("node")).agg(F.min("low").alias("low"))
        to = lambda c, up: moved.select(F.col("node").alias(c), F.col("up").alias(up)).hint("shuffle_hash")  # noqa: B023, E731
        left = edges.join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y").select(_ranked("x", "y"))
        edges = saved(left.repartition(1 + n // _EDGES, "a", "b").distinct())
    if alone and len(levels) == 1:
        return levels[0].select("node", F.col("up").alias("root"))
    roots = low.select("node", F.col("low").alias("root"))
    for nth, level in enumerate(reversed(levels)):
        if nth:  # else the plan would hold all levels
            roots = saved(roots)
        down = level.where("up is not null").select(F.col("node").alias("from_"), F.col("up").alias("node")).join(roots, "node")
        roots = level.where("up is null").select("node", F.col("low").alias("root")).unionByName(down.select(F.col("from_").alias("node"), "root"))
    return roots
