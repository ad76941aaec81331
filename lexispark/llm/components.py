"""Connected components of an edge table: forests within tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that a task thins to a forest; a table of no more is solved by that alone.
EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of ``n`` nodes, given the ends of the edges."""
    label = np.arange(n)
    while True:
        one, two = label[a], label[b]
        low, high = np.minimum(one, two), np.maximum(one, two)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _forest(batches):
    """(u, v): each node of a task's edges and the smallest that they join it with."""
    rows = list(batches)
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    nodes = pa.concat_arrays([table[c].combine_chunks() for c in ("u", "v")]).dictionary_encode()
    order = pc.sort_indices(nodes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[nodes.indices.to_numpy()]
    root = roots(ends[: table.num_rows], ends[table.num_rows :], len(order))
    on = np.flatnonzero(root != np.arange(len(order)))
    names = nodes.dictionary.take(pa.array(order))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(on)), names.take(pa.array(root[on]))], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours point to the smallest node around it.

    Sums by node have partial results on the map side, and the join's large side may be split, so a node with very many
    neighbours isn't bound to one task.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): the label is the smallest node of its component.

    Nodes are long, string or binary. Tasks get ``EDGES`` edges each, whatever their number.
    """
    kind = edges.schema["u"].dataType.simpleString()
    now = common.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tasks = -(-now.count() // EDGES)
    now = now.repartition(max(1, tasks)).mapInArrow(_forest, f"u {kind}, v {kind}")
    if tasks > 1:
        mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = common.materialize(now.distinct())
        was = mark(now)
        while True:
            now = common.materialize(_star(_star(now, True), False))
            if (new := mark(now)) == was:
                break
            was = new
    now = common.stored(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
