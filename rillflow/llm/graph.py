"""Connected components of an edge table: contraction within slices, and alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_package
from .common import _arrow_schema, cut

#: Edges of a slice at most, one MB.
SLICE = 1 << 16
EDGES = "u long, v long"


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges in order, and the smallest node that each reaches over them."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (further := least[least] != least).any():
            least[further] = least[least[further]]
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[least]


def _contracted(pairs: DataFrame, tasks: int, roots: bool) -> DataFrame:
    """Edges (u, v) that join what the given ones join: from each slice a star for each component of its edges.

    ``roots``: with a row (v, v) for the smallest node of each star.
    """
    send_package(pairs.sparkSession)
    arrow = _arrow_schema(pairs.sparkSession, EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            u, v = stars(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))
            held.clear()
            told = slice(None) if roots else u != v
            return pa.RecordBatch.from_arrays([pa.array(u[told]), pa.array(v[told])], schema=arrow)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, SLICE - sum(x.num_rows for x in held))
                held.append(part)
                batch = batch.slice(part.num_rows)
                if sum(x.num_rows for x in held) == SLICE:
                    yield close()
        if held:
            yield close()

    return pairs.coalesce(tasks).mapInArrow(run, EDGES)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (smallest node reached) of every node with an edge to another.

    Each round first contracts the edges within slices of ``SLICE``, in as many tasks as there are slices; edges
    of no more than a slice are done with that, without a shuffle.  Others take a step that joins nodes with their smallest
    neighbour, found by a combined aggregate, so a hub's neighbours are never gathered; that aggregate is
    cut off, so that the join can split a hub's edges over tasks.  Stops when all edges point at roots.
    """
    pairs = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v"))
    for _ in range(rounds):
        slices = max(1, -(-pairs.count() // SLICE))
        if slices == 1:
            return cut(_contracted(pairs, 1, True).select(F.col("u").alias("node"), F.col("v").alias("component")))
        pairs = cut(_contracted(pairs, slices, False).distinct())
        # done when the edges are stars: no node has two parents, or is a parent and has one
        ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")), F.struct(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))).alias("e")).select("e.*")
        if ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 OR c = 1 AND p = 1").isEmpty():
            break
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = cut(small.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
