"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stage


#: Edges in one part of a round's table; rounds make fewer and fewer.
EDGES = 500_000
#: So many edges are settled in one task, at once; more need rounds, each of which costs the driver some ten plans.
TOGETHER = 100_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a batch's edges by a star for each group that they connect; the centre is its smallest node."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))

        def find(x: int, parent=parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(places[: len(a)].tolist(), places[len(a) :].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        roots = nodes[[find(x) for x in range(len(nodes))]] if len(nodes) else nodes
        keep = roots != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(roots[keep], pa.int64())], names=["a", "b"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of all batches together."""
    held = [*batches]
    yield from _union_find(pa.Table.from_batches(held).combine_chunks().to_batches() if held else [])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of edges (a long, b long): the smallest node reachable.

    Tasks first contract their own edges by union-find, and one task the rest of them if there are TOGETHER at most; of
    more, large-star and small-star rounds go on until the edges stay as they are. Hubs are handled by minima with
    partial aggregation and joins that Spark can split, never by gathering neighbours. Null and self edges are left out.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now, before, parts = stage(edges.mapInArrow(_union_find, "a long, b long").distinct(), "edges"), None, None
    for _ in range(max_rounds):
        # two checksums of 64 bits: equal for different tables once in 2**128
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first()
        if not state[0] or state == before:
            break
        if state[0] <= TOGETHER:
            now = stage(now.coalesce(1).mapInArrow(_settled, "a long, b long"), "edges")
            break
        before, parts = state, max(8, -(-state[0] // EDGES))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()  # every edge now goes from a node to a smaller one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = stage(small.where("a <> b").distinct().coalesce(parts), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return found.unionByName(roots)
