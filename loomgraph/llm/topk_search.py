"""Exact top-k search over sparse integer vectors by term-at-a-time accumulation.

A bounded number of queries at a time is broadcast; tasks read the candidates where they are, turn blocks of them into
postings by term (dimension), and for each term of a query scatter query weight times posting into a dense array
of scores, one for each candidate of the block. A partition selection leaves the k best of them; a task
merges those of its blocks, and the k best of all tasks are merged by query. Vectors are shuffled once, to drop
repeated rows, and never copied; every query meets every candidate.

Defined results: vectors that are null or hold null or non-finite components take no part, and neither do rows with
a null id; an empty vector takes part with score 0 everywhere; a shorter vector lacks its last terms (they count 0);
rows that repeat an id and its vector
count once, and an id with two vectors is two rows; a query never finds its own id; ties go to the smaller id;
an empty table gives an empty result; columns other than the two named ones are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stage

#: Queries that are broadcast at once (about), and rows of one block of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 16_384, 4096


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id long, weights array<long>): floor(scale * x) of each component x, of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("weights"))


def _postings(weights: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the rows with a weight other than 0, and the weights."""
    sizes = weights.value_lengths().fill_null(0).to_numpy()
    flat = weights.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = flat != 0
    row, term, flat = row[keep], term[keep], flat[keep]
    order = np.argsort(term, kind="stable")
    row, flat = row[order], flat[order]
    cuts = np.searchsorted(term[order], np.arange((int(term.max()) if len(term) else -1) + 2))
    return [(row[a:b], flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows with the highest scores, ties to the smaller id."""
    if len(ids) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        reach = np.flatnonzero(scores >= bound)
        reach = reach[np.lexsort((ids[reach], -scores[reach]))[:k]]
        ids, scores = ids[reach], scores[reach]
    return ids, scores


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_ROWS):
            held.append(batch.slice(at, CANDIDATE_ROWS))
            rows += held[-1].num_rows
            if rows >= CANDIDATE_ROWS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        for block in _blocks(batches):
            ids, terms = block.column("id").to_numpy(), _postings(block.column("weights").combine_chunks())
            for n, (query, own) in enumerate(zip(queries, weights, strict=True)):
                scores = np.zeros(len(ids), np.int64)
                for (rows, values), weight in zip(terms, own, strict=False):
                    if weight and len(rows) == len(scores):
                        scores += weight * values
                    elif weight:
                        scores[rows] += weight * values  # a row comes once in a term
                other = ids != query
                here = _best(ids[other], scores[other], k)
                found[n] = _best(*(np.concatenate(x) for x in zip(found[n], here, strict=True)), k)
        for n, (ids, scores) in enumerate(found):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), queries[n])), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score long: the k best candidates of each query by integer inner product."""
    rows = stage(quantised(vectors, scale, id_col, vector_col).distinct(), "vectors")
    turns = max(1, -(-rows.where(is_query).count() // QUERY_ROWS))
    best = None
    for turn in range(turns):
        chosen = rows.where(is_query).where(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn).toArrow()  # about QUERY_ROWS
        shared = rows.sparkSession.sparkContext.broadcast((chosen.column("id").to_pylist(), chosen.column("weights").to_pylist()))
        found = rows.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        found = found if turns == 1 else stage(found, "best")
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
