"""Packed text blocks and the mail between them and the tasks that group what they send.

A *block* is a row ``(block, n_bytes, payload)`` whose payload is a compressed Arrow file of some documents
(``doc_id``, ``text``). Iterative operators read the block table several times, so it is written once, in buckets
by its block number: mail travels to the bucket of its block, and texts are never shuffled. Block numbers come out
of that table and never change when a task is run again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.staging import release, stage, stage_bucketed

#: Uncompressed bytes of text in one block of a corpus of up to SCALE_BYTES; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Every block sends mail to every group, so beyond SCALE_BYTES both grow with the root of the corpus, up to MOST_SCALE
#: times, and the number of messages grows with the corpus only.
SCALE_BYTES, MOST_SCALE = 30 << 30, 16
#: Buckets of a block table at most (spark.sql.sources.bucketing.maxBuckets), and blocks in one bucket otherwise.
MOST_BUCKETS, BUCKET_BLOCKS = 100_000, 3
#: Keys that are broadcast at most: those with more than one in HOT of all rows.
HOT = 10_000
#: Tasks that group what blocks send at most; with more parts a task gets several, one after the other.
MOST_TASKS = 10_000
#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Bytes of text that are worked on at once; some ten arrays of eight bytes for each of them are in memory then.
SLICE_BYTES = 1 << 19


def bounded(frame: DataFrame) -> DataFrame:
    """The same frame, in a session whose Arrow batches hold BATCH_BYTES at most: by default they end after 10,000 rows, however
    long these are, and every task holds some copies of a batch in the JVM and in Python. A smaller setting stays."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", frame.sparkSession
    number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(key).lower()).groups()
    now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return frame


def scale(n_bytes: int) -> float:
    """How many times larger than for SCALE_BYTES blocks and groups are; 1 at least, and MOST_SCALE at most."""
    return min(max(1.0, math.sqrt(n_bytes / SCALE_BYTES)), MOST_SCALE)


def texts(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (int64, one more than rows) of an Arrow string or binary column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays([c.cast(pa.large_binary()) for c in arr.chunks]) if arr.num_chunks else pa.array([], pa.large_binary())
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pack_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_bytes(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def pack_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """docs as a staged table of blocks: block long, n_bytes long, payload binary (doc_id, text; null text is kept);
    and the number of bytes of all texts.

    One pass after counting bytes, no shuffle: each task cuts what it scans into blocks of about block_bytes.
    """
    from pyspark import TaskContext

    docs = bounded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size_of_block = block_bytes or int(BLOCK_BYTES * scale(total))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, seq
            table = pa.Table.from_batches(held)
            row = pa.RecordBatch.from_arrays([pa.array([(task << 32) | seq], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_bytes(table)], pa.binary())], names=["block", "n_bytes", "payload"])
            held, size, seq = [], 0, seq + 1
            return row

        for batch in batches:
            _, offsets = texts(batch.column(1))
            start = 0
            while start < batch.num_rows:
                end = int(np.searchsorted(offsets, offsets[start] + size_of_block - size, "right"))
                end = min(max(end - 1, start + 1), batch.num_rows)
                held.append(batch.slice(start, end - start))
                size += int(offsets[end] - offsets[start])
                start = end
                if size >= size_of_block or start < batch.num_rows:
                    yield flush()
        if held:
            yield flush()

    buckets = min(max(8, math.ceil(total / (BUCKET_BLOCKS * size_of_block))), MOST_BUCKETS)
    return stage_bucketed(docs.mapInArrow(pack, "block long, n_bytes long, payload binary"), "blocks", "block", buckets), total


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with table (how: inner or left), whose weight says how many rows each key has; the weight comes along.

    Of the keys with more than one in HOT of all rows there are HOT at most: they are broadcast, and their rows stay where
    they are. The shuffle of the others is even, so a key with a third of all rows is no hot spot, whatever the settings
    for skewed joins."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(weight) * HOT > total))
    cold = table.where(F.col(weight) * HOT <= total)
    marked = rows.join(hot, on, "left")  # both branches use the same broadcast
    rest = marked.where(F.col(weight).isNull()).select(*rows.columns).join(cold, on, how)
    return marked.where(F.col(weight).isNotNull()).unionByName(rest)


Mail = dict[tuple[int, int], list[bytes]]


def blocks_only(blocks: DataFrame, work: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work() makes of the number and the documents of each block."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block"), batch.column("payload"), strict=True):
                yield from work(block.as_py(), unpack_bytes(payload.as_py()))

    return blocks.select("block", "payload").mapInArrow(run, schema)


def with_mail(blocks: DataFrame, mail: list[DataFrame], work: Callable[[int, pa.Table, Mail], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work() makes of the number, the documents and the mail of each block. Mail has rows (block, kind int, part
    long, data binary) and comes as a dictionary by (kind, part); only the mail is shuffled."""
    sent = mail[0]
    for more in mail[1:]:
        sent = sent.unionByName(more)
    wanted = spark_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: Mail = {}
        for kind, part, data in zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("data"), strict=True):
            got.setdefault((kind, part), []).append(data.as_py())
        made = [b for k, payload in zip(left.column("block"), left.column("payload"), strict=True) for b in work(k.as_py(), unpack_bytes(payload.as_py()), got)]
        return pa.Table.from_batches(made) if made else wanted.empty_table()

    return blocks.select("block", "payload").groupBy("block").cogroup(sent.select("block", "kind", "part", "data").groupBy("block")).applyInArrow(run, schema)


def by_part(sent: DataFrame, parts: int, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What work() makes of all rows of each part (column part, numbers from 0 to about parts). Parts are dealt out evenly, one to
    a task as long as there are not too many, and not by a hash that piles up several in one."""
    tasks = min(parts, MOST_TASKS)
    dealt = sent.withColumn("slot", F.pmod(F.col("part"), F.lit(tasks)).cast("int")).repartitionById(tasks, "slot")
    return dealt.groupBy("slot", "part").applyInArrow(work, schema)


def spark_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def sharded(order: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """Cuts a sorted uint64 array into shards of equal key ranges: (shard, slice) of those that have keys."""
    bounds = np.searchsorted(order, (np.arange(1, shards, dtype=np.uint64) * np.uint64((1 << 64) // shards))) if shards > 1 else np.empty(0, np.int64)
    cuts = np.concatenate([[0], bounds, [len(order)]]).astype(np.int64)
    return [(k, slice(int(cuts[k]), int(cuts[k + 1]))) for k in range(shards) if cuts[k + 1] > cuts[k]]


__all__ = ["Mail", "blocks_only", "bounded", "by_part", "pack_blocks", "release", "scale", "sharded", "spread_join", "stage", "texts", "with_mail"]
