"""The event fold as a stream: stateful by target, and stateless counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.staging import folder

RECORDS = "addr string, counter string, delta long, duration_ms long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TargetFold(StatefulProcessor):
    """Folds a target's events in order of (at_ms, seq); emits changes of counters. State lives from the first event to the end of
    the result: the kind of hit, whether it ran, and when it started; of a target that failed, that it did stays.

    A failure that another one caused counts as blocked when it comes, also before that other one: which root it belongs to is
    only told by the batch operators, which see all events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("target", "cached string, ran boolean, started_ms long, rooted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))[["at_ms", "seq", "type", "error", "upstream_of"]].sort_values(["at_ms", "seq"])  # one target in one batch
        held = self._state.get() if self._state.exists() else None
        out, state = fold(key[0], events.itertuples(), held)
        if state is None:
            self._state.clear()
        else:
            self._state.update(state)
        yield pd.DataFrame(out, columns=["addr", "counter", "delta", "duration_ms"]).astype({"duration_ms": "Int64"})

    def close(self) -> None:
        pass


NEW = (None, False, None, False)
STARTS, HITS, MISSES = ("result_start", "execute_start", "local_hit", "remote_hit"), ("local_hit", "remote_hit"), ("local_miss", "remote_miss")


def fold(addr: str, events, state: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Changes (addr, counter, delta, duration) and the state after the events; unknown kinds of events are ignored."""
    out: list[tuple] = []
    cached, ran, started, rooted = state or NEW
    for e in events:
        if e.type in STARTS and started is None:
            started = int(e.at_ms)
        if e.type == "execute_start":
            if cached:  # a target that runs is not a cached one: take the hit back
                out.append((addr, f"cached_{cached}", -1, None))
            cached, ran = None, True
        elif e.type in HITS and not cached and not ran:
            cached = e.type.removesuffix("_hit")
            out.append((addr, f"cached_{cached}", 1, None))
        elif e.type in MISSES:
            out.append((addr, f"miss_{e.type.removesuffix('_miss')}", 1, None))
        elif e.type == "execute_end" and not isinstance(e.error, str):
            out.append((addr, "executed", 1, None))
        elif e.type == "result_end":
            if not isinstance(e.error, str):
                out += [(addr, "finished", 1, int(e.at_ms) - started)] if ran else []
            elif isinstance(e.upstream_of, str):
                out.append((addr, "blocked", 1, None))
            elif not rooted:
                out.append((addr, "roots", 1, None))
                rooted = True
            cached, ran, started = NEW[:3]
    state = (cached, ran, started, rooted)
    return out, None if state == NEW else state


def fold_stream(events: DataFrame, time_mode: str = "None") -> DataFrame:
    """The stateful fold of a stream of events; set spark.sql.streaming.stateStore.providerClass to STATE_STORE before."""
    return events.groupBy("addr").transformWithStateInPandas(statefulProcessor=TargetFold(), outputStructType=RECORDS, outputMode="Update", timeMode=time_mode)


def type_counts(events: DataFrame) -> DataFrame:
    """Stateless telemetry: events of each type, for update mode."""
    return events.groupBy("type").agg(F.count("*").alias("n"))


def matched_set(announced: DataFrame) -> DataFrame:
    """(addr, complete) of announced targets (addr, complete), each once, as a stream in update mode: complete becomes true with the
    announcement that says it is the last. State is a flag for each target."""
    return announced.groupBy("addr").agg(F.max("complete").alias("complete"))


def refresh(stream: DataFrame, render, folder_name: str, seconds: int = 10):
    """Runs a stream in update mode and calls render(changed rows, batch number) again and again, at most every so many seconds;
    the running query is returned."""
    state = folder(stream.sparkSession, folder_name)
    return stream.writeStream.outputMode("update").foreachBatch(render).option("checkpointLocation", state).trigger(processingTime=f"{seconds} seconds").start()


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows that run_available() returned, the last of each key."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, "r.*")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, in update mode, and returns the rows that it put out, with the number of their batch. A
    batch that is run again after a failure replaces what it wrote before."""
    spark = stream.sparkSession
    root = folder(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{root}/rows/batch=-1")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.parquet(f"{root}/rows")
