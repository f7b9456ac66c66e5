"""From specs to definitions: the steps that turn what a target declares into what it is built from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph, store
from loomgraph.operators.selection import resolve_specs
from loomgraph.operators.staging import stage


def parse_specs(specs: DataFrame, parse: Callable, schema: str) -> DataFrame:
    """Definitions of specs by a driver's own parse(): an iterator of pandas frames in, one out; rows stay where they are."""
    return specs.mapInPandas(parse, schema)


def resolve_definitions(targets: DataFrame, inputs: DataFrame, outputs: DataFrame, contributions: DataFrame | None = None, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(definitions, inputs) of targets, or of the wanted ones (addr): the first provider's spec; inputs (addr, pos, dep_addr,
    runtime) with those on the own outputs turned into files and globs; what runtime inputs hand on, after the own ones, with kind
    'dep', 'tool' or 'env'; and the history, doubled for outputs in place. Definitions carry `error` where no provider has the target.

    Inputs come as (addr, kind, place, dep_addr): place counts a target's own inputs, and is null for what is handed on."""
    specs = stage(resolve_specs(targets, wanted if wanted is not None else targets), "specs")
    mine = inputs.join(specs.select("addr"), "addr", "left_semi")
    own = graph.introspect(mine.select("addr", "pos", "dep_addr"), outputs)
    rows = own.select("addr", F.lit("input").alias("kind"), F.col("pos").alias("place"), "dep_addr")
    if contributions is not None:
        handed = graph.transitive(mine, contributions)
        rows = rows.unionByName(handed.select("addr", "kind", F.lit(None).cast("int").alias("place"), F.col("value").alias("dep_addr")))
    history = store.effective_history(specs.where("error is null").select("addr", "cache_history"), outputs)
    definitions = specs.join(history, "addr", "left").select("addr", "driver", "history", "error")
    return definitions, rows


__all__ = ["parse_specs", "resolve_definitions"]
