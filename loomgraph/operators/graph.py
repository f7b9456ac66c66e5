"""Dependency-graph operators over inputs (addr, pos, dep_addr, ...)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.selection import first_by
from loomgraph.operators.staging import stage

#: The input that stands for the outputs of its own target.
OWN_OUTPUTS = "//@introspect:outputs"
#: Levels of a closure after which its tables are written as one.
COMPACT = 16


def deps(inputs: DataFrame, addr: str | None = None, runtime_only: bool = False) -> DataFrame:
    """(addr, dep_addr, pos): distinct dependencies, at the place of their first declaration."""
    mine = inputs if addr is None else inputs.where(F.col("addr") == addr)
    mine = mine.where("runtime") if runtime_only else mine
    return mine.groupBy("addr", "dep_addr").agg(F.min("pos").alias("pos"))


def resolved_deps(inputs: DataFrame, targets: DataFrame, contributions: DataFrame | None = None) -> DataFrame:
    """(addr, dep_addr, pos) as resolved: groups stand for their members, and with contributions come the dependencies that runtime
    inputs hand on, after a target's own ones. Each once, at the place where it first comes."""
    order = expand_groups(inputs, targets).select("addr", "dep_addr", "order", F.lit(0).alias("handed"))
    if contributions is not None:
        given = transitive(inputs, contributions.where("kind = 'dep'"))
        order = order.unionByName(given.select("addr", F.col("key").alias("dep_addr"), F.array().cast("array<int>").alias("order"), F.lit(1).alias("handed")))
    first = order.groupBy("addr", "dep_addr").agg(F.min(F.struct("handed", "order")).alias("at"))
    place = Window.partitionBy("addr").orderBy("at", "dep_addr")
    return first.select("addr", "dep_addr", (F.row_number().over(place) - 1).alias("pos"))


def among(frame: DataFrame, column: str, wanted: DataFrame | Sequence[str]) -> DataFrame:
    """Rows whose column is one of a list, which reaches the scan, or of a table's column of that name."""
    if isinstance(wanted, DataFrame):
        return frame.join(wanted.select(column), column, "left_semi")
    return frame.where(F.col(column).isin(list(wanted)))


def revdeps(inputs: DataFrame, on: DataFrame | Sequence[str], scope: DataFrame | None = None) -> DataFrame:
    """(addr) of targets that have an input among `on` (addresses, or a table (dep_addr)); with scope, of its targets only, all
    their columns. Inputs are filtered before anything is shuffled."""
    found = among(inputs, "dep_addr", on).select("addr").distinct()
    return found if scope is None else scope.join(found, "addr", "left_semi")


def closure(inputs: DataFrame, start: DataFrame | Sequence[str], reverse: bool = False) -> DataFrame:
    """(addr, level) of all that `start` (addresses, or a table (addr)) depends on, itself included at level 0; with reverse, what
    depends on it.

    One join for each level, of the new nodes with the staged edges; levels are staged, so a lost executor costs one level."""
    a, b = ("dep_addr", "addr") if reverse else ("addr", "dep_addr")
    edges = stage(inputs.select(F.col(a).alias("from"), F.col(b).alias("to")), "edges")
    if not isinstance(start, DataFrame):
        start = inputs.sparkSession.createDataFrame([(x,) for x in start], "addr string")
    seen = front = stage(start.select("addr").distinct().withColumn("level", F.lit(0)), "closure")
    for level in itertools.count(1):
        new = edges.join(front.select(F.col("addr").alias("from")), "from", "left_semi").select(F.col("to").alias("addr")).distinct()
        front = stage(new.join(seen, "addr", "left_anti").withColumn("level", F.lit(level)), "closure")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        seen = seen if level % COMPACT else stage(seen, "closure")


def dep_path(inputs: DataFrame, source: str, goal: str) -> list[str] | None:
    """A shortest path along declared dependencies, or None. Ties go to the earlier node of the level before, then to
    the earlier declaration. A level holds its paths, so only the levels walked so far are ever read."""
    if source == goal:
        return [source]
    spark = inputs.sparkSession
    edges = stage(deps(inputs), "deps")
    front = spark.createDataFrame([(source, [0], [source])], "node string, rank array<int>, path array<string>")
    seen = front.select("node")
    for level in itertools.count(1):
        step = front.join(edges, F.col("node") == F.col("addr"))
        step = step.select(F.col("dep_addr").alias("node"), F.concat("rank", F.array(F.col("pos").cast("int"))).alias("rank"), F.concat("path", F.array("dep_addr")).alias("path"))
        front = stage(first_by(step.join(seen, "node", "left_anti"), ["node"], ["rank", "path"]), "path")
        found = front.where(F.col("node") == goal).select("path").first()
        if found:
            return found.path
        if front.isEmpty():
            return None
        seen = seen.unionByName(front.select("node"))
        seen = seen if level % COMPACT else stage(seen, "seen")


def dep_path_between(inputs: DataFrame, a: str, b: str, targets: DataFrame | None = None) -> list[str] | None:
    """A path from the one that depends to the other, whichever way round. With targets, ValueError names the first of both
    that isn't among them, before anything is searched."""
    if targets is not None:
        known = {r.addr for r in among(targets, "addr", [a, b]).select("addr").distinct().collect()}
        for x in (a, b):
            if x not in known:
                raise ValueError(f"unknown target {x}")
    return dep_path(inputs, a, b) or dep_path(inputs, b, a)


def topological_levels(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(addr, level): 0 without dependencies, else one more than the highest of them; null for nodes on or above a cycle.
    Kahn peeling from the leaves over one staged table of nodes with the number of dependencies that are still open: a
    join and an aggregation for each level."""
    nodes = nodes.select("addr").distinct()
    edges = inputs.select("addr", "dep_addr").distinct().join(nodes.select(F.col("addr").alias("dep_addr")), "dep_addr", "left_semi")
    edges = stage(edges, "edges")
    now = nodes.join(edges.groupBy("addr").agg(F.count("*").alias("n")), "addr", "left")
    now = stage(now.select("addr", F.coalesce("n", F.lit(0)).alias("open"), F.when(F.col("n").isNull(), F.lit(0)).alias("level")), "levels")
    for level in itertools.count(1):
        front = now.where(F.col("level") == level - 1).select(F.col("addr").alias("dep_addr"))
        if front.isEmpty():
            return now.select("addr", "level")
        less = edges.join(front, "dep_addr", "left_semi").groupBy("addr").agg(F.count("*").alias("less"))
        left = F.col("open") - F.coalesce("less", F.lit(0))
        now = stage(now.join(less, "addr", "left").select("addr", left.alias("open"), F.coalesce("level", F.when(left == 0, F.lit(level))).alias("level")), "levels")


def cyclic(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle: what peeling from below and then from above leaves."""
    up = topological_levels(nodes, inputs).where("level is null").select("addr")
    up = stage(up, "cyclic")
    left = inputs.join(up, "addr", "left_semi").join(up.select(F.col("addr").alias("dep_addr")), "dep_addr", "left_semi")
    turned = left.select(F.col("dep_addr").alias("addr"), F.col("addr").alias("dep_addr"))
    return topological_levels(up, turned).where("level is null").select("addr")


def expand_groups(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """Inputs with transparent targets replaced by their members, at any depth; `order` is the path of places that leads to
    each. A member that is reached twice is there twice. Mode, origin and flags are those of the input that names the
    group; annotations are merged, those of members first. ValueError for a group that holds itself."""
    groups = targets.where("transparent").select(F.col("addr").alias("group_addr")).distinct()
    named = lambda c, flag: groups.select(F.col("group_addr").alias(c), F.lit(True).alias(flag))
    marked = inputs.join(named("addr", "_of_group"), "addr", "left").join(named("dep_addr", "_to_group"), "dep_addr", "left")
    marked = stage(marked.select(*inputs.columns, F.col("_of_group").isNotNull().alias("of_group"), F.col("_to_group").isNotNull().alias("to_group")), "inputs")
    members = marked.where("of_group").select(F.col("addr").alias("group_addr"), F.col("dep_addr").alias("member"), F.col("pos").alias("member_pos"), F.col("annotations").alias("member_notes"), F.col("to_group").alias("member_to_group"))
    now = marked.where("not of_group").drop("of_group").withColumns({"order": F.array("pos"), "via": F.array().cast("array<string>")})
    out = None
    while True:
        plain = now.where("not to_group")
        out = plain if out is None else out.unionByName(plain)
        open_ = now.where("to_group")
        if open_.isEmpty():
            return out.drop("via", "to_group")
        if not open_.where(F.array_contains("via", F.col("dep_addr"))).isEmpty():
            raise ValueError("a group is a member of itself")
        inner = open_.drop("to_group").join(members, F.col("dep_addr") == F.col("group_addr"))
        notes = F.map_concat(F.map_filter("annotations", lambda k, _: ~F.map_contains_key("member_notes", k)), "member_notes")
        now = inner.withColumns({"via": F.concat("via", F.array("dep_addr")), "order": F.concat("order", F.array("member_pos")), "annotations": notes}).withColumn("dep_addr", F.col("member")).withColumnRenamed("member_to_group", "to_group").drop("group_addr", "member", "member_pos", "member_notes")
        now = stage(now, "expanded")


def introspect(inputs: DataFrame, outputs: DataFrame, magic: str = OWN_OUTPUTS) -> DataFrame:
    """(addr, pos, out_pos, dep_addr): inputs on `magic` become a file or glob input for each output that their target
    declares, each once; the others stay as they are."""
    own = inputs.where(F.col("dep_addr") == magic).select("addr", "pos")
    bare = F.regexp_replace("path", "/+$", "")
    source = F.when(F.col("kind") == "file", F.concat(F.lit("file:"), "path")).when(F.col("kind") == "dir", F.concat(F.lit("glob:"), bare, F.lit("/**/*"))).otherwise(F.concat(F.lit("glob:"), "path"))
    made = own.join(outputs.select("addr", F.col("pos").alias("out_pos"), source.alias("dep_addr")), "addr")
    made = made.groupBy("addr", "pos", "dep_addr").agg(F.min("out_pos").alias("out_pos"))
    rest = inputs.where(F.col("dep_addr") != magic).select("addr", "pos", F.lit(None).cast("int").alias("out_pos"), "dep_addr")
    return rest.unionByName(made)


def link(inputs: DataFrame, outputs: DataFrame, targets: DataFrame) -> DataFrame:
    """Runtime inputs with the output groups that they select: (addr, pos, dep_addr, group, paths, error), a row for each group.

    An input that names no group selects all of its target; without any it keeps one row with a null group. Errors: an unknown
    target, a named group that isn't there, and a tool whose group isn't exactly one file."""
    named = inputs.where("runtime").select("addr", "pos", "dep_addr", "mode", F.col("output").alias("wanted"))
    groups = outputs.groupBy(F.col("addr").alias("made_by"), "group").agg(F.sort_array(F.collect_list(F.struct("pos", "path"))).alias("found"), F.count_if(F.col("kind") == "file").alias("n_files"))
    picked = (F.col("dep_addr") == F.col("made_by")) & (F.col("wanted").isNull() | (F.col("wanted") == F.col("group")))
    linked = named.join(groups, picked, "left")
    lost = F.col("wanted").isNotNull() & F.col("made_by").isNull()
    error = F.when(lost, F.lit("missing group")).when((F.col("mode") == "tool") & (F.col("n_files") != 1), F.lit("tool needs exactly one file"))
    known = targets.select(F.col("addr").alias("dep_addr")).distinct().withColumn("_known", F.lit(True))
    linked = linked.join(known, "dep_addr", "left")
    error = F.when(F.col("_known").isNull(), F.lit("unknown target")).otherwise(error)
    return linked.select("addr", "pos", "dep_addr", "group", F.transform("found", lambda f: f["path"]).alias("paths"), error.alias("error"))


def transitive(inputs: DataFrame, contributions: DataFrame) -> DataFrame:
    """What runtime dependencies contribute to a target: (addr, kind, key, mode, value), each key once. Tools are told apart by
    key, deps by key and mode, and the first declared stays; of an environment variable the last stays."""
    got = inputs.where("runtime").select("addr", "dep_addr", "pos").join(contributions.withColumnRenamed("addr", "dep_addr"), "dep_addr")
    got = got.withColumn("_mode", F.when(F.col("kind") == "dep", F.col("mode")))
    first = first_by(got.where("kind <> 'env'"), ["addr", "kind", "key", "_mode"], ["pos", "dep_addr"])
    last = got.where("kind = 'env'").groupBy(F.col("addr").alias("_addr"), F.col("key").alias("_key")).agg(F.max_by(F.struct(*got.columns), F.struct("pos", "dep_addr")).alias("_row")).select("_row.*")
    return first.unionByName(last).drop("pos", "dep_addr", "_mode")


def failure_roots(inputs: DataFrame, failed: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """(addr, root boolean) of failed targets: a root has no failed dependency. With cancelled (addr), `class` too: own,
    collateral, or cancelled for a target that ended because the run was stopped, which is no root and makes none."""
    stopped = failed.sparkSession.createDataFrame([], "addr string") if cancelled is None else cancelled.select("addr").distinct()
    failed = failed.select("addr").distinct().join(stopped, "addr", "left_anti")
    below = inputs.join(failed.select(F.col("addr").alias("dep_addr")), "dep_addr", "left_semi").select("addr").distinct().withColumn("_below", F.lit(True))
    out = failed.join(below, "addr", "left").select("addr", F.col("_below").isNull().alias("root"))
    if cancelled is None:
        return out
    out = out.withColumn("class", F.when(F.col("root"), "own").otherwise("collateral"))
    return out.unionByName(stopped.select("addr", F.lit(False).alias("root"), F.lit("cancelled").alias("class")))


def blame(inputs: DataFrame, failed: DataFrame) -> DataFrame:
    """(addr, root) of failed targets: the root that the first declared failed dependency leads to, and a root itself for
    itself; null on or above a cycle of such dependencies. Pointers are doubled in each round, so a chain of n failures
    takes log2(n) joins; a row for each target is all that is ever held."""
    failed = stage(failed.select("addr").distinct(), "failed")
    bad = inputs.join(failed, "addr", "left_semi").join(failed.select(F.col("addr").alias("dep_addr")), "dep_addr", "left_semi")
    first = bad.groupBy("addr").agg(F.min(F.struct("pos", "dep_addr"))["dep_addr"].alias("to"))
    now = stage(failed.join(first, "addr", "left").select("addr", F.coalesce("to", "addr").alias("to"), F.col("to").isNull().alias("ended")), "blame")
    for _ in range(failed.count().bit_length() + 1):
        if now.where("not ended").isEmpty():
            break
        step = now.select(F.col("addr").alias("to"), F.col("to").alias("next"), F.col("ended").alias("there"))
        now = stage(now.join(step, "to").select("addr", F.col("next").alias("to"), F.col("there").alias("ended")), "blame")
    return now.select("addr", F.when(F.col("ended"), F.col("to")).alias("root"))


def distinct_members(members: DataFrame, key: str = "addr") -> DataFrame:
    """(key, members, single): distinct members in the order they first appear, and whether there is only one."""
    once = members.groupBy(key, "member").agg(F.min("pos").alias("pos"))
    listed = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "member"))).alias("m"))
    return listed.select(key, F.transform("m", lambda m: m["member"]).alias("members"), (F.size("m") == 1).alias("single"))


def layered_graph(spark, n: int = 1000, packages: int = 100, layers: int = 6, fan_out: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A synthetic acyclic graph: target i is in layer i mod layers and package i mod packages, with up to fan_out
    dependencies picked by hash from the layer below. (targets, inputs)"""
    ids = spark.range(n).withColumn("layer", F.col("id") % layers)
    name = lambda i: F.concat(F.lit("//pkg"), (i % packages).cast("string"), F.lit(":t"), i.cast("string"))
    targets = ids.select(name(F.col("id")).alias("addr"), F.concat(F.lit("pkg"), (F.col("id") % packages).cast("string")).alias("package"), "layer")
    below = F.ceil((F.lit(n) - (F.col("layer") - 1)) / layers)
    picks = ids.where("layer > 0").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(fan_out - 1))))
    picks = picks.withColumn("dep", F.pmod(F.xxhash64("id", "pos", F.lit(seed)), below) * layers + F.col("layer") - 1)
    inputs = picks.select(name(F.col("id")).alias("addr"), "pos", name(F.col("dep")).alias("dep_addr")).groupBy("addr", "dep_addr").agg(F.min("pos").alias("pos"))
    return targets, inputs


def touched(targets: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The targets of a share of the packages, picked by hash: an incremental change."""
    slot = F.conv(F.substring(F.md5(F.concat("package", F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")
    return targets.where(slot % 1_000_000 < int(fraction * 1_000_000))


__all__ = ["among", "blame", "closure", "cyclic", "dep_path", "dep_path_between", "deps", "distinct_members", "expand_groups", "failure_roots", "introspect", "layered_graph", "link", "resolved_deps", "revdeps", "topological_levels", "touched", "transitive"]
