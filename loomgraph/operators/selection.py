"""Scans of packages and targets, ordered deduplication, labels and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators.staging import stage


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key: the first by order, which should be total. Partial aggregation on a sort key, no window."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(first.alias("_row")).select("_row.*")


def package_scan(packages: DataFrame, under: str = "") -> DataFrame:
    """(package, provider_ord): packages under a prefix, each once, at the first provider that lists it."""
    return packages.where(paths.has_prefix("package", under)).groupBy("package").agg(F.min("provider_ord").alias("provider_ord"))


def packages_of_files(files: DataFrame, build_names: tuple[str, ...] = ("BUILD",)) -> DataFrame:
    """Packages of a file tree: each directory with a build file, and all its ancestors."""
    dirs = files.where(paths.basename("path").isin(*build_names)).select(F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), "/$", "").alias("dir")).distinct()
    return dirs.select(F.explode(paths.ancestors("dir")).alias("package")).distinct()


def available(targets: DataFrame) -> DataFrame:
    """Without rows whose `status` (if there is one) says that the provider has no such target, or that asking it ran in a circle."""
    return targets.where(F.coalesce(~F.col("status").isin("not_found", "cyclic"), F.lit(True))) if "status" in targets.columns else targets


def resolve_specs(targets: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row for each address: the first provider that has it wins, those that haven't or run in a circle are passed over. With
    wanted (addr), a row for each of these, with `error` where no provider has it."""
    found = first_by(available(targets), ["addr"], ["provider_ord"])
    if wanted is None:
        return found
    missing = F.when(F.col("provider_ord").isNull(), F.concat(F.lit("no provider has "), "addr"))
    return wanted.select("addr").distinct().join(found, "addr", "left").withColumn("error", missing)


def positions(frame: DataFrame, order: list[str | Column]) -> DataFrame:
    """frame with `position`, from 0, in an order that should be total. Rows are sorted by ranges, and a table with a row for each
    range says how many rows come before: no task sees more than a range."""
    sorted_ = stage(frame.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_id")), "sorted")
    part = F.shiftright("_id", 33)
    sizes = sorted_.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = sorted_.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return found.select(*frame.columns, (F.col("_id") - F.shiftleft("_part", 33) + F.col("_before")).alias("position"))


def package_order(packages: DataFrame) -> DataFrame:
    """(provider_ord, package, position): the packages of each provider once, in the order of their bytes, provider by provider."""
    return positions(packages.select("provider_ord", "package").distinct(), ["provider_ord", F.col("package").cast("binary")])


def labels(targets: DataFrame, ordered: bool = False) -> DataFrame:
    """Distinct labels; ordered: in the order of their bytes."""
    found = targets.select(F.explode("labels").alias("label")).where("label is not null").distinct()
    return found.orderBy(F.col("label").cast("binary")) if ordered else found


def graph_size(targets: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """How many targets there are; with whole, the catalog, never less than that has (the guard of calls on a part of it)."""
    mine = targets.agg(F.countDistinct("addr").alias("n_targets"))
    return mine if whole is None else mine.unionByName(graph_size(whole)).agg(F.max("n_targets").alias("n_targets"))


def group_artifacts(inputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(addr, pos, dep_addr, ...artifact columns, position): what a group is made of: the artifacts of its members, in the order
    of its inputs and, for each, in their own order; a member that is named twice counts once."""
    once = inputs.groupBy("addr", "dep_addr").agg(F.min("pos").alias("pos"))
    rest = [c for c in artifacts.columns if c != "addr"]
    found = once.join(artifacts.withColumnRenamed("addr", "dep_addr"), "dep_addr").select("addr", "pos", "dep_addr", *rest)
    place = Window.partitionBy("addr").orderBy("pos", "dep_addr", *rest)
    return found.withColumn("position", F.row_number().over(place) - 1)


def tree_outputs(outputs: DataFrame) -> DataFrame:
    """(addr, tree_outputs array<struct<dir, file>>): where a target's generated outputs go in the tree."""
    here = outputs.where("codegen <> 'none'")
    parent = F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), "/$", "")
    where = F.when(F.col("kind") == "file", parent).when(F.col("kind") == "glob", paths.glob_base("path")).otherwise(F.regexp_replace("path", "/$", ""))
    return here.select("addr", F.struct(where.alias("dir"), (F.col("kind") == "file").alias("file")).alias("o")).groupBy("addr").agg(F.collect_set("o").alias("tree_outputs"))


def select_outputs(outputs: DataFrame, names: list[str] | None) -> DataFrame:
    """Outputs of the named groups (None: all). Unknown names are rows with a null path, for the caller to reject."""
    if names is None:
        return outputs
    mine = outputs.where(F.col("group").isin(names)).select(F.col("group").alias("wanted"), "*")
    wanted = outputs.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "wanted string")
    lost = wanted.join(mine.select("wanted").distinct(), "wanted", "left_anti")  # as many rows as names at most
    return mine.unionByName(lost.select("wanted", *(F.lit(None).cast(t).alias(c) for c, t in outputs.dtypes)))


def complete(targets: DataFrame, typed: str, base: str = "") -> DataFrame:
    """Distinct completions of what was typed, in the same form: //pkg: and //pkg:name, :name, ./sub: and ../sib: with or without a
    name, and a bare name. Relative forms are as seen from base; packages go by their text, so that //go also finds group."""
    head, colon, name = typed.rpartition(":")
    if typed.startswith("//") and not colon:
        return _texts(targets.where(F.startswith("package", F.lit(typed[2:]))), F.concat(F.lit("//"), "package", F.lit(":")))
    if typed.startswith(("./", "../")) and not colon:
        near = relative(base)
        return _texts(targets.where(F.startswith(near, F.lit(typed))), F.concat(near, F.lit(":")))
    if "/" in typed and not colon:
        return _texts(targets.where(F.lit(False)), F.col("package"))
    try:
        package = head[2:] if head.startswith("//") else paths.join_rel_checked(base, head, keep_slash=False)
    except ValueError:
        return _texts(targets.where(F.lit(False)), F.col("package"))
    named = targets.where((F.col("package") == package) & F.startswith("name", F.lit(name)))
    return _texts(named, F.concat(F.lit(head + colon), "name"))


def _texts(found: DataFrame, text: Column) -> DataFrame:
    return found.select(text.alias("completion")).distinct()


def relative(base: str) -> Column:
    """./sub or ../sib for the column package as seen from base; null for base itself."""
    pieces = [p for p in base.split("/") if p]
    out = None
    for up in range(len(pieces) + 1):
        top = "/".join(pieces[: len(pieces) - up])
        rest = F.expr(f"substring(package, {len(top) + 2 if top else 1})")
        text = F.concat(F.lit("../" * up), rest) if up else F.when(F.col("package") != base, F.concat(F.lit("./"), rest))
        out = F.when(paths.has_prefix("package", top), text) if out is None else out.when(paths.has_prefix("package", top), text)
    return out
