"""Maintenance of a revision store: revisions (addr, hashin, created_at_ns), artifacts (addr, hashin, name, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import paths


def keep_newest(revisions: DataFrame, history: DataFrame | int = 1, protected: DataFrame | None = None) -> DataFrame:
    """revisions with `keep`: the newest N of an address (N a number, or a table (addr, history)), and protected ones
    (addr, hashin) beyond that. A null time counts as the oldest; ties go to the smaller hash."""
    newest = Window.partitionBy("addr").orderBy(F.desc(F.coalesce("created_at_ns", F.lit(0))), "hashin")
    ranked = revisions.withColumn("place", F.row_number().over(newest))
    if isinstance(history, int):
        ranked = ranked.withColumn("history", F.lit(history))
    else:
        ranked = ranked.join(history.select("addr", "history"), "addr", "left").withColumn("history", F.coalesce("history", F.lit(1)))
    keep = F.col("place") <= F.col("history")
    if protected is not None:
        ranked = ranked.join(protected.select("addr", "hashin").distinct().withColumn("_protected", F.lit(True)), ["addr", "hashin"], "left")
        keep = keep | F.coalesce("_protected", F.lit(False))
    return ranked.withColumn("keep", keep).drop("place", "_protected")


def orphans(revisions: DataFrame, targets: DataFrame) -> DataFrame:
    """Addresses with revisions but no target."""
    return revisions.select("addr").distinct().join(targets.select("addr"), "addr", "left_anti")


def effective_history(targets: DataFrame, outputs: DataFrame) -> DataFrame:
    """(addr, history): twice the configured history for targets with outputs generated in place."""
    in_place = outputs.where("codegen = 'in_place'").select("addr").distinct().withColumn("_twice", F.lit(True))
    return targets.join(in_place, "addr", "left").select("addr", (F.col("cache_history") * F.when(F.col("_twice"), 2).otherwise(1)).cast("int").alias("history"))


def collect_garbage(revisions: DataFrame, artifacts: DataFrame, specs: DataFrame) -> DataFrame:
    """One row for each revision to delete (addr, hashin, reason, bytes). specs (addr, status, history): no row means the
    target is gone (all its revisions go), status 'error' means that nothing of it may be deleted."""
    known = specs.select("addr", "status", "history")
    decided = revisions.join(known, "addr", "left").withColumn("decision", F.when(F.col("status").isNull(), "orphan").when(F.col("status") == "error", "skip").otherwise("trim"))
    newest = Window.partitionBy("addr").orderBy(F.desc(F.coalesce("created_at_ns", F.lit(0))), "hashin")
    doomed = decided.withColumn("place", F.row_number().over(newest)).where("decision = 'orphan' or (decision = 'trim' and place > coalesce(history, 1))")
    sizes = artifacts.groupBy("addr", "hashin").agg(F.sum("size").alias("bytes"))
    return doomed.join(sizes, ["addr", "hashin"], "left").select("addr", "hashin", F.col("decision").alias("reason"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def garbage_totals(revisions: DataFrame, doomed: DataFrame, specs: DataFrame) -> DataFrame:
    """One row: revisions removed, those kept on live targets, bytes, orphaned targets, and targets left alone for an error."""
    gone = doomed.agg(F.count("*").alias("removed"), F.count_if(F.col("reason") == "trim").alias("trimmed"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.countDistinct(F.when(F.col("reason") == "orphan", F.col("addr"))).alias("orphans"))
    known = revisions.join(specs.select("addr", "status"), "addr")
    left = known.agg(F.count_if(F.col("status") != "error").alias("live"), F.countDistinct(F.when(F.col("status") == "error", F.col("addr"))).alias("errored"))
    return left.join(gone).select("removed", (F.col("live") - F.col("trimmed")).alias("kept"), "bytes", "orphans", "errored")


def prune_older(rows: DataFrame, column: str, cutoff) -> DataFrame:
    """Rows whose column is not before the cutoff."""
    return rows.where(F.col(column) >= F.lit(cutoff))


def last_write_wins(writes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last write of each key."""
    return writes.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(F.struct(*writes.columns), seq).alias("_row")).select("_row.*")


def clean(revisions: DataFrame, selected: DataFrame) -> DataFrame:
    """Revisions without those of the selected addresses. For matchers on addresses alone, select from the revisions
    themselves, which reaches orphans too; for labels and outputs, select from the targets."""
    return revisions.join(selected.select("addr").distinct(), "addr", "left_anti")


def keep_newest_rows(spool: DataFrame, most: int = 200) -> DataFrame:
    """A queue cut to its newest rows."""
    return spool.orderBy(F.desc("id")).limit(most)


def next_batch(spool: DataFrame, most: int = 50) -> DataFrame:
    """The oldest rows of a queue."""
    return spool.orderBy("id").limit(most)


def touch(files: DataFrame, seen: DataFrame, now_ns: int) -> DataFrame:
    """files with accessed_ns set to now for the seen paths."""
    hit = seen.select("path").distinct().withColumn("_seen", F.lit(True))
    return files.join(hit, "path", "left").withColumn("accessed_ns", F.when(F.col("_seen"), F.lit(now_ns)).otherwise(F.col("accessed_ns"))).drop("_seen")


def cached_hashes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, size, mtime_ns, fresh hash column `hashout` or null) with the cached hash where size and time agree."""
    known = cache.select("path", "size", "mtime_ns", F.col("hashout").alias("_cached"))
    return files.join(known, ["path", "size", "mtime_ns"], "left").withColumn("valid", F.col("_cached").isNotNull()).withColumn("hashout", F.coalesce("_cached", "hashout")).drop("_cached")


def read_order(probes: DataFrame) -> DataFrame:
    """Caches by their median latency; unreachable ones last."""
    return probes.groupBy("cache").agg(F.expr("percentile(latency_ms, 0.5)").alias("median_ms")).withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("median_ms"), "cache")))


def cached_listings(dirs: DataFrame, cache: DataFrame) -> DataFrame:
    """dirs (path, mtime_ns) with the cached `listing` where the times agree; where `valid` is false, it has to be read anew."""
    known = cache.select("path", "mtime_ns", "listing")
    return dirs.join(known, ["path", "mtime_ns"], "left").withColumn("valid", F.col("listing").isNotNull())


def prune_gone(cache: DataFrame, live: DataFrame) -> DataFrame:
    """Cache rows whose path still exists."""
    return cache.join(live.select("path"), "path", "left_semi")


def needed_artifacts(artifacts: DataFrame, names: list[str]) -> DataFrame:
    """Artifacts (addr, hashin, type, group, ...) that a reader of the named output groups needs: their outputs, and the support
    files; if no group is named, support files only of revisions without any output. Never logs."""
    output = (F.col("type") == "output") & (F.col("group").isin(*names) if names else F.lit(False))
    if names:
        return artifacts.where(output | (F.col("type") == "support"))
    with_output = artifacts.where("type = 'output'").select("addr", "hashin").distinct()
    return artifacts.where("type = 'support'").join(with_output, ["addr", "hashin"], "left_anti")


def missing_blobs(needed: DataFrame, present: DataFrame) -> DataFrame:
    """Needed artifacts whose blob isn't in a store (addr, hashin, name) yet."""
    return needed.join(present.select("addr", "hashin", "name"), ["addr", "hashin", "name"], "left_anti")


def clean_totals(revisions: DataFrame, artifacts: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of what clean() takes away: (removed revisions, addrs, artifacts, bytes)."""
    gone = selected.select("addr").distinct()
    mine = revisions.join(gone, "addr", "left_semi")
    sizes = artifacts.join(mine.select("addr", "hashin").distinct(), ["addr", "hashin"], "left_semi").agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return mine.agg(F.count("*").alias("removed"), F.count_distinct("addr").alias("addrs")).join(F.broadcast(sizes))  # a row each


def collect_all(revisions: DataFrame, artifacts: DataFrame, specs: DataFrame, files: DataFrame, cutoff_ns: int, staged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole collection: the revisions to delete, the cached files that stay after those not read since the cutoff are gone, and
    the staged files (path) to clear, which are all of them."""
    return collect_garbage(revisions, artifacts, specs), prune_older(files, "accessed_ns", cutoff_ns), staged.select("path")


def lookup(artifacts: DataFrame, addr: str, hashin: str, name: str) -> DataFrame:
    """One row (found) if there is such an artifact, else none; the key reaches the scan and reading ends at the first row."""
    return artifacts.where((F.col("addr") == addr) & (F.col("hashin") == hashin) & (F.col("name") == name)).select(F.lit(1).alias("found")).limit(1)


def sizes_of(artifacts: DataFrame) -> DataFrame:
    """(addr, hashin, name, size): how many bytes each artifact has."""
    return artifacts.select("addr", "hashin", "name", F.octet_length("data").cast("long").alias("size"))


def ranges(artifacts: DataFrame, offset: int, length: int) -> DataFrame:
    """(addr, hashin, name, part): the bytes from an offset on, fewer where the artifact ends before; for seeking readers."""
    return artifacts.select("addr", "hashin", "name", F.substring("data", offset + 1, length).alias("part"))


def hashes_of(artifacts: DataFrame, addr: str) -> DataFrame:
    """The distinct hashes of an address."""
    return artifacts.where(F.col("addr") == addr).select("hashin").distinct()


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """A store table by package, so that a lookup or a clean of one package reads its folder only."""
    package = paths.package_of("addr")
    artifacts.withColumn("package", package).repartition("package", "addr").write.partitionBy("package").mode("append").parquet(path)


def delete_batch(spool: DataFrame, sent: DataFrame) -> DataFrame:
    """A queue without a batch that was sent."""
    return spool.join(sent.select("id"), "id", "left_anti")
