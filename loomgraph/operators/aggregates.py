"""Roll-ups of events and sizes, and benchmark verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import paths


#: Milliseconds of events of one target that a task orders at once.
SLOT_MS = 3_600_000


def lives(events: DataFrame) -> DataFrame:
    """events with `life`: how many results of the target ended before; a target starts anew after each.

    Events are ordered by target and hour, and a row for each hour says how many results ended before it, so that a target with
    a third of all events is spread over its hours."""
    slot = ["addr", "_slot"]
    rows = events.withColumn("_slot", F.coalesce(F.floor(F.col("at_ms") / SLOT_MS), F.lit(-1)))
    ended = F.count_if(F.col("type") == "result_end")
    earlier = Window.partitionBy("addr").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*slot).agg(ended.alias("_n")).select(*slot, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy(*slot).orderBy("at_ms", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.coalesce(ended.over(order), F.lit(0))).join(before, slot)
    return rows.withColumn("life", F.col("_here") + F.col("_before")).select(*events.columns, "life")


def life_records(events: DataFrame) -> DataFrame:
    """(addr, life, cached, executed_ok, ran, started_ms, ended_ms, failed, misses): one row for each life of a target.
    A hit counts only in a life without execution, and only the first; executions count if they succeed."""
    rows = lives(events)
    is_hit = F.col("type").isin("local_hit", "remote_hit")
    starts = F.col("type").isin("result_start", "execute_start", "local_hit", "remote_hit")
    ended = F.col("type") == "result_end"
    return rows.groupBy("addr", "life").agg(
        F.when(F.max(F.col("type") == "execute_start"), F.lit(None)).otherwise(F.min_by(F.when(is_hit, F.col("type")), F.when(is_hit, F.struct("at_ms", "seq")))).alias("cached"),
        F.count_if((F.col("type") == "execute_end") & F.col("error").isNull()).alias("executed_ok"),
        F.max(F.col("type") == "execute_start").alias("ran"),
        F.min(F.when(starts, F.col("at_ms"))).alias("started_ms"),
        F.max(F.when(ended, F.col("at_ms"))).alias("ended_ms"),
        F.max(F.when(ended, F.col("error"))).alias("failed"),
        F.count_if(ended & F.col("error").isNotNull() & F.col("upstream_of").isNotNull()).alias("blocked"),
        F.max(ended & F.col("error").isNotNull() & F.col("upstream_of").isNull()).alias("own_failure"),
        F.count_if(F.col("type") == "local_miss").alias("miss_local"),
        F.count_if(F.col("type") == "remote_miss").alias("miss_remote"),
    )


def counters(events: DataFrame) -> DataFrame:
    """One row of totals: executions, hits, misses, results blocked by another failure, and targets that failed by themselves; with
    the hit rate cached / (cached + missed), null if the caches were never asked."""
    r = life_records(events)
    totals = r.agg(
        F.coalesce(F.sum("executed_ok"), F.lit(0)).alias("executed"),
        F.count_if(F.col("cached") == "local_hit").alias("cached_local"),
        F.count_if(F.col("cached") == "remote_hit").alias("cached_remote"),
        F.coalesce(F.sum("miss_local"), F.lit(0)).alias("miss_local"),
        F.coalesce(F.sum("miss_remote"), F.lit(0)).alias("miss_remote"),
        F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"),
        F.count_distinct(F.when(F.col("own_failure"), F.col("addr"))).alias("roots"),
    )
    cached = F.col("cached_local") + F.col("cached_remote")
    return totals.withColumn("hit_rate", F.try_divide(cached.cast("double"), cached + F.col("miss_local") + F.col("miss_remote")))


def misses_by_package(events: DataFrame, most: int | None = None) -> DataFrame:
    """(package, misses) of local misses; remote misses accompany local ones and don't count. With most, the first of them in
    order of misses, and the number of all packages."""
    found = events.where("type = 'local_miss'").groupBy(paths.package_of("addr").alias("package")).agg(F.count("*").alias("misses"))
    return found if most is None else found.orderBy(F.desc("misses"), "package").limit(most).join(found.agg(F.count("*").alias("n_packages")))


def blocked_by_root(events: DataFrame) -> DataFrame:
    """(root, package, blocked): targets that failed because another one did."""
    failed = events.where("type = 'result_end' and error is not null and upstream_of is not null")
    return failed.groupBy(F.col("upstream_of").alias("root"), paths.package_of("addr").alias("package")).agg(F.count("*").alias("blocked"))


def root_failures(events: DataFrame, most: int = 10) -> DataFrame:
    """The first failure of each target that failed by itself, first seen first, with the number of all such targets."""
    own = events.where("type = 'result_end' and error is not null and upstream_of is null")
    first = own.groupBy("addr").agg(F.min(F.struct("at_ms", "seq", "error")).alias("f"))
    total = first.agg(F.count("*").alias("n_roots"))
    return first.select("addr", "f.*").orderBy("at_ms", "seq").limit(most).join(total).select("addr", "at_ms", "error", "n_roots")


def progress(events: DataFrame, matched: DataFrame) -> DataFrame:
    """(done, total, final) of the matched targets (addr, and complete where the announcements say so): done never exceeds total, as a
    result may end before its target is announced; final once an announcement was the last."""
    final = F.max("complete") if "complete" in matched.columns else F.lit(False)
    ended = events.where("type = 'result_end'").select("addr").distinct().withColumn("_ended", F.lit(True))
    mine = matched.groupBy("addr").agg(final.alias("complete"))
    return mine.join(ended, "addr", "left").agg(F.count("_ended").alias("done"), F.count("*").alias("total"), F.coalesce(F.max("complete"), F.lit(False)).alias("final"))


def open_spans(events: DataFrame, start: str = "phase_start", end: str = "phase_end", by: tuple[str, ...] = ("addr", "phase")) -> DataFrame:
    """(...by, open, since_ms): the last start or end of each span, whatever the order in which events come in; the same over a
    stream in update mode, where a row replaces the one before. Where open is false the span has ended."""
    last = events.where(F.col("type").isin(start, end)).groupBy(*by).agg(F.max_by(F.struct((F.col("type") == start).alias("open"), F.col("at_ms").alias("since_ms")), F.struct("at_ms", "seq")).alias("s"))
    return last.select(*by, "s.open", "s.since_ms")


def slowest(events: DataFrame, most: int = 20) -> DataFrame:
    """(addr, duration_ms) of the longest successful executions, from the first event of a life to its end."""
    r = life_records(events).where("ran and ended_ms is not null and failed is null")
    return r.select("addr", (F.col("ended_ms") - F.col("started_ms")).alias("duration_ms")).orderBy(F.desc("duration_ms"), "addr").limit(most)


def running_over(spans: DataFrame, now_ms: int, threshold_ms: int, most: int = 10, strict: bool = False) -> DataFrame:
    """Open spans (addr, phase, since_ms) of at least (strict: over) the threshold, longest first, with their number; background
    phases don't count."""
    elapsed = F.col("elapsed_ms")
    over = spans.where("phase <> 'remote_cache_write'").withColumn("elapsed_ms", F.lit(now_ms) - F.col("since_ms")).where(elapsed > threshold_ms if strict else elapsed >= threshold_ms)
    return over.orderBy(F.desc("elapsed_ms"), "addr").limit(most).join(over.agg(F.count("*").alias("n_over")))


def lock_waits(events: DataFrame, now_ms: int, threshold_ms: int, most: int = 10) -> DataFrame:
    """(addr, since_ms, n_over): targets that have waited for their lock for the threshold or longer, longest first, with their number."""
    last = events.where("type in ('lock_wait_start', 'lock_wait_end')").groupBy("addr").agg(F.max_by(F.struct("type", F.col("at_ms").alias("since_ms")), F.struct("at_ms", "seq")).alias("w"))
    over = last.where("w.type = 'lock_wait_start'").select("addr", "w.since_ms").where(F.lit(now_ms) - F.col("since_ms") >= threshold_ms)
    return over.orderBy("since_ms", "addr").limit(most).join(over.agg(F.count("*").alias("n_over")))


def elapsed(events: DataFrame, now_ms: int | None = None) -> DataFrame:
    """One row elapsed_ms: from the first event to the last, or to now while the stream is open; 0 without events."""
    end = F.max("at_ms") if now_ms is None else F.greatest(F.max("at_ms"), F.lit(now_ms))
    return events.agg(F.coalesce(F.greatest(end - F.min_by("at_ms", "seq"), F.lit(0)), F.lit(0)).alias("elapsed_ms"))


def seen_counts(events: DataFrame) -> DataFrame:
    """(done, total) over every target that was seen: the total grows as dependencies come in."""
    results = events.where("type in ('result_start', 'result_end')").groupBy("addr").agg(F.max(F.col("type") == "result_end").alias("ended"))
    return results.agg(F.count_if("ended").alias("done"), F.count("*").alias("total"))


def operation_times(spans: DataFrame, order: list[str], least_ms: int = 1000) -> DataFrame:
    """(addr, op, total_ms, place): summed time by operation, without short ones, in the order of the pipeline."""
    total = spans.groupBy("addr", "op").agg(F.sum("ms").alias("total_ms")).where(F.col("total_ms") >= least_ms)
    return total.withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("op")))


def size_statistics(sizes: DataFrame, column: str) -> DataFrame:
    """count, sized, sum, max and p99, where p99 is the upper edge of the power-of-two bucket of the nearest rank."""
    s = sizes.agg(F.count("*").alias("n"), F.count(column).alias("n_sized"), F.coalesce(F.sum(column), F.lit(0)).alias("total"), F.max(column).alias("largest"))
    return s.join(histogram_quantile(sizes, column))


def histogram_quantile(sizes: DataFrame, column: str, percent: int = 99) -> DataFrame:
    """One row `p<percent>`: buckets by bit length, the nearest rank among them, and that bucket's upper edge; 0 for nothing.
    A bucket for each bit length is all that a single task gets."""
    buckets = sizes.where(F.col(column).isNotNull()).groupBy(paths.bit_bucket(column).alias("bucket")).agg(F.count("*").alias("n"))
    up_to = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = buckets.select("bucket", F.sum("n").over(up_to).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    hit = summed.where(F.col("upto") >= F.ceil(F.col("all") * percent / 100)).agg(F.min("bucket").alias("b"))
    return hit.select(F.coalesce(paths.bucket_upper(F.col("b")), F.lit(0)).cast("long").alias(f"p{percent}"))


def verdicts(baseline: DataFrame, candidate: DataFrame, thresholds: DataFrame | None = None, default_percent: float = 8.0, noise_k: float = 2.0) -> DataFrame:
    """Per scenario of both sides (scenario, ms): means, change in percent, the noise band, and whether it is a regression:
    the change is over the threshold and over the noise."""
    b = baseline.groupBy("scenario").agg(F.count("*").alias("baseline_reps"), F.avg("ms").alias("baseline_mean_ms"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("sd"))
    c = candidate.groupBy("scenario").agg(F.count("*").alias("candidate_reps"), F.avg("ms").alias("candidate_mean_ms"))
    both = b.join(c, "scenario")
    both = both.join(thresholds, "scenario", "left") if thresholds is not None else both.withColumn("threshold_percent", F.lit(None).cast("double"))
    positive = F.col("baseline_mean_ms") > 0
    delta = F.when(positive, (F.col("candidate_mean_ms") - F.col("baseline_mean_ms")) / F.col("baseline_mean_ms") * 100).otherwise(0.0)
    noise = F.when(positive, F.lit(noise_k) * (F.col("sd") / F.col("baseline_mean_ms") * 100)).otherwise(0.0)
    both = both.withColumns({"delta_pct": delta, "noise_band_pct": noise, "effective_threshold_pct": F.greatest(F.coalesce("threshold_percent", F.lit(default_percent)), noise)})
    return both.select("scenario", "baseline_reps", "candidate_reps", "baseline_mean_ms", "candidate_mean_ms", "delta_pct", "noise_band_pct", "effective_threshold_pct", (F.col("delta_pct") > F.col("effective_threshold_pct")).alias("regression"))
