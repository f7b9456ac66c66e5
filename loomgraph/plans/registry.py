"""Queries by name over the bridged tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import aggregates, graph, hierarchy, merkle, outputs, selection, store
from loomgraph.plans import query_language
from loomgraph.plans.catalog import Bridge
from loomgraph.sources import files as file_sources

FLAGSHIP = "//world/... && label(BUILDING) && !//world/ASIA/..."

# The bridged relations in SQL.
TARGETS = """
places AS (SELECT n_nationkey, 'world/' || regexp_replace(r_name, '[ #:]', '_', 'g') AS rp, 'world/' || regexp_replace(r_name, '[ #:]', '_', 'g') || '/' || regexp_replace(n_name, '[ #:]', '_', 'g') AS np FROM nation JOIN region ON n_regionkey = r_regionkey),
named AS (
  SELECT rp AS package, 'n' || n_nationkey AS name, 0 AS provider_ord, CAST([] AS VARCHAR[]) AS labels FROM places
  UNION ALL SELECT np, 'c' || c_custkey, 0, [c_mktsegment] FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT np || '/suppliers', 's' || s_suppkey, 0, CAST([] AS VARCHAR[]) FROM supplier JOIN places ON s_nationkey = n_nationkey
  UNION ALL SELECT 'parts/' || regexp_replace(p_brand, '[ #:]', '_', 'g'), 'p' || p_partkey, 1, [p_type] FROM part
  UNION ALL SELECT 'orders/' || strftime(o_orderdate, '%Y/%m'), 'o' || o_orderkey, 2, [o_orderstatus, o_orderpriority] FROM orders),
targets AS (SELECT '//' || package || ':' || name AS addr, * FROM named)
"""
INPUTS = """
inputs AS (
  SELECT 'o' || o_orderkey AS addr, 0 AS pos, 'c' || o_custkey AS dep_addr FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 1, 'p' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 2, 's' || l_suppkey FROM lineitem
  UNION ALL SELECT 'c' || c_custkey, 0, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 0, 'n' || s_nationkey FROM supplier)
"""
REVISIONS = """
revisions AS (SELECT 'p' || l_partkey AS addr, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS hashin, CAST(epoch_us(l_shipdate) * 1000 AS BIGINT) AS created_at_ns, CAST(l_quantity AS BIGINT) AS size FROM lineitem)
"""
EVENTS = """
raw AS (SELECT CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS at_ms, event_id, event_type, user_id, '//users/g' || (user_id % 10) || ':u' || user_id AS addr,
  CASE event_type WHEN 'click' THEN ['local_hit'] WHEN 'view' THEN ['remote_hit'] WHEN 'signup' THEN ['execute_start', 'execute_end', 'result_end'] WHEN 'purchase' THEN ['local_miss'] ELSE ['result_end'] END AS kinds FROM events),
ev AS (SELECT at_ms, event_id * 10 + k AS seq, kinds[k + 1] AS type, addr, CASE WHEN event_type = 'error' THEN 'failed' END AS error,
  CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN '//users/g1:u1' END AS upstream_of FROM (SELECT *, unnest(range(0, len(kinds))) AS k FROM raw)),
lived AS (SELECT *, coalesce(count(*) FILTER (type = 'result_end') OVER (PARTITION BY addr ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM ev),
rec AS (SELECT addr, life,
  CASE WHEN bool_or(type = 'execute_start') THEN NULL ELSE (list(type ORDER BY at_ms, seq) FILTER (type IN ('local_hit', 'remote_hit')))[1] END AS cached,
  count(*) FILTER (type = 'execute_end' AND error IS NULL) AS ok, bool_or(type = 'execute_start') AS ran,
  min(at_ms) FILTER (type IN ('result_start', 'execute_start', 'local_hit', 'remote_hit')) AS started, max(at_ms) FILTER (type = 'result_end') AS ended,
  max(error) FILTER (type = 'result_end') AS failed, count(*) FILTER (type = 'local_miss') AS ml, count(*) FILTER (type = 'remote_miss') AS mr,
  count(*) FILTER (type = 'result_end' AND error IS NOT NULL AND upstream_of IS NOT NULL) AS blocked, bool_or(type = 'result_end' AND error IS NOT NULL AND upstream_of IS NULL) AS own FROM lived GROUP BY addr, life)
"""
PATHS = "pagepaths AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, page_id FROM pages)"
UP = "list_transform(range(len(string_split({x}, '/')), -1, -1), lambda n: array_to_string(string_split({x}, '/')[1:n], '/'))"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = lambda spark, sf_dir: function(Bridge(spark, sf_dir))
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def _selected(expr: str, where: str):
    def run(b: Bridge) -> DataFrame:
        return query_language.query(b.targets(), expr).select("addr", "package")

    return run, f"WITH {TARGETS} SELECT DISTINCT addr, package FROM targets WHERE {where}"


def named(name: str, run, sql: str) -> None:
    run.__name__ = name
    register(sql)(run)


_WORLD = "(package = 'world' OR package LIKE 'world/%')"
named("q_flagship", *_selected(FLAGSHIP, f"{_WORLD} AND list_contains(labels, 'BUILDING') AND NOT (package = 'world/ASIA' OR package LIKE 'world/ASIA/%')"))
named("q_prefix", *_selected("//world/ASIA/...", "(package = 'world/ASIA' OR package LIKE 'world/ASIA/%')"))
named("q_exact_package", *_selected("//world/ASIA", "package = 'world/ASIA'"))
named("q_addr", *_selected("//world/AFRICA:n0 || addr(//world/AFRICA:n5)", "addr IN ('//world/AFRICA:n0', '//world/AFRICA:n5')"))
named("q_label", *_selected("label(BUILDING)", "list_contains(labels, 'BUILDING')"))
named("q_union", *_selected("label(F) || label(ECONOMY)", "list_contains(labels, 'F') OR list_contains(labels, 'ECONOMY')"))
named("q_except", *_selected("//parts/... && !label(ECONOMY)", "package LIKE 'parts/%' AND NOT list_contains(labels, 'ECONOMY')"))
named("q_precedence", *_selected("label(F) || //parts/... && !(label(ECONOMY) || label(LARGE))", "list_contains(labels, 'F') OR (package LIKE 'parts/%' AND NOT (list_contains(labels, 'ECONOMY') OR list_contains(labels, 'LARGE')))"))
named("q_whole_graph", *_selected("//...", "true"))


@register(f"WITH {TARGETS} SELECT DISTINCT addr, package FROM targets WHERE provider_ord NOT IN (0) AND list_contains(labels, 'F')")
def q_skip_provider(b: Bridge) -> DataFrame:
    return query_language.query(b.targets(), "label(F)", skip_providers=("world",)).select("addr", "package")


@register(f"WITH {TARGETS} SELECT DISTINCT addr, package FROM targets WHERE list_contains(labels, 'BUILDING') AND package LIKE 'world/EUROPE/%'")
def q_select_label_under(b: Bridge) -> DataFrame:
    return query_language.select(b.targets(), label="BUILDING", under="//world/EUROPE/...").select("addr", "package")


@register(f"WITH {TARGETS}, dup AS (SELECT *, provider_ord AS o FROM targets UNION ALL SELECT *, 9 FROM targets WHERE package LIKE 'parts/%') SELECT addr, min(o) AS provider_ord FROM dup GROUP BY addr")
def q_first_provider_wins(b: Bridge) -> DataFrame:
    t = b.targets()
    twice = t.unionByName(t.where(paths.has_prefix("package", "parts")).withColumn("provider_ord", F.lit(9)))
    return selection.resolve_specs(twice).select("addr", "provider_ord")


@register(f"WITH {TARGETS} SELECT package, min(provider_ord) AS provider_ord FROM targets WHERE {_WORLD} GROUP BY package")
def q_package_scan(b: Bridge) -> DataFrame:
    return selection.package_scan(b.targets(), "world")


@register(f"WITH {TARGETS} SELECT DISTINCT unnest(labels) AS label FROM targets WHERE {_WORLD}")
def q_labels(b: Bridge) -> DataFrame:
    return selection.labels(b.targets().where(paths.has_prefix("package", "world")))


@register(f"WITH {TARGETS} SELECT count(DISTINCT addr) AS n_targets FROM targets")
def q_graph_size(b: Bridge) -> DataFrame:
    return selection.graph_size(b.targets())


@register(f"WITH {TARGETS} SELECT DISTINCT '//' || package || ':' AS completion FROM targets WHERE starts_with(package, 'world/A')")
def q_completion(b: Bridge) -> DataFrame:
    return selection.complete(b.targets(), "//world/A")


_OUT = "CASE WHEN page_id % 3 = 0 THEN 'none' WHEN page_id % 3 = 1 THEN 'copy' ELSE 'in_place' END"


def outputs_of(b: Bridge) -> DataFrame:
    """Pages as targets of the root package, with outputs by their URL paths: files, directories and globs."""
    p = b.url_paths()
    codegen = F.when(F.col("page_id") % 3 == 0, F.lit("none")).when(F.col("page_id") % 3 == 1, F.lit("copy")).otherwise(F.lit("in_place"))
    kind = F.when(F.col("page_id") % 5 == 0, F.lit("dir")).when(F.col("page_id") % 5 == 1, F.lit("glob")).otherwise(F.lit("file"))
    path = F.when(kind == "glob", F.concat("path", F.lit("/*.txt"))).when(kind == "dir", F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path"))
    return p.select(F.concat(F.lit("//:p"), F.col("page_id").cast("string")).alias("addr"), F.lit("out").alias("group"), F.lit(0).alias("pos"), path.alias("path"), kind.alias("kind"), codegen.alias("codegen"), F.when(F.col("page_id") % 7 == 0, F.lit("fs")).otherwise(F.lit("exec")).alias("driver"), "page_id")


OUTPUTS = f"""{PATHS}, outs AS (SELECT '//:p' || page_id AS addr, CASE page_id % 5 WHEN 0 THEN regexp_replace(path, '/[^/]*$', '') WHEN 1 THEN path || '/*.txt' ELSE path END AS path, CASE page_id % 5 WHEN 0 THEN 'dir' WHEN 1 THEN 'glob' ELSE 'file' END AS kind, {_OUT} AS codegen, CASE WHEN page_id % 7 = 0 THEN 'fs' ELSE 'exec' END AS driver, CASE page_id % 5 WHEN 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS base FROM pagepaths)"""


@register(f"""WITH {OUTPUTS}, first AS (SELECT split_part(min(path), '/', 1) AS host FROM pagepaths),
d AS (SELECT addr, kind, CASE WHEN kind = 'file' THEN regexp_replace(regexp_replace(path, '[^/]*$', ''), '/$', '') ELSE base END AS dir FROM outs WHERE codegen <> 'none')
SELECT DISTINCT addr FROM d, first WHERE dir = host OR starts_with(dir, host || '/') OR (kind <> 'file' AND (dir = '' OR starts_with(host, dir || '/')))""")
def q_tree_output(b: Bridge) -> DataFrame:
    outs = outputs_of(b)
    host = outs.agg(F.min(F.split_part("path", F.lit("/"), F.lit(1)))).first()[0] or ""
    targets = outs.select("addr", F.lit("").alias("package"), F.array().cast("array<string>").alias("labels"), F.lit("pages").alias("provider"), F.lit(0).alias("provider_ord"))
    return query_language.query(targets, f'tree_output("{host}")', outputs=outs).select("addr")


@register(f"WITH {INPUTS} SELECT addr, dep_addr, min(pos) AS pos FROM inputs GROUP BY ALL")
def q_deps(b: Bridge) -> DataFrame:
    return graph.deps(b.inputs())


@register(f"WITH {INPUTS} SELECT DISTINCT addr FROM inputs WHERE dep_addr = 'p7'")
def q_revdeps(b: Bridge) -> DataFrame:
    return graph.revdeps(b.inputs(), ["p7"])


@register(f"WITH RECURSIVE {INPUTS}, reach AS (SELECT 'o1' AS addr UNION SELECT dep_addr FROM reach JOIN inputs USING (addr)) SELECT addr FROM reach")
def q_closure(b: Bridge) -> DataFrame:
    return graph.closure(b.inputs(), ["o1"]).select("addr")


@register(f"WITH RECURSIVE {INPUTS}, reach AS (SELECT 'n3' AS addr UNION SELECT i.addr FROM reach JOIN inputs i ON i.dep_addr = reach.addr) SELECT addr FROM reach")
def q_reverse_closure(b: Bridge) -> DataFrame:
    return graph.closure(b.inputs(), ["n3"], reverse=True).select("addr")


@register(f"WITH {INPUTS}, o AS (SELECT addr, dep_addr FROM inputs WHERE addr = 'o1' AND pos = 0), c AS (SELECT addr, dep_addr FROM inputs) SELECT 0 AS step, 'o1' AS addr UNION ALL SELECT 1, dep_addr FROM o UNION ALL SELECT 2, c.dep_addr FROM o JOIN c ON c.addr = o.dep_addr")
def q_dep_path(b: Bridge) -> DataFrame:
    inputs = b.inputs()
    goal = inputs.where("addr = 'o1' and pos = 0").join(inputs.select(F.col("addr").alias("dep_addr"), F.col("dep_addr").alias("goal")), "dep_addr").select("goal").first()
    found = graph.dep_path_between(inputs, goal.goal, "o1") if goal else None
    return b.spark.createDataFrame(list(enumerate(found or [])), "step int, addr string")


@register(f"WITH {INPUTS}, nodes AS (SELECT addr FROM inputs UNION SELECT dep_addr FROM inputs) SELECT addr, CASE left(addr, 1) WHEN 'n' THEN 0 WHEN 'p' THEN 0 WHEN 'c' THEN 1 WHEN 's' THEN 1 ELSE 2 END AS level FROM nodes")
def q_topological_levels(b: Bridge) -> DataFrame:
    inputs = b.inputs()
    return graph.topological_levels(inputs.select("addr").union(inputs.select("dep_addr")).distinct(), inputs)


@register(f"WITH {INPUTS} SELECT i.addr, g.dep_addr, g.pos FROM inputs i JOIN inputs g ON g.addr = i.dep_addr WHERE i.addr LIKE 'o%' AND (i.dep_addr LIKE 'c%' OR i.dep_addr LIKE 's%') UNION ALL SELECT addr, dep_addr, 1 FROM inputs WHERE dep_addr LIKE 'p%'")
def q_group_expand(b: Bridge) -> DataFrame:
    i = b.inputs()
    inputs = i.select("addr", "pos", "dep_addr", F.lit(None).cast("string").alias("output"), F.lit("standard").alias("mode"), F.lit("").alias("origin_id"), F.lit(True).alias("hashed"), F.lit(True).alias("runtime"), F.create_map().cast("map<string,string>").alias("annotations"))
    groups = i.select("addr").distinct().select("addr", F.substring("addr", 1, 1).isin("c", "s").alias("transparent"))
    out = graph.expand_groups(inputs, groups).where("addr like 'o%'")
    return out.select("addr", "dep_addr", F.when(F.col("dep_addr").startswith("p"), 1).otherwise(0).alias("pos"))


@register(f"WITH {INPUTS} SELECT DISTINCT addr FROM inputs WHERE dep_addr IN ('p1', 'p2', 'n3')")
def q_failed_dependents(b: Bridge) -> DataFrame:
    return graph.revdeps(b.inputs(), ["p1", "p2", "n3"])


@register(f"WITH {INPUTS}, f AS (SELECT DISTINCT addr FROM inputs WHERE addr LIKE '%7'), r AS (SELECT DISTINCT i.addr FROM inputs i JOIN f ON f.addr = i.dep_addr) SELECT f.addr, r.addr IS NULL AS root FROM f LEFT JOIN r USING (addr)")
def q_failure_roots(b: Bridge) -> DataFrame:
    inputs = b.inputs()
    return graph.failure_roots(inputs, inputs.where("addr like '%7'").select("addr"))


@register(f"""WITH {INPUTS}, leaf AS (SELECT DISTINCT dep_addr AS addr, sha256('d|' || dep_addr || '|') AS h FROM inputs WHERE dep_addr NOT IN (SELECT addr FROM inputs)),
mid AS (SELECT i.addr, sha256('d|' || i.addr || '|' || string_agg(leaf.h, ',' ORDER BY leaf.h)) AS h FROM inputs i JOIN leaf ON leaf.addr = i.dep_addr WHERE i.addr NOT LIKE 'o%' GROUP BY i.addr),
low AS (SELECT * FROM leaf UNION ALL SELECT * FROM mid),
top AS (SELECT i.addr, sha256('d|' || i.addr || '|' || string_agg(low.h, ',' ORDER BY low.h)) AS h FROM inputs i JOIN low ON low.addr = i.dep_addr WHERE i.addr LIKE 'o%' GROUP BY i.addr)
SELECT addr, h AS hashin FROM low UNION ALL SELECT addr, h FROM top""")
def q_merkle(b: Bridge) -> DataFrame:
    inputs = b.inputs().withColumn("hashed", F.lit(True))
    targets = inputs.select("addr").union(inputs.select("dep_addr")).distinct().select("addr", F.lit("d").alias("driver"), F.col("addr").alias("def_hash"))
    return merkle.content_hashes(targets, inputs)


@register(f"WITH {REVISIONS} SELECT addr, hashin, created_at_ns FROM revisions QUALIFY row_number() OVER (PARTITION BY addr ORDER BY created_at_ns DESC, hashin) <= 3")
def q_keep_newest(b: Bridge) -> DataFrame:
    return store.keep_newest(b.revisions(), 3).where("keep").select("addr", "hashin", "created_at_ns")


@register(f"WITH {REVISIONS} SELECT DISTINCT addr FROM revisions WHERE addr NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size <= 25)")
def q_orphans(b: Bridge) -> DataFrame:
    return store.orphans(b.revisions(), b.table("part").where("p_size <= 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("addr")))


SPECS = "specs AS (SELECT 'p' || p_partkey AS addr, CASE WHEN p_size % 10 = 0 THEN 'error' ELSE 'ok' END AS status, 2 + p_size % 2 AS history FROM part WHERE p_size <= 25)"
DOOMED = f"{REVISIONS}, {SPECS}, doomed AS (SELECT r.addr, hashin, CASE WHEN status IS NULL THEN 'orphan' ELSE 'trim' END AS reason, bytes FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY addr, hashin) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY addr ORDER BY created_at_ns DESC, hashin) AS k FROM revisions) r LEFT JOIN specs USING (addr) WHERE status IS NULL OR (status = 'ok' AND k > history))"


def doomed_of(b: Bridge) -> tuple[DataFrame, DataFrame, DataFrame]:
    revisions = b.revisions()
    specs = b.table("part").where("p_size <= 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("addr"), F.when(F.col("p_size") % 10 == 0, "error").otherwise("ok").alias("status"), (F.col("p_size") % 2 + 2).alias("history"))
    return revisions, store.collect_garbage(revisions.select("addr", "hashin", "created_at_ns"), revisions.select("addr", "hashin", "size"), specs), specs


@register(f"WITH {DOOMED} SELECT * FROM doomed")
def q_collect_garbage(b: Bridge) -> DataFrame:
    return doomed_of(b)[1]


@register(f"WITH {DOOMED} SELECT count(*) AS removed, (SELECT count(*) FROM revisions JOIN specs USING (addr) WHERE status <> 'error') - count(*) FILTER (reason = 'trim') AS kept, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(DISTINCT CASE WHEN reason = 'orphan' THEN addr END) AS orphans, (SELECT count(DISTINCT addr) FROM revisions JOIN specs USING (addr) WHERE status = 'error') AS errored FROM doomed")
def q_garbage_totals(b: Bridge) -> DataFrame:
    return store.garbage_totals(*doomed_of(b))


@register(f"WITH {REVISIONS} SELECT addr, hashin FROM revisions WHERE created_at_ns >= 852076800000000000")
def q_ttl_prune(b: Bridge) -> DataFrame:
    return store.prune_older(b.revisions(), "created_at_ns", 852076800000000000).select("addr", "hashin")


@register("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def q_last_write_wins(b: Bridge) -> DataFrame:
    return store.last_write_wins(b.table("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@register("SELECT event_id AS id, event_type FROM events ORDER BY id DESC LIMIT 200")
def q_spool_cap(b: Bridge) -> DataFrame:
    return store.keep_newest_rows(b.table("events").select(F.col("event_id").alias("id"), "event_type"))


@register("SELECT event_id AS id, event_type FROM events ORDER BY id LIMIT 50")
def q_spool_batch(b: Bridge) -> DataFrame:
    return store.next_batch(b.table("events").select(F.col("event_id").alias("id"), "event_type"))


@register(f"WITH {REVISIONS} SELECT addr, hashin FROM revisions WHERE addr NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_type = 'ECONOMY')")
def q_clean(b: Bridge) -> DataFrame:
    gone = b.table("part").where("p_type = 'ECONOMY'").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("addr"))
    return store.clean(b.revisions(), gone).select("addr", "hashin")


@register(f"WITH {EVENTS}, t AS (SELECT CAST(sum(ok) AS BIGINT) AS executed, count(*) FILTER (cached = 'local_hit') AS cached_local, count(*) FILTER (cached = 'remote_hit') AS cached_remote, CAST(sum(ml) AS BIGINT) AS miss_local, CAST(sum(mr) AS BIGINT) AS miss_remote, CAST(sum(blocked) AS BIGINT) AS blocked, count(DISTINCT CASE WHEN own THEN addr END) AS roots FROM rec) SELECT *, CAST(cached_local + cached_remote AS DOUBLE) / nullif(cached_local + cached_remote + miss_local + miss_remote, 0) AS hit_rate FROM t")
def q_counters(b: Bridge) -> DataFrame:
    return aggregates.counters(b.events())


@register(f"WITH {EVENTS} SELECT regexp_replace(regexp_extract(addr, '^(.*):[^:]*$', 1), '^//', '') AS package, count(*) AS misses FROM ev WHERE type = 'local_miss' GROUP BY 1")
def q_misses_by_package(b: Bridge) -> DataFrame:
    return aggregates.misses_by_package(b.events())


@register(f"WITH {EVENTS} SELECT upstream_of AS root, regexp_replace(regexp_extract(addr, '^(.*):[^:]*$', 1), '^//', '') AS package, count(*) AS blocked FROM ev WHERE type = 'result_end' AND error IS NOT NULL AND upstream_of IS NOT NULL GROUP BY 1, 2")
def q_blocked_by_root(b: Bridge) -> DataFrame:
    return aggregates.blocked_by_root(b.events())


@register(f"WITH {EVENTS}, f AS (SELECT addr, min(at_ms) AS at_ms, arg_min(error, seq) AS error, min(seq) AS seq FROM ev WHERE type = 'result_end' AND error IS NOT NULL AND upstream_of IS NULL GROUP BY addr) SELECT addr, at_ms, error, (SELECT count(*) FROM f) AS n_roots FROM f ORDER BY at_ms, seq LIMIT 10")
def q_root_failures(b: Bridge) -> DataFrame:
    return aggregates.root_failures(b.events())


@register(f"WITH {EVENTS} SELECT count(DISTINCT CASE WHEN type = 'result_end' THEN addr END) AS done, count(DISTINCT addr) AS total, bool_or(addr LIKE '%11') AS final FROM ev WHERE addr LIKE '%1'")
def q_progress(b: Bridge) -> DataFrame:
    events = b.events()
    return aggregates.progress(events, events.where("addr like '%1'").select("addr", F.col("addr").like("%11").alias("complete")))


@register(f"WITH {EVENTS} SELECT addr, ended - started AS duration_ms FROM rec WHERE ran AND ended IS NOT NULL AND failed IS NULL ORDER BY duration_ms DESC, addr LIMIT 20")
def q_slowest(b: Bridge) -> DataFrame:
    return aggregates.slowest(b.events())


@register("WITH b AS (SELECT CASE WHEN n_chars <= 0 THEN 0 ELSE length(bin(n_chars)) END AS k, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1), c AS (SELECT k, sum(n) OVER (ORDER BY k) AS u, sum(n) OVER () AS a FROM b) SELECT coalesce(9223372036854775807 >> CAST(63 - min(k) AS INTEGER), 0) AS p99 FROM c WHERE u >= ceil(a * 99 / 100)")
def q_p99_bucket(b: Bridge) -> DataFrame:
    return aggregates.histogram_quantile(b.table("documents"), "n_chars")


@register("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def q_event_counts(b: Bridge) -> DataFrame:
    return b.table("events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


@register("""WITH s AS (SELECT user_id % 20 AS scenario, value AS ms, event_id % 2 AS side FROM events),
x AS (SELECT scenario, count(*) AS baseline_reps, avg(ms) AS bm, coalesce(stddev_samp(ms), 0) AS sd FROM s WHERE side = 0 GROUP BY 1), y AS (SELECT scenario, count(*) AS candidate_reps, avg(ms) AS cm FROM s WHERE side = 1 GROUP BY 1),
z AS (SELECT *, CASE WHEN bm > 0 THEN (cm - bm) / bm * 100 ELSE 0 END AS d, CASE WHEN bm > 0 THEN 0.1 * (sd / bm * 100) ELSE 0 END AS noise FROM x JOIN y USING (scenario))
SELECT scenario, baseline_reps, candidate_reps, round(bm, 6) AS baseline_mean_ms, round(cm, 6) AS candidate_mean_ms, round(d, 6) AS delta_pct, round(greatest(8, noise), 6) AS effective_threshold_pct, d > greatest(8, noise) AS regression FROM z""")
def q_bench_verdict(b: Bridge) -> DataFrame:
    s = b.table("events").select((F.col("user_id") % 20).alias("scenario"), F.col("value").alias("ms"), (F.col("event_id") % 2).alias("side"))
    v = aggregates.verdicts(s.where("side = 0"), s.where("side = 1"), noise_k=0.1)
    r = lambda c: F.round(c, 6).alias(c)
    return v.select("scenario", "baseline_reps", "candidate_reps", r("baseline_mean_ms"), r("candidate_mean_ms"), r("delta_pct"), r("effective_threshold_pct"), "regression")


STATES = f"{PATHS}, st AS (SELECT regexp_replace(path, '/[^/]*$', '') AS package, min(page_id) AS page FROM pagepaths GROUP BY 1)"


def states_of(b: Bridge) -> DataFrame:
    return b.url_paths().groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("package")).agg(F.min("page_id").alias("page"))


@register(f"WITH {STATES}, up AS (SELECT DISTINCT path AS package, unnest({UP.format(x='path')}) AS declared_at FROM pagepaths) SELECT DISTINCT up.package, declared_at, page FROM up JOIN st ON st.package = declared_at")
def q_ancestor_states(b: Bridge) -> DataFrame:
    return hierarchy.ancestor_states(b.url_paths().select(F.col("path").alias("package")), states_of(b)).select("package", "declared_at", "page")


@register(f"WITH {STATES}, up AS (SELECT DISTINCT path AS package, unnest({UP.format(x='path')}) AS declared_at FROM pagepaths) SELECT DISTINCT up.package, declared_at, page FROM up JOIN st ON st.package = declared_at QUALIFY row_number() OVER (PARTITION BY up.package ORDER BY length(declared_at) DESC) = 1")
def q_nearest_override(b: Bridge) -> DataFrame:
    return hierarchy.nearest(b.url_paths().select(F.col("path").alias("package")), states_of(b)).select("package", "declared_at", "page")


@register(f"WITH {STATES}, up AS (SELECT DISTINCT path AS import_path, unnest({UP.format(x='path')}) AS module FROM pagepaths) SELECT import_path, arg_max(module, length(module)) AS module FROM up JOIN st ON st.package = up.module GROUP BY 1")
def q_longest_prefix(b: Bridge) -> DataFrame:
    return hierarchy.longest_prefix(b.url_paths().select(F.col("path").alias("import_path")), states_of(b).select(F.col("package").alias("module"), F.col("page").alias("pos")))


@register(f"WITH {STATES} SELECT package, page FROM st WHERE starts_with(package || '/', (SELECT min(split_part(path, '/', 1)) FROM pagepaths) || '/')")
def q_states_under(b: Bridge) -> DataFrame:
    host = b.url_paths().agg(F.min(F.split_part("path", F.lit("/"), F.lit(1)))).first()[0] or ""
    return hierarchy.states_under(states_of(b), host)


@register(f"""WITH {OUTPUTS}, m AS (SELECT DISTINCT regexp_replace(path, '/+$', '') AS path, addr, driver FROM outs WHERE codegen = 'copy')
SELECT DISTINCT a.path, a.addr, b.path AS other_path, b.addr AS other_addr FROM m a JOIN m b ON a.addr <> b.addr AND ((a.path = b.path AND a.addr < b.addr) OR starts_with(a.path, b.path || '/')) WHERE NOT (a.driver = 'fs' AND b.driver = 'fs')""")
def q_overlap(b: Bridge) -> DataFrame:
    return outputs.overlaps(outputs_of(b))


@register(f"WITH {OUTPUTS} SELECT DISTINCT '/' || CASE kind WHEN 'dir' THEN trim(path, '/') ELSE ltrim(path, '/') END AS pattern, addr FROM outs WHERE codegen = 'copy'")
def q_ignore_patterns(b: Bridge) -> DataFrame:
    return outputs.ignore_patterns(outputs_of(b))


@register(f"WITH {PATHS} SELECT DISTINCT path, 'site/' || path AS dst FROM pagepaths WHERE regexp_matches(path, '^[^/]*/(en|de)/[^/]*$') AND NOT regexp_matches(path, '^[^/]*/de/1[^/]*$')")
def q_path_transform(b: Bridge) -> DataFrame:
    move = outputs.PathTransform(include=("*/{en,de}/*",), exclude=("*/de/1*",), prefix="site")
    return move.apply(b.url_paths().select("path").distinct()).select("path", "dst")


#: The components of a path that cleaning leaves, where no '..' is in it.
TIDY = "list_filter(string_split({x}, '/'), lambda c: c NOT IN ('', '.'))"
_DIR = "array_to_string(" + TIDY.format(x="regexp_replace(path, '[^/]*$', '')") + ", '/')"


@register(f"""WITH {PATHS}, p AS (SELECT DISTINCT path, {_DIR} AS d, regexp_replace(path, '/+$', '') AS bare FROM pagepaths)
SELECT path, CASE WHEN path = '' THEN '.' WHEN bare = '' THEN '/' ELSE regexp_extract(bare, '([^/]*)$', 1) END AS base,
  CASE WHEN starts_with(path, '/') THEN '/' || d WHEN d = '' THEN '.' ELSE d END AS dir, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth FROM p""")
def q_path_functions(b: Bridge) -> DataFrame:
    p = b.url_paths().select("path").distinct()
    return p.select("path", paths.basename("path").alias("base"), paths.dirname("path").alias("dir"), paths.depth("path").cast("long").alias("depth"))


@register(f"SELECT DISTINCT unnest({UP.format(x='d')}) AS package FROM (WITH {PATHS} SELECT regexp_replace(path, '/[^/]*$', '') AS d FROM pagepaths WHERE regexp_matches(path, '/1[^/]*$'))")
def q_build_tree_packages(b: Bridge) -> DataFrame:
    files = b.url_paths().where(F.col("path").rlike("/1[^/]*$")).select(F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/BUILD")).alias("path"))
    return selection.packages_of_files(files)


@register(f"WITH {PATHS} SELECT DISTINCT path FROM pagepaths WHERE regexp_matches(path, '^[^/]*/fr/[^/]*$') AND NOT regexp_matches(path, '^[^/]*/fr/[^/]*9$')")
def q_glob(b: Bridge) -> DataFrame:
    return file_sources.glob(b.url_paths().select("path").distinct(), "*/fr/*", ("**/*9",))


@register("SELECT doc_id, n_chars >= 1024 AND doc_id % 2 = 0 AS gzip, sha256(text) AS digest FROM documents")
def q_compression_and_digest(b: Bridge) -> DataFrame:
    d = b.table("documents")
    how = paths.compression_for(F.col("n_chars"), F.col("doc_id") % 2 == 1)
    return d.select("doc_id", (how == "gzip").alias("gzip"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@register("WITH a AS (SELECT event_type AS type, CAST(user_id AS VARCHAR) AS g, event_type AS h FROM events WHERE event_id % 2 = 0), b AS (SELECT event_type, CAST(user_id AS VARCHAR), event_type FROM events WHERE event_id % 2 = 1) SELECT type, g AS \"group\", h AS hashout, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def q_reconcile_artifacts(b: Bridge) -> DataFrame:
    e = b.table("events").select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("group"), F.col("event_type").alias("hashout"), "event_id")
    return merkle.same_artifacts(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


@register("SELECT CAST(i % 6 AS INTEGER) AS level, count(*) AS n FROM range(1000) t(i) GROUP BY 1")
def q_layered_graph_levels(b: Bridge) -> DataFrame:
    targets, inputs = graph.layered_graph(b.spark)
    return graph.topological_levels(targets, inputs).groupBy("level").agg(F.count("*").alias("n"))


@register(f"""WITH RECURSIVE {INPUTS}, back AS (SELECT 'n' || c_nationkey AS addr, 'c' || min(c_custkey) AS dep_addr FROM customer WHERE c_nationkey % 5 = 0 GROUP BY c_nationkey UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey FROM part WHERE p_size = 7),
e AS (SELECT addr, dep_addr FROM inputs UNION ALL FROM back),
r AS (SELECT addr AS a, dep_addr AS b FROM back UNION SELECT r.a, e.dep_addr FROM r JOIN e ON e.addr = r.b),
again AS (SELECT DISTINCT b AS a, e.dep_addr AS b FROM r JOIN e ON e.addr = r.b UNION SELECT again.a, e.dep_addr FROM again JOIN e ON e.addr = again.b) SELECT DISTINCT a AS addr FROM again WHERE a = b""")
def q_cycles(b: Bridge) -> DataFrame:
    """All inputs, with edges back from every fifth nation to one of its customers, and parts that need themselves."""
    key = lambda letter, column: F.concat(F.lit(letter), column.cast("string"))
    nations = b.table("customer").where("c_nationkey % 5 = 0").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c"))
    back = nations.select(key("n", F.col("c_nationkey")).alias("addr"), F.lit(0).alias("pos"), key("c", F.col("c")).alias("dep_addr"))
    loops = b.table("part").where("p_size = 7").select(key("p", F.col("p_partkey")).alias("addr"), F.lit(0).alias("pos"), key("p", F.col("p_partkey")).alias("dep_addr"))
    inputs = b.inputs().unionByName(back).unionByName(loops)
    return graph.cyclic(inputs.select("addr").union(inputs.select("dep_addr")).distinct(), inputs)


@register("""WITH RECURSIVE v AS (SELECT p_partkey AS k, CASE WHEN p_partkey = 1 OR p_partkey % 3 = 0 THEN p_brand END AS goos, CASE WHEN p_partkey = 1 OR p_partkey % 5 = 0 THEN p_type END AS goarch FROM part),
walk AS (SELECT k, k // 2 AS next, goos, goarch FROM v UNION ALL SELECT w.k, w.next // 2, coalesce(w.goos, v.goos), coalesce(w.goarch, v.goarch) FROM walk w JOIN v ON v.k = w.next AND w.next > 0)
SELECT 'p' || k AS name, goos, goarch FROM walk WHERE next = 0""")
def q_variant_inheritance(b: Bridge) -> DataFrame:
    """Parts as variants: each inherits the one of half its number."""
    k, name = F.col("p_partkey"), lambda c: F.concat(F.lit("p"), c.cast("string"))
    own = lambda column, n: F.when((k == 1) | (k % n == 0), F.col(column))
    variants = b.table("part").select(name(k).alias("name"), F.when(k > 1, name(F.floor(k / 2))).alias("inherit"), own("p_brand", 3).alias("goos"), own("p_type", 5).alias("goarch"))
    return hierarchy.inherit(variants, ("goos", "goarch"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_language.query(Bridge(spark, sf_dir).targets(), FLAGSHIP).select("addr", "package", "labels").orderBy("package", "addr")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from loomgraph.plans import detail_queries, further_queries  # noqa: E402, F401  they register further queries

__all__ = ["flagship", "oracle_sql", "queries"]
