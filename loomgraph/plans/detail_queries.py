"""Further queries: linking and contributions, failures, stores, states and variants, paths, files, reports and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import aggregates, graph, hierarchy, merkle, outputs, selection, store
from loomgraph.plans import query_language
from loomgraph.plans.catalog import Bridge
from loomgraph.plans.registry import EVENTS, INPUTS, OUTPUTS, PATHS, REVISIONS, TARGETS, TIDY, UP, outputs_of, register
from loomgraph.sources import files as file_sources
from loomgraph.sources import sinks
from loomgraph.streaming import fold


def _key(letter: str, column: str) -> Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


# Selection


@register(f"WITH {TARGETS} SELECT DISTINCT '//world/AFRICA:' || name AS completion FROM targets WHERE package = 'world/AFRICA' AND starts_with(name, 'n1')")
def q_completion_names(b: Bridge) -> DataFrame:
    return selection.complete(b.targets(), "//world/AFRICA:n1")


@register(f"WITH {TARGETS} SELECT DISTINCT '../' || substr(package, 7) || ':' AS completion FROM targets WHERE starts_with(package, 'world/A')")
def q_completion_relative(b: Bridge) -> DataFrame:
    return selection.complete(b.targets(), "../A", base="world/EUROPE")


@register(f"WITH {OUTPUTS} SELECT 'out' AS wanted, addr, path FROM outs UNION ALL SELECT 'nope', NULL, NULL")
def q_select_outputs(b: Bridge) -> DataFrame:
    return selection.select_outputs(outputs_of(b), ["out", "nope"]).select("wanted", "addr", "path")


@register(f"WITH {TARGETS} SELECT DISTINCT addr FROM targets WHERE provider_ord <> 0 AND (list_contains(labels, 'F') OR package LIKE 'world/%')")
def q_query_target(b: Bridge) -> DataFrame:
    address = query_language.query_address("label(F) || ./...", "world", ("world",))
    return query_language.query_members(b.targets(), address).select("addr")


@register("SELECT 'c' || c_custkey AS addr, CASE WHEN c_custkey % 2 = 0 THEN '//@query:query@_origin=' || substr(sha256('c' || c_custkey), 1, 16) || CASE WHEN c_custkey % 3 = 0 THEN ',exclude_provider=mine' ELSE ',exclude_provider=world' END || ',expr=label(F)' ELSE '//lib:x' END AS dep FROM customer")
def q_stamped_inputs(b: Bridge) -> DataFrame:
    asks = F.col("c_custkey") % 2 == 0
    args = F.when(asks & (F.col("c_custkey") % 3 == 0), F.create_map(F.lit("expr"), F.lit("label(F)"), F.lit("exclude_provider"), F.lit("mine"))).when(asks, F.create_map(F.lit("expr"), F.lit("label(F)"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = b.table("customer").select(_key("c", "c_custkey").alias("addr"), F.lit("world").alias("provider"), F.when(asks, query_language.QUERY_PACKAGE).otherwise("lib").alias("dep_package"), F.when(asks, "query").otherwise("x").alias("dep_name"), args.alias("dep_args"))
    from loomgraph.functions.address import format_address

    return query_language.stamp_query_inputs(rows).select("addr", format_address(F.col("dep_package"), F.col("dep_name"), F.col("dep_args")).alias("dep"))


@register(f"WITH {TARGETS} SELECT package, count(DISTINCT addr) AS n FROM targets WHERE package LIKE 'parts/%' AND NOT list_contains(labels, 'ECONOMY') GROUP BY 1")
def q_inspect_packages(b: Bridge) -> DataFrame:
    return query_language.query(b.targets(), "//parts/... && !label(ECONOMY)").groupBy("package").agg(F.count("*").alias("n"))


@register(f"WITH {TARGETS} SELECT CAST(json_object('addr', addr, 'package', package, 'labels', labels) AS VARCHAR) AS report FROM targets WHERE package LIKE 'parts/%'")
def q_inspect_spec(b: Bridge) -> DataFrame:
    return sinks.json_report(query_language.query(b.targets(), "//parts/...").select("addr", "package", "labels"))


# Inputs


@register(f"WITH {OUTPUTS} SELECT addr, 0 AS pos, CASE kind WHEN 'file' THEN 'file:' || path WHEN 'dir' THEN 'glob:' || rtrim(path, '/') || '/**/*' ELSE 'glob:' || path END AS dep_addr FROM outs UNION ALL SELECT addr, 1, '//:p0' FROM outs")
def q_introspect(b: Bridge) -> DataFrame:
    outs = outputs_of(b)
    inputs = outs.select("addr", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit(graph.OWN_OUTPUTS).alias("dep_addr")), F.struct(F.lit(1).alias("pos"), F.lit("//:p0").alias("dep_addr")))).alias("i")).select("addr", "i.*")
    return graph.introspect(inputs, outs).select("addr", "pos", "dep_addr")


_LINKED = f"""{OUTPUTS}, made AS (SELECT addr, 'out' AS g, kind FROM outs),
i AS (SELECT '//:p' || page_id AS addr, '//:p' || (page_id - 1) AS dep_addr, CASE page_id % 4 WHEN 0 THEN 'out' WHEN 2 THEN 'nope' END AS wanted, page_id % 3 = 0 AS tool FROM pages WHERE page_id % 7 <> 0),
linked AS (SELECT i.addr, i.dep_addr, g, CASE WHEN i.dep_addr NOT IN (SELECT addr FROM outs) THEN 'unknown target' WHEN wanted IS NOT NULL AND g IS NULL THEN 'missing group' WHEN tool AND kind <> 'file' THEN 'tool needs exactly one file' END AS error FROM i LEFT JOIN made ON made.addr = i.dep_addr AND (wanted IS NULL OR wanted = g))"""


def _linked(b: Bridge) -> DataFrame:
    page = F.col("page_id")
    wanted = F.when(page % 4 == 0, "out").when(page % 4 == 2, "nope")
    inputs = b.table("pages").select(_key("//:p", "page_id").alias("addr"), F.lit(0).alias("pos"), F.concat(F.lit("//:p"), (page - 1).cast("string")).alias("dep_addr"), F.when(page % 3 == 0, "tool").otherwise("standard").alias("mode"), wanted.alias("output"), (page % 7 != 0).alias("runtime"))
    outs = outputs_of(b)
    return graph.link(inputs, outs, outs)


@register(f"WITH {_LINKED} SELECT addr, dep_addr, g AS \"group\", error FROM linked")
def q_link(b: Bridge) -> DataFrame:
    return _linked(b).select("addr", "dep_addr", "group", "error")


@register(f"""WITH {_LINKED}, m AS (SELECT DISTINCT regexp_replace(path, '/+$', '') AS path, addr, driver FROM outs WHERE codegen = 'copy'),
pats AS (SELECT DISTINCT '/' || CASE kind WHEN 'dir' THEN trim(path, '/') ELSE ltrim(path, '/') END AS pattern, addr, driver FROM outs WHERE codegen = 'copy')
SELECT 'link' AS "check", addr, error || ': ' || dep_addr AS detail FROM linked WHERE error IS NOT NULL
UNION ALL SELECT DISTINCT 'overlap', a.addr, a.path || ' and ' || b.path || ' of ' || b.addr FROM m a JOIN m b ON a.addr <> b.addr AND ((a.path = b.path AND a.addr < b.addr) OR starts_with(a.path, b.path || '/')) WHERE NOT (a.driver = 'fs' AND b.driver = 'fs')
UNION ALL SELECT 'ignore', addr, 'not ignored: ' || pattern FROM pats WHERE driver = 'fs' UNION ALL SELECT 'ignore', '//gone:x', 'no longer made: /old'""")
def q_validate(b: Bridge) -> DataFrame:
    outs = outputs_of(b)
    written = outputs.ignore_patterns(outs.where("driver <> 'fs'")).union(b.spark.createDataFrame([("/old", "//gone:x")], "pattern string, addr string"))
    return outputs.violations(_linked(b), outputs.overlaps(outs), outputs.ignore_patterns(outs), written)


@register(f"""WITH {INPUTS} SELECT i.addr, 'dep' AS kind, c_mktsegment AS key, 'm' || (c_custkey % 2) AS mode, i.dep_addr AS value FROM inputs i JOIN customer ON i.dep_addr = 'c' || c_custkey WHERE i.addr LIKE 'o%'
UNION ALL SELECT addr, 'env', 'e' || (s_suppkey % 2), NULL, max(dep_addr) FROM inputs JOIN supplier ON dep_addr = 's' || s_suppkey WHERE addr LIKE 'o%' GROUP BY ALL""")
def q_transitive(b: Bridge) -> DataFrame:
    customers = b.table("customer").select(_key("c", "c_custkey").alias("addr"), F.lit("dep").alias("kind"), F.col("c_mktsegment").alias("key"), F.concat(F.lit("m"), (F.col("c_custkey") % 2).cast("string")).alias("mode"), _key("c", "c_custkey").alias("value"))
    suppliers = b.table("supplier").select(_key("s", "s_suppkey").alias("addr"), F.lit("env").alias("kind"), F.concat(F.lit("e"), (F.col("s_suppkey") % 2).cast("string")).alias("key"), F.lit(None).cast("string").alias("mode"), _key("s", "s_suppkey").alias("value"))
    inputs = b.inputs().where("addr like 'o%'").withColumn("runtime", F.lit(True))
    return graph.transitive(inputs, customers.unionByName(suppliers)).select("addr", "kind", "key", "mode", "value")


@register("WITH m AS (SELECT 'o' || l_orderkey AS addr, 's' || l_suppkey AS member, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2) SELECT addr, string_agg(member, ',' ORDER BY pos, member) AS members, count(*) = 1 AS single FROM m GROUP BY 1")
def q_distinct_members(b: Bridge) -> DataFrame:
    members = b.table("lineitem").select(_key("o", "l_orderkey").alias("addr"), _key("s", "l_suppkey").alias("member"), F.col("l_linenumber").alias("pos"))
    return graph.distinct_members(members).select("addr", F.array_join("members", ",").alias("members"), "single")


@register(f"""WITH RECURSIVE {INPUTS}, f AS (SELECT addr FROM inputs WHERE addr LIKE '%7' UNION SELECT dep_addr FROM inputs WHERE dep_addr LIKE '%7'),
e AS (SELECT addr, arg_min(dep_addr, (pos, dep_addr)) AS dep FROM inputs WHERE addr IN (FROM f) AND dep_addr IN (FROM f) GROUP BY addr),
walk AS (SELECT addr, addr AS here FROM f UNION ALL SELECT walk.addr, e.dep FROM walk JOIN e ON e.addr = walk.here) SELECT addr, here AS root FROM walk WHERE here NOT IN (SELECT addr FROM e)""")
def q_failure_blame(b: Bridge) -> DataFrame:
    inputs = b.inputs()
    failed = inputs.select("addr").union(inputs.select("dep_addr")).where("addr like '%7'")
    return graph.blame(inputs, failed)


@register("SELECT 'p' || p_partkey AS addr, p_brand AS hashin FROM part WHERE p_size <= 10")
def q_stale(b: Bridge) -> DataFrame:
    hashes = b.table("part").select(_key("p", "p_partkey").alias("addr"), F.col("p_brand").alias("hashin"), "p_size")
    return merkle.stale(hashes, hashes.where("p_size > 10")).select("addr", "hashin")


# Events and sizes


@register("WITH b AS (SELECT CASE WHEN n_chars <= 0 THEN 0 ELSE length(bin(n_chars)) END AS k, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1), c AS (SELECT k, sum(n) OVER (ORDER BY k) AS u, sum(n) OVER () AS a FROM b) SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(n_chars) FROM documents) AS n_sized, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS total, (SELECT max(n_chars) FROM documents) AS largest, CAST(coalesce(2 ** min(k) - 1, 0) AS BIGINT) AS p99 FROM c WHERE u >= ceil(a * 99 / 100)")
def q_size_statistics(b: Bridge) -> DataFrame:
    return aggregates.size_statistics(b.table("documents"), "n_chars")


_SPANS = "spans AS (SELECT 'e' || event_id AS addr, CASE event_type WHEN 'view' THEN 'remote_cache_write' ELSE event_type END AS phase, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS since_ms FROM events), o AS (SELECT *, 1706659200000 - since_ms AS elapsed_ms FROM spans WHERE phase <> 'remote_cache_write')"


@register(f"WITH {_SPANS}, x AS (SELECT * FROM o WHERE elapsed_ms >= 864000000) SELECT *, (SELECT count(*) FROM x) AS n_over FROM x ORDER BY elapsed_ms DESC, addr LIMIT 10")
def q_running_over(b: Bridge) -> DataFrame:
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    spans = b.table("events").select(_key("e", "event_id").alias("addr"), F.when(F.col("event_type") == "view", "remote_cache_write").otherwise(F.col("event_type")).alias("phase"), at.alias("since_ms"))
    return aggregates.running_over(spans, 1_706_659_200_000, 864_000_000).select("addr", "phase", "since_ms", "elapsed_ms", "n_over")


@register(f"WITH {EVENTS}, w AS (SELECT addr, arg_max(type, (at_ms, seq)) AS type, arg_max(at_ms, (at_ms, seq)) AS since_ms FROM ev WHERE type IN ('local_hit', 'local_miss') GROUP BY 1), x AS (SELECT addr, since_ms FROM w WHERE type = 'local_hit' AND 1706659200000 - since_ms >= 3600000) SELECT *, (SELECT count(*) FROM x) AS n_over FROM x ORDER BY since_ms, addr LIMIT 10")
def q_lock_waits(b: Bridge) -> DataFrame:
    events = b.events()
    waits = events.withColumn("type", F.when(F.col("type") == "local_hit", "lock_wait_start").when(F.col("type") == "local_miss", "lock_wait_end").otherwise(F.col("type")))
    return aggregates.lock_waits(waits, 1_706_659_200_000, 3_600_000)


@register("WITH t AS (SELECT 'u' || user_id AS addr, event_type AS op, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total_ms FROM events GROUP BY 1, 2) SELECT addr, op, total_ms, CAST(coalesce(list_position(['signup', 'click', 'view', 'purchase'], op), 0) AS BIGINT) AS place FROM t WHERE total_ms >= 1000")
def q_operation_times(b: Bridge) -> DataFrame:
    spans = b.table("events").select(_key("u", "user_id").alias("addr"), F.col("event_type").alias("op"), F.floor(F.col("value") * 100).cast("long").alias("ms"))
    return aggregates.operation_times(spans, ["signup", "click", "view", "purchase"])


@register(f"WITH {EVENTS} SELECT max(at_ms) - arg_min(at_ms, seq) AS elapsed_ms FROM ev")
def q_elapsed(b: Bridge) -> DataFrame:
    return aggregates.elapsed(b.events())


@register(f"WITH {EVENTS} SELECT count(DISTINCT addr) FILTER (type = 'result_end') AS done, count(DISTINCT addr) FILTER (type IN ('result_start', 'result_end')) AS total FROM ev")
def q_seen_counts(b: Bridge) -> DataFrame:
    return aggregates.seen_counts(b.events())


@register(f"WITH {EVENTS}, m AS (SELECT regexp_replace(regexp_extract(addr, '^(.*):[^:]*$', 1), '^//', '') AS package, count(*) AS misses FROM ev WHERE type = 'local_miss' GROUP BY 1) SELECT *, (SELECT count(*) FROM m) AS n_packages FROM m ORDER BY misses DESC, package LIMIT 3")
def q_most_misses(b: Bridge) -> DataFrame:
    return aggregates.misses_by_package(b.events(), most=3)


@register(f"""WITH {EVENTS}, c AS (SELECT 'executed' AS counter, CAST(sum(ok) AS BIGINT) AS total FROM rec UNION ALL SELECT 'cached_local', count(*) FILTER (cached = 'local_hit') FROM rec UNION ALL SELECT 'cached_remote', count(*) FILTER (cached = 'remote_hit') FROM rec
UNION ALL SELECT 'miss_local', CAST(sum(ml) AS BIGINT) FROM rec UNION ALL SELECT 'miss_remote', CAST(sum(mr) AS BIGINT) FROM rec UNION ALL SELECT 'blocked', CAST(sum(blocked) AS BIGINT) FROM rec UNION ALL SELECT 'roots', count(DISTINCT CASE WHEN own THEN addr END) FROM rec
UNION ALL SELECT 'finished', count(*) FILTER (ran AND ended IS NOT NULL AND failed IS NULL) FROM rec) SELECT * FROM c WHERE total <> 0""")
def q_stream_counters(b: Bridge) -> DataFrame:
    changes = fold.run_available(fold.fold_stream(b.events(b.stream("events"))), "fold")
    return changes.groupBy("counter").agg(F.sum("delta").alias("total")).where("total <> 0")


@register(f"WITH {EVENTS} SELECT type, count(*) AS n FROM ev GROUP BY 1")
def q_stream_type_counts(b: Bridge) -> DataFrame:
    return fold.run_available(fold.type_counts(b.events(b.stream("events"))), "types").groupBy("type").agg(F.max("n").alias("n"))


# Stores


@register("SELECT 'p' || p_partkey AS addr, CAST(p_size % 3 * CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS history FROM part")
def q_effective_history(b: Bridge) -> DataFrame:
    targets = b.table("part").select(_key("p", "p_partkey").alias("addr"), (F.col("p_size") % 3).alias("cache_history"), F.when(F.col("p_size") % 2 == 0, "in_place").otherwise("copy").alias("codegen"))
    return store.effective_history(targets, targets)


@register(f"WITH {REVISIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY addr ORDER BY created_at_ns DESC, hashin) AS k FROM revisions) SELECT addr, hashin FROM r WHERE k <= 1 OR size >= 49")
def q_trim_after_write(b: Bridge) -> DataFrame:
    revisions = b.revisions()
    return store.keep_newest(revisions, 1, revisions.where("size >= 49")).where("keep").select("addr", "hashin")


_ARTIFACTS = "artifacts AS (SELECT 'o' || l_orderkey AS addr, l_shipdate AS hashin, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS name, l_returnflag AS g, CASE WHEN l_linenumber = 7 THEN 'log' WHEN l_linestatus = 'F' THEN 'support' ELSE 'output' END AS type FROM lineitem)"


def _artifacts(b: Bridge) -> DataFrame:
    kind = F.when(F.col("l_linenumber") == 7, "log").when(F.col("l_linestatus") == "F", "support").otherwise("output")
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")))
    return b.table("lineitem").select(_key("o", "l_orderkey").alias("addr"), F.col("l_shipdate").alias("hashin"), name.alias("name"), F.col("l_returnflag").alias("group"), kind.alias("type"))


@register(f"WITH {_ARTIFACTS} SELECT addr, name FROM artifacts WHERE type = 'support' OR (type = 'output' AND g IN ('R', 'A'))")
def q_needed_artifacts(b: Bridge) -> DataFrame:
    return store.needed_artifacts(_artifacts(b), ["R", "A"]).select("addr", "name")


@register(f"WITH {_ARTIFACTS} SELECT addr, name FROM artifacts a WHERE type = 'support' AND NOT EXISTS (SELECT 1 FROM artifacts o WHERE o.addr = a.addr AND o.hashin = a.hashin AND o.type = 'output')")
def q_needed_without_names(b: Bridge) -> DataFrame:
    return store.needed_artifacts(_artifacts(b), []).select("addr", "name")


@register(f"WITH {_ARTIFACTS} SELECT addr, name FROM artifacts WHERE (type = 'support' OR (type = 'output' AND g = 'N')) AND NOT starts_with(name, '1-')")
def q_missing_blobs(b: Bridge) -> DataFrame:
    artifacts = _artifacts(b)
    return store.missing_blobs(store.needed_artifacts(artifacts, ["N"]), artifacts.where("startswith(name, '1-')")).select("addr", "name")


def _files(b: Bridge) -> DataFrame:
    return b.table("documents").select(_key("d/", "doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 10).alias("mtime_ns"), F.lit("fresh").alias("hashout"), F.col("doc_id").alias("accessed_ns"))


@register("SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'cached' ELSE 'fresh' END AS hashout, doc_id % 3 = 0 AS valid FROM documents")
def q_cached_hashes(b: Bridge) -> DataFrame:
    mine = _files(b)
    third = F.substring("path", 3, 20).cast("long") % 3
    cache = mine.where(third != 2).select("path", "size", (F.col("mtime_ns") + third).alias("mtime_ns"), F.lit("cached").alias("hashout"))
    return store.cached_hashes(mine, cache).select("path", "hashout", "valid")


@register("SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'a,b' END AS listing, doc_id % 2 = 0 AS valid FROM documents")
def q_cached_listings(b: Bridge) -> DataFrame:
    dirs = _files(b).select("path", "mtime_ns")
    odd = F.col("mtime_ns") / 10 % 2
    return store.cached_listings(dirs, dirs.select("path", (F.col("mtime_ns") + odd).cast("long").alias("mtime_ns"), F.lit("a,b").alias("listing"))).select("path", "listing", "valid")


@register("SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 99 ELSE doc_id END AS accessed_ns FROM documents")
def q_touch(b: Bridge) -> DataFrame:
    mine = _files(b)
    return store.touch(mine, mine.where("accessed_ns % 2 = 0"), 99).select("path", F.col("accessed_ns").cast("long").alias("accessed_ns"))


@register("SELECT 'd/' || doc_id AS path FROM documents WHERE doc_id % 5 <> 0")
def q_prune_gone(b: Bridge) -> DataFrame:
    mine = _files(b)
    return store.prune_gone(mine, mine.where("accessed_ns % 5 <> 0")).select("path")


@register("WITH m AS (SELECT event_type AS cache, quantile_cont(CASE WHEN event_type <> 'error' THEN value END, 0.5) AS median_ms FROM events GROUP BY 1) SELECT cache, round(median_ms, 6) AS median_ms, CAST(row_number() OVER (ORDER BY median_ms NULLS LAST, cache) AS INTEGER) AS place FROM m")
def q_read_order(b: Bridge) -> DataFrame:
    probes = b.table("events").select(F.col("event_type").alias("cache"), F.when(F.col("event_type") != "error", F.col("value")).alias("latency_ms"))
    return store.read_order(probes).select("cache", F.round("median_ms", 6).alias("median_ms"), "place")


# Configuration


@register("""WITH base AS (SELECT 'c' || c_custkey AS name, c_name AS uri, CASE WHEN c_custkey % 2 = 0 THEN false END AS r FROM customer WHERE c_custkey % 4 <> 3),
profile AS (SELECT 'c' || c_custkey AS name, CASE WHEN c_custkey % 2 = 1 THEN 'u' || c_custkey END AS uri, c_custkey % 6 = 0 AS w FROM customer WHERE c_custkey % 3 = 0)
SELECT name, coalesce(p.uri, b.uri) AS uri, coalesce(r, true) AS "read", coalesce(w, true) AS "write" FROM base b FULL JOIN profile p USING (name)""")
def q_overlay(b: Bridge) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("boolean")
    customers, name = b.table("customer"), _key("c", "c_custkey").alias("name")
    base = customers.where(k % 4 != 3).select(name, F.col("c_name").alias("uri"), F.when(k % 2 == 0, False).alias("read"), none.alias("write"))
    profile = customers.where(k % 3 == 0).select(name, F.when(k % 2 == 1, _key("u", "c_custkey")).alias("uri"), none.alias("read"), (k % 6 == 0).alias("write"))
    return hierarchy.with_defaults(hierarchy.overlay([base, profile]), {"read": True, "write": True}, ("uri",))


@register("""WITH e AS (SELECT 'c' || c_custkey AS name, c_custkey AS pos FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT 'c' || c_custkey AS name, c_custkey AS pos FROM customer WHERE c_custkey % 3 = 0)
SELECT name, coalesce(e.pos, (SELECT max(pos) + 1 FROM e) + n.pos) AS pos, CASE WHEN n.name IS NULL THEN 'old' ELSE 'new' END AS options FROM e FULL JOIN n USING (name)""")
def q_merge_lists(b: Bridge) -> DataFrame:
    rows = lambda n, options: b.table("customer").where(F.col("c_custkey") % n == 0).select(_key("c", "c_custkey").alias("name"), F.col("c_custkey").alias("pos"), F.lit(options).alias("options"))
    return hierarchy.merge_lists(rows(2, "old"), rows(3, "new"))


@register("SELECT 'n' || n_nationkey AS package, CAST(json_object('a', n_name, 'z', CAST(n_regionkey AS VARCHAR)) AS VARCHAR) AS json FROM nation")
def q_state_json(b: Bridge) -> DataFrame:
    state = F.create_map(F.lit("z"), F.col("n_regionkey").cast("string"), F.lit("a"), F.col("n_name"))
    return hierarchy.state_json(b.table("nation").select(_key("n", "n_nationkey").alias("package"), state.alias("state"))).select("package", "json")


_VARIANTS = f"{PATHS}, vs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS package, 'v' || (page_id % 3) AS name, CAST(min(page_id) AS BIGINT) AS page FROM pagepaths GROUP BY 1, 2)"


def _variants(b: Bridge) -> DataFrame:
    return b.url_paths().groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("package"), F.concat(F.lit("v"), (F.col("page_id") % 3).cast("string")).alias("name")).agg(F.min("page_id").cast("long").alias("page"))


@register(f"WITH {_VARIANTS}, up AS (SELECT DISTINCT path AS package, unnest({UP.format(x='path')}) AS declared_at FROM pagepaths) SELECT up.package, name, declared_at, page FROM up JOIN vs ON vs.package = declared_at QUALIFY row_number() OVER (PARTITION BY up.package, name ORDER BY length(declared_at) DESC) = 1")
def q_ancestry_variants(b: Bridge) -> DataFrame:
    return hierarchy.nearest(b.url_paths().select(F.col("path").alias("package")), _variants(b), by=["name"]).select("package", "name", "declared_at", "page")


@register(f"WITH {_VARIANTS}, host AS (SELECT min(split_part(package, '/', 1)) AS h FROM vs) SELECT package, name, page FROM vs, host WHERE package = h OR starts_with(package, h || '/')")
def q_variant_universe(b: Bridge) -> DataFrame:
    variants = _variants(b)
    host = variants.agg(F.min(F.split_part("package", F.lit("/"), F.lit(1)))).first()[0] or ""
    return hierarchy.universe(variants, host).select("package", "name", "page")


@register(f"WITH {_VARIANTS}, refs AS (SELECT package, 'v1' AS name FROM vs GROUP BY 1) SELECT refs.name, refs.package, vs.page, CASE WHEN vs.page IS NULL THEN 'variant v1 is not declared at ' || refs.package END AS error FROM refs LEFT JOIN vs USING (package, name)")
def q_pinned_variants(b: Bridge) -> DataFrame:
    variants = _variants(b)
    return hierarchy.pinned(variants.select(F.lit("v1").alias("name"), "package").distinct(), variants)


@register(f"WITH {_VARIANTS}, up AS (SELECT DISTINCT path AS package, unnest({UP.format(x='path')}) AS declared_at FROM pagepaths) SELECT up.package, declared_at, name, CASE declared_at WHEN '' THEN 0 ELSE len(string_split(declared_at, '/')) END AS depth FROM up JOIN vs ON vs.package = declared_at")
def q_listed_states(b: Bridge) -> DataFrame:
    packages = b.url_paths().select(F.col("path").alias("package"))
    return hierarchy.listed_states(packages, _variants(b)).select("package", "declared_at", "name", F.col("depth").cast("long").alias("depth"))


# Paths and files


@register(f"WITH {PATHS}, f AS (SELECT DISTINCT path, split_part(path, '/', 2) AS d, split_part(path, '/', 3) AS n FROM pagepaths WHERE regexp_matches(path, '^[^/]+/(fr|en)/[^/]+$')) SELECT path, CASE d WHEN 'fr' THEN 'x/' || n ELSE 'x/' || path END AS dst FROM f")
def q_path_transform_in_package(b: Bridge) -> DataFrame:
    files = b.url_paths().select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("package")).distinct().where("package <> ''")
    return outputs.PathTransform(include=("fr/*", "en/*"), strip_prefix="fr", prefix="x").apply(files).select("path", "dst")


@register(f"""WITH {PATHS}, f AS (SELECT DISTINCT path FROM pagepaths), d AS (SELECT path, CASE WHEN path IN (SELECT min(path) FROM f UNION ALL SELECT max(path) FROM f) THEN 'o/a.txt' ELSE path END AS dst FROM f)
SELECT 'collision' AS problem, dst AS detail FROM d GROUP BY dst HAVING count(*) > 1 UNION ALL SELECT 'unknown rename', 'zz' WHERE 'zz' NOT IN (FROM f) UNION ALL SELECT 'unused strip_prefix', 'q' WHERE NOT EXISTS (FROM f WHERE starts_with(path, 'q/'))""")
def q_path_transform_problems(b: Bridge) -> DataFrame:
    files = b.url_paths().select("path").distinct()
    first, last = files.agg(F.min("path"), F.max("path")).first()
    move = outputs.PathTransform(rename=((first, "o/a.txt"), (last, "o/a.txt"), ("zz", "y")), strip_prefix="q")
    return move.problems(files)


@register(f"WITH {OUTPUTS} SELECT DISTINCT '/' || CASE kind WHEN 'dir' THEN trim(path, '/') ELSE ltrim(path, '/') END AS pattern, '//' || split_part(path, '/', 2) || ':x' AS addr FROM outs WHERE codegen = 'copy' AND split_part(path, '/', 2) <> 'fr' UNION SELECT '/kept', NULL UNION SELECT '/new', '//fr:x'")
def q_merge_section(b: Bridge) -> DataFrame:
    outs = outputs_of(b).withColumn("addr", F.concat(F.lit("//"), F.split_part("path", F.lit("/"), F.lit(2)), F.lit(":x")))
    schema = "pattern string, addr string"
    old = outputs.ignore_patterns(outs).union(b.spark.createDataFrame([("/kept", None)], schema))
    return outputs.merge_section(old, b.spark.createDataFrame([("/new", "//fr:x")], schema), "fr")


@register(f"WITH {PATHS}, up AS (SELECT DISTINCT path AS package, unnest({UP.format(x='path')}) AS dir FROM pagepaths), held AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir, true AS h FROM pagepaths WHERE regexp_matches(path, '/(fr|de)/[^/]*$')) SELECT package, arg_max(dir, length(dir)) FILTER (h) || '/BUILD' AS parent FROM up LEFT JOIN held USING (dir) GROUP BY 1")
def q_parent_with(b: Bridge) -> DataFrame:
    p = b.url_paths()
    files = p.where(F.col("path").rlike("/(fr|de)/[^/]*$")).select(F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/BUILD")).alias("path"))
    return file_sources.parent_with(p.select(F.col("path").alias("package")), files, "BUILD")


@register(f"WITH {PATHS} SELECT DISTINCT path, regexp_matches(path, '^[^/]*/fr/[^/]*$') OR path = 'a/b' OR starts_with(path, 'a/b/') AS skipped FROM pagepaths")
def q_ignored(b: Bridge) -> DataFrame:
    return b.url_paths().select("path", file_sources.ignored("path", ("a/b",), ("*/fr/*",)).alias("skipped")).distinct()


@register(f"""WITH {PATHS}, p AS (SELECT DISTINCT path, {TIDY.format(x="path")} AS c FROM pagepaths)
SELECT path, CASE WHEN path = '' OR starts_with(path, '/') THEN '/' ELSE '' END || array_to_string(list_append(c[:-2], 'x'), '/') AS cleaned, array_to_string(list_prepend('top', c), '/') AS joined FROM p""")
def q_clean_and_join(b: Bridge) -> DataFrame:
    p = b.url_paths().select("path").distinct()
    return p.select("path", paths.clean(F.concat("path", F.lit("/.././x"))).alias("cleaned"), paths.join(F.lit("top/"), F.lit(""), "path").alias("joined"))


@register("""WITH t AS (SELECT o_orderkey AS k, o_orderkey * 7919 AS ms FROM orders), s AS (SELECT k, ms, ms // 1000 AS s FROM t),
w AS (SELECT k, ms, s, CASE WHEN s < 3600 THEN printf('%dm%02ds', s // 60, s % 60) WHEN s < 86400 THEN printf('%dh%02dm', s // 3600, s % 3600 // 60) ELSE printf('%dd%02dh', s // 86400, s % 86400 // 3600) END AS x FROM s)
SELECT k, CASE WHEN s < 60 THEN s || 's' ELSE lpad(x, greatest(length(x), 6)::INTEGER, ' ') END AS shown, CASE WHEN s < 60 THEN printf('%d.%03ds', s, ms % 1000) ELSE lpad(x, greatest(length(x), 6)::INTEGER, ' ') END AS exact FROM w""")
def q_human_elapsed(b: Bridge) -> DataFrame:
    t = b.table("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7919).alias("ms"))
    return t.select("k", paths.human_elapsed("ms").alias("shown"), paths.human_elapsed("ms", millis=True).alias("exact"))


@register("""WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '--' || p_partkey WHEN 2 THEN 'p' || p_partkey || '@v=1' ELSE repeat(p_brand, 20) END AS raw FROM part)
SELECT k, CASE WHEN regexp_full_match(raw, '[A-Za-z0-9._@=,-]+') AND length(raw) <= 96 AND raw NOT IN ('.', '..') AND NOT contains(raw, '--') THEN raw ELSE substr(regexp_replace(raw, '[^A-Za-z0-9._@=,-]', '_', 'g'), 1, 96) || '--' || substr(sha256(raw), 1, 16) END AS segment FROM t""")
def q_key_segment(b: Bridge) -> DataFrame:
    kind = F.col("p_partkey") % 4
    raw = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat("p_brand", F.lit("--"), F.col("p_partkey").cast("string"))).when(kind == 2, F.concat(_key("p", "p_partkey"), F.lit("@v=1"))).otherwise(F.repeat("p_brand", 20))
    return b.table("part").select(F.col("p_partkey").alias("k"), paths.key_segment(raw).alias("segment"))


@register("SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'gzip' WHEN 1 THEN 'webp' WHEN 2 THEN 'mp4' WHEN 3 THEN 'zip' END AS format FROM part")
def q_sniff(b: Bridge) -> DataFrame:
    heads = ["1F8B", "52494646000000005745425000", "0000002066747970", "504B0304", "74657874"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("p_partkey") % 5 + 1).cast("int"))
    content = F.concat(F.unhex(head), F.col("p_name").cast("binary"))
    return b.table("part").select(F.col("p_partkey").alias("k"), file_sources.sniff(content).alias("format"))


@register("SELECT doc_id, CASE WHEN n_chars <= 0 THEN 0 ELSE length(bin(n_chars)) END AS bucket, CASE WHEN n_chars <= 0 THEN 0 ELSE 9223372036854775807 >> CAST(63 - length(bin(n_chars)) AS INTEGER) END AS upper FROM documents WHERE n_chars IS NOT NULL")
def q_size_buckets(b: Bridge) -> DataFrame:
    d = b.table("documents").where("n_chars is not null").withColumn("bucket", paths.bit_bucket("n_chars"))
    return d.select("doc_id", F.col("bucket").cast("long").alias("bucket"), paths.bucket_upper(F.col("bucket")).alias("upper"))


@register("SELECT doc_id, CASE WHEN length(t) > 20 THEN substr(t, 1, 20) || '…' ELSE t END AS short, replace(replace(replace(t, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS line FROM (SELECT doc_id, text AS t FROM documents)")
def q_annotations(b: Bridge) -> DataFrame:
    return b.table("documents").select("doc_id", sinks.truncated("text", 20).alias("short"), sinks.escape_annotation("text").alias("line"))
