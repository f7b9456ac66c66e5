"""Further queries: orders and positions, providers, definitions, artifact lookups, maintenance and streams over several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import address, paths, tables
from loomgraph.operators import aggregates, graph, hierarchy, outputs, resolution, selection, store
from loomgraph.operators.staging import folder
from loomgraph.plans import catalog, query_language
from loomgraph.plans.catalog import Bridge
from loomgraph.plans.registry import EVENTS, INPUTS, OUTPUTS, PATHS, REVISIONS, TARGETS, UP, doomed_of, outputs_of, register
from loomgraph.sources import files as file_sources
from loomgraph.sources import sinks
from loomgraph.streaming import fold


def _key(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


# Order


@register(f"""WITH {TARGETS}, found AS (SELECT DISTINCT package, provider_ord, addr FROM targets WHERE list_contains(labels, 'F') OR package LIKE 'parts/%')
SELECT package, provider_ord, addr, row_number() OVER (ORDER BY package, provider_ord, addr) - 1 AS position FROM found""")
def q_query_order(b: Bridge) -> DataFrame:
    found = query_language.query(b.targets(), "label(F) || //parts/...")
    return selection.positions(found.select(*query_language.ORDER), list(query_language.ORDER))


@register(f"""WITH {TARGETS}, l AS (SELECT DISTINCT unnest(labels) AS label FROM targets) SELECT label, row_number() OVER (ORDER BY label) - 1 AS position FROM l""")
def q_label_order(b: Bridge) -> DataFrame:
    return selection.positions(selection.labels(b.targets()), [F.col("label").cast("binary")])


@register(f"""WITH {TARGETS}, p AS (SELECT DISTINCT provider_ord, package FROM targets) SELECT *, row_number() OVER (ORDER BY provider_ord, package) - 1 AS position FROM p""")
def q_package_order(b: Bridge) -> DataFrame:
    return selection.package_order(b.targets())


@register(f"""WITH {OUTPUTS}, m AS (SELECT DISTINCT regexp_replace(path, '/+$', '') AS path, addr, driver FROM outs WHERE codegen = 'copy'),
o AS (SELECT DISTINCT a.path, a.addr, b.path AS other_path, b.addr AS other_addr FROM m a JOIN m b ON a.addr <> b.addr AND ((a.path = b.path AND a.addr < b.addr) OR starts_with(a.path, b.path || '/')) WHERE NOT (a.driver = 'fs' AND b.driver = 'fs'))
SELECT *, row_number() OVER (ORDER BY string_split(path, '/'), addr, string_split(other_path, '/'), other_addr) - 1 AS position FROM o""")
def q_overlap_order(b: Bridge) -> DataFrame:
    order = [outputs.by_components("path"), "addr", outputs.by_components("other_path"), "other_addr"]
    return selection.positions(outputs.overlaps(outputs_of(b)), order)


@register(f"""WITH {OUTPUTS}, m AS (SELECT DISTINCT regexp_replace(path, '/+$', '') AS path, addr FROM outs WHERE codegen = 'copy')
SELECT path, string_agg(addr, ',' ORDER BY addr) AS owners, count(*) AS n_owners FROM m GROUP BY path HAVING count(*) > 1""")
def q_shared_paths(b: Bridge) -> DataFrame:
    return outputs.shared_paths(outputs_of(b)).select("path", F.array_join("owners", ",").alias("owners"), "n_owners")


# Providers and definitions


@register(f"WITH {TARGETS} SELECT DISTINCT addr, provider_ord FROM targets WHERE package LIKE 'parts/%' OR list_contains(labels, 'BUILDING')")
def q_unavailable_skipped(b: Bridge) -> DataFrame:
    """Earlier providers list the same targets, and turn out not to have them or to run in a circle."""
    t = b.targets().withColumn("status", F.lit("ok"))
    lost = t.withColumns({"status": F.when(F.col("package").startswith("parts"), "not_found").otherwise("cyclic"), "provider_ord": F.lit(-1)})
    return query_language.query(t.unionByName(lost), "//parts/... || label(BUILDING)").select("addr", "provider_ord")


@register(f"WITH {TARGETS} SELECT 'p' || p_partkey AS name, CASE WHEN p_size <= 25 THEN 1 END AS provider_ord, CASE WHEN p_size > 25 THEN 'no provider has ' || addr END AS error FROM part JOIN targets ON name = 'p' || p_partkey")
def q_specs_of_wanted(b: Bridge) -> DataFrame:
    t = b.targets().where("provider = 'parts'")
    size = b.table("part").select(_key("p", "p_partkey").alias("name"), "p_size")
    t = t.join(size, "name").withColumn("status", F.when(F.col("p_size") > 25, "not_found").otherwise("ok"))
    return selection.resolve_specs(t, t).select(F.split_part("addr", F.lit(":"), F.lit(2)).alias("name"), "provider_ord", "error")


@register(f"WITH {TARGETS} SELECT DISTINCT addr FROM targets WHERE package LIKE 'world/A%' AND NOT (package = 'world/AFRICA' OR package LIKE 'world/AFRICA/%') AND list_contains(labels, 'BUILDING')")
def q_pruned_packages(b: Bridge) -> DataFrame:
    """Packages are listed under the prefix that the query narrows to, and chosen by what it says of a package alone."""
    node = query_language.parse("//world/... && !//world/AFRICA/... && label(BUILDING)")
    listed = selection.package_scan(b.targets(), query_language.narrowing_prefix(node))
    packages = listed.where(query_language.package_filter(node) & F.col("package").startswith("world/A")).select("package")
    return query_language.query(b.targets().join(packages, "package", "left_semi"), "label(BUILDING)").select("addr")


@register("""SELECT 'world/' || r_name AS package, 'n' || n_nationkey AS name, 'go' AS driver FROM (SELECT n_nationkey, regexp_replace(r_name, '[ #:]', '_', 'g') AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def q_provider_tables(b: Bridge) -> DataFrame:
    places = b.table("nation").join(b.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = places.select(F.concat(F.lit("world/"), F.regexp_replace("r_name", "[ #:]", "_")), _key("n", "n_nationkey"), F.lit("go")).collect()  # a nation each
    packages, listing, _ = tables.register_provider(b.spark, "places", tables.StaticProvider([tuple(r) for r in rows]))
    return b.spark.sql(f"SELECT p.package, t.name, t.driver FROM {packages}('world') p, LATERAL {listing}(p.package) t")


@register("SELECT 'n' || n_nationkey AS name, n_name AS value FROM nation WHERE n_regionkey < 3")
def q_provider_probe(b: Bridge) -> DataFrame:
    states = [(f"n{r.n_nationkey}", "name", r.n_name) for r in b.table("nation").collect() if r.n_regionkey < 3]  # a nation each
    probe = tables.register_provider(b.spark, "nations", tables.StaticProvider([], states))[2]
    b.table("nation").select(_key("n", "n_nationkey").alias("name")).createOrReplaceTempView("asked_nations")
    return b.spark.sql(f"SELECT a.name, p.value FROM asked_nations a, LATERAL {probe}(a.name) p")


@register(f"""WITH {INPUTS}, m AS (SELECT i.addr, g.dep_addr, i.pos FROM inputs i JOIN inputs g ON g.addr = i.dep_addr WHERE i.addr LIKE 'o%' UNION ALL SELECT addr, dep_addr, 1 FROM inputs WHERE dep_addr LIKE 'p%'),
f AS (SELECT addr, dep_addr, min(pos) AS place FROM m GROUP BY 1, 2) SELECT addr, dep_addr, row_number() OVER (PARTITION BY addr ORDER BY place, dep_addr) - 1 AS pos FROM f""")
def q_resolved_deps(b: Bridge) -> DataFrame:
    i = b.inputs()
    inputs = i.select("addr", "pos", "dep_addr", F.lit("standard").alias("mode"), F.lit(True).alias("runtime"), F.create_map().cast("map<string,string>").alias("annotations"))
    groups = i.select("addr").distinct().select("addr", F.substring("addr", 1, 1).isin("c", "s").alias("transparent"))
    return graph.resolved_deps(inputs, groups)


@register(f"""WITH {OUTPUTS}, specs AS (SELECT '//:p' || page_id AS addr, page_id FROM pages),
d AS (SELECT addr, 'history' AS kind, 0 AS place, CAST((page_id % 3) * CASE WHEN page_id % 3 = 2 THEN 2 ELSE 1 END AS VARCHAR) AS value FROM specs)
SELECT * FROM d UNION ALL SELECT addr, 'input', 0, CASE kind WHEN 'file' THEN 'file:' || path WHEN 'dir' THEN 'glob:' || rtrim(path, '/') || '/**/*' ELSE 'glob:' || path END FROM outs
UNION ALL SELECT addr, 'input', 1, '//:p' || (page_id - 1) FROM specs
UNION ALL SELECT addr, 'tool', NULL, 'bin' || (page_id - 1) FROM specs WHERE '//:p' || (page_id - 1) IN (SELECT addr FROM specs) AND (page_id - 1) % 2 = 0""")
def q_definitions(b: Bridge) -> DataFrame:
    """Pages as targets that read their own outputs and the page before them, which may hand on a tool."""
    page = F.col("page_id")
    targets = b.table("pages").select(_key("//:p", "page_id").alias("addr"), F.lit("exec").alias("driver"), F.lit(0).alias("provider_ord"), (page % 3).alias("cache_history"))
    pair = lambda pos, dep: F.struct(F.lit(pos).alias("pos"), dep.alias("dep_addr"))
    both = F.explode(F.array(pair(0, F.lit(graph.OWN_OUTPUTS)), pair(1, F.concat(F.lit("//:p"), (page - 1).cast("string")))))
    inputs = b.table("pages").select(_key("//:p", "page_id").alias("addr"), both.alias("i")).select("addr", "i.*", F.lit(True).alias("runtime"))
    tools = b.table("pages").where("page_id % 2 = 0").select(_key("//:p", "page_id").alias("addr"), F.lit("tool").alias("kind"), _key("bin", "page_id").alias("key"), F.lit(None).cast("string").alias("mode"), _key("bin", "page_id").alias("value"))
    definitions, rows = resolution.resolve_definitions(targets, inputs, outputs_of(b), tools)
    history = definitions.select("addr", F.lit("history").alias("kind"), F.lit(0).alias("place"), F.col("history").cast("string").alias("value"))
    return history.unionByName(rows.withColumnRenamed("dep_addr", "value"))


@register("SELECT 'p' || p_partkey AS k, '//' || p_brand || ':build' || CASE WHEN p_size % 2 = 0 THEN '@v=' || p_type ELSE '' END AS built, p_brand AS package, CASE WHEN p_size % 2 = 0 THEN p_type END AS variant FROM part")
def q_build_address(b: Bridge) -> DataFrame:
    built = address.build_address(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("")))
    rows = b.table("part").select(_key("p", "p_partkey").alias("k"), built.alias("built"))
    parsed = address.parsed_address(F.col("built"))
    return rows.select("k", "built", parsed["package"].alias("package"), parsed["args"]["v"].alias("variant"))


# Stores


@register(f"""WITH {INPUTS}, f AS (SELECT addr, dep_addr, min(pos) AS pos FROM inputs WHERE dep_addr LIKE 'p%' GROUP BY 1, 2)
SELECT addr, dep_addr, name, row_number() OVER (PARTITION BY addr ORDER BY pos, dep_addr, name) - 1 AS position FROM f JOIN (SELECT 'p' || p_partkey AS dep_addr, p_name AS name FROM part UNION ALL SELECT 'p' || p_partkey, p_type FROM part WHERE p_size > 40) USING (dep_addr)""")
def q_group_artifacts(b: Bridge) -> DataFrame:
    part = b.table("part")
    artifacts = part.select(_key("p", "p_partkey").alias("addr"), F.col("p_name").alias("name")).unionByName(part.where("p_size > 40").select(_key("p", "p_partkey").alias("addr"), F.col("p_type").alias("name")))
    return selection.group_artifacts(b.inputs().where("dep_addr like 'p%'"), artifacts).select("addr", "dep_addr", "name", "position")


@register(f"WITH {REVISIONS}, gone AS (SELECT 'p' || p_partkey AS addr FROM part WHERE p_type = 'ECONOMY'), r AS (SELECT * FROM revisions WHERE addr IN (FROM gone)) SELECT (SELECT count(*) FROM r) AS removed, (SELECT count(DISTINCT addr) FROM r) AS addrs, (SELECT count(*) FROM r) AS artifacts, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM r) AS bytes")
def q_clean_totals(b: Bridge) -> DataFrame:
    revisions = b.revisions()
    gone = b.table("part").where("p_type = 'ECONOMY'").select(_key("p", "p_partkey").alias("addr"))
    return store.clean_totals(revisions.select("addr", "hashin"), revisions.select("addr", "hashin", "size"), gone)


@register("""WITH s AS (SELECT 'file' AS kind, 'd/' || doc_id AS item FROM documents WHERE doc_id >= 100 UNION ALL SELECT 'staged', 'e/' || event_id FROM events)
SELECT kind, count(*) AS n, min(item) AS first FROM s GROUP BY 1 UNION ALL SELECT 'revision', (SELECT count(*) FROM (WITH """ + f"{REVISIONS}" + """, specs AS (SELECT 'p' || p_partkey AS addr, CASE WHEN p_size % 10 = 0 THEN 'error' ELSE 'ok' END AS status, 2 + p_size % 2 AS history FROM part WHERE p_size <= 25)
SELECT r.addr FROM (SELECT *, row_number() OVER (PARTITION BY addr ORDER BY created_at_ns DESC, hashin) AS k FROM revisions) r LEFT JOIN specs USING (addr) WHERE status IS NULL OR (status = 'ok' AND k > history))), NULL""")
def q_collect_all(b: Bridge) -> DataFrame:
    revisions, _, specs = doomed_of(b)
    files = b.table("documents").select(_key("d/", "doc_id").alias("path"), F.col("doc_id").alias("accessed_ns"))
    staged = b.table("events").select(_key("e/", "event_id").alias("path"))
    doomed, left, cleared = store.collect_all(revisions.select("addr", "hashin", "created_at_ns"), revisions.select("addr", "hashin", "size"), specs, files, 100, staged)
    total = lambda kind, frame, first: frame.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), first.alias("first"))
    return total("revision", doomed, F.lit(None).cast("string")).unionByName(total("file", left, F.min("path"))).unionByName(total("staged", cleared, F.min("path")))


_DATA = "a AS (SELECT 'd/' || source || ':' || lang AS addr, coalesce(lang, '') AS hashin, 'd' || doc_id AS name, encode(coalesce(text, '')) AS data FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"


def _data(b: Bridge) -> DataFrame:
    d = b.table("documents").where("source is not null and lang is not null")
    return d.select(F.concat(F.lit("d/"), "source", F.lit(":"), "lang").alias("addr"), F.col("lang").alias("hashin"), _key("d", "doc_id").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))


@register("SELECT 1 AS found FROM documents WHERE doc_id = 7 AND lang IS NOT NULL AND source IS NOT NULL")
def q_point_lookup(b: Bridge) -> DataFrame:
    row = b.table("documents").where("doc_id = 7").select("source", "lang").first()
    return store.lookup(_data(b), f"d/{row.source}:{row.lang}" if row else "", row.lang if row else "", "d7")


@register(f"WITH {_DATA} SELECT addr, hashin, name, CAST(octet_length(data) AS BIGINT) AS size FROM a")
def q_artifact_sizes(b: Bridge) -> DataFrame:
    return store.sizes_of(_data(b))


@register(f"WITH {_DATA} SELECT name, hex(CASE WHEN octet_length(data) > 100 THEN array_slice(data, 101, 164) ELSE ''::BLOB END) AS part FROM a")
def q_artifact_ranges(b: Bridge) -> DataFrame:
    return store.ranges(_data(b), 100, 64).select("name", F.hex("part").alias("part"))


@register(f"WITH {_DATA} SELECT DISTINCT hashin FROM a WHERE addr = (SELECT min(addr) FROM a)")
def q_hashes_of_address(b: Bridge) -> DataFrame:
    data = _data(b)
    return store.hashes_of(data, data.agg(F.min("addr")).first()[0] or "")


@register(f"WITH {_DATA} SELECT regexp_replace(addr, ':[^:]*$', '') AS package, count(*) AS n FROM a GROUP BY 1")
def q_store_by_package(b: Bridge) -> DataFrame:
    """Artifacts written in a folder for each package, and read back."""
    path = folder(b.spark, "store")
    store.write_artifacts(_data(b), path)
    return b.spark.read.schema("addr string, hashin string, name string, data binary, package string").parquet(path).groupBy("package").agg(F.count("*").alias("n"))


@register("SELECT event_id AS id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY event_id LIMIT 50)")
def q_spool_delete(b: Bridge) -> DataFrame:
    spool = b.table("events").select(F.col("event_id").alias("id"), "event_type")
    return store.delete_batch(spool, store.next_batch(spool))


# Failures, phases and streams over several batches


@register(f"""WITH {INPUTS}, f AS (SELECT DISTINCT addr FROM inputs WHERE addr LIKE '%7'), s AS (SELECT addr FROM f WHERE addr LIKE '%17'), own AS (SELECT addr FROM f WHERE addr NOT IN (FROM s)), r AS (SELECT DISTINCT i.addr FROM inputs i JOIN own ON own.addr = i.dep_addr)
SELECT own.addr, CASE WHEN r.addr IS NULL THEN 'own' ELSE 'collateral' END AS class FROM own LEFT JOIN r USING (addr) UNION ALL SELECT addr, 'cancelled' FROM s""")
def q_failure_classes(b: Bridge) -> DataFrame:
    inputs = b.inputs()
    failed = inputs.where("addr like '%7'").select("addr")
    return graph.failure_roots(inputs, failed, failed.where("addr like '%17'")).select("addr", "class")


_PHASES = f"""{EVENTS}, ph AS (SELECT addr, at_ms, seq, CASE WHEN type IN ('remote_hit', 'execute_end') THEN 'remote_cache_write' ELSE 'execute' END AS phase, type IN ('local_hit', 'remote_hit') AS open FROM ev WHERE type IN ('local_hit', 'local_miss', 'remote_hit', 'execute_end')),
spans AS (SELECT addr, phase, arg_max(open, (at_ms, seq)) AS open, arg_max(at_ms, (at_ms, seq)) AS since_ms FROM ph GROUP BY 1, 2)"""


def _phases(events: DataFrame) -> DataFrame:
    kind = F.col("type")
    rows = events.where(kind.isin("local_hit", "local_miss", "remote_hit", "execute_end"))
    phase = F.when(kind.isin("remote_hit", "execute_end"), "remote_cache_write").otherwise("execute")
    return rows.select("addr", "at_ms", "seq", phase.alias("phase"), F.when(kind.isin("local_hit", "remote_hit"), "phase_start").otherwise("phase_end").alias("type"))


@register(f"WITH {_PHASES}, x AS (SELECT addr, phase, since_ms, 1706659200000 - since_ms AS elapsed_ms FROM spans WHERE open AND phase <> 'remote_cache_write' AND 1706659200000 - since_ms >= 3600000) SELECT *, (SELECT count(*) FROM x) AS n_over FROM x ORDER BY elapsed_ms DESC, addr LIMIT 10")
def q_open_phases(b: Bridge) -> DataFrame:
    spans = aggregates.open_spans(_phases(b.events())).where("open")
    return aggregates.running_over(spans, 1_706_659_200_000, 3_600_000).select("addr", "phase", "since_ms", "elapsed_ms", "n_over")


@register(f"WITH {_PHASES} SELECT addr, phase, open, since_ms FROM spans")
def q_stream_phases(b: Bridge) -> DataFrame:
    """Spans over a stream whose batches bring events in any order."""
    stream = b.events(b.scattered("events", "event_id"))
    return fold.latest(fold.run_available(aggregates.open_spans(_phases(stream)), "phases"), ["addr", "phase"])


@register(f"WITH {EVENTS} SELECT addr, bool_or(type = 'result_end') AS complete FROM ev GROUP BY 1")
def q_stream_matched(b: Bridge) -> DataFrame:
    stream = b.events(b.scattered("events", "event_id"))
    announced = stream.select("addr", (F.col("type") == "result_end").alias("complete"))
    return fold.latest(fold.run_available(fold.matched_set(announced), "matched"), ["addr"])


@register(f"WITH {EVENTS} SELECT type, count(*) AS n FROM ev GROUP BY 1")
def q_stream_refreshed(b: Bridge) -> DataFrame:
    """A report that is rendered anew while the stream runs; the last rendering has it all."""
    shown: dict[str, int] = {}
    running = fold.refresh(fold.type_counts(b.events(b.scattered("events", "event_id"))), lambda rows, _: shown.update({r.type: r.n for r in rows.collect()}), "refreshed", 1)  # a row for each type
    running.processAllAvailable()
    running.stop()
    return b.spark.createDataFrame(list(shown.items()), "type string, n long")


@register(f"""WITH {EVENTS} SELECT addr, ended - started AS duration_ms, count(*) AS n FROM rec WHERE ran AND ended IS NOT NULL AND failed IS NULL GROUP BY ALL""")
def q_stream_durations(b: Bridge) -> DataFrame:
    changes = fold.run_available(fold.fold_stream(b.events(b.stream("events"))), "fold")
    return changes.where("counter = 'finished'").groupBy("addr", "duration_ms").agg(F.count("*").alias("n"))


# Reports


@register(f"""WITH {EVENTS}, t AS (SELECT CAST(sum(ok) AS BIGINT) AS executed, count(*) FILTER (cached = 'local_hit') AS cached_local, count(*) FILTER (cached = 'remote_hit') AS cached_remote FROM rec)
SELECT '| executed | cached_local | cached_remote |' AS line, 0 AS place UNION ALL SELECT '| --- | --- | --- |', 1 UNION ALL SELECT '| ' || executed || ' | ' || cached_local || ' | ' || cached_remote || ' |', 2 FROM t""")
def q_comment_table(b: Bridge) -> DataFrame:
    return sinks.markdown_table(aggregates.counters(b.events()).select("executed", "cached_local", "cached_remote"))


@register(f"WITH {EVENTS}, t AS (SELECT CAST(sum(ok) AS BIGINT) AS executed, CAST(sum(ml) AS BIGINT) AS misses FROM rec) SELECT 'executed=' || executed AS line FROM t UNION ALL SELECT 'miss_local=' || misses FROM t")
def q_step_outputs(b: Bridge) -> DataFrame:
    return sinks.step_outputs(aggregates.counters(b.events()).select("executed", "miss_local"))


@register("SELECT 'o' || o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN './x' || o_orderkey WHEN o_orderkey % 3 = 1 THEN '../b/x' ELSE '../c/d/e/f' END AS shown FROM orders")
def q_relative_packages(b: Bridge) -> DataFrame:
    k = F.col("o_orderkey")
    package = F.when(k % 3 == 0, F.concat(F.lit("a/x"), k.cast("string"))).when(k % 3 == 1, "b/x").otherwise("c/d/e/f")
    return b.table("orders").select(_key("o", "o_orderkey").alias("k"), package.alias("package")).select("k", selection.relative("a").alias("shown"))


@register(f"WITH {TARGETS} SELECT package, count(*) AS n FROM (SELECT DISTINCT package, name FROM targets) WHERE package = 'world' OR starts_with(package, 'world/') GROUP BY 1")
def q_selected_under(b: Bridge) -> DataFrame:
    found = query_language.select(b.targets(), label="all", under="//world/...")
    return found.groupBy("package").agg(F.count("*").alias("n"))


@register("SELECT path, starts_with(path || '/', base || '/') OR base = '' AS inside FROM (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS base FROM pages)")
def q_prefix_columns(b: Bridge) -> DataFrame:
    p = b.url_paths().select("path", F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(1)).alias("base")).distinct()
    return p.select("path", paths.has_prefix("path", F.col("base")).alias("inside"))


@register(f"WITH {TARGETS} SELECT DISTINCT addr FROM targets WHERE CAST('0x' || substr(md5(package || '|3'), 1, 8) AS BIGINT) % 1000000 < 250000")
def q_incremental_change(b: Bridge) -> DataFrame:
    return graph.touched(b.targets(), 0.25, seed=3).select("addr").distinct()


@register("SELECT doc_id, doc_id % 2 = 0 AS intact FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def q_verified_content(b: Bridge) -> DataFrame:
    """Half of the documents come with the digest of their text, in capitals, the others with that of another one."""
    d = b.table("documents").where("text is not null and lang is not null")
    content = F.col("text").cast("binary")
    digest = F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2(content, 256))).otherwise(F.sha2(F.concat("text", F.lit("x")).cast("binary"), 256))
    return d.select("doc_id", file_sources.verified(content, digest).alias("intact"))


@register(f"WITH {TARGETS} SELECT DISTINCT addr, package, labels[1] AS first_label FROM targets WHERE package LIKE 'parts/%'")
def q_catalog_at_rest(b: Bridge) -> DataFrame:
    """Targets written as JSON, loaded with their schema and queried."""
    root = folder(b.spark, "catalog")
    query_language.query(b.targets(), "//parts/...").write.json(f"{root}/targets")
    found = query_language.query(catalog.load(b.spark, root, "targets", "json"), "//parts/...")
    return found.select("addr", "package", F.col("labels")[0].alias("first_label"))


@register("SELECT '//static/' || n_regionkey || ':n' || n_nationkey AS addr, 'static/' || n_regionkey AS package FROM nation WHERE n_nationkey % 2 = 0")
def q_static_targets(b: Bridge) -> DataFrame:
    """A fixed list as a provider's targets; a label picks every second one."""
    rows = [(f"//static/{r.n_regionkey}:n{r.n_nationkey}", f"static/{r.n_regionkey}", f"n{r.n_nationkey}", "exec", "static", 0, ["even"] if r.n_nationkey % 2 == 0 else [], False, True, 1, "x") for r in b.table("nation").collect()]  # a nation each
    return query_language.query(catalog.relation(b.spark, "targets", rows), "//static/... && label(even)").select("addr", "package")


@register(f"""WITH {PATHS}, vs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS package, 'v' || (page_id % 3) AS name, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS provider, min(page_id) AS page FROM pagepaths GROUP BY 1, 2, 3)
SELECT package, name, CAST(page AS BIGINT) AS page FROM vs WHERE provider = 'even'""")
def q_own_states(b: Bridge) -> DataFrame:
    """States declared at a package itself, by one provider."""
    package, provider = F.regexp_replace("path", "/[^/]*$", "").alias("package"), F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd").alias("provider")
    states = b.url_paths().groupBy(package, F.concat(F.lit("v"), (F.col("page_id") % 3).cast("string")).alias("name"), provider).agg(F.min("page_id").cast("long").alias("page"))
    return hierarchy.listed_states(states.select("package"), states, inherited=False, provider="even").select("package", "name", "page")


@register(f"""WITH {PATHS}, st AS (SELECT regexp_replace(path, '/[^/]*$', '') AS package, min(page_id) AS page FROM pagepaths GROUP BY 1), host AS (SELECT min(split_part(path, '/', 1)) AS h FROM pagepaths),
up AS (SELECT DISTINCT path AS package, unnest({UP.format(x='path')}) AS declared_at FROM pagepaths) SELECT up.package, declared_at, page FROM up JOIN st ON st.package = declared_at, host WHERE declared_at = h OR starts_with(declared_at, h || '/') QUALIFY row_number() OVER (PARTITION BY up.package ORDER BY length(declared_at) DESC) = 1""")
def q_nearest_below_root(b: Bridge) -> DataFrame:
    p = b.url_paths()
    host = p.agg(F.min(F.split_part("path", F.lit("/"), F.lit(1)))).first()[0] or ""
    states = p.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("package")).agg(F.min("page_id").alias("page"))
    return hierarchy.nearest(p.select(F.col("path").alias("package")), states, root=host).select("package", "declared_at", "page")


@register("""WITH s AS (SELECT user_id % 20 AS scenario, value AS ms, event_id % 2 AS side FROM events),
x AS (SELECT scenario, avg(ms) AS bm, coalesce(stddev_samp(ms), 0) AS sd FROM s WHERE side = 0 GROUP BY 1), y AS (SELECT scenario, avg(ms) AS cm FROM s WHERE side = 1 GROUP BY 1),
z AS (SELECT scenario, CASE WHEN bm > 0 THEN (cm - bm) / bm * 100 ELSE 0 END AS d, greatest(CASE WHEN scenario % 2 = 0 THEN scenario ELSE 8 END, CASE WHEN bm > 0 THEN 0.1 * (sd / bm * 100) ELSE 0 END) AS t FROM x JOIN y USING (scenario))
SELECT scenario, round(t, 6) AS effective_threshold_pct, d > t AS regression FROM z""")
def q_bench_thresholds(b: Bridge) -> DataFrame:
    """Every second scenario has a threshold of its own."""
    s = b.table("events").select((F.col("user_id") % 20).alias("scenario"), F.col("value").alias("ms"), (F.col("event_id") % 2).alias("side"))
    own = s.where("scenario % 2 = 0").select("scenario", F.col("scenario").cast("double").alias("threshold_percent")).distinct()
    found = aggregates.verdicts(s.where("side = 0"), s.where("side = 1"), own, noise_k=0.1)
    return found.select("scenario", F.round("effective_threshold_pct", 6).alias("effective_threshold_pct"), "regression")


@register("""SELECT 'p' || p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'a/b/x' || p_partkey WHEN 1 THEN 'a/' || p_partkey || '/' WHEN 2 THEN p_type END AS joined FROM part""")
def q_joined_paths(b: Bridge) -> DataFrame:
    """Paths below a package, beside it, from the root, and one that leaves the root."""
    k, text = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    rel = F.when(k == 0, F.concat(F.lit("./x"), text)).when(k == 1, F.concat(F.lit("../"), text, F.lit("/"))).when(k == 2, F.concat(F.lit("../..//"), "p_type")).otherwise(F.lit("../../../x"))
    return b.table("part").select(_key("p", "p_partkey").alias("k"), paths.join_rel(F.lit("a/b"), rel).alias("joined"))
