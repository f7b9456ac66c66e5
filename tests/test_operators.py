import io
import os
import tarfile

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import aggregates, graph, hierarchy, merkle, outputs, selection, store
from loomgraph.plans import query_language, registry
from loomgraph.sources import files, sinks
from loomgraph.streaming import fold

DATA = "/root/testdata/sf0.001"
EDGES = "addr string, pos int, dep_addr string"


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGES)


def text(value):
    if value is None or value != value:
        return "~"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = registry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    assert cols == sorted(names)
    rows = sorted(tuple(map(text, r)) for r in got.select(*cols).collect())
    assert rows == sorted(tuple(text(r[names.index(c)]) for c in cols) for r in want.fetchall())


def test_shortest_path_and_cycles(spark):
    dag = edges(spark, ("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("c", 0, "d"), ("d", 0, "e"))
    assert graph.dep_path(dag, "a", "e") == ["a", "b", "d", "e"]
    assert graph.dep_path_between(dag, "e", "a") == ["a", "b", "d", "e"]
    assert graph.dep_path(dag, "b", "c") is None and graph.dep_path(dag, "a", "a") == ["a"]
    loop = edges(spark, ("a", 0, "b"), ("b", 0, "a"), ("x", 0, "x"), ("y", 0, "a"))
    nodes = loop.select("addr").union(loop.select("dep_addr")).distinct()
    assert sorted(r.addr for r in graph.cyclic(nodes, loop).collect()) == ["a", "b", "x"]
    assert graph.cyclic(dag.select("addr").distinct(), dag).isEmpty()
    targets = nodes.select("addr", F.lit("d").alias("driver"), F.lit("h").alias("def_hash"))
    assert merkle.content_hashes(targets, loop.withColumn("hashed", F.lit(True))).where("hashin is null").count() == 4


def test_histogram(spark):
    ms = spark.createDataFrame([(4,)] * 99 + [(4096,)], "ms long")
    assert aggregates.histogram_quantile(ms, "ms").first()[0] == 7
    assert aggregates.histogram_quantile(ms.limit(0), "ms").first()[0] == 0


def test_fold_agrees_with_batch(spark):
    rows = [(1, 1, "local_hit", "//p:a", None), (2, 2, "execute_start", "//p:a", None), (3, 3, "execute_end", "//p:a", None), (4, 4, "result_end", "//p:a", None), (5, 5, "remote_hit", "//p:a", None), (6, 6, "local_miss", "//p:b", None), (7, 7, "odd", "//p:b", None), (8, 8, "result_end", "//p:b", "x")]
    events = spark.createDataFrame([(*r, None) for r in rows], "at_ms long, seq long, type string, addr string, error string, upstream_of string")
    got = aggregates.counters(events).first()
    assert (got.executed, got.cached_local, got.cached_remote, got.miss_local, got.roots, got.blocked) == (1, 0, 1, 1, 1, 0)
    total: dict[str, int] = {}
    for addr in ("//p:a", "//p:b"):
        changes, _ = fold.fold(addr, events.where(F.col("addr") == addr).orderBy("seq").collect(), None)
        for _, counter, delta, _ in changes:
            total[counter] = total.get(counter, 0) + delta
    assert total == {"cached_local": 0, "executed": 1, "finished": 1, "cached_remote": 1, "miss_local": 1, "roots": 1}
    assert [tuple(r) for r in aggregates.slowest(events).collect()] == [("//p:a", 3)]


def test_store(spark):
    r = spark.createDataFrame([("a", "h1", 1), ("a", "h2", None), ("a", "h3", 3)], "addr string, hashin string, created_at_ns long")
    keep = store.keep_newest(r, 1, spark.createDataFrame([("a", "h2")], "addr string, hashin string")).where("keep")
    assert sorted(x.hashin for x in keep.collect()) == ["h2", "h3"]
    writes = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, seq int, v string")
    assert store.last_write_wins(writes, ["k"], "seq").first().v == "new"


def test_hierarchy_and_outputs(spark):
    loop = spark.createDataFrame([("a", "b", "l"), ("b", "a", None)], "name string, inherit string, goos string")
    with pytest.raises(ValueError):
        hierarchy.inherit(loop)
    out = spark.createDataFrame([("//a:a", "d/x", "copy", "exec"), ("//b:b", "d", "copy", "exec"), ("//c:c", "d-e", "copy", "exec"), ("//a:a", "d", "copy", "exec"), ("//e:e", "d", "none", "exec")], "addr string, path string, codegen string, driver string")
    got = {(r.addr, r.path, r.other_addr) for r in outputs.overlaps(out).collect()}
    assert got == {("//a:a", "d/x", "//b:b"), ("//a:a", "d", "//b:b")}
    f = spark.createDataFrame([("s/a.txt",), ("s/b.txt",), ("t/a.txt",)], "path string")
    move = outputs.PathTransform(include=("*/a.txt",), rename=(("t/a.txt", "a.txt"), ("zz", "y")), strip_prefix="s")
    assert sorted(tuple(r) for r in move.problems(f).collect()) == [("collision", "a.txt"), ("unknown rename", "zz")]


def test_null_labels_and_duplicates(spark):
    t = spark.createDataFrame([("//a:x", "a", ["l"], 0, "p"), ("//a:y", "a", None, 0, "p"), ("//a:x", "a", ["l"], 1, "q")], "addr string, package string, labels array<string>, provider_ord int, provider string")
    assert [r.addr for r in query_language.query(t, "!label(l)").collect()] == ["//a:y"]
    assert query_language.query(t, "label(l)").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("hello")
    with tarfile.open(tmp_path / "t.tar", "w") as tar:
        tar.add(tmp_path / "a/x.txt", "x.txt")
    spark.dataSource.register(files.TarSource)
    assert [(r.name, r.size) for r in spark.read.format("tar_index").load(str(tmp_path / "t.tar")).collect()] == [("x.txt", 5)]
    assert [r.path for r in files.file_catalog(spark, str(tmp_path), "a/*.txt").collect()] == ["a/x.txt"]
    heads = spark.createDataFrame([(bytearray(b"\x1f\x8b\x08"),), (bytearray(b"text"),)], "content binary")
    assert [r.k for r in heads.select(files.sniff("content").alias("k")).collect()] == ["gzip", None]
    section = [sinks.BEGIN, "/x  # //a:a", sinks.END]
    once = sinks.merge_file("keep\n", section)
    assert sinks.merge_file(once, section) == once


def test_sections(spark):
    rows = spark.createDataFrame([("/b", "//p:y"), ("/a", None), ("/b", "//p:x"), ("/b", "//p:x")], "pattern string, addr string")
    section = sinks.render_section(rows)
    assert section[1:-1] == ["/a", "# //p:x", "/b", "# //p:y", "/b"]
    text = sinks.merge_file("keep", section)
    assert text.startswith("keep\n\n") and sinks.merge_file(text, section) == text
    assert sinks.parse_section(text) == [("/a", None), ("/b", "//p:x"), ("/b", "//p:y")]
    odd = "\n".join([sinks.BEGIN, "# some words", "# //p:lost", "# //p:x", "/b", "", sinks.END])
    assert sinks.parse_section(odd) == [("# some words", None), ("# //p:lost", None), ("/b", "//p:x")] and sinks.parse_section("x") == []


def test_archive_verdicts(spark):
    def archive(*members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, content in members:
                entry = tarfile.TarInfo(name)
                entry.size = len(content)
                tar.addfile(entry, io.BytesIO(content))
        return bytearray(out.getvalue())

    packed, plain, small = b"\x1f\x8b" + b"z" * 400_000, b"text" * 100_000, b"\x1f\x8bz"
    rows = [("packed", archive(("a.gz", packed))), ("half", archive(("a.gz", packed), ("b", plain))), ("small", archive(("a.gz", small))), ("none", bytearray(b"no archive")), ("null", None)]
    got = {r.archive: (r.incompressible_bytes, r.dominant, r.precompressed) for r in files.archive_verdicts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["packed"] == (400_002, "gzip", True) and got["half"] == (400_002, "gzip", False)
    assert got["small"] == (0, None, False) and got["none"] == (0, None, False) and not got["null"][2]


def test_single_destination(spark):
    f = spark.createDataFrame([("p/a.so", "p"), ("p/b.txt", "p")], "path string, package string")
    one = outputs.PathTransform(include=("*.so",), rename="bin/a")
    assert [tuple(r) for r in one.apply(f).select("path", "dst").collect()] == [("p/a.so", "bin/a")] and one.problems(f).isEmpty()
    assert [r.problem for r in outputs.PathTransform(rename="x").problems(f).collect()] == ["several to rename"]
    assert [r.problem for r in outputs.PathTransform(include=("*.c",), rename="x").problems(f).collect()] == ["nothing to rename"]
    assert outputs.PathTransform(include=("*.c",), rename="x").problems(f.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        outputs.PathTransform(rename="x", prefix="y")


def test_blame(spark):
    bad = edges(spark, ("a", 0, "b"), ("b", 1, "c"), ("b", 0, "d"), ("x", 0, "y"), ("y", 0, "x"), ("z", 0, "x"), ("a", 1, "ok"))
    failed = spark.createDataFrame([(n,) for n in "abcdxyz"], "addr string")
    assert {r.addr: r.root for r in graph.blame(bad, failed).collect()} == {"a": "d", "b": "d", "c": "c", "d": "d", "x": None, "y": None, "z": None}
    assert graph.blame(bad, failed.limit(0)).isEmpty()


def test_groups_keep_repeated_members(spark):
    schema = "addr string, pos int, dep_addr string, output string, mode string, origin_id string, hashed boolean, runtime boolean, annotations map<string,string>"
    row = lambda a, p, d, **notes: (a, p, d, None, "standard", f"i{p}", True, True, notes)
    inputs = spark.createDataFrame([row("t", 0, "g", k="group", only="g"), row("t", 1, "m"), row("g", 0, "m", k="member")], schema)
    targets = spark.createDataFrame([("g", True), ("t", False), ("m", False)], "addr string, transparent boolean")
    got = graph.expand_groups(inputs, targets).orderBy("order").collect()
    assert [(r.dep_addr, r.origin_id, dict(r.annotations)) for r in got] == [("m", "i0", {"k": "member", "only": "g"}), ("m", "i1", {})]
    with pytest.raises(ValueError):
        graph.expand_groups(inputs.unionByName(spark.createDataFrame([row("g", 1, "g")], schema)), targets)


def test_query_targets(spark):
    t = spark.createDataFrame([("//a:x", "a", "x", ["l"], 0, "p"), ("//a/b:y", "a/b", "y", ["l"], 1, "q")], "addr string, package string, name string, labels array<string>, provider_ord int, provider string")
    ask = lambda **a: [r.addr for r in query_language.query_members(t, query_language.Address("@query", "query", tuple(a.items()))).collect()]
    assert ask(expr="label(l)", exclude_provider="p;;") == ["//a/b:y"] and ask(expr="./b", _base="a", _origin="1") == ["//a/b:y"]
    assert len(ask(expr="label(l)", exclude_provider="__none__")) == 2
    for wrong in ({"lable": "l"}, {}):
        with pytest.raises(query_language.QueryError):
            ask(**wrong)
    typed = lambda text, base="": sorted(r.completion for r in selection.complete(t, text, base).collect())
    assert typed("//a") == ["//a/b:", "//a:"] and typed("./b:", "a") == ["./b:y"] and typed("../", "a/b") == ["../:"]
    assert typed("x", "a") == ["x"] and typed(":", "a") == [":x"] and typed("../../../x:", "a") == [] and typed("q/x") == []


def test_required_fields(spark):
    rows = spark.createDataFrame([("c", None)], "name string, uri string")
    with pytest.raises(ValueError, match="c is missing the required uri"):
        hierarchy.with_defaults(rows, {}, ("uri",))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
