"""Cases that the tables don't have: chains, cycles, quotes, large numbers, orders over ranges and unavailable targets."""

import hashlib
import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import address, paths, tables
from loomgraph.operators import aggregates, graph, hierarchy, merkle, selection, staging, store
from loomgraph.plans import query_language as q
from loomgraph.sources import sinks

TARGETS = "addr string, package string, provider string, provider_ord int, labels array<string>"


def test_upper_ends_of_large_buckets(spark):
    rows = spark.createDataFrame([(2**k - 1, k) for k in range(1, 64)] + [(2**54, 55), (0, 0), (-5, 0)], "v long, k int")
    got = rows.select("v", "k", paths.bit_bucket("v").alias("b"), paths.bucket_upper(F.col("k")).alias("u")).collect()
    assert all(r.b == r.k and r.u == (2**r.k - 1 if r.k else 0) for r in got)
    sizes = spark.createDataFrame([(2**54,)] * 10, "n long")
    assert aggregates.histogram_quantile(sizes, "n").first()[0] == 2**55 - 1


def test_quotes_and_operators_in_arguments(spark):
    t = spark.createDataFrame([("//a:x", "a", "p", 0, ['l") || label("m']), ("//a:y", "a", "p", 0, ["m"]), ("//b:z", "b", "p", 0, ["l"])], TARGETS)
    assert [r.addr for r in q.select(t, label='l") || label("m').collect()] == ["//a:x"]
    assert [r.addr for r in q.select(t, label="l", under="//b").collect()] == ["//b:z"]
    assert [r.addr for r in q.select(t, addr="//a:y").collect()] == ["//a:y"]
    with pytest.raises(q.QueryError):
        q.select(t, label="l", under="label(m)")


def test_long_chains_of_variants(spark):
    rows = [(f"v{k}", f"v{k - 1}" if k else None, "linux" if not k else None, str(k) if k % 40 == 0 else None) for k in range(150)]
    got = {r.name: (r.goos, r.arch) for r in hierarchy.inherit(spark.createDataFrame(rows, "name string, inherit string, goos string, arch string"), ("goos",)).collect()}
    assert got == {f"v{k}": ("linux", str(k // 40 * 40)) for k in range(150)}
    for bad in ([("a", "b"), ("b", "c"), ("c", "a")], [("a", "gone")], [("a", "a")]):
        with pytest.raises(ValueError):
            hierarchy.inherit(spark.createDataFrame(bad, "name string, inherit string"))


def test_what_a_package_filter_says_is_what_its_verdict_says(spark):
    texts = ["//a/...", "//a", "label(x)", "!//a/...", "//a:x", "!//a:x", "//a/... && label(x)", "//a || !label(x)", "!(//a && label(x)) && //b/...", "!(//a/... || label(x))"]
    packages = ["", "a", "a/b", "ab", "b", "b/c"]
    frame = spark.createDataFrame([(p,) for p in packages], "package string")
    for text in texts:
        node = q.parse(text)
        got = {r.package: (r.may, r.sure) for r in frame.select("package", q.package_filter(node).alias("may"), q.package_filter(node, True).alias("sure")).collect()}
        for p in packages:
            assert got[p] == {True: (True, True), False: (False, False), None: (True, False)}[q.package_verdict(node, p)], (text, p)


def test_positions_run_on_over_ranges(spark):
    rows = [(f"p{i % 7}", i * 37 % 501) for i in range(500)]
    frame = spark.createDataFrame(rows, "package string, n int").repartition(6)
    got = [(r.package, r.n) for r in selection.positions(frame, ["package", "n"]).orderBy("position").collect()]
    assert got == sorted(rows)
    assert sorted(r.position for r in selection.positions(frame, ["package", "n"]).collect()) == list(range(500))
    assert selection.positions(frame.limit(0), ["n"]).count() == 0


def test_unavailable_targets(spark):
    rows = [("//a:x", "a", "p", 0, ["l"], "not_found"), ("//a:x", "a", "r", 1, ["l"], None), ("//a:y", "a", "p", 0, ["l"], "cyclic"), ("//b:z", "b", "p", 0, ["l"], "ok")]
    t = spark.createDataFrame(rows, TARGETS + ", status string")
    assert sorted((r.addr, r.provider) for r in q.query(t, "label(l)").collect()) == [("//a:x", "r"), ("//b:z", "p")]
    got = selection.resolve_specs(t, t).orderBy("addr").collect()
    assert [(r.addr, r.provider, r.error) for r in got] == [("//a:x", "r", None), ("//a:y", None, "no provider has //a:y"), ("//b:z", "p", None)]


def test_hashes_and_levels_of_a_deep_graph(spark):
    n = 40
    inputs = spark.createDataFrame([(f"t{k}", f"t{k - 1}", True) for k in range(1, n)] + [("t5", "t0", False), ("t9", "t2", True), ("c1", "c2", True), ("c2", "c1", True), ("up", "c1", True)], "addr string, dep_addr string, hashed boolean")
    targets = spark.createDataFrame([(f"t{k}", "d", "x") for k in range(n)] + [(c, "d", "x") for c in ("c1", "c2", "up")], "addr string, driver string, def_hash string")
    levels = {r.addr: r.level for r in graph.topological_levels(targets, inputs).collect()}
    assert levels == {f"t{k}": k for k in range(n)} | {"c1": None, "c2": None, "up": None}
    want = {}
    for k in range(n):
        below = ([want[f"t{k - 1}"]] if k else []) + ([want["t2"]] if k == 9 else [])
        want[f"t{k}"] = hashlib.sha256(f"d|x|{','.join(sorted(below))}".encode()).hexdigest()
    got = {r.addr: r.hashin for r in merkle.content_hashes(targets, inputs).collect()}
    assert got == want | {"c1": None, "c2": None, "up": None}
    far = {r.addr: r.level for r in graph.closure(inputs, ["t39"]).collect()}
    assert far == {f"t{k}": 39 - k for k in range(3, n)} | {"t2": 31, "t1": 32, "t0": 33}


def test_members_of_groups_in_order(spark):
    rows = [("g", 0, "//b"), ("g", 1, "//a"), ("g", 2, "//b")]
    inputs = spark.createDataFrame(rows, "addr string, pos int, dep_addr string")
    artifacts = spark.createDataFrame([("//a", "x"), ("//b", "z"), ("//b", "y")], "addr string, name string")
    got = [(r.dep_addr, r.name) for r in selection.group_artifacts(inputs, artifacts).orderBy("position").collect()]
    assert got == [("//b", "y"), ("//b", "z"), ("//a", "x")]


def test_unknown_targets(spark):
    outs = spark.createDataFrame([("//a:x", "out", 0, "p", "file", "copy")], "addr string, group string, pos int, path string, kind string, codegen string")
    inputs = spark.createDataFrame([("//b:y", 0, "//a:x", "tool", None, True), ("//b:y", 1, "//gone:z", "tool", None, True)], "addr string, pos int, dep_addr string, mode string, output string, runtime boolean")
    got = {r.dep_addr: r.error for r in graph.link(inputs, outs, spark.createDataFrame([("//a:x",)], "addr string")).collect()}
    assert got == {"//a:x": None, "//gone:z": "unknown target"}
    chosen = selection.select_outputs(outs, ["out", "none"]).select("wanted", "path").collect()
    assert Counter(map(tuple, chosen)) == Counter([("out", "p"), ("none", None)])
    with pytest.raises(ValueError, match="//gone:z"):
        graph.dep_path_between(inputs, "//gone:z", "//also:gone", targets=outs)


def test_addresses_as_columns(spark):
    texts = ["//a/b:c", "//:x@v=1,w", '//p:q@k="a,b",z=2', "no address", "//a:b@"]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(address.parsed_address(F.col("t")).alias("p")).collect()]
    for text, p in zip(texts, got, strict=True):
        try:
            want = address.parse_address(text)
        except ValueError:
            want = None
        assert (p and (p.package, p.name, p.args)) == (want and (want.package, want.name, dict(want.args))), text


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_dir(Session)


def test_provider_functions(spark):
    provider = tables.StaticProvider([("a/b", "x", "go"), ("a", "y", "py"), ("ab", "z", "py"), ("a", "w", "py")], [("a", "k", "v")])
    packages, listing, probe = tables.register_provider(spark, "mine", provider)
    assert [r.package for r in spark.sql(f"select * from {packages}('a')").collect()] == ["a", "a/b"]
    assert [tuple(r) for r in spark.sql(f"select * from {listing}('a')").collect()] == [("y", "py"), ("w", "py")]
    assert [tuple(r) for r in spark.sql(f"select * from {probe}('a')").collect()] == [("k", "v")]


def test_lookup_reads_at_most_a_row(spark, tmp_path):
    a = spark.createDataFrame([("//a:x", "h", "n", bytearray(b"0123456789")), ("//a:x", "i", "n", bytearray(b""))], "addr string, hashin string, name string, data binary")
    store.write_artifacts(a, str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert store.lookup(stored, "//a:x", "h", "n").count() == 1 and store.lookup(stored, "//a:x", "h", "m").count() == 0
    assert sorted(bytes(r.part) for r in store.ranges(stored, 4, 3).collect()) == [b"", b"456"]
    assert sorted(r.size for r in store.sizes_of(stored).collect()) == [0, 10] and stored.select("package").distinct().first()[0] == "a"


def test_spans_in_any_order(spark):
    events = [("a", "p", 5, 1, "phase_end"), ("a", "p", 3, 0, "phase_start"), ("b", "p", 3, 0, "phase_start"), ("b", "p", 1, 0, "phase_end")]
    for order in itertools.islice(itertools.permutations(events), 0, 24, 5):
        frame = spark.createDataFrame(list(order), "addr string, phase string, at_ms long, seq long, type string")
        assert {(r.addr, r.open, r.since_ms) for r in aggregates.open_spans(frame).collect()} == {("a", False, 5), ("b", True, 3)}


def test_shapes_and_streams_of_addresses(spark):
    assert q.shape(q.parse("//a && !(label(x) || //b/...)")) == Counter({"package": 1, "and": 1, "not": 1, "or": 1, "label": 1, "prefix": 1})
    frame = spark.createDataFrame([("//a:x",), ("//a:y",)], "addr string").orderBy("addr")
    assert list(sinks.stream_addresses(frame)) == ["//a:x", "//a:y"]
    t = address.parse_target_address("./b:c|out[*.{h,c}, x]", "a")
    assert (str(t.ref), t.output, t.filters) == ("//a/b:c", "out", ("*.{h,c}", "x"))
    with pytest.raises(ValueError):
        address.parse_target_address("//a:b|")


def test_strict_thresholds(spark):
    spans = spark.createDataFrame([("a", "run", 0), ("b", "run", 5), ("c", "remote_cache_write", 0)], "addr string, phase string, since_ms long")
    assert [r.addr for r in aggregates.running_over(spans, 10, 5).collect()] == ["a", "b"]
    assert [r.addr for r in aggregates.running_over(spans, 10, 5, strict=True).collect()] == ["a"]


def test_joins_of_relative_paths(spark):
    pairs = [("a/b", x) for x in ("", ".", "..", "../..", "../../..", "c/", "/", "../c//d/", "./../x/..", "..//..//..", "x/../../../y")] + [("", ".."), ("", "a/..")]

    def checked(base, rel):
        try:
            return paths.join_rel_checked(base, rel)
        except ValueError:
            return None

    got = spark.createDataFrame(pairs, "b string, r string").select(paths.join_rel("b", "r").alias("j")).collect()
    assert [r.j for r in got] == [checked(*p) for p in pairs]


def test_lives_over_hours(spark):
    events = [("a", k * 1_200_000, k, "result_end" if k % 4 == 3 else "local_hit") for k in range(40)] + [("b", None, 0, "result_end"), ("b", 5, 1, "local_hit")]
    got = {(r.addr, r.seq): r.life for r in aggregates.lives(spark.createDataFrame(events, "addr string, at_ms long, seq long, type string")).collect()}
    assert got == {("a", k): k // 4 for k in range(40)} | {("b", 0): 0, ("b", 1): 1}
