import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.functions import address, paths, values
from loomgraph.plans import query_language as q

leaf = st.one_of(
    st.builds(lambda v: q.Node("label", v), st.sampled_from(["a", "x y", "b&c"])),
    st.builds(lambda v: q.Node("package", v), st.sampled_from(["", "a", "a/b"])),
    st.builds(lambda v: q.Node("prefix", v), st.sampled_from(["", "a", "a/b"])),
    st.builds(lambda v: q.Node("tree_output", v), st.sampled_from(["", "a/b"])),
    st.builds(lambda v: q.Node("addr", v), st.sampled_from(["//a:b", "//:x@k=v"])),
)
trees = st.recursive(leaf, lambda t: st.one_of(st.builds(lambda n: q.Node("not", nodes=(n,)), t), st.builds(lambda k, n: q.Node(k, nodes=tuple(n)), st.sampled_from(["and", "or"]), st.lists(t, min_size=2, max_size=3))), max_leaves=8)


@settings(deadline=None)
@given(trees)
def test_round_trip(tree):
    assert q.parse(q.format_query(tree)) == tree


def test_precedence_and_errors():
    assert q.parse("//a || //b && !//c") == q.Node("or", nodes=(q.Node("package", "a"), q.Node("and", nodes=(q.Node("package", "b"), q.Node("not", nodes=(q.Node("package", "c"),))))))
    assert q.parse("./x/...", "p") == q.Node("prefix", "p/x")
    for bad in ("", "//a &", "(//a", "nope(x)", "x", "//a //b", "//../a", "!" * 300 + "//a"):
        with pytest.raises(q.QueryError):
            q.parse(bad)


def test_pruning():
    tree = q.parse("//foo/bar/... && label(x)")
    assert q.package_verdict(tree, "foo/bar/baz") is None and q.package_verdict(tree, "foo/ba") is False
    assert q.package_verdict(q.parse("!//a"), "a") is False and q.narrowing_prefix(tree) == "foo/bar"


def test_addresses():
    a = address.parse_address('//p/q:n@b=2,a="x, y"')
    assert a == address.Address("p/q", "n", (("a", "x, y"), ("b", "2"))) and address.parse_address(str(a)) == a
    assert str(address.parse_address("../z:t", "a/b")) == "//a/z:t"
    for bad in ("t", "./t", "//a", "../../../x:t", "//a:b@="):
        with pytest.raises(ValueError):
            address.parse_address(bad, "a")
    assert address.split_filters("{a,b}, c") == ["{a,b}", "c"]


def test_values():
    assert values.parse_strings(["a", None, "b"]) == ["a", "b"] and values.parse_map_string_strings("x") == {"": ["x"]}
    f = values.Functions()
    f.add("fs", "add", values.Signature((values.Param("a", values.Kind("int")), values.Param("b", values.Kind("int"), 2)), returns=values.Kind("int")), lambda a, b: a + b)
    assert f.call("fs", "add", 1) == 3 and f.listing()[0][2] == "(a: int, b: int = 2) -> int"
    with pytest.raises(TypeError):
        f.call("fs", "add", "x")


def test_paths(spark):
    rows = {"a/b/c": ["a/b/c", "a/b", "a", ""], "": [""]}
    df = spark.createDataFrame([(k,) for k in rows], "p string").select("p", paths.ancestors("p").alias("a"))
    assert {r.p: r.a for r in df.collect()} == rows
    got = spark.createDataFrame([("foo/bar/baz",)], "p string").select(*(paths.has_prefix("p", x) for x in ("foo/bar", "foo/ba", ""))).first()
    assert list(got) == [True, False, True]
    cleaned = spark.createDataFrame([("a/./b/../c",), ("/../x",), ("../y",), ("",)], "p string").select(paths.clean("p").alias("c")).collect()
    assert [r.c for r in cleaned] == ["a/c", "/x", "../y", "."]
    globs = spark.createDataFrame([("a/b.txt",), ("a/c/b.txt",), ("a/b.md",)], "p string")
    assert [r.p for r in globs.where(paths.matches_glob("p", "a/*.{txt,rs}")).collect()] == ["a/b.txt"]
    assert globs.where(paths.matches_glob("p", "a/**/*.txt")).count() == 2
