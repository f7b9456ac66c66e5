"""Queries over whole tables, where others take a part of them."""

import os

import duckdb

from loomgraph.operators import graph
from loomgraph.plans import registry
from loomgraph.plans.catalog import Bridge

DATA = "/root/testdata/sf0.001"


def wanted(name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con.execute(registry.oracle_sql()[name])


def test_every_node_has_a_hash(spark):
    inputs = Bridge(spark, DATA).inputs()
    nodes = {r[0] for r in inputs.select("addr").union(inputs.select("dep_addr")).distinct().collect()}
    got = {r.addr: r.hashin for r in registry.queries()["q_merkle"](spark, DATA).select("addr", "hashin").collect()}
    assert set(got) == nodes and None not in got.values()
    assert got == dict(wanted("q_merkle").fetchall())


def test_dependencies_of_all_targets(spark):
    got = {tuple(r) for r in registry.queries()["q_deps"](spark, DATA).select("addr", "dep_addr", "pos").collect()}
    assert {a[0] for a, _, _ in got} == {"o", "c", "s"}
    assert got == set(wanted("q_deps").fetchall())


def test_path_is_searched_in_all_inputs(spark, monkeypatch):
    searched, between = [], graph.dep_path_between
    monkeypatch.setattr(graph, "dep_path_between", lambda inputs, a, b: searched.append(inputs.count()) or between(inputs, a, b))
    got = [tuple(r) for r in registry.queries()["q_dep_path"](spark, DATA).orderBy("step").collect()]
    assert searched == [Bridge(spark, DATA).inputs().count()]
    assert got == sorted(wanted("q_dep_path").fetchall())
