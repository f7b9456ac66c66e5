"""What the pipeline leaves out of the driver: training, and plans for what a bounded task or plain arithmetic settles."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import components, source_mixing, toxicity


def test_training_runs_in_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"grubfoul {i}" if i % 2 else f"kind {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    expected = toxicity.train([f"grubfoul {i}" if i % 2 else f"kind {i}" for i in range(40)], [i % 2 for i in range(40)], 21 / 42, window_words=3)
    model = toxicity.fit(docs.repartition(5), labels, window_words=3)
    assert (model.weights == expected.weights).all() and (model.bias, model.slope, model.shift, model.window_words) == (expected.bias, expected.slope, expected.shift, 3)
    assert toxicity.fit(docs.limit(0), labels).bias == 0.0  # labels without texts

    def train(texts, labels, prior, window_words=None):
        return toxicity.Model(expected.weights, float(os.getpid()), 1.0, float(sum(labels)))

    monkeypatch.setattr(toxicity, "train", train)
    model = toxicity.fit(docs, labels)
    assert model.bias != os.getpid() and model.shift == 20


def test_few_edges_settle_in_one_task(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7), (None, 3)]
    parent = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b and None not in (a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    found = {}
    for most in (components.TOGETHER, 0, 50):
        monkeypatch.setattr(components, "TOGETHER", most)
        written = []
        monkeypatch.setattr(components, "stage", lambda df, name, f=components.stage, w=written: (w.append(name), f(df, name))[1])
        rows = components.connected_components(edges).collect()
        assert {r.id: r.component for r in rows} == {x: find(x) for x in parent} and len(rows) == len(parent)
        found[most] = len(written)
    assert found[100_000] == 2 < found[0]
    assert components.connected_components(edges.limit(0)).count() == 0


def test_epoch_bound_needs_one_pass(spark, monkeypatch):
    tokens = [5, 70, 900, 12_000]
    sizes = spark.createDataFrame([(str(i), n) for i, n in enumerate(tokens)] + [("none", 0)], "source string, tokens long")
    monkeypatch.setattr(source_mixing, "_entropies", lambda *a: pytest.fail("sums are for entropies only"))
    alpha = source_mixing.temperature(sizes, 4.0)
    assert math.isclose(alpha, 1 - math.log(4) / math.log(max(tokens) / min(tokens)), abs_tol=1e-8)
    assert source_mixing.temperature(sizes, 1e9) == 0.0
