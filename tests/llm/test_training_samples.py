import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.llm import language_id, toxicity


def test_rare_toxic_words_are_learned():
    rng = random.Random(7)
    plain = ["".join(rng.choices("aeioustrn", k=rng.randint(3, 6))) for _ in range(150)]
    texts, labels = [], []
    for i in range(2000):
        words = rng.choices(plain, k=12)
        bad = "bocoo" if i < 7 else "grubfoul" if i < 300 else None
        if bad:
            words[rng.randrange(len(words))] = bad
        texts.append(" ".join(words))
        labels.append(int(bad is not None))
    model = toxicity.train(texts, labels)
    some = " ".join(rng.choices(plain, k=6))
    clean, unknown, rare = toxicity.scores(pa.array([some, some + " vwxyz", some + " bocoo"], pa.string()), model)
    assert rare >= 0.5 > clean and rare > unknown + 0.2


def test_small_languages_are_trained_on(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 60)
    monkeypatch.setattr(language_id, "train", lambda windows, labels: taken.extend(labels))
    rows = [(i, f"text {i}", "xx" if i % 800 == 0 else "yy" if i % 3 == 0 else "zz") for i in range(4000)] + [(None, "text", "xx"), (5000, "1", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for parts in (1, 5):
        taken.clear()
        language_id.fit(docs.repartition(parts), F.lit(True))
        assert {x: taken.count(x) for x in ("xx", "yy", "zz")} == {"xx": 10, "yy": 52, "zz": 54}
    taken.clear()
    language_id.fit(docs.limit(0), F.lit(True))
    assert taken == []
