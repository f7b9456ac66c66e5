import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import chat_format, decontaminate, language_id, near_dedup, secret_scan, source_mixing, substring_dedup, suffix_dedup, topk_search, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, seed=0, n=60):
    """Small documents with copies, near copies, shared passages, nulls, empty texts, ties and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=150))
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([1, 3, 40, 120, 400]))
        if i % 5 == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        text = " ".join(words) + rng.choice(["", "\n", "  "])
        if i % 7 == 2 and rows:
            text = rng.choice(rows)[1] or ""
        if i % 7 == 4 and rows and rows[-1][1]:
            text = rows[-1][1].upper() + " extra"
        rows.append((i, text))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "x " * 3000), (1003, "x " * 3000), (None, passage)]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    return frame.withColumn("block", F.lit(1)).withColumn("id", F.lit("clash")), rows


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_word_windows(spark, monkeypatch):
    docs, rows = corpus(spark)
    monkeypatch.setattr(substring_dedup.pack_blocks, "__defaults__", ("doc_id", "text", 4000))
    split = [(d, (t or "").encode().split()) for d, t in rows]
    n = Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    want = Counter()
    for d, w in split:
        gone = [any(n[tuple(w[i : i + 35])] > 1 for i in range(max(0, j - 34), min(j, len(w) - 35) + 1)) for j in range(len(w))]
        want[d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    assert counted(substring_dedup.digest(docs, 35)) == want
    assert substring_dedup.digest(docs.limit(0)).count() == 0


def without_repeats(data):
    """Rows of op5's contract for (doc_id, bytes), by brute force."""
    n = Counter(hash(b[i : i + 400]) for _, b in data for i in range(len(b) - 399))
    want = Counter()
    for d, b in data:
        edges = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if n[hash(b[i : i + 400])] > 1:
                edges[i] += 1
                edges[i + 400] -= 1
        gone = np.cumsum(edges)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return want


def test_byte_strings(spark, monkeypatch):
    docs, rows = corpus(spark, 1)
    monkeypatch.setattr(suffix_dedup.pack_blocks, "__defaults__", ("doc_id", "text", 4000))
    assert counted(suffix_dedup.remove_repeated_strings(docs, 400, digest_only=True)) == without_repeats([(d, (t or "").encode()) for d, t in rows])
    assert suffix_dedup.remove_repeated_strings(docs.limit(0)).count() == 0


def test_byte_strings_of_long_documents(spark):
    """A text that is cut into pieces, parts of it in other documents at other places, and one passage after many contexts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    long, passage = text(400_000), text(90)
    rows = [(0, long), (1, text(50) + long[900_000:1_200_000] + text(500) + long[100:5000]), (2, "x" * 5000), (3, "x" * 399), (4, "x" * 400 + "y")]
    rows += [(10 + i, text(rng.randint(0, 80)) + passage[rng.randint(0, 60) :] + text(rng.randint(0, 200))) for i in range(100)]
    assert len(long) > 2 << 20
    assert counted(suffix_dedup.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"), digest_only=True)) == without_repeats([(d, t.encode()) for d, t in rows])


def test_buckets_meet_without_a_message_for_each_block(spark, monkeypatch):
    """Groups of runs send the groups that compare their buckets two messages at most, however many blocks there are."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [text(700) for _ in range(100)]
    rows = [(k, text(900) + passages[k // 2] + text(900)) for k in range(200)]
    monkeypatch.setattr(suffix_dedup.pack_blocks, "__defaults__", ("doc_id", "text", 3000))
    staged, stage = {}, suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", lambda frame, name: staged.setdefault(name, stage(frame, name)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(suffix_dedup.remove_repeated_strings(docs, digest_only=True)) == without_repeats([(d, t.encode()) for d, t in rows])
    shards = 8
    assert 0 < staged["runs"].where(f"kind = {suffix_dedup.MIXED}").count() <= 2 * shards**2
    assert staged["mixed"].groupBy("block", "part").count().where("count > 1").isEmpty()


def test_refinement():
    rng = np.random.default_rng(0)
    for columns in (1, 2, 4, 7):
        rows, times = rng.integers(0, 3, (300, columns)).astype(np.uint64), rng.integers(1, 3, 300).astype(np.uint8)
        n = Counter()
        for row, k in zip(rows.tolist(), times.tolist(), strict=True):
            n[tuple(row)] += k
        total, bucket = suffix_dedup.refine(rows, times)
        assert total.tolist() == [n[tuple(r)] for r in rows.tolist()]
        assert len(set(zip(bucket.tolist(), map(tuple, rows.tolist()), strict=True))) == len(n) == len(set(bucket.tolist()))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    docs, rows = corpus(spark, 2)
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids = sorted(d for d in sets if d is not None)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = sorted((find(x), find(y)))
                parent[q] = p
    got = near_dedup.near_duplicates(docs, size)
    want = Counter((d, len(sets[d]), find(d) if d is not None else None, d is None or find(d) == d) for d, _ in rows)
    assert counted(got) == want
    kept = near_dedup.distinct_groups(docs, got)
    assert kept.columns == docs.columns and kept.where("doc_id is not null").count() == len({find(d) for d in ids})
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 1500).astype(np.uint64)
    sig = near_dedup.superminhash([np.unique(pool[:1000]), np.unique(pool[250:1250])], 256)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.12


def test_secrets(spark):
    t = ["é password = 'Abcdefgh1'", "API_KEY:short", "AKIA" + "A1" * 8, "z" + "0f" * 20, None, "", "ſecret=abcdefghij", "token=" + "a" * 40 + " Token: bbbbbbbbbb"]
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").withColumn("spans", F.lit(0))
    got = {r.doc_id: r for r in secret_scan.digest(docs).collect()}
    assert got[0].spans == "assign:2:23" and got[0].base_sha256 == hashlib.sha256(b"assign:2:23").hexdigest()
    assert got[1].spans == got[4].spans == got[5].spans == got[6].spans == "" and got[2].n_access == got[3].n_hex == 1
    assert got[7].spans == "assign:0:46,hex:6:46,assign:47:64"
    assert [r.text for r in secret_scan.redact(docs).where("doc_id in (0, 4)").orderBy("doc_id").collect()] == ["é [SECRET]'", None]
    assert secret_scan.trigram_query("[0-9a-f]+") is True
    assert secret_scan.trigram_query("AKIA[A-Z]+") == ("and", (("tri", b"aki"), ("tri", b"kia")))


def test_decontamination(spark, monkeypatch):
    item = "One two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"É, {item.upper()}! end"), (2, "two three four"), (3, None), (4, "short-ITEM here short item"), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "Short item"), (9, None), (10, " ")], "item_id long, text string")
    for part in (1 << 20, 2):
        monkeypatch.setattr(decontaminate, "PART_WINDOWS", part)
        got = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench).collect()}
        assert [(got[d].n_words, got[d].n_hit, got[d].items) for d in (1, 2, 3, 4, 5)] == [(13, 11, ["7"]), (3, 0, []), (0, 0, []), (5, 4, ["8"]), (0, 0, [])]
        assert [tuple(s) for s in got[4].spans] == [(0, 10), (16, 26)] and [tuple(s) for s in got[1].spans] == [(3, 3 + len(item))]
        assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 3, 5]
    assert decontaminate.digest(docs, bench.limit(0)).where("contaminated").count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_ROWS", 16)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, -0.3, 0.5, 0.25]) for _ in range(6)]) for i in range(80)]
    rows += [(90, None), (91, [float("nan")] * 6), (92, [None] * 6), (None, [1.0] * 6), rows[5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    got = sorted(tuple(r) for r in topk_search.top_k(frame, F.col("id") % 20 == 0).collect())
    w = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows[:80]}
    want = []
    for query in range(0, 80, 20):
        scored = sorted((-sum(a * b for a, b in zip(w[query], w[c], strict=True)), c) for c in w if c != query)[:5]
        want += [(query, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert got == want
    assert topk_search.top_k(frame.limit(0), F.col("id") % 2 == 0).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), f"s{min(i % 8, 3) % 4}" if i % 16 else None) for i in range(400)] + [(999, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = source_mixing.mix_sources(docs, max_epochs=3.0)
    assert out.select("doc_id").distinct().count() == 401
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    top = max(sizes.values())
    taken = {r.source: r.t for r in out.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    least = min(v for v in sizes.values() if v)
    alpha = max(0.0, 1 - np.log(3.0) / np.log(top / least))
    for s, n in sizes.items():
        if n:
            goal = max(n, top * (n / top) ** alpha)
            assert goal - 1 <= taken[s] <= goal + 7
    assert source_mixing.mix_sources(docs.limit(0)).count() == 0
    frame = spark.createDataFrame([("a", 900, 1), ("b", 90, 1), ("c", 10, 1)], "source string, tokens long, n_docs long")
    b = source_mixing.source_budgets(frame, None, 0.9).collect()
    w = [r.weight for r in b]
    assert abs(-sum(x * np.log(x) for x in w) - 0.9) < 1e-4


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "ab"), (4, 0, "user", "ab"), (5, 0, None, None), (None, 0, "x", "y"), (6, None, "x", "y")]
    rows += [(7, t, "user", str(t)) for t in range(600)] + [(8, t, "user", str(t)) for t in range(300)]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rank", F.lit(0))
    got = {(r.conv_id, r.part): r for r in chat_format.format_chats(chat).collect()}
    assert set(got) == {(1, 0), (4, 0), (5, 0), (7, 0), (7, 1), (7, 2)}
    assert got[1, 0].n_copies == 2 and got[1, 0].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n"
    assert got[4, 0].n_turns == 1 and got[7, 2].n_turns == 600 and got[7, 2].rendered.endswith("599<|im_end|>\n")
    assert chat_format.format_chats(chat.limit(0)).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(docs, F.col("doc_id") % 5 != 0)
    held = docs.where("doc_id % 5 = 0")
    got = language_id.predict(held, net).join(held.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * held.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "the and " * 60000)], "doc_id long, text string")
    assert [(r.doc_id, r.lang_pred) for r in language_id.predict(odd, net).orderBy("doc_id").collect()] == [(1, "und"), (2, "und"), (3, "und"), (4, "en")]
    assert language_id.fit(docs.limit(0), F.lit(True)) is None and language_id.predict(odd, None).where("lang_pred <> 'und'").isEmpty()


def test_toxicity(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choices("aeioustrn", k=rng.randint(2, 6))) for _ in range(200)]
    bad = ["wretchling", "grubfoul", "snotbag"]
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=rng.randint(5, 120))
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    # one bad word among up to 120 is what the average over a whole text loses; the windows of the queries find it
    for window, least in ((None, 0.8), (toxicity.WORST_WINDOW, 0.9)):
        model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0, window_words=window)
        got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0]
        assert np.mean(held) > least
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "wretchlling " + " ".join(plain[:20]))], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert s[1] == s[2] and s[3] > s[1] and 0 <= s[1] <= 1


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, now, sf)
        assert after.columns == docs.columns and 0 < after.count() <= now.count()
        now = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert mixed.select("doc_id").distinct().count() == now.count()
