"""Queries without SQL, or with inputs that the tables don't have, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import chat_format, common, decontaminate, language_id, near_dedup, queries, secret_scan, source_mixing, topk_search, toxicity

KINDS = {
    "assign": (rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (rb"AKIA[A-Z0-9]+", 0, 16),
    "hex": (rb"[0-9a-f]+", 0, 32),
    "pem": (rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    "git_token": (rb"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    "chat_token": (rb"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    "jwt": (rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
}
SECRETS = ["password = 'Abcdefgh1'", "Token:abc", "api_key=\"zzzzzzzz9\"", "AKIA" + "Q7" * 7, "0f" * 20, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 10, "xoxb-" + "12-ab" * 5, "eyJhbGci.eyJzdWIi.c2ln", "secret: " + "e" * 33, "PASSWD==x12345678"]


def secrets_of(text):
    """(start, kind, end) in code points."""
    data = (text or "").encode()
    out = []
    for k, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        out += [(len(data[: m.start()].decode()), k, kind, len(data[: m.end()].decode())) for m in re.finditer(pattern, data) if m.end(group) - m.start(group) >= least]
    return [(a, kind, b) for a, _, kind, b in sorted(out)]


def words_in(rng, n, letters="abcdeéß"):
    return ["".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(n)]


def test_secrets(spark):
    rng = random.Random(1)
    texts = [None, "", "½ " * 400_000 + SECRETS[0] + " x" * 400_000]
    for _ in range(80):
        words = words_in(rng, rng.randint(0, 60))
        for s in rng.sample(SECRETS, rng.randint(0, 4)):
            words.insert(rng.randint(0, len(words)), s)
        texts.append(rng.choice([" ", "\n", "", "  "]).join(words))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(4, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("kind", F.lit(1))
    want = Counter()
    for d, t in rows:
        spans = secrets_of(t)
        base = [s for s in spans if s[1] in ("assign", "access", "hex")]
        named = lambda x: ",".join(f"{k}:{a}:{b}" for a, k, b in x)
        n = Counter(k for _, k, _ in spans)
        want[d, n["assign"], n["access"], n["hex"], hashlib.sha256(named(base).encode()).hexdigest(), named(spans)] += 1
    assert Counter(tuple(r) for r in secret_scan.digest(docs).collect()) == want
    assert sum(x[1] for x in want) > 20 and secret_scan.digest(docs.limit(0)).count() == 0
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.redact(docs.limit(0)).count() == 0


def test_queries_of_regexes():
    """Whatever a regex matches satisfies its query."""
    tri = lambda *texts: ("and", tuple(("tri", t) for t in texts)) if len(texts) > 1 else ("tri", texts[0])
    assert secret_scan.trigram_query("abcd") == tri(b"abc", b"bcd") and secret_scan.trigram_query("ab.") is True
    assert secret_scan.trigram_query("(?i:ABC|xyz)[0-9]+") == ("or", (tri(b"abc"), tri(b"xyz")))
    assert secret_scan.trigram_query(r"x(?:abc)?\x2e") is True and secret_scan.trigram_query("[^a]bcd{2}e*") == tri(b"bcd", b"cdd")
    assert secret_scan.trigram_query("abc(?=def)") == tri(b"abc") and secret_scan.trigram_query("a{3}|[a-c]+") is True

    def holds(query, text):
        if query is True:
            return True
        kind, arg = query
        return arg in text if kind == "tri" else (all if kind == "and" else any)(holds(q, text) for q in arg)

    for kind, (pattern, _, _) in KINDS.items():
        query = secret_scan.trigram_query(pattern.decode())
        assert (query is True) == (kind == "hex")
        for s in SECRETS:
            assert not re.search(pattern, s.encode()) or holds(query, s.lower().encode())
    for bad in ("(a", "a)", "[a"):
        with pytest.raises(ValueError):
            secret_scan.trigram_query(bad)


def mixture_of(rows, max_epochs=4.0):
    """(doc_id, source, tokens, epoch, block, place) for rows (doc_id, text, source)."""
    md5 = lambda *x: hashlib.md5("|".join([*(str(y) for y in x if y is not None), "0"]).encode()).hexdigest()
    sized = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in rows]
    sizes, n_docs = defaultdict(int), Counter(s for _, _, s in sized)
    for _, n, s in sized:
        sizes[s] += n
    full = [n for n in sizes.values() if n]
    total, top = sum(full), max(full, default=0)
    alpha = 1.0 if len(full) < 2 else 0.0 if min(full) == top else max(0.0, 1 - math.log(max_epochs) / math.log(top / min(full)))
    out = Counter()
    for source, n in sizes.items():
        budget = max(round((n / total) ** alpha * total * (top / total) ** (1 - alpha)), n) if n else 0
        blocks = defaultdict(list)
        for d, k, s in sized:
            if s == source:
                blocks[int(md5("block", d or 0)[:12], 16) % max(1, math.ceil(math.sqrt(n_docs[source])))].append((md5("doc", d), d is not None, d or 0, k, d))
        before = 0
        for rank, b in enumerate(sorted(blocks, key=lambda b: md5("order", b)), 1):
            for place, (_, _, _, k, d) in enumerate(sorted(blocks[b], key=lambda x: x[:4]), 1):
                times = (budget // n if n else 1) + (k > 0 and before < (budget % n if n else 0))
                before += k
                for epoch in range(times):
                    out[d, source, k, epoch, rank, place] += 1
    return out


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words_in(rng, rng.randint(0, 30))), rng.choice(["a"] * 12 + ["b"] * 4 + ["c", None])) for i in range(300)]
    rows += [(7, rows[7][1], rows[7][2])] * 3 + [(8, "x y", rows[8][2]), (None, "one two", "a"), (None, "one two", "a"), (None, None, "b"), (500, "", "empty"), (-3, "far", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(5) for c in ("tokens", "block", "place", "copies", "budget")})
    for epochs in (4.0, 1.5):
        assert Counter(tuple(r) for r in source_mixing.mix_sources(docs, epochs).collect()) == mixture_of(rows, epochs)


def test_repeated_rows_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "COPIES", 7)
    docs = spark.createDataFrame([(1, "a b", "s")] * 50 + [(2, "c", "s")], "doc_id long, text string, source string")
    got = Counter(tuple(r) for r in source_mixing.mix_sources(docs).collect())
    assert got == mixture_of([(1, "a b", "s")] * 50 + [(2, "c", "s")])


def test_network_scores_are_those_of_its_layers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = language_id.fit(docs, queries.fold() != 0)
    rows = [(i, t) for i, (t,) in enumerate(docs.select("text").limit(30).collect())] + [(100, None), (101, "½ ² ① 12"), (102, "é"), (102, "é"), (None, "ab " * 700_000), (103, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(0)).withColumn("score", F.lit("x"))
    want = Counter()
    for d, t in rows:
        if not any(c.isalpha() for c in t or ""):
            want[d, "und", 0.0] += 1
            continue
        data, total = np.frombuffer(t.encode(), np.uint8), 0
        for a in range(0, min(len(data), 50 * language_id.WINDOW) if d is None else len(data), language_id.WINDOW):
            part = data[a : a + language_id.WINDOW]
            e, act = net.embed[part], []
            for k, w, b in zip(language_id.WIDTHS, net.filters, net.bias, strict=True):
                z = [e[i : i + k].ravel() @ w for i in range(len(part) - k + 1)]
                act.append(np.maximum(np.max(z, 0) + b, 0) if z else np.zeros(language_id.FILTERS))
            z = np.concatenate(act) @ net.out + net.out_bias
            p = np.exp(z - z.max())
            total = total + p / p.sum() * len(part)
        p = total / total.sum()
        want[d, net.labels[p.argmax()], round(float(p.max()), 2 if d is None else 4)] += 1
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 2 if r.doc_id is None else 4)) for r in language_id.predict(odd, net).collect())
    assert got == want
    assert language_id.predict(odd.limit(0), net).count() == 0


def toxic_score(text, model):
    """The score by the definition: n-grams of words with a space before and after, averaged over a window."""
    spelled = "".join(c.lower() for c in text or "").encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", spelled)
    size = model.window_words or max(len(words), 1)
    logits = []
    for at in range(0, max(len(words), 1), size):
        values = []
        for w in words[at : at + size]:
            marked = b" " + w + b" "
            for n in toxicity.GRAMS:
                for i in range(len(marked) - n + 1):
                    h = 0
                    for c in marked[i : i + n]:
                        h = (h * 0x01000193 + c + 1) & 0xFFFFFFFF
                    values.append(float(model.weights[((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - toxicity.BUCKET_BITS)]))
        logits.append((sum(values) / len(values) if values else 0.0) + model.bias)
    return 1 / (1 + math.exp(-min(max(model.slope * max(logits) + model.shift, -40), 40)))


def test_toxicity_scores_are_those_of_the_average(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words_in(rng, rng.randint(1, 90), "abcdeßÉ9,-") + ["Wretchling!"] * (i % 3 == 0))) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    rows += [(200, None), (201, ""), (202, "?!"), (5, "other text"), (5, "other text"), (None, "wretchling " + "abc " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("toxic", F.lit(9))
    for window in (None, 3):
        model = toxicity.fit(docs, labels, window_words=window)
        again = toxicity.fit(docs.repartition(5), labels.repartition(3), window_words=window)
        assert (model.weights == again.weights).all() and model.slope == again.slope
        got = Counter((r.doc_id, round(r.score, 5)) for r in toxicity.score(docs, model).collect())
        assert got == Counter((d, round(toxic_score(t, model), 5)) for d, t in rows)
        assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0 == toxicity.drop_toxic(docs.limit(0), model).count()
    untaught = toxicity.fit(docs, labels.limit(0))
    assert len({r.score for r in toxicity.score(docs, untaught).collect()}) == 1


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks_of(text, items, size=10):
    w, names, hit = words_of(text), set(), set()
    for name, item in items:
        v = words_of(item)
        windows = {tuple(v[i : i + size]) for i in range(max(len(v) - size, 0) + 1)} if v else set()
        n = min(len(v), size)
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                names.add(name)
                hit.update(range(i, i + n))
    return len(w), len(hit), names


def test_leaks(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = words_in(rng, 30, "abé1")
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 9, 10, 11, 40])))) for i in range(15)]
    items += [(None, "zeta eta"), (None, "eta theta"), (3, items[3][1]), (90, "zeta, ETA"), (91, None), (92, " - "), (93, "null")]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _, t in rng.sample(items, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = (t or "").split()[: rng.choice([9, 10, 100])]
        rows.append((i, rng.choice([" ", "-", "\n"]).join(words)))
    rows += [(1, rows[1][1]), (None, "Zeta eta theta null"), (70, None), (71, ""), (72, "q " * 400_000 + "zeta eta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item_id", "items", "hits", "n_words")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    want = Counter()
    for d, t in rows:
        n, hit, names = leaks_of(t, items)
        joined = ",".join(sorted(str(x) for x in names if x is not None))
        want[d, n, hit, len(names), hashlib.sha256(joined.encode()).hexdigest(), hit > 0] += 1
    for part in (1 << 20, 60):
        monkeypatch.setattr(decontaminate, "PART_WINDOWS", part)
        assert Counter(tuple(r) for r in decontaminate.digest(docs, bench).collect()) == want
        kept = decontaminate.drop_leaks(docs, bench)
        assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t) for d, t in rows if not leaks_of(t, items)[1])
    assert decontaminate.digest(docs.limit(0), bench).count() == 0


def test_many_rows_of_one_turn(spark):
    rng = random.Random(5)
    rows = [(1, 0, "user", f"t{i}") for i in range(700)] + [(1, 3, "user", "end"), (2, 0, "user", "x" * 300_000), (2, 0, "user", "x" * 300_000), (2, -1, None, "")]
    rows += [(3, t, "user", f"t{t}") for t in range(300)] + [(4, t, "user", f"t{t}") for t in range(290)] + [(5, 2**40, "a", "b")]
    rng.shuffle(rows)
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("rank", "key", "chunk", "n", "copies")})
    want = Counter()
    for conv in (1, 2, 3, 5):
        turns = sorted({(t, hashlib.md5(f"{len(r or '')}:{r or ''}{x}".encode()).hexdigest(), r or "", x) for c, t, r, x in rows if c == conv})
        for part in range(0, len(turns), chat_format.CHUNK):
            want[conv, len(turns), 1, part // chat_format.CHUNK, "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, _, r, x in turns[part : part + chat_format.CHUNK])] += 1
    assert Counter(tuple(r) for r in chat_format.format_chats(chat).collect()) == want


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 3)
    inf = float("inf")
    rows = [(0, [1.0, 2.0]), (1, []), (2, [0.5]), (3, [1.0, 1.0, 9.0]), (4, [inf, 1.0]), (5, [-inf]), (6, [None, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [0.0, 3.0]), (8, [-1.0, -1.0])]
    fine = [(0, (256, 512)), (1, ()), (2, (128,)), (3, (256, 256, 2304)), (7, (256, 512)), (7, (0, 768)), (8, (-256, -256))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(frame.where("vec_id <> 7 or embedding[0] = 1"), F.lit(True), 3).collect())
    want = Counter()
    fine = [x for x in fine if x != (7, (0, 768))]
    for q, w in fine:
        scored = sorted((-sum(a * b for a, b in zip(w, v)), c) for c, v in fine if c != q)[:3]  # noqa: B905
        want.update((q, k, c, -s) for k, (s, c) in enumerate(scored, 1))
    assert got == want
    twice = topk_search.top_k(frame.where("vec_id in (0, 7)"), F.col("id") == 0).collect()
    assert sorted((r.vec_id, r.score) for r in twice) == [(7, 256 * 256 + 512 * 512), (7, 512 * 768)]


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, k) for k in range(2, 20)], "k long, x long")
    table = spark.createDataFrame([(1, 50)] + [(k, 1) for k in range(2, 15)] + [(99, 1)], "k long, n long")
    for how in ("inner", "left"):
        got = common.spread_join(rows, table, ["k"], "n", how)
        assert Counter(map(tuple, got.select("k", "x", "n").collect())) == Counter(map(tuple, rows.join(table, "k", how).select("k", "x", "n").collect()))


def near_groups(rows, size, percent):
    """The smallest id that links reach, by comparing all pairs."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((group[a], group[b]))
                group = {d: p if g == q else g for d, g in group.items()}
    return group


def test_bucket_with_many_groups(spark, monkeypatch):
    """One large group of near copies, and smaller ones beside it that share its buckets, in grid cells of few members."""
    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    rng = random.Random(6)
    base = words_in(rng, 60)
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 4, 6, 8, 10])):
            words[rng.randrange(60)] = rng.choice(base) + rng.choice("xyz")
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("id", F.lit(1))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 2, 80, bands=32, rows=2).collect()}
    want = near_groups(rows, 2, 80)
    assert got == want and 2 < len(set(want.values())) < 60


def test_buckets_of_one_centre_meet_once(spark, monkeypatch):
    """Near copies that share most bands meet once for each centre, and not once for each band."""
    rng = random.Random(8)
    base, rows = words_in(rng, 80), []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([1, 2, 9, 11])):
            words[rng.randrange(80)] = rng.choice(base) + rng.choice("xyz")
        rows.append((i, " ".join(words)))
    made, promising = [], near_dedup._promising_members
    monkeypatch.setattr(near_dedup, "_promising_members", lambda left, *a: made.append(left.count()) or promising(left, *a))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, bands=32, rows=1).collect()}
    want = near_groups(rows, 2, 80)
    assert got == want and 2 < len(set(want.values())) < 90
    assert 90 <= made[0] < 32 * 90 / 2


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = words_in(rng, 400)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    bench = [(i, text(14)) for i in range(5)] + [(9, None), (None, text(12))]
    rows = []
    for i in range(160):
        t = text(rng.randint(20, 90))
        if i % 8 == 1:
            t += " grubfoul snotbag wretchling"
        if i % 11 == 2:
            t += " " + rng.choice(bench[:5])[1]
        if i % 13 == 3:
            t += " " + rng.choice(SECRETS)
        if i % 6 == 4 and rows:
            t = rng.choice(rows)[1].upper()
        rows.append((i, t, "en", rng.choice("aaab"), len(t)))
    rows += [(300, None, None, None, None), (301, "", "en", "c", 0), (None, text(40), "en", "a", 1), (None, "same", "en", "a", 1), (None, "same", "en", "a", 1), (5, rows[5][1], "en", "b", 1)]
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("row", "kept_id", "score", "id", "slot")}).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int("grubfoul" in rows[i][1].lower())) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    def held(frame):
        return [(r.doc_id, r.text, r.source) for r in frame.collect()]

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), window_words=toxicity.WORST_WINDOW)
    now, docs = held(docs), common.stage(steps["toxicity"](spark, docs, sf), "test")
    now = [r for r in now if toxic_score(r[1], model) < 0.5]
    assert Counter(held(docs)) == Counter(now) and docs.columns == columns
    assert all("grubfoul" not in (t or "").lower() for _, t, _ in now) and len(now) > 120
    docs = common.stage(steps["minhash_near_dedup"](spark, docs, sf), "test")
    group = near_groups([r[:2] for r in now if r[0] is not None], 5, 80)
    assert sorted(d for d, _, _ in held(docs) if d is not None) == sorted(d for d, g in group.items() if d == g) and docs.columns == columns
    assert sum(d is None for d, _, _ in held(docs)) == 3 and len(set(group.values())) < len(group)
    now, docs = held(docs), common.stage(steps["benchmark_decontamination"](spark, docs, sf), "test")
    clean = [r for r in now if not leaks_of(r[1], bench)[1]]
    assert Counter(held(docs)) == Counter(clean) and len(clean) < len(now) and docs.columns == columns
    docs = common.stage(steps["secret_scans"](spark, docs, sf), "test")

    def redacted(t):
        out, at = "", 0
        for a, _, b in secrets_of(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        return t and out + t[at:]

    assert Counter(held(docs)) == Counter((d, redacted(t), s) for d, t, s in clean) and docs.columns == columns
    assert any("[SECRET]" in (t or "") for _, t, _ in held(docs))
    now = held(docs)
    got = [(r.doc_id, r.source, r.text, r.tokens, r.epoch) for r in steps["source_mixing"](spark, docs, sf).collect()]
    assert {x[:3] for x in got} == {(d, s, t) for d, t, s in now}
    times, sizes = Counter((d, s, t) for d, s, t, _, _ in got), Counter()
    for d, t, s in now:
        sizes[s] += len((t or "").split())
        assert times[d, s, t] >= 1
    for source in sizes:
        mine = [x for x in got if x[1] == source]
        assert sum(x[3] for x in mine) >= sizes[source] and max(x[4] for x in mine) < 5
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for step in steps.values():
        assert step(spark, empty, sf).count() == 0



def test_bytes_of_a_batch(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("64m", 8 << 20), ("4m", 4 << 20), ("5000b", 5000), ("1g", 8 << 20)):
            spark.conf.set(key, given)
            common.bounded(spark.range(1))
            got = spark.conf.get(key)
            assert got == (given if want != 8 << 20 else str(want))
    finally:
        spark.conf.set(key, before)
